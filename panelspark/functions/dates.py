"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def compact_date(x) -> Column:
    """``yyyyMMdd`` text to a date; anything else is null."""
    s = _c(x).cast("string")
    return F.when(s.rlike("^[0-9]{8}$"), F.try_to_date(s, "yyyyMMdd"))


def years_back(day, n) -> Column:
    """The same day ``n`` years earlier; 29 February becomes the 28th."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.add_months(_c(day), -12 * n)


def weekdays_between(start, end) -> Column:
    """Weekdays after ``start`` up to and including ``end``."""
    s, e = _c(start), _c(end)
    days = F.sequence(F.date_add(s, 1), e)
    return F.when(e > s, F.size(F.filter(days, lambda d: ~F.dayofweek(d).isin(1, 7)))).otherwise(F.lit(0))


def session_date(ts, zone: str = "America/New_York") -> Column:
    """The exchange-local date of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(_c(ts), zone))


# Feed date layouts, tried in this order.
FEED_DATE_LAYOUTS = (
    "EEE, dd MMM yyyy HH:mm:ss Z",
    "EEE, dd MMM yyyy HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd",
)


def feed_timestamp(x) -> Column:
    """A feed date in any of the four layouts; the weekday name is not checked."""
    s = F.regexp_replace(F.trim(_c(x)), " (GMT|UTC)$", " +0000")
    bare = F.regexp_replace(s, "^[A-Za-z]{3}, ", "")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
    )
