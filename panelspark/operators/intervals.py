"""Interval joins as equi-joins on the nodes of a dyadic tree.

Days (or microseconds) are numbered, and node ``n`` of level ``l`` stands for the numbers from ``n * 2^l`` on, ``2^l`` of
them. A span is the union of at most two nodes a level, those inside it whose parent is not; a point lies in a span
just if one of the span's nodes is among the point's ancestors. So a span of any length has O(log length) rows, a
point one row per level in use, and they meet by equality of key and node: a point is not compared with the spans
of its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from panelspark.operators.asof import asof_backward

DAY_BITS, MICRO_BITS = 22, 62


def number(df: DataFrame, column: str) -> tuple[Column, int]:
    """A date as a day number, a timestamp as microseconds, a whole number as it is; and how many bits may differ."""
    kind = df.schema[column].dataType
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("long"), DAY_BITS
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")), MICRO_BITS
    return F.col(column).cast("long"), MICRO_BITS


def span_nodes(lo: Column, hi: Column, bits: int) -> Column:
    """Array of ``(level, node)`` that make up the numbers lo to hi, both included; empty if hi is less."""
    shift = lambda x, level: F.call_function("shiftright", x, level)
    at_least = lambda x, level: -shift(-x, level)  # noqa: E731      the first node of the level that begins at x or later
    at_most = lambda x, level: shift(x + 1, level) - 1  # noqa: E731      the last one that ends at x or before
    inside = lambda level, node: (node >= at_least(lo, level)) & (node <= at_most(hi, level))

    def of(level):
        ends = F.array_distinct(F.array(at_least(lo, level), at_most(hi, level)))
        kept = F.filter(ends, lambda n: inside(level, n) & ~inside(level + 1, shift(n, F.lit(1))))
        return F.transform(kept, lambda n: F.struct(level.alias("level"), n.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), of))


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Every (row of ``points``, row of ``spans``) of one key with ``start <= at <= end``, both ends included; spans without both ends meet nothing.

    Columns of ``spans`` besides the key are added. A date, timestamp or whole number may be asked, of the same kind as the ends.
    """
    x, bits = number(points, at)
    (lo, _), (hi, _) = number(spans, start), number(spans, end)
    s = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    s = s.select("*", F.explode(span_nodes(lo, hi, bits)).alias("__n")).select(*[F.col(c).alias(f"__s_{c}") if c == key else F.col(c) for c in spans.columns], F.col("__n.level").alias("__l"), F.col("__n.node").alias("__v"))
    used = sorted(r[0] for r in s.select("__l").distinct().collect())           # one row per level in use
    up = F.array(*[F.struct(F.lit(l).alias("level"), F.call_function("shiftright", F.col("__x"), F.lit(l)).alias("node")) for l in used]) if used else F.array().cast("array<struct<level:int,node:bigint>>")
    p = points.withColumn("__x", x).where(F.col("__x").isNotNull()).select(*points.columns, F.explode(up).alias("__p"))
    j = p.join(s, (F.col(key) == F.col(f"__s_{key}")) & (F.col("__p.level") == F.col("__l")) & (F.col("__p.node") == F.col("__v")))
    return j.select(*points.columns, *[c for c in spans.columns if c != key])


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """Drop exact repeats of a span; an open end stays null."""
    return spans.select(key, "start_date", "end_date").distinct()


def in_spans(rows: DataFrame, spans: DataFrame, key: str, day: str, out: str) -> DataFrame:
    """``rows`` with a boolean ``out``: whether ``day`` lies in any span of the key; both ends count, a null end is open.

    Some span holds the day just if the latest end among the spans begun by then is not before it. Spans and rows
    are carried together in one order per key, so a row meets no span and is not multiplied; a row without key or day
    is in none.
    """
    kind = rows.schema[day].dataType
    s = merge_spans(spans, key).where(F.col(key).isNotNull() & F.col("start_date").isNotNull())
    never = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in (key, day)]
    begun = s.select(key, F.col("start_date").cast(kind).alias(day), *never, F.lit(0).alias("__ask"), F.col("end_date").cast(kind).alias("__end"), F.col("end_date").isNull().alias("__open"))
    asks = rows.select(key, day, *[c for c in rows.columns if c not in (key, day)], F.lit(1).alias("__ask"), F.lit(None).cast(kind).alias("__end"), F.lit(False).alias("__open"))
    upto = Window.partitionBy(key).orderBy(day, "__ask").rowsBetween(Window.unboundedPreceding, 0)         # rows of a panel: at most the calendar
    held = F.max("__open").over(upto) | F.coalesce(F.max("__end").over(upto) >= F.col(day), F.lit(False))
    known = F.col(key).isNotNull() & F.col(day).isNotNull()
    return asks.unionByName(begun).withColumn(out, known & held).where("__ask = 1").select(*rows.columns, out)


def inside_any(rows: DataFrame, spans: DataFrame, key: str, day: str) -> DataFrame:
    """Rows whose ``day`` lies in any span of the key; both ends count, a null end is open."""
    return in_spans(rows, spans, key, day, "__in").where("__in").drop("__in")


def alive_on(listings: DataFrame, as_of) -> "F.Column":
    """Listed by the date and not yet gone; an unknown listing date is not listed."""
    day = as_of
    return (F.col("ipo_date").isNotNull() & (F.col("ipo_date") <= day)
            & (F.col("delist_date").isNull() | (F.col("delist_date") > day)))


def alive_on_dates(asks: DataFrame, listings: DataFrame, day: str) -> DataFrame:
    """J11 for many dates: rows of ``asks(ticker, day, ...)`` whose name was listed by the day and not yet gone on it."""
    gone = F.date_sub(F.coalesce("delist_date", F.lit("9999-12-31").cast("date")), 1)
    spans = listings.where(F.col("ipo_date").isNotNull()).select("ticker", F.col("ipo_date").alias("start_date"), gone.alias("end_date")).distinct()
    return inside_any(asks, spans, "ticker", day)


def range_self_join(facts: DataFrame, keys: list[str], long_q: int, short_q: int, lo: int, hi: int) -> DataFrame:
    """Each long-period fact with the short-period fact ending ``lo..hi`` days earlier and filed
    no later; the latest by (filed, adsh) wins.

    A long-period fact first meets the *period ends* of short facts in its band, of which there is one or none as a
    rule, by month slots. For each it then asks what was filed last, by an as-of join over (keys, period end): the
    filings of a period are carried, never paired with the facts that ask.
    """
    a = facts.where(F.col("qtrs") == long_q).select(
        *keys, F.col("ddate").alias("a_ddate"), F.col("value").alias("a_value"),
        F.col("filed").alias("a_filed"), F.col("adsh").alias("a_adsh"))
    b = facts.where(F.col("qtrs") == short_q).select(*keys, F.col("ddate").alias("b_ddate"), F.col("value").alias("b_value"), F.col("filed").alias("b_filed"), F.col("adsh").alias("b_adsh"))
    ends = b.select(*keys, "b_ddate").distinct().withColumn("_m", F.trunc("b_ddate", "month"))
    band = a.select(*keys, "a_ddate").distinct().withColumn("_m", F.explode(F.sequence(
        F.trunc(F.date_sub("a_ddate", hi), "month"), F.trunc(F.date_sub("a_ddate", lo), "month"), F.expr("interval 1 month"))))
    pairs = band.join(ends, keys + ["_m"]).where(F.datediff("a_ddate", "b_ddate").between(lo, hi)).drop("_m")
    asks = a.join(pairs, keys + ["a_ddate"])
    # filings of one day: the greatest (adsh, value) stands for them
    last = b.groupBy(*keys, "b_ddate", "b_filed").agg(F.max(F.struct("b_adsh", "b_value")).alias("_r")).select(*keys, "b_ddate", "b_filed", "_r.*", F.col("b_filed").alias("_f"))
    j = asof_backward(asks, last, keys + ["b_ddate"], "a_filed", "b_filed", ["_f", "b_adsh", "b_value"]).where(F.col("_f").isNotNull()).withColumnRenamed("_f", "b_filed")
    return j.groupBy(*keys, "a_ddate", "a_value", "a_filed", "a_adsh").agg(
        F.max_by(F.struct("b_ddate", "b_value", "b_filed", "b_adsh"),
                 F.struct("b_filed", "b_adsh", "b_ddate", "b_value")).alias("_b")
    ).select(*keys, "a_ddate", "a_value", "a_filed", "a_adsh", "_b.*")
