"""Number expressions. Every one keeps missing as missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def finite(x) -> Column:
    """NaN and the infinities become null; done once, at the scan."""
    v = _c(x).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def safe_div(a, b) -> Column:
    """``a / b``; null on a missing or zero divisor."""
    return F.try_divide(_c(a), _c(b))


def growth(now, before) -> Column:
    """``now / before - 1``; null on a missing or zero base."""
    return safe_div(now, before) - 1.0


def cagr(first, last, years) -> Column:
    """Compound growth, only where both ends are positive and time has passed."""
    f, l, y = _c(first), _c(last), _c(years)
    return F.when((f > 0) & (l > 0) & (y > 0), F.pow(l / f, F.lit(1.0) / y) - 1.0)


def clip(x, lo, hi) -> Column:
    """Clip that leaves null as null (``least``/``greatest`` alone would not)."""
    v = _c(x)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))


def ladder(steps: list[tuple[Column, object]], default=None) -> Column:
    """First true condition wins; a null condition does not fire."""
    out = None
    for cond, value in steps:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def annualised(rate, years) -> Column:
    """Yearly rate of a loss observed over ``years``: 1 - (1 - r)^(1/y)."""
    r, y = _c(rate), _c(years)
    return F.when((r >= 0) & (r <= 1) & (y > 0), 1.0 - F.pow(1.0 - r, F.lit(1.0) / y))


def let(x: Column, of) -> Column:
    """``of(x)`` with ``x`` evaluated once, however often ``of`` names it."""
    return F.get(F.transform(F.array(x), of), F.lit(0))
