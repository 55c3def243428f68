"""As-of joins by union-and-carry.

The distinct (key, point) pairs of the left side are resolved, then joined back, so
a key with many probes is not gathered: its points are few, and the join back is an
equi-join that AQE can split. Both sides are one row per (key, point) by then. Where
points are dates, a key has at most one row per calendar day and a single window by
key carries the value. Where points are timestamps, a key's history has no such
bound: time is cut into slots, and the value carried into a slot comes from a table
with one row per (key, slot), so a long history is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from panelspark.operators.ranks import join_on


def _slot(x: Column, grain: str) -> Column:
    return F.date_trunc(grain, x)


def _resolve(points: DataFrame, right: DataFrame, by: list[str], grain: str, forward: bool,
             strict: bool) -> DataFrame:
    """``by, _pt, _hit``: for each point the struct of right values nearest on the wanted side."""
    pick = F.min_by if forward else F.max_by
    r = right.withColumn("_slot", _slot(F.col("_pt"), grain))
    p = points.withColumn("_slot", _slot(F.col("_pt"), grain))

    # one row per (key, slot): the value a neighbouring slot would carry in
    edge = r.groupBy(*by, "_slot").agg(pick("_val", "_pt").alias("_edge"))
    slots = p.select(*by, "_slot").distinct().withColumn("_edge", F.lit(None).cast(right.schema["_val"].dataType))
    order = F.desc("_slot") if forward else F.asc("_slot")
    both = edge.withColumn("_p", F.lit(False)).unionByName(slots.withColumn("_p", F.lit(True)))
    both = both.groupBy(*by, "_slot").agg(F.max("_p").alias("_p"), F.first("_edge", ignorenulls=True).alias("_edge"))
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = (both.withColumn("_in", F.last("_edge", ignorenulls=True).over(before))
               .where(F.col("_p")).select(*by, "_slot", "_in"))

    # inside a slot: right rows and points in one order, the last right value is carried
    rank_right = 0 if not strict else 1
    rows = r.select(*by, "_slot", "_pt", "_val", F.lit(rank_right).alias("_side"), F.lit(False).alias("_p"))
    asks = p.select(*by, "_slot", "_pt", F.lit(None).cast(right.schema["_val"].dataType).alias("_val"),
                    F.lit(1 - rank_right).alias("_side"), F.lit(True).alias("_p"))
    o = [F.desc("_pt") if forward else F.asc("_pt"), F.asc("_side")]
    inside = Window.partitionBy(*by, "_slot").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    near = (rows.unionByName(asks).withColumn("_near", F.last("_val", ignorenulls=True).over(inside))
            .where(F.col("_p")).select(*by, "_slot", "_pt", "_near"))
    return join_on(near, carried, by + ["_slot"], "left").select(
        *by, "_pt", F.coalesce("_near", "_in").alias("_hit"))


def _resolve_days(points: DataFrame, right: DataFrame, by: list[str], forward: bool, strict: bool, ties: bool = False) -> DataFrame:
    """As ``_resolve`` where a key has at most one row per day on either side; with ``ties`` the greatest of more is taken."""
    rank_right = 1 if strict else 0
    rows = right.select(*by, "_pt", "_val", F.lit(rank_right).alias("_side"))
    asks = points.select(*by, "_pt", F.lit(None).cast(right.schema["_val"].dataType).alias("_val"),
                         F.lit(1 - rank_right).alias("_side"))
    o = [F.desc("_pt") if forward else F.asc("_pt"), F.asc("_side"), *([F.asc("_val")] if ties else [])]
    w = Window.partitionBy(*by).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.unionByName(asks).withColumn("_hit", F.last("_val", ignorenulls=True).over(w))
    return carried.where(F.col("_side") == 1 - rank_right).select(*by, "_pt", "_hit")


def _asof(left, right, by, left_on, right_on, values, grain, forward, strict, unique=False):
    days = isinstance(left.schema[left_on].dataType, DateType) and isinstance(right.schema[right_on].dataType, DateType)
    at = "date" if days else "timestamp"
    r = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).cast(at).alias("_pt"), F.struct(*values).alias("_val"))
    # one right row per point: ties are resolved by the whole value, the greatest wins; a struct would be aggregated by a sort
    best = F.struct(F.max(F.col("_val")[values[0]]).alias(values[0])) if len(values) == 1 else F.max("_val")
    if not (unique and days):
        r = r.groupBy(*by, "_pt").agg(best.alias("_val"))
    points = left.where(F.col(left_on).isNotNull()).select(*by, F.col(left_on).cast(at).alias("_pt")).distinct()
    if days:
        hits = _resolve_days(points, r, by, forward, strict, unique)
    else:
        hits = _resolve(points, r, by, grain, forward, strict)
    tagged = left.withColumn("_pt", F.col(left_on).cast(at))
    # a history that all rows share has a point per day, any other one per name and day
    return join_on(tagged, hits, by + ["_pt"], "left", long=by != ["_all"]).select(
        *left.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str,
                  values: list[str], grain: str = "day", strict: bool = False) -> DataFrame:
    """The right row at or before (``strict``: before) each left point."""
    return _asof(left, right, by, left_on, right_on, values, grain, False, strict)


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str,
                 values: list[str], grain: str = "day", strict: bool = False, unique: bool = False) -> DataFrame:
    """The right row at or after (``strict``: after) each left point.

    ``unique``: the right side is known to have a row per key and day, or few, so it is not gathered by them first.
    """
    return _asof(left, right, by, left_on, right_on, values, grain, True, strict, unique)


def factor_on(bars: DataFrame, factors: DataFrame, values: list[str]) -> DataFrame:
    """The first factor row dated at or after the bar; past the end the last row holds."""
    j = asof_forward(bars, factors, ["ticker"], "session", "factor_date", values)
    last = factors.groupBy("ticker").agg(*[F.max_by(v, "factor_date").alias(f"_l_{v}") for v in values])
    out = join_on(j, last, ["ticker"], "left")
    return out.select(*bars.columns, *[F.coalesce(v, f"_l_{v}").alias(v) for v in values])


def known_on(facts: DataFrame, keys: list[str], on: Column, order: list[str], value: str = "value",
             filed: str = "filed") -> DataFrame:
    """J8 for one knowledge date: per key the fact filed by then, latest by ``order``."""
    return facts.where(F.col(filed) <= on).groupBy(*keys).agg(
        F.max_by(F.struct(value, filed, *[o for o in order if o not in (value, filed)]), F.struct(*order)).alias("_f")
    ).select(*keys, "_f.*")


def known_on_many(facts: DataFrame, asks: DataFrame, keys: list[str], on: str, order: list[str],
                  values: list[str], filed: str = "filed") -> DataFrame:
    """J8 for many knowledge dates: per (keys, on) the fact filed by then, latest by ``order``.

    The running maximum of (order..., values...) in filing order is itself a value
    that can be carried, so this is an as-of join over a per-key running maximum.
    Facts are first reduced to one row per (keys, filed).
    """
    rec = F.struct(*order, *[v for v in values if v not in order])
    per = facts.groupBy(*keys, filed).agg(F.max(rec).alias("_rec"))
    w = Window.partitionBy(*keys).orderBy(filed).rowsBetween(Window.unboundedPreceding, 0)
    best = per.withColumn("_rec", F.max("_rec").over(w))
    out = asof_backward(asks, best, keys, on, filed, ["_rec"])
    return out.select(*asks.columns, *[F.col(f"_rec.{v}").alias(v) for v in values])
