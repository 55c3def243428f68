"""Summary aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import safe_div
from panelspark.operators.ranks import join_on, percentile_from_ranks, value_ranks_at
from panelspark.session import cut_lineage


def describe(df: DataFrame, keys: list[str], value: str, qs: dict[str, float] | None = None) -> DataFrame:
    """A5: n, mean, both deviations, exact median and percentiles, scaled MAD, one-sample t.

    Moments are plain aggregates; order statistics come from counts per value bucket and the rows of
    the buckets they lie in, so no group is collected and no value table is built.
    """
    df = cut_lineage(df.select(*keys, value))                # read five times
    plain = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).alias("sd"), F.stddev_pop(value).alias("sd_pop"))
    r = value_ranks_at(df, keys, value, [0.5, *(qs or {}).values()])
    # written, so that its size is known and the rows are not dealt by group to meet it
    order = cut_lineage(r.groupBy(*keys).agg(percentile_from_ranks(value, 0.5).alias("median"),
                                             *[percentile_from_ranks(value, q).alias(c) for c, q in (qs or {}).items()]))
    dev = join_on(df, order.select(*keys, "median"), keys, "left").withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mad = value_ranks_at(dev, keys, "_d", [0.5]).groupBy(*keys).agg(
        F.when(F.max("n") > 1, percentile_from_ranks("_d", 0.5) * 1.4826).alias("mad"))
    out = join_on(join_on(plain, order, keys, "left"), mad, keys, "left")
    return out.withColumn("t", safe_div("mean", F.col("sd") / F.sqrt(F.col("n").cast("double"))))


def curve_stats(curve: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Last value per month and the maximum drawdown of a value series."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    dd = curve.withColumn("_dd", safe_div(value, F.max(value).over(w)) - 1.0)
    monthly = dd.groupBy(key, F.date_format(day, "yyyy-MM").alias("month")).agg(
        F.max_by(value, day).alias("month_value"), F.min("_dd").alias("_low"))
    return monthly.select(key, "month", "month_value",
                          F.min("_low").over(Window.partitionBy(key)).alias("max_drawdown"))
