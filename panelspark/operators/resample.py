"""Bootstrap intervals. Draws come from integer arithmetic, so any engine and any
retry of a task sees the same sample.

The series handed in here are per-date or per-month statistics, one row per period,
so they are short however large the data behind them is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.ranks import join_on, percentile_from_ranks, value_ranks

PRIME = 2147483647
SEED = 20260906


def draw(rep: Column, item: Column, seed: int, modulus: Column) -> Column:
    """A number in [0, modulus) from (rep, item, seed); squares mix the bits, all below 2^63."""
    x = (rep.cast("long") * F.lit(48271) + item.cast("long") * F.lit(69621) + F.lit(seed)) % F.lit(PRIME)
    x = (x * x + F.lit(12345)) % F.lit(PRIME)
    x = (x * x + item.cast("long") * F.lit(16807) + F.lit(1)) % F.lit(PRIME)
    return x % modulus


def draw_sql(rep: str, item: str, seed: int, modulus: str) -> str:
    """The same draw as SQL text."""
    x = f"((CAST({rep} AS BIGINT) * 48271 + CAST({item} AS BIGINT) * 69621 + {seed}) % {PRIME})"
    x = f"(({x} * {x} + 12345) % {PRIME})"
    x = f"(({x} * {x} + CAST({item} AS BIGINT) * 16807 + 1) % {PRIME})"
    return f"({x} % {modulus})"


def _positions(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    v = series.where(F.col(value).isNotNull()).select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v"))
    by = Window.partitionBy(*keys)
    return v.withColumn("_i", (F.row_number().over(by.orderBy("_o")) - 1).cast("long")).withColumn(
        "_n", F.count(F.lit(1)).over(by))


def _interval(draws: DataFrame, keys: list[str], confidence: float, reps: int) -> DataFrame:
    """Order statistics at int(a*(B-1)) and int((1-a)*(B-1)), no interpolation."""
    a = (1.0 - confidence) / 2.0
    lo, hi = int(a * (reps - 1)), int((1.0 - a) * (reps - 1))
    by = Window.partitionBy(*keys)
    r = draws.withColumn("_rn", F.row_number().over(by.orderBy("_stat", "_rep")) - 1)   # B rows per group
    return r.groupBy(*keys).agg(F.max(F.when(F.col("_rn") == lo, F.col("_stat"))).alias("ci_low"),
                                F.max(F.when(F.col("_rn") == hi, F.col("_stat"))).alias("ci_high"))


def bootstrap_ci(series: DataFrame, keys: list[str], order: str, value: str, statistic=None,
                 reps: int = 2000, confidence: float = 0.95, seed: int = SEED) -> DataFrame:
    """Percentile interval of a statistic under independent resampling; null below three values.

    ``statistic`` makes an aggregate column from a column name; the mean by default.
    """
    if not keys:
        whole = series.withColumn("_all", F.lit(0))
        return bootstrap_ci(whole, ["_all"], order, value, statistic, reps, confidence, seed).drop("_all")
    stat = statistic or (lambda c: F.avg(c))
    p = _positions(series, keys, order, value)
    slots = p.where(F.col("_n") >= 3).select(*keys, F.col("_i").alias("_slot"), "_n")
    picks = slots.select(*keys, "_slot", "_n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("_rep"))
    picks = picks.withColumn("_i", draw(F.col("_rep"), F.col("_slot"), seed, F.col("_n")))
    draws = picks.join(p.select(*keys, "_i", "_v"), keys + ["_i"]).groupBy(*keys, "_rep").agg(stat("_v").alias("_stat"))
    return _interval(draws, keys, confidence, reps)


# How likely a Poisson variable of mean one is at most 0, 1, 2 ...
POISSON_ONE = (0.36787944117144233, 0.73575888234288467, 0.91969860292860584, 0.98101184312384626, 0.99634015317265630, 0.99940581518241830, 0.99991675885071200, 0.99998975080332534)


def multiplicity(rep: Column, item: Column, seed: int) -> Column:
    """How often an item is drawn in a replicate: Poisson of mean one, by integer arithmetic."""
    u = draw(rep, item, seed, F.lit(PRIME))
    return sum((F.when(u >= int(p * PRIME), 1).otherwise(0) for p in POISSON_ONE), F.lit(0))


def multiplicity_sql(rep: str, item: str, seed: int) -> str:
    u = draw_sql(rep, item, seed, str(PRIME))
    return "(" + " + ".join(f"CASE WHEN {u} >= {int(p * PRIME)} THEN 1 ELSE 0 END" for p in POISSON_ONE) + ")"


def weighted_bootstrap_ci(rows: DataFrame, keys: list[str], item: str, value: str, statistic: str | float = "mean", reps: int = 2000, confidence: float = 0.95, seed: int = SEED) -> DataFrame:
    """Percentile interval of any order statistic or the mean under Poisson resampling; null below three values.

    ``item`` is a whole number that names a row of its group, ``statistic`` is ``mean`` or a share (0.5: the median).
    A replicate gives each row a weight instead of drawing rows, so nothing is joined: the mean is a map-side sum per
    replicate, and a percentile the weighted order statistic of the replicate's value table. Replicates of a
    small group that draw nothing are left out of the interval.
    """
    if not keys:
        return weighted_bootstrap_ci(rows.withColumn("_all", F.lit(0)), ["_all"], item, value, statistic, reps, confidence, seed).drop("_all")
    v = rows.where(F.col(value).isNotNull()).select(*keys, F.col(item).cast("long").alias("_i"), F.col(value).alias("_v"))
    big = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").drop("_n")
    w = v.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("_rep")).withColumn("_w", multiplicity(F.col("_rep"), F.col("_i"), seed)).where("_w > 0")
    if statistic == "mean":
        draws = w.groupBy(*keys, "_rep").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("_stat"))
    else:
        ranks = value_ranks(w, [*keys, "_rep"], "_v", weight="_w")
        draws = ranks.groupBy(*keys, "_rep").agg(percentile_from_ranks("_v", float(statistic)).alias("_stat"))
    draws = join_on(draws, big, keys)
    a = (1.0 - confidence) / 2.0
    by = Window.partitionBy(*keys)
    r = draws.withColumns({"_rn": F.row_number().over(by.orderBy("_stat", "_rep")) - 1, "_b": F.count(F.lit(1)).over(by)})          # B rows per group
    at = lambda q: F.max(F.when(F.col("_rn") == F.floor(F.lit(q) * (F.col("_b") - 1)), F.col("_stat")))
    return r.groupBy(*keys).agg(at(a).alias("ci_low"), at(1.0 - a).alias("ci_high"))


def block_bootstrap_ci(series: DataFrame, keys: list[str], order: str, value: str, block: Column | int,
                       reps: int = 3000, confidence: float = 0.95, seed: int = SEED) -> DataFrame:
    """Moving-block interval for the mean; blocks from uniform starts, the last one cut to length.

    Sums of a full and of a cut block are made once per start from running sums, so a
    replicate joins n/block rows and not n. ``block`` may be a column of the series.
    """
    if not keys:
        whole = series.withColumn("_all", F.lit(0))
        return block_bootstrap_ci(whole, ["_all"], order, value, block, reps, confidence, seed).drop("_all")
    blk = block if isinstance(block, Column) else F.lit(block)
    withb = series.withColumn("_blk", blk)
    p = _positions(withb, keys, order, value)
    sizes = withb.groupBy(*keys).agg(F.max("_blk").alias("_blk"))
    p = p.join(sizes, keys)
    p = p.where(F.col("_n") >= 3).withColumn("_blk", F.greatest(F.lit(1), F.least(F.col("_blk"), F.col("_n"))).cast("long"))
    p = p.withColumn("_cut", F.col("_n") % F.col("_blk"))
    # a block's sum is a difference of two running sums, met by equi-joins on the start of the block
    running = F.sum("_v").over(Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    c = p.withColumn("_cum", running)

    def ends(length: str, out: str) -> DataFrame:
        return c.where(F.col(length) > 0).select(*keys, (F.col("_i") - F.col(length) + 1).alias("_start"), F.col("_cum").alias(out)).where("_start >= 0")

    starts = c.select(*keys, F.col("_i").alias("_start"), (F.col("_cum") - F.col("_v")).alias("_before")).join(ends("_blk", "_upto"), keys + ["_start"]).join(ends("_cut", "_short"), keys + ["_start"], "left")
    starts = starts.select(*keys, "_start", (F.col("_upto") - F.col("_before")).alias("_full"), (F.col("_short") - F.col("_before")).alias("_part"))
    n_blocks = F.ceil(F.col("_n") / F.col("_blk")).cast("long")
    plan = c.where("_i = 0").select(*keys, "_n", "_blk", "_cut", n_blocks.alias("_k"),
                      F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("_rep"))
    plan = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_j"))
    plan = plan.withColumn("_start", draw(F.col("_rep"), F.col("_j"), seed, F.col("_n") - F.col("_blk") + 1))
    got = plan.join(starts, keys + ["_start"])
    last_cut = (F.col("_j") == F.col("_k") - 1) & (F.col("_cut") > 0)
    draws = got.groupBy(*keys, "_rep").agg(
        (F.sum(F.when(last_cut, F.col("_part")).otherwise(F.col("_full"))) / F.max("_n")).alias("_stat"))
    return _interval(draws, keys, confidence, reps)
