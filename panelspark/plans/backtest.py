"""Measuring a score against forward returns, date by date."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import ladder, safe_div
from panelspark.operators.describe import describe
from panelspark.operators.ranks import rank_columns, safe_corr, spearman
from panelspark.operators.resample import SEED, block_bootstrap_ci
from panelspark.session import cut_lineage

# Thresholds of the measurement.
MIN_NAMES = 20
SUSPICIOUS_IC = 0.25
NEEDED_SIGMAS = 1.959963985 + 0.8416212336


def ranked(rb: DataFrame) -> DataFrame:
    """Rows with a score and a return on dates with enough names, with both within-date percentiles.

    Every statistic below starts here, so it is written once.
    """
    have = rb.where(F.col("score").isNotNull() & F.col("fwd_ret").isNotNull())
    r = rank_columns(have, ["date", "ticker"], ["date"], {"p_score": "score", "p_ret": "fwd_ret"})
    sizes = have.groupBy("date").agg(F.count(F.lit(1)).alias("n_names"))
    return cut_lineage(r.join(sizes, "date"))


def ic_series(rk: DataFrame) -> DataFrame:
    """Rank correlation per date; null under 20 names, the count always there."""
    flat = (F.min("p_score") == F.max("p_score")) | (F.min("p_ret") == F.max("p_ret"))
    return rk.groupBy("date", "n_names").agg(
        F.when((F.col("n_names") >= MIN_NAMES) & ~flat, safe_corr("p_score", "p_ret")).alias("ic")).withColumnRenamed("n_names", "n")


def missing_census(rb: DataFrame) -> DataFrame:
    """Names scored without a return, counted per date and listed one per row."""
    gone = F.col("fwd_ret").isNull() & F.col("score").isNotNull()
    return rb.groupBy("date").agg(F.count("score").alias("n_scored"), F.count_if(gone).alias("n_missing"))


def missing_names(rb: DataFrame) -> DataFrame:
    return rb.where(F.col("fwd_ret").isNull() & F.col("score").isNotNull()).select("date", "ticker", "score")


def quintiles(rk: DataFrame, n: int = 5) -> DataFrame:
    """Within-date buckets, pooled returns."""
    b = rk.where(F.col("n_names") >= MIN_NAMES).withColumn(
        "bucket", F.least(F.floor(F.col("p_score") * n), F.lit(n - 1)).cast("int"))
    stats = describe(b, ["bucket"], "fwd_ret").select("bucket", "n", F.col("mean").alias("mean_ret"), F.col("median").alias("median_ret"), "sd")
    more = b.groupBy("bucket").agg(F.count_distinct("date").alias("n_dates"),
                                   (F.count_if(F.col("fwd_ret") > 0) / F.count(F.lit(1))).alias("hit_rate"))
    return stats.join(more, "bucket")


def spread_series(rk: DataFrame) -> DataFrame:
    """A10: per date, mean return at p >= 0.8 minus mean return at p < 0.2."""
    hi = F.avg(F.when(F.col("p_score") >= 0.8, F.col("fwd_ret")))
    lo = F.avg(F.when(F.col("p_score") < 0.2, F.col("fwd_ret")))
    return rk.where(F.col("n_names") >= MIN_NAMES).groupBy("date").agg((hi - lo).alias("spread"))


def group_ic(rk: DataFrame, group: Column) -> DataFrame:
    """Percentiles pooled over dates within a group, then one rank correlation.

    ``group`` is a string or an array of strings; a name may be in several groups.
    """
    g = rk.where(F.col("n_names") >= MIN_NAMES).withColumn("_g", group)
    if g.schema["_g"].dataType.typeName() == "array":
        g = g.withColumn("grp", F.explode("_g"))
    else:
        g = g.withColumn("grp", F.col("_g"))
    return spearman(g.where(F.col("grp").isNotNull()).drop("_g"), ["grp"], "p_score", "p_ret")


def bucket_labels(buckets: str = "buckets") -> Column:
    return F.when(F.size(buckets) > 0, F.col(buckets)).otherwise(F.array(F.lit("unbucketed")))


def ic_verdict(lo: Column, hi: Column, n_eff: Column, t_eff: Column, k: int) -> Column:
    """A18, for an IC: interval first, then the number of independent periods, then multiplicity."""
    needed = 1.96 + 0.5 * math.log(max(k, 1))
    return ladder([
        (lo.isNull() | hi.isNull(), "no evidence"),
        ((lo <= 0) & (hi >= 0), "no evidence"),
        (n_eff < 12, "weak"), (n_eff < 20, "suggestive"),
        (F.lit(k > 1) & (F.abs(t_eff) < needed), "suggestive"),
    ], "supported")


def excess_verdict(mean: Column, lo: Column, hi: Column, t: Column, n_eff: Column, k: Column | int) -> Column:
    """A18, for a mean excess: an interval wholly below zero is the wrong way."""
    k = k if isinstance(k, Column) else F.lit(k)
    needed = 1.96 + 0.5 * F.ln(F.greatest(k, F.lit(1)).cast("double"))
    return ladder([
        (mean.isNull() | lo.isNull(), "no evidence"),
        ((lo <= 0) & (hi >= 0), "no evidence"),
        (hi < 0, "wrong way"), (n_eff < 12, "weak"), (n_eff < 20, "suggestive"),
        ((k > 1) & t.isNotNull() & (F.abs(t) < needed), "suggestive"),
    ], "supported")


def summary(rb: DataFrame, horizon: int, spacing: int, k: int = 1, limitations: list[str] | None = None,
            reps: int = 3000, rk: DataFrame | None = None) -> DataFrame:
    """One row that carries its own caveats."""
    if not limitations:
        raise ValueError("a backtest result needs its limitations")
    rk = rk if rk is not None else ranked(rb)
    ic = cut_lineage(ic_series(rk))
    overlap = max(1.0, horizon / max(spacing, 1))
    block = int(math.ceil(overlap))
    tag = lambda d: d.withColumn("_w", F.lit(1))
    stats = describe(tag(ic.where(F.col("ic").isNotNull())), ["_w"], "ic")
    hits = tag(ic).groupBy("_w").agg(
        F.count(F.lit(1)).alias("n_rebalances"), F.min("n").alias("min_names"),
        safe_div(F.count_if(F.col("ic") > 0).cast("double"), F.count("ic")).alias("hit_rate"))
    ci = block_bootstrap_ci(tag(ic), ["_w"], "date", "ic", block, reps=reps)
    sp = tag(spread_series(rk))
    spread_ci = block_bootstrap_ci(sp, ["_w"], "date", "spread", block, reps=reps, seed=SEED + 1).select(
        "_w", F.col("ci_low").alias("spread_low"), F.col("ci_high").alias("spread_high"))
    q = quintiles(rk).withColumn("_w", F.lit(1)).groupBy("_w").agg(
        (F.max(F.when(F.col("bucket") == 4, F.col("mean_ret"))) - F.max(F.when(F.col("bucket") == 0, F.col("mean_ret")))).alias("long_short"))
    j = hits.join(stats, "_w", "left").join(ci, "_w", "left").join(spread_ci, "_w", "left").join(q, "_w", "left")
    n_eff, t_eff = F.col("n") / F.lit(overlap), F.col("t") / F.lit(math.sqrt(overlap))
    j = j.withColumns({"effective_n": n_eff, "effective_t": t_eff})
    se = F.lit(1.0) / F.sqrt(F.col("n").cast("double") * (F.col("min_names") - 1))
    flags = F.array_compact(F.array(
        F.when(F.abs("mean") > SUSPICIOUS_IC, "suspiciously large mean IC"),
        F.when(F.col("n") < 3, "fewer than three scored rebalances"),
        F.when(F.col("min_names") < MIN_NAMES, "a date had too few names and was skipped")))
    return j.select(
        "n_rebalances", F.col("n").alias("n_scored"), "effective_n", F.col("mean").alias("mean_ic"), F.col("median").alias("median_ic"),
        F.col("sd").alias("ic_sd"), F.col("t").alias("ic_t"), "effective_t", "hit_rate", "ci_low", "ci_high", "long_short", "spread_low", "spread_high",
        ic_verdict(F.col("ci_low"), F.col("ci_high"), F.col("effective_n"), F.col("effective_t"), k).alias("verdict"),
        (se * NEEDED_SIGMAS).alias("detectable_ic"), flags.alias("flags"),
        F.array(*[F.lit(x) for x in limitations]).alias("limitations"))


def worst_dates(ic: DataFrame, n: int = 5) -> DataFrame:
    """The lowest ICs."""
    return ic.where(F.col("ic").isNotNull()).orderBy("ic", "date").limit(n)


def failure_modes(rk: DataFrame, ic: DataFrame) -> DataFrame:
    """Where the score went the wrong way, one row per finding."""
    sec = group_ic(rk, F.col("sector")).where((F.col("rho") < 0) & (F.col("n") >= 30)).select(
        F.lit("negative sector").alias("kind"), F.col("grp").alias("what"), F.col("rho").alias("value"))
    buc = group_ic(rk, bucket_labels()).where((F.col("rho") < 0) & (F.col("n") >= 30)).select(
        F.lit("negative bucket").alias("kind"), F.col("grp").alias("what"), F.col("rho").alias("value"))
    bad = worst_dates(ic, 3).select(F.lit("worst date").alias("kind"), F.col("date").cast("string").alias("what"), F.col("ic").alias("value"))
    q = cut_lineage(quintiles(rk).select("bucket", "mean_ret"))
    nxt = q.select((F.col("bucket") - 1).alias("bucket"), F.col("mean_ret").alias("up"))
    mono = q.join(nxt, "bucket").where(F.col("up") < F.col("mean_ret")).select(
        F.lit("not monotonic").alias("kind"), F.concat(F.lit("Q"), F.col("bucket") + 1).alias("what"), (F.col("up") - F.col("mean_ret")).alias("value"))
    ends = q.where("bucket in (0, 4)").groupBy().agg(
        (F.max(F.when(F.col("bucket") == 4, F.col("mean_ret"))) - F.max(F.when(F.col("bucket") == 0, F.col("mean_ret")))).alias("value"))
    ends = ends.where("value <= 0").select(F.lit("top did not beat bottom").alias("kind"), F.lit("Q5-Q1").alias("what"), "value")
    return sec.unionByName(buc).unionByName(bad).unionByName(mono).unionByName(ends)


def detectable(n_names: Column, k: Column) -> Column:
    """Smallest true IC seen with 80% power at 5%."""
    return F.when((n_names >= 3) & (k >= 1), NEEDED_SIGMAS / F.sqrt(k * (n_names - 1).cast("double")))


def periods_needed(true_ic: float, n_names: Column, cap: int = 200) -> Column:
    """The least number of periods that makes ``true_ic`` detectable; null beyond ``cap``."""
    if true_ic <= 0:
        return F.lit(None).cast("int")
    k = F.ceil(F.pow(F.lit(NEEDED_SIGMAS / true_ic), 2.0) / (n_names - 1)).cast("int")
    return F.when((n_names >= 3) & (k <= cap), F.greatest(k, F.lit(1)))
