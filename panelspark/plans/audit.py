"""Is a price panel fit for use: splits, cross-source checks, coverage, the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import ladder
from panelspark.operators.asof import asof_forward
from panelspark.operators.intervals import inside_any

# Ratios a split usually has, and the tolerances of the audit.
COMMON_RATIOS = (1.5, 2.0, 3.0, 4.0, 5.0, 7.0, 10.0)
BIG_MOVE, SETTLED, NEAR = 0.40, 0.15, 0.08


def own_rows(panel: DataFrame) -> DataFrame:
    """Own observations with the price before, the prior 20-session volume mean and the next three closes' mean."""
    w = Window.partitionBy("ticker").orderBy("session")                  # one row per session
    o = panel.where(F.col("close").isNotNull())
    after = w.rowsBetween(1, 3)
    return o.withColumns({
        "prior": F.lag("close").over(w), "prior_session": F.lag("session").over(w),
        "volume_multiple": F.try_divide("volume", F.when(F.avg("volume").over(w.rowsBetween(-20, -1)) > 0, F.avg("volume").over(w.rowsBetween(-20, -1)))),
        "later": F.when(F.count("close").over(after) == 3, F.avg("close").over(after)), "seen_on": F.col("session")})


def known_events(own: DataFrame, events: DataFrame) -> DataFrame:
    """Ratio seen at each known event (``ticker, date, ratio``) and what it says."""
    j = asof_forward(events, own, ["ticker"], "date", "session", ["close", "prior", "volume_multiple"])
    seen = F.when((F.col("close") > 0) & (F.col("prior") > 0), F.col("prior") / F.col("close"))
    j = j.withColumn("ratio_seen", seen)
    v = ladder([(F.col("ratio_seen").isNull(), "no_data"), (F.abs(F.col("ratio_seen") - 1.0) < 0.10, "adjusted"),
                (F.abs(F.col("ratio_seen") / F.col("ratio") - 1.0) < 0.12, "unadjusted")], "ambiguous")
    return j.select("ticker", "date", F.col("ratio").alias("ratio_known"), "ratio_seen", F.when(F.col("ratio_seen").isNotNull(), F.col("volume_multiple")).alias("volume_multiple"), v.alias("verdict"))


def near_common(r: Column) -> Column:
    one = lambda c: (F.abs(r / c - 1.0) < NEAR) | (F.abs(r * c - 1.0) < NEAR)
    return F.exists(F.array(*[F.lit(c) for c in COMMON_RATIOS]), one)


def sweep(own: DataFrame, cal: DataFrame, known: DataFrame) -> DataFrame:
    """One-session moves past 40% that settle and sit near a common ratio; known events left out.

    The move is between neighbouring panel sessions; what follows are the name's own.
    """
    idx = cal.select(F.col("session").alias("prior_session"), (F.col("s_idx") + 1).alias("s_idx"))
    o = own.join(F.broadcast(cal), "session").join(F.broadcast(idx), ["prior_session", "s_idx"])        # one row per session
    r = F.col("prior") / F.col("close")
    o = o.where((F.col("close") > 0) & (F.col("prior") > 0) & (F.abs(F.col("close") / F.col("prior") - 1.0) > BIG_MOVE)
                & F.col("later").isNotNull() & (F.abs(F.col("later") / F.col("close") - 1.0) <= SETTLED) & near_common(r))
    o = o.select("ticker", F.col("session").alias("date"), F.lit(None).cast("double").alias("ratio_known"), r.alias("ratio_seen"), "volume_multiple", F.lit("candidate").alias("verdict"))
    return o.join(known.select("ticker", "date"), ["ticker", "date"], "left_anti").select(*known.columns)


def dataset_verdict(findings: DataFrame) -> DataFrame:
    """Unanimous, mixed or unknown, over the known events that could be read."""
    k = findings.where(F.col("ratio_known").isNotNull() & F.col("verdict").isin("adjusted", "unadjusted", "ambiguous"))
    kinds = F.sort_array(F.collect_set("verdict"))                        # three values at most
    return k.agg(kinds.alias("_k")).select(
        F.when(F.size("_k") == 0, "unknown").when(F.array_contains("_k", "ambiguous") | (F.size("_k") > 1), "mixed").otherwise(F.get("_k", F.lit(0))).alias("dataset_verdict"))


def suspects(findings: DataFrame, multiple: float = 2.0) -> DataFrame:
    """A split-like move on ordinary volume."""
    return findings.where((F.col("verdict") == "candidate") & (F.col("volume_multiple").isNull() | (F.col("volume_multiple") < multiple))).select("ticker").distinct()


def adjust_for_splits(panel: DataFrame, findings: DataFrame, fields=("close",), only_known: bool = True) -> DataFrame:
    """History before every unadjusted event is divided by the ratio seen, volume multiplied.

    A session needs the product of the ratios of all later events. Those products are
    made per event from the end backwards and carried to sessions by a forward as-of join.
    """
    e = findings.where((F.col("verdict") == "unadjusted") & F.col("ratio_seen").isNotNull())
    if only_known:
        e = e.where(F.col("ratio_known").isNotNull())
    w = Window.partitionBy("ticker").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)     # a name's few events
    e = e.groupBy("ticker", "date").agg(F.product("ratio_seen").alias("_r")).withColumns({"factor": F.product("_r").over(w), "on": F.col("date")})
    j = asof_forward(panel, e, ["ticker"], "session", "on", ["factor"], strict=True).withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    return j.withColumns({**{f: F.col(f) / F.col("factor") for f in fields}, "volume": F.col("volume") * F.col("factor")})


def cross_check(a: DataFrame, b: DataFrame, median_tol: float = 0.001, max_tol: float = 0.10, min_days: int = 20) -> DataFrame:
    """Two sources of the same names compared by daily return on shared days.

    A name has at most one shared row per session, so its median is over a short list.
    """
    j = a.select("ticker", "session", F.col("close").alias("a")).join(b.select("ticker", "session", F.col("close").alias("b")), ["ticker", "session"])
    j = j.where((F.col("a") > 0) & (F.col("b") > 0))
    w = Window.partitionBy("ticker").orderBy("session")
    d = F.abs((F.col("a") / F.lag("a").over(w) - 1.0) - (F.col("b") / F.lag("b").over(w) - 1.0))
    g = j.withColumn("_d", d).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_overlap"), F.median("_d").alias("_med"), F.max("_d").alias("_max"), F.median(F.col("a") / F.col("b")).alias("_ratio"))
    ok = F.col("n_overlap") >= min_days
    return g.select("ticker", "n_overlap", F.when(ok, F.col("_med")).alias("median_diff"), F.when(ok, F.col("_max")).alias("max_diff"), F.when(ok, F.col("_ratio")).alias("level_ratio"),
                    (ok & (F.col("_med") <= median_tol) & (F.col("_max") <= max_tol)).alias("passed"))


def benchmark_splits(factors: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Split steps of a benchmark's factor rows inside the window."""
    w = Window.partitionBy("ticker").orderBy("factor_date")               # one row per change
    nxt = F.lead("split_factor").over(w)
    f = factors.withColumn("_step", nxt.isNotNull() & (F.col("split_factor") != nxt))
    return f.where(F.col("factor_date").between(lo, hi)).groupBy("ticker").agg(F.count_if("_step").alias("n_splits"))


def thin_tickers(panel: DataFrame, min_sessions: int = 500) -> DataFrame:
    return panel.groupBy("ticker").agg(F.count("close").alias("n_obs")).where(F.col("n_obs") < min_sessions)


def member_counts(panel: DataFrame, spans: DataFrame) -> DataFrame:
    """Panel names that were members on the first and on the last session."""
    ends = F.array(panel.agg(F.min("session")).scalar(), panel.agg(F.max("session")).scalar())
    rows = panel.select("ticker").distinct().select("ticker", F.posexplode(ends).alias("_end", "session"))
    hit = inside_any(rows, spans, "ticker", "session")
    return hit.agg(F.count_if(F.col("_end") == 0).alias("members_first"), F.count_if(F.col("_end") == 1).alias("members_last"))


def gate(findings: DataFrame, checks: DataFrame, bench_splits: DataFrame) -> DataFrame:
    """FAIL on a mixed or unknown verdict, a failed cross-check, or a benchmark split inside the window."""
    v = dataset_verdict(findings)
    bad = checks.agg(F.coalesce(F.bool_or(~F.col("passed")), F.lit(False))).scalar()
    split = bench_splits.agg(F.coalesce(F.bool_or(F.col("n_splits") > 0), F.lit(False))).scalar()
    v = v.withColumns({"any_check_failed": bad, "any_benchmark_split": split})
    fail = F.col("dataset_verdict").isin("mixed", "unknown") | F.col("any_check_failed") | F.col("any_benchmark_split")
    return v.withColumn("gate", F.when(fail, "FAIL").otherwise("PASS"))
