"""Grading of a dated call log against prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import growth, ladder
from panelspark.functions.text import call_kind, price_trigger
from panelspark.operators.asof import asof_backward, asof_forward
from panelspark.operators.ranks import spearman
from panelspark.session import cut_lineage

# Sessions after a call that are always graded, and the floors of the readout.
SWING_WINDOWS = (5, 10, 20)
FLOORS = {"usable": 20, "dates": 4, "sessions": 63}


def score_at_call(calls: DataFrame, snapshots: DataFrame, date: str, value: str) -> DataFrame:
    """The score in the last snapshot on or before the call, never after it.

    The snapshot is chosen first, over all names; a name missing from it has no score.
    """
    dates = snapshots.select("snapshot").distinct().withColumns({"_all": F.lit(1), "_on": F.col("snapshot")})
    picked = asof_backward(calls.withColumn("_all", F.lit(1)), dates, ["_all"], date, "_on", ["snapshot"]).drop("_all")
    return picked.join(snapshots.select("snapshot", "ticker", value), ["snapshot", "ticker"], "left")


def latest_calls(calls: DataFrame) -> DataFrame:
    """The latest call per ticker; on one date the later one in the log."""
    cols = [c for c in calls.columns if c != "ticker"]
    return calls.groupBy("ticker").agg(F.max_by(F.struct(*cols), F.struct("date", "pos")).alias("_c")).select("ticker", "_c.*")


def low_since(calls: DataFrame, prices: DataFrame, as_of: str) -> DataFrame:
    """Lowest close in (call, as_of], from a running minimum read at the first session after the call."""
    p = prices.where(F.col("close").isNotNull() & (F.col("session") <= F.lit(as_of).cast("date")))
    w = Window.partitionBy("ticker").orderBy(F.desc("session")).rowsBetween(Window.unboundedPreceding, 0)   # one row per session
    p = p.select("ticker", "session", F.min("close").over(w).alias("low_since_call"))
    return asof_forward(calls, p, ["ticker"], "date", "session", ["low_since_call"], strict=True)


def sessions_upto(rows: DataFrame, cal: DataFrame, day: str, out: str) -> DataFrame:
    """How many calendar sessions lie on or before ``day``."""
    c = cal.select(F.lit(1).alias("_all"), "session", (F.col("s_idx") + 1).alias(out))
    j = asof_backward(rows.withColumn("_all", F.lit(1)), c, ["_all"], day, "session", [out]).drop("_all")
    return j.withColumn(out, F.coalesce(out, F.lit(0)))


def grade(calls: DataFrame, prices: DataFrame, bench: DataFrame, as_of: str, snapshots: DataFrame | None = None) -> DataFrame:
    """One grade per call; a call that cannot be graded keeps its row and says why."""
    from panelspark.operators.panel import calendar
    day = F.lit(as_of).cast("date")
    cal = calendar(prices)
    c = calls.withColumns({"kind": call_kind("action"), "trigger": price_trigger("wrong_if")})
    if snapshots is not None:
        c = score_at_call(c, snapshots, "date", "score_percentile")
    per = prices.where(F.col("close").isNotNull()).groupBy("ticker").agg(
        F.max_by("close", F.when(F.col("session") <= day, F.col("session"))).alias("price_now"), F.max("session").alias("_last"), F.lit(True).alias("_col"))
    b = bench.select(F.lit(1).alias("_all"), "session", F.col("bench").alias("_b0"))
    b1 = bench.where(F.col("session") <= day).agg(F.max_by("bench", "session")).scalar()
    n_now = cal.where(F.col("session") <= day).agg(F.count(F.lit(1))).scalar()
    g = sessions_upto(c, cal, "date", "_n0").join(per, "ticker", "left")
    g = asof_backward(g.withColumn("_all", F.lit(1)), b, ["_all"], "date", "session", ["_b0"]).drop("_all")
    g = low_since(g, prices, as_of)
    reason = ladder([(F.col("price_at_call").isNull(), "the log records no price at call"), (F.col("date") > day, "the call is dated after the grading date"),
                     (F.col("_col").isNull(), "no price column for this name"), (F.col("price_now").isNull(), "no price at or before the grading date")])
    g = g.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    ret, br = growth("price_now", "price_at_call"), F.when(F.col("_b0") > 0, b1 / F.col("_b0") - 1.0)
    g = g.withColumns({
        "ret": F.when(ok, ret), "bench_ret": F.when(ok, br), "excess": F.when(ok, ret - br), "trading_days": F.when(ok, (n_now - F.col("_n0")).cast("long")),
        "low_since_call": F.when(ok, F.col("low_since_call")),
        "stopped_trading": F.coalesce(ok & (F.col("_last") < day) & (F.datediff(day, F.col("_last")) > 7), F.lit(False))})
    g = g.withColumns({"trigger_breached": F.col("low_since_call") < F.col("trigger"), "stop_breached": F.col("low_since_call") < F.col("stop")})
    status = ladder([(F.col("reason").isNotNull(), "ungraded"), (F.col("trigger_breached"), "falsified"), (F.col("stop_breached"), "stopped")], "graded")
    return g.withColumn("status", status).withColumn("verdict", verdict()).drop("_n0", "_last", "_col", "_b0")


def verdict() -> Column:
    """The reading of an excess, by what the call committed to."""
    ahead = F.col("excess") > 0
    return ladder([
        (F.col("status") == "ungraded", F.concat(F.lit("not graded: "), F.col("reason"))),
        (F.col("excess").isNull(), "no benchmark to set it against"),
        (F.col("kind").startswith("buy") & ahead, "ahead so far"), (F.col("kind").startswith("buy"), "behind so far"),
        (F.col("kind").isin("pass", "watch") & ahead, "missed so far"), (F.col("kind").isin("pass", "watch"), "avoided so far")], "graded")


def horizon_grades(calls: DataFrame, prices: DataFrame, bench: DataFrame, as_of: str) -> DataFrame:
    """The close N sessions after each swing call, the return to it and the excess; null while not reached."""
    from panelspark.operators.panel import calendar
    day = F.lit(as_of).cast("date")
    cal = calendar(prices)
    n_now = cal.where(F.col("session") <= day).agg(F.count(F.lit(1))).scalar()
    c = sessions_upto(calls.where(F.col("horizon_days").isNotNull() & F.col("price_at_call").isNotNull()), cal, "date", "_n0")
    windows = F.array_distinct(F.concat(F.array(*[F.lit(n) for n in SWING_WINDOWS]), F.array("horizon_days")))
    c = c.select("*", F.explode(windows).alias("n")).withColumn("s_idx", F.col("_n0") + F.col("n") - 1)
    c = c.withColumn("s_idx", F.when(F.col("s_idx") < n_now, F.col("s_idx")))
    c = c.join(F.broadcast(cal.withColumnRenamed("session", "on")), "s_idx", "left")              # one row per session
    p = prices.where(F.col("close").isNotNull()).withColumn("px", F.col("close"))
    c = asof_backward(c, p, ["ticker"], "on", "session", ["px"]).withColumn("_all", F.lit(1))
    b = bench.select(F.lit(1).alias("_all"), "session", F.col("bench").alias("_b0"), F.col("bench").alias("_b1"))
    c = asof_backward(asof_backward(c, b, ["_all"], "date", "session", ["_b0"]), b, ["_all"], "on", "session", ["_b1"])
    ret, br = growth("px", "price_at_call"), F.when(F.col("_b0") > 0, F.col("_b1") / F.col("_b0") - 1.0)
    return c.select("ticker", "date", "pos", "n", (F.col("n") == F.col("horizon_days")).alias("is_horizon"), "on", ret.alias("ret"), br.alias("bench_ret"), (ret - br).alias("excess"))


def grade_summary(grades: DataFrame) -> DataFrame:
    """One row over all grades."""
    graded, buy = F.col("status") != "ungraded", F.col("kind").startswith("buy")
    other, has = F.col("kind").isin("pass", "watch"), F.col("excess").isNotNull()
    return grades.agg(
        F.count(F.lit(1)).alias("n_calls"), F.count_if(graded).alias("n_graded"), F.count_if(~graded).alias("n_ungraded"),
        F.count_if(F.col("status") == "falsified").alias("n_falsified"), F.count_if(graded & buy & has).alias("buys_graded"),
        F.count_if(graded & buy & (F.col("excess") > 0)).alias("buys_ahead"), F.count_if(graded & other & has).alias("passes_graded"),
        F.count_if(graded & other & (F.col("excess") > 0)).alias("passes_missed"), F.avg(F.when(graded & buy, F.col("excess"))).alias("mean_excess_buys"),
        F.max(F.when(graded, F.col("trading_days"))).alias("trading_days"), F.count("horizon_days").alias("swing_calls"),
        F.count_if(F.col("horizon_days").isNotNull() & F.col("stop_breached")).alias("swing_stopped"))


def outcome_readout(grades: DataFrame, is_real: bool) -> DataFrame:
    """The rank correlation of score at call and excess, refused with its shortfalls below the floors."""
    graded = grades.where(F.col("status") != "ungraded")
    use = cut_lineage(graded.where(F.col("score_percentile").isNotNull() & F.col("excess").isNotNull())
                      .select("date", "score_percentile", F.round("excess", 12).alias("excess")).withColumn("_w", F.lit(1)))
    top = graded.agg(F.max("trading_days")).scalar()
    s = use.agg(F.count(F.lit(1)).alias("n_usable"), F.count_distinct("date").alias("n_dates"),
                F.avg(F.when(F.col("score_percentile") >= 50, F.col("excess"))).alias("liked"),
                F.avg(F.when(F.col("score_percentile") < 50, F.col("excess"))).alias("disliked")).withColumn("longest", F.coalesce(top, F.lit(0)))
    rho = spearman(use, ["_w"], "score_percentile", "excess").select("_w", "rho")
    s = s.withColumn("_w", F.lit(1)).join(rho, "_w", "left").drop("_w")
    short = F.array_compact(F.array(
        F.when(F.lit(not is_real), "not real data"), F.when(F.col("n_usable") < FLOORS["usable"], "too few calls"),
        F.when(F.col("n_dates") < FLOORS["dates"], "too few dates"), F.when(F.col("longest") < FLOORS["sessions"], "window too short")))
    s = s.withColumn("shortfalls", short)
    read = F.size("shortfalls") == 0
    verdict_ = ladder([(~read, "no readout"), (F.col("rho").isNull(), "no readout"), (F.abs("rho") < 0.10, "no relationship visible so far"),
                       (F.col("rho") > 0, "suggestive so far")], "suggestive so far, the wrong way")
    return s.select("n_usable", "n_dates", "longest", F.array_join("shortfalls", "; ").alias("shortfalls"), F.when(read, "READ").otherwise("INSUFFICIENT").alias("status"),
                    F.when(read, F.col("rho")).alias("rank_ic"), F.when(read, F.col("liked")).alias("liked"), F.when(read, F.col("disliked")).alias("disliked"), verdict_.alias("verdict"))
