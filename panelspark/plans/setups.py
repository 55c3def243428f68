"""Live setups on each name's own observations as of a date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.asof import asof_forward

# The order in which one kind is preferred for a name.
KINDS = ("pead", "guidance", "breakout", "pullback")


@dataclass(frozen=True)
class SetupRules:
    gap: float = 0.05
    pead_sessions: int = 3
    guidance_age: int = 5
    lookback: int = 252
    breakout_min: int = 60
    breakout_stop: float = 0.08
    band: float = 0.03
    max_dd: float = -0.15
    short: int = 20
    mid: int = 50
    long: int = 200


def observations(prices: DataFrame, as_of: str) -> DataFrame:
    """Own observations up to the date, newest first (``rn``), with the price before and the low since."""
    p = prices.where(F.col("close").isNotNull() & (F.col("session") <= F.lit(as_of).cast("date"))).select("ticker", "session", "close")
    newest = Window.partitionBy("ticker").orderBy(F.desc("session"))             # one row per session
    return p.withColumns({
        "rn": F.row_number().over(newest), "prior": F.lead("close").over(newest),
        "low_since": F.min("close").over(newest.rowsBetween(Window.unboundedPreceding, 0))})


def summary(obs: DataFrame, r: SetupRules) -> DataFrame:
    """Everything the rules need of one name, in one pass."""
    c, n = F.col("close"), F.col("rn")
    last = lambda k: F.when(n <= k, c)
    return obs.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_obs"), F.max(F.when(n == 1, c)).alias("latest"),
        F.avg(last(r.short)).alias("ma_short"), F.avg(last(r.mid)).alias("ma_mid"), F.avg(last(r.long)).alias("ma_long"),
        F.max(last(r.lookback)).alias("high"), F.max(F.when(n.between(2, r.lookback), c)).alias("prior_high"),
        F.min(last(5)).alias("low_5"), F.min(last(r.short)).alias("low_short"))


def pead(obs: DataFrame, latest: DataFrame, releases: DataFrame, r: SetupRules) -> DataFrame:
    """A release in the last sessions that gapped up and is held; the newest qualifying release counts."""
    o = obs.withColumns({"release_session": F.col("session"), "release": F.col("close")})
    j = asof_forward(releases.select("ticker", "filed").distinct(), o, ["ticker"], "filed", "session", ["release_session", "release", "prior", "rn", "low_since"])
    j = j.join(latest.select("ticker", "latest", "n_obs"), "ticker")
    j = j.where((F.col("n_obs") >= 3) & (F.col("rn") <= r.pead_sessions) & (F.col("prior") > 0) & (F.col("release") / F.col("prior") - 1.0 >= r.gap)
                & (F.col("latest") >= F.col("release")) & (F.col("low_since") < F.col("latest")))
    return j.groupBy("ticker").agg(F.max_by(F.struct(F.col("latest").alias("entry"), F.col("low_since").alias("stop")), "filed").alias("_s")).select(
        "ticker", F.lit("pead").alias("kind"), "_s.entry", "_s.stop", F.lit(20).alias("horizon"))


def guidance(obs: DataFrame, latest: DataFrame, diffs: DataFrame, r: SetupRules) -> DataFrame:
    """A raised figure on revenue or EPS in a recent release; ``diffs``: ``ticker, filed, metric, change``."""
    raised = diffs.where((F.col("change") == "raised") & F.col("metric").isin("revenue", "eps")).groupBy("ticker").agg(F.max("filed").alias("filed"))
    since = raised.join(obs, "ticker").groupBy("ticker", "filed").agg(F.count_if(F.col("session") > F.col("filed")).alias("age"))
    j = since.where(F.col("age") <= r.guidance_age).join(latest, "ticker").where((F.col("n_obs") >= 6) & (F.col("low_5") < F.col("latest")))
    return j.select("ticker", F.lit("guidance").alias("kind"), F.col("latest").alias("entry"), F.col("low_5").alias("stop"), F.lit(20).alias("horizon"))


def breakout(latest: DataFrame, screen: DataFrame, r: SetupRules) -> DataFrame:
    j = latest.join(screen.where(F.col("eps_fy1_chg_30d") > 0).select("ticker"), "ticker").where(
        (F.col("n_obs") >= r.breakout_min) & (F.col("latest") > F.col("prior_high")))
    return j.select("ticker", F.lit("breakout").alias("kind"), F.col("latest").alias("entry"), (F.col("latest") * (1.0 - r.breakout_stop)).alias("stop"), F.lit(10).alias("horizon"))


def pullback(latest: DataFrame, names: DataFrame, r: SetupRules) -> DataFrame:
    c = F.col("latest")
    j = latest.join(names.select("ticker"), "ticker", "left_semi").where(
        (F.col("n_obs") >= r.long) & (F.col("ma_mid") > F.col("ma_long")) & (c > F.col("ma_long")) & (F.abs(c / F.col("ma_short") - 1.0) <= r.band)
        & (c / F.col("high") - 1.0 >= r.max_dd) & (F.col("low_short") < c))
    return j.select("ticker", F.lit("pullback").alias("kind"), c.alias("entry"), F.col("low_short").alias("stop"), F.lit(10).alias("horizon"))


def live_setups(prices: DataFrame, as_of: str, releases: DataFrame, diffs: DataFrame, screen: DataFrame, quality: DataFrame,
                rules: SetupRules = SetupRules()) -> DataFrame:
    """X15 + T8: one setup per name by kind order, the other kinds noted in ``also``."""
    obs = observations(prices, as_of)
    s = summary(obs, rules)
    every = pead(obs, s, releases, rules).unionByName(guidance(obs, s, diffs, rules)).unionByName(breakout(s, screen, rules)).unionByName(pullback(s, quality, rules))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    g = every.withColumn("_o", order).groupBy("ticker").agg(                     # four kinds at most
        F.sort_array(F.collect_list(F.struct("_o", "kind", "entry", "stop", "horizon"))).alias("_l"))
    first = F.get("_l", F.lit(0))
    return g.select("ticker", first["kind"].alias("kind"), first["entry"].alias("entry"), first["stop"].alias("stop"), first["horizon"].alias("horizon"),
                    F.greatest(F.lit(0.0), 1.0 - F.try_divide(first["stop"], first["entry"])).alias("risk_pct"),
                    F.array_join(F.transform(F.slice("_l", 2, 4), lambda x: x["kind"]), ", ").alias("also"))
