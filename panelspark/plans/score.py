"""Cross-sectional score from components held as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.ranks import rank_percentile, sector_neutral_z
from panelspark.session import cut_lineage

MIN_COVERAGE = 0.60


@dataclass(frozen=True)
class Component:
    """One input: its column, weight, direction, and whether it is compared inside its sector.

    Anyone adds one with SQL text or a Column; no Python function is called per row.
    """
    key: str
    weight: float
    expr: str | Column
    higher_is_better: bool = True
    sector_neutral: bool = False
    contested: bool = False


# net cash sits at -1.0, below any borrower
LEVERAGE = "CASE WHEN net_cash THEN -1.0D ELSE nd_to_ebitda END"
# a margin is punished for more than one negative year: towards zero above it, away below it
CASH_MARGIN = ("CASE WHEN fcf_years <> 0 AND fcf_years - fcf_positive_years > 1 THEN IF(fcf_margin_avg > 0, fcf_margin_avg * 0.4D, "
               "fcf_margin_avg / 0.4D) ELSE fcf_margin_avg END")
# nobody revising is missing, not balance
REVISION_BREADTH = ("CASE WHEN rev_up IS NOT NULL OR rev_down IS NOT NULL THEN try_divide(coalesce(rev_up, 0D) - coalesce(rev_down, 0D), "
                    "coalesce(rev_up, 0D) + coalesce(rev_down, 0D)) END")


def components(variant: str = "quality_value") -> list[Component]:
    """The components with their fixed weights; the price component is added on top."""
    base = [
        Component("roic", 0.15, "roic_avg", True, True),
        Component("roic_trend", 0.04, "roic_trend", True, True),
        Component("fcf", 0.11, CASH_MARGIN, True, True),
        Component("growth", 0.06, "rev_cagr", True, True),
        Component("margin_stability", 0.04, "gm_std", False, True),
        Component("balance", 0.06, LEVERAGE, False),
        Component("value_ev", 0.13, "IF(n_hist_years >= 3, ev_vs_median, NULL)", False),
        Component("value_pe", 0.08, "IF(n_hist_years >= 3, pe_vs_median, NULL)", False),
        Component("revisions_90d", 0.11, "eps_fy1_chg_90d"),
        Component("revisions_30d", 0.08, "eps_fy1_chg_30d"),
        Component("revision_breadth", 0.06, REVISION_BREADTH),
        Component("share_count", 0.05, "share_change", False),
        Component("short_interest", 0.03, "short_pct_float", False),
    ]
    extra = {"quality_value": [],
             "with_momentum": [Component("momentum_52w", 0.10, "dd_52w", contested=True)],
             "with_reversal": [Component("reversal_ath", 0.10, "-dd_ath", contested=True)]}
    if variant not in extra:
        raise ValueError(f"unknown variant {variant!r}")
    return base + extra[variant]


def component_z(records: DataFrame, comps: list[Component], keys: list[str] | None = None) -> DataFrame:
    """``keys, ticker, key, pos, weight, z``: signed z of every component of every name, in one pass."""
    keys = keys or []
    spec = F.array(*[F.struct(
        F.lit(c.key).alias("key"), F.lit(i).alias("pos"), F.lit(c.weight).alias("weight"),
        F.lit(1.0 if c.higher_is_better else -1.0).alias("sign"), F.lit(c.sector_neutral).alias("neutral"),
        (F.expr(c.expr) if isinstance(c.expr, str) else c.expr).cast("double").alias("raw")) for i, c in enumerate(comps)])
    long = records.select(*keys, "ticker", "sector", F.explode(spec).alias("_c")).select(*keys, "ticker", "sector", "_c.*")
    z = sector_neutral_z(long, keys + ["key"], "sector", "raw", "_z", neutral=F.col("neutral"))
    return cut_lineage(z.select(*keys, "ticker", "key", "pos", "weight", (F.col("sign") * F.col("_z")).alias("z")))


def score_from_z(z: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Weighted sum, coverage, missing list, contributions, percentile and display."""
    keys = keys or []
    has = F.col("z").isNotNull()
    part = F.struct("pos", "key", F.coalesce(F.col("weight") * F.col("z"), F.lit(0.0)).alias("c"), has.alias("ok"))
    # one entry per component of a name: at most fifteen
    g = z.groupBy(*keys, "ticker").agg(
        F.sort_array(F.collect_list(part)).alias("_p"),
        (F.sum(F.when(has, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("coverage"))
    g = g.select(
        *keys, "ticker", "coverage",
        F.aggregate("_p", F.lit(0.0), lambda s, x: s + x["c"]).alias("score"),
        F.transform(F.filter("_p", lambda x: ~x["ok"]), lambda x: x["key"]).alias("missing"),
        F.map_from_entries(F.transform("_p", lambda x: F.struct(x["key"], x["c"]))).alias("contributions"))
    # equal scores up to noise of the last bits must tie
    g = rank_percentile(g.withColumn("_s", F.round("score", 12)), keys, "_s", "percentile").drop("_s")
    return g.withColumns({"display": F.bround(F.col("percentile") * 100, 1), "thin": F.col("coverage") < MIN_COVERAGE})


def score_universe(records: DataFrame, variant: str = "quality_value", keys: list[str] | None = None) -> DataFrame:
    return score_from_z(component_z(records, components(variant), keys), keys)


VARIANTS = ("quality_value", "with_momentum", "with_reversal")


def variant_scores(records: DataFrame, variants: tuple[str, ...] = VARIANTS) -> tuple[dict[str, DataFrame], DataFrame]:
    """``(scores by variant, z)``: every component is ranked once, and the variants take what is theirs of it."""
    mine = {v: components(v) for v in variants}
    every = list({c.key: c for comps in mine.values() for c in comps}.values())
    z = component_z(records, every)
    return {v: score_from_z(z.where(F.col("key").isin(*[c.key for c in comps]))) for v, comps in mine.items()}, z
