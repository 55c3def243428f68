"""Valuation against a name's own peer set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import ladder
from panelspark.operators.ranks import join_on, rank_percentile, top_n

MIN_PEERS = 6
WIDE_GAP = 0.35

# (label, column, higher is better)
PRICE_INPUTS = (("forward P/E", "forward_pe"), ("EV/EBITDA", "ev_ebitda"))
QUALITY_INPUTS = (("return on invested capital", "roic_avg", True), ("free cash flow margin", "fcf_margin_avg", True),
                  ("revenue growth", "rev_cagr", True), ("gross margin stability", "gm_std", False))


def row_median(values: Column) -> Column:
    """Median of a short array, nulls left out."""
    v = F.array_sort(F.array_compact(values))
    n = F.size(v)
    mid = (n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(v, mid)).otherwise((F.get(v, mid - 1) + F.get(v, mid)) / 2)


def peer_scope(records: DataFrame) -> DataFrame:
    """Industry when it has six names, else sector, else everything; as ``scope, basis, label, n_peers``."""
    total = records.agg(F.count(F.lit(1))).scalar()
    ind = records.where(F.col("industry").isNotNull()).groupBy("industry").agg(F.count(F.lit(1)).alias("_ni"))
    sec = records.where(F.col("sector").isNotNull()).groupBy("sector").agg(F.count(F.lit(1)).alias("_ns"))
    j = records.join(ind, "industry", "left").join(sec, "sector", "left")
    by_i, by_s = F.coalesce(F.col("_ni") >= MIN_PEERS, F.lit(False)), F.coalesce(F.col("_ns") >= MIN_PEERS, F.lit(False))
    return j.withColumns({
        "basis": F.when(by_i, "industry").when(by_s, "sector").otherwise("whole list"),
        "label": F.when(by_i, F.col("industry")).when(by_s, F.col("sector")).otherwise("the whole list"),
        "n_peers": F.when(by_i, F.col("_ni")).when(by_s, F.col("_ns")).otherwise(total),
        "scope": F.when(by_i, F.concat(F.lit("i:"), "industry")).when(by_s, F.concat(F.lit("s:"), "sector")).otherwise("*"),
    }).drop("_ni", "_ns")


def _memberships() -> Column:
    """The groups a name is a peer in, whatever its own basis is."""
    return F.array_compact(F.array(F.concat(F.lit("i:"), "industry"), F.concat(F.lit("s:"), "sector"), F.lit("*")))


def verdict(price: Column, quality: Column) -> Column:
    gap = quality - price
    cheap, dear = price <= 0.35, price >= 0.65
    good, poor = quality >= 0.65, quality <= 0.35
    return ladder([
        (price.isNull() | quality.isNull(), "not comparable"),
        (cheap & good, "cheap against peers of better quality"),
        (dear & poor, "expensive against peers of worse quality"),
        ((F.abs(gap) >= WIDE_GAP) & (gap > 0), "priced below where its quality sits"),
        (F.abs(gap) >= WIDE_GAP, "priced above where its quality sits"),
        (cheap & poor, "cheap, and the quality suggests why"),
        (dear & good, "expensive, and the quality supports it"),
    ], "in the middle")


def peer_valuation(records: DataFrame, price_inputs=PRICE_INPUTS, quality_inputs=QUALITY_INPUTS) -> DataFrame:
    """Percentiles inside the peer set, their medians, the gap and the verdict.

    ``price_inputs`` are ``(label, column)``, ``quality_inputs`` ``(label, column, higher is better)`` (D5).
    """
    own = peer_scope(records)
    inputs = [(lab, F.when(F.col(c) > 0, F.col(c)), "price", 1.0) for lab, c in price_inputs]
    inputs += [(lab, F.col(c), "quality", 1.0 if up else -1.0) for lab, c, up in quality_inputs]
    spec = F.array(*[F.struct(F.lit(lab).alias("input"), F.lit(side).alias("side"), (v.cast("double") * sign).alias("v"))
                     for lab, v, side, sign in inputs])
    long = records.select("ticker", F.explode(_memberships()).alias("scope"), *[c for c in records.columns if c not in ("ticker", "scope")])
    long = long.select("ticker", "scope", F.explode(spec).alias("_c")).select("ticker", "scope", "_c.*")
    # only the groups some name uses are ranked
    used = own.select("scope").distinct()
    ranked = rank_percentile(long.join(used, "scope", "left_semi"), ["scope", "input"], "v", "pct")
    mine = own.select("ticker", "scope", "basis", "label", "n_peers").join(ranked.hint("merge"), ["ticker", "scope"])
    g = mine.groupBy("ticker", "basis", "label", "n_peers", "scope").agg(
        F.collect_list(F.when(F.col("side") == "price", F.col("pct"))).alias("_p"),
        F.collect_list(F.when(F.col("side") == "quality", F.col("pct"))).alias("_q"))       # six inputs
    g = g.withColumns({"price_rank": row_median(F.col("_p")), "quality_rank": row_median(F.col("_q"))})
    return g.withColumns({"gap": F.col("quality_rank") - F.col("price_rank"),
                          "verdict": verdict(F.col("price_rank"), F.col("quality_rank"))}).drop("_p", "_q")


def extreme_peers(records: DataFrame, n: int = 4) -> DataFrame:
    """The cheapest and dearest names of each used peer set by positive forward P/E."""
    used = peer_scope(records).select("scope").distinct()
    rows = records.where(F.col("forward_pe") > 0).select("ticker", "forward_pe", F.explode(_memberships()).alias("scope"))
    rows = rows.join(used, "scope", "left_semi")
    cheap = top_n(rows, ["scope"], [F.asc("forward_pe"), F.asc("ticker")], n).withColumn("side", F.lit("cheapest"))
    dear = top_n(rows, ["scope"], [F.desc("forward_pe"), F.desc("ticker")], n).withColumn("side", F.lit("dearest"))
    return cheap.unionByName(dear).select("scope", "side", "rank", "ticker", "forward_pe")
