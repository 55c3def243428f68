"""The position memo in one call: what could be bought, what was read and declined, what to read next."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.plans import reports as rp
from panelspark.plans.diagnose import top_overlap
from panelspark.plans.peers import peer_valuation
from panelspark.plans.score import MIN_COVERAGE, VARIANTS, components, variant_scores
from panelspark.session import cut_lineage

FACTS = ["sector", "forward_pe", "pe_vs_median", "dd_52w", "eps_fy1_chg_90d"]


@dataclass
class Memo:
    rows: DataFrame             # the three lists, one row per name
    overlap: DataFrame          # names that the best of two variants share


def position_memo(records: DataFrame, notes: DataFrame, held: DataFrame, total: float, variant: str = "quality_value", n: int = 12) -> Memo:
    """``notes``: ``ticker, action``; ``total``: equity to size by.

    Rows: ``list`` (candidate, declined, queue), ``rank``, stance, score, coverage, drivers and drags, peer verdict and set, facts,
    ``confidence`` (moderate with a note, low without) and a size range with what bounds it. Only candidates are sized: a name nobody has
    read, or that its reader declined, has none and says so in ``size_notes``.
    """
    by, z = variant_scores(records)
    by = {v: cut_lineage(s.select("ticker", F.round("score", 12).alias("score"), F.round("coverage", 9).alias("coverage"), "display")) for v, s in by.items()}
    listed = cut_lineage(rp.position_lists(by[variant], notes, held, n))
    mine = z.where(F.col("key").isin(*[c.key for c in components(variant)])).join(listed.select("ticker"), "ticker", "left_semi")
    parts = rp.drivers_and_drags(mine)

    # four of either side at most
    def side(name: str):
        ranked = F.sort_array(F.collect_list(F.when(F.col("side") == name, F.struct("rank", "key", "contribution"))))
        return F.transform(ranked, lambda x: F.struct(x["key"].alias("key"), x["contribution"].alias("contribution"))).alias(f"{name}s")

    sides = parts.groupBy("ticker").agg(side("driver"), side("drag"))
    peers = peer_valuation(records).select("ticker", F.col("verdict").alias("peer_verdict"), F.col("gap").alias("peer_gap"), F.col("basis").alias("peer_set"), F.col("n_peers").alias("peer_set_n"))
    j = listed.join(records.select("ticker", *FACTS, F.coalesce("bucket_cyclical_turn", F.lit(False)).alias("_cyc")), "ticker").join(sides, "ticker", "left").join(peers, "ticker", "left")
    thin = F.col("coverage") < MIN_COVERAGE
    lo, hi, why = rp.size_band(F.lit(float(total)), thin, F.col("has_note"), F.col("_cyc"))
    sized = F.col("list") == "candidate"
    rows = j.withColumns({"thin": thin, "size_low": F.when(sized, lo), "size_high": F.when(sized, hi), "confidence": F.when(F.col("has_note"), "moderate").otherwise("low"),
                          "size_notes": F.when(sized, why).otherwise(F.array(F.concat(F.lit("not sized: "), "stance")))}).drop("_cyc", "has_note")
    shared = None
    for i, a in enumerate(VARIANTS):
        for b in VARIANTS[i + 1:]:
            one = top_overlap(by[a], by[b], n).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "shared")
            shared = one if shared is None else shared.unionByName(one)
    return Memo(rows, shared)
