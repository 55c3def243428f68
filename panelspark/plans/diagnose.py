"""What a score is made of: correlations, effective signals, variance share, coverage, movement."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.ranks import position, spearman, value_ranks
from panelspark.plans.score import MIN_COVERAGE, component_z, components, score_from_z
from panelspark.session import cut_lineage

REDUNDANT = 0.75
MIN_NAMES = 20
# When a note is worth a row.
FEW_SIGNALS, NARROWS, WIDER, AGREES = 0.6, -0.01, 0.08, 0.6


def pair_correlations(z: DataFrame) -> DataFrame:
    """Rank correlation of every pair of components over the names having both.

    Pairs are formed inside one name (at most fifteen components), not between names.
    """
    per = z.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "weight", "z"))).alias("_p"))
    a = per.select("ticker", "_p", F.posexplode("_p").alias("_i", "_a"))
    pairs = a.select("ticker", "_a", F.explode(F.filter("_p", lambda x: x["pos"] > F.col("_a.pos"))).alias("_b"))
    rows = pairs.select(F.col("_a.key").alias("a"), F.col("_b.key").alias("b"),
                        (F.col("_a.weight") + F.col("_b.weight")).alias("w"), F.col("_a.z").alias("x"), F.col("_b.z").alias("y"))
    s = spearman(rows, ["a", "b", "w"], "x", "y")
    return s.select("a", "b", "rho", "n", F.col("w").alias("combined_weight"),
                    F.coalesce(F.abs("rho") >= REDUNDANT, F.lit(False)).alias("redundant"))


def effective_signals(pairs: DataFrame, keys: list[str], n_names: int) -> float | None:
    """Exp of the entropy of the normalised eigenvalues of the k x k matrix (k <= 15 rows come back)."""
    if n_names < MIN_NAMES:
        return None
    at = {k: i for i, k in enumerate(keys)}
    m = np.eye(len(keys))
    for r in pairs.select("a", "b", "rho").where("rho is not null").collect():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["rho"]
    e = np.clip(np.linalg.eigvalsh(m), 0.0, None)
    p = e / e.sum()
    p = p[p > 1e-12]
    return float(math.exp(-(p * np.log(p)).sum()))


def variance_share(z: DataFrame) -> DataFrame:
    """cov(contribution, total) / var(total) per component."""
    c = z.withColumn("c", F.coalesce(F.col("weight") * F.col("z"), F.lit(0.0)))
    totals = c.groupBy("ticker").agg(F.sum("c").alias("total"))
    all_w = F.sum("weight").over(Window.partitionBy(F.lit(0)))           # one row per component
    s = c.join(totals.hint("merge"), "ticker").groupBy("key", "weight").agg(
        F.try_divide(F.covar_samp("c", "total"), F.var_samp("total")).alias("share"))
    return s.select("key", "share", (F.col("weight") / all_w).alias("nominal_weight"))


def coverage_distribution(scores: DataFrame) -> DataFrame:
    """Min, lower order statistic at 10%, upper median, mean, max, thin names."""
    r = value_ranks(scores, [], "coverage")
    def pick(i):
        return F.max(F.when((F.col("n_below") <= i) & (i < F.col("n_below") + F.col("tie_n")), F.col("coverage")))
    return r.agg(F.min("coverage").alias("min"), pick(F.floor(F.lit(0.10) * (F.col("n") - 1))).alias("p10"),
                 pick(F.floor(F.col("n") / 2)).alias("median"),
                 (F.sum(F.col("coverage") * F.col("tie_n")) / F.sum("tie_n")).alias("mean"), F.max("coverage").alias("max"),
                 F.sum(F.when(F.col("coverage") < 0.60, F.col("tie_n")).otherwise(0)).alias("n_thin"))


def rank_movement(scores: DataFrame, old: str, new: str, n: int = 12) -> DataFrame:
    """Place by the old score against place by the new one; the largest moves."""
    a = position(scores.withColumn("_old", F.coalesce(old, F.lit(0.0))), "_old", "ticker", "old_rank")
    b = position(a, new, "ticker", "new_rank").withColumn("moved", F.col("old_rank") - F.col("new_rank"))
    return b.select("ticker", "old_rank", "new_rank", "moved").orderBy(F.desc(F.abs("moved")), "ticker").limit(n)


def variant_agreement(scores: dict[str, DataFrame]) -> DataFrame:
    """Rank correlation of each pair of variants over common names."""
    names = sorted(scores)
    out = None
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            j = scores[a].select("ticker", F.col("score").alias("x")).join(
                scores[b].select("ticker", F.col("score").alias("y")).hint("merge"), "ticker")
            s = spearman(j.withColumns({"a": F.lit(a), "b": F.lit(b)}), ["a", "b"], "x", "y")
            out = s if out is None else out.unionByName(s)
    return out


def top_overlap(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """How many of the best ``n`` two score lists share."""
    ta = a.orderBy(F.desc("score"), "ticker").limit(n).select("ticker")
    tb = b.orderBy(F.desc("score"), "ticker").limit(n).select("ticker")
    return ta.join(tb, "ticker").agg(F.count(F.lit(1)).alias("shared"))


@dataclass
class Diagnosis:
    pairs: DataFrame                # every pair of components: rho, n, combined weight, redundant
    effective: float | None         # independent signals by entropy; None under ``MIN_NAMES`` names
    variance: DataFrame             # share of the score's variance beside the nominal weight
    coverage: DataFrame             # one row
    thin: DataFrame                 # names ranked on too little of the weight
    moves: DataFrame                # largest moves against the older score
    notes: DataFrame                # ``note, subject, value``: what a reader should know, one row each


def participation(pairs: DataFrame, k: int) -> DataFrame:
    """``(value)``: k^2 over the sum of all squared correlations, the other usual count of independent signals; one row."""
    mass = F.lit(float(k)) + 2 * F.coalesce(F.sum(F.col("rho") * F.col("rho")), F.lit(0.0))
    return pairs.agg((F.lit(float(k * k)) / mass).alias("value"))


def diagnose(records: DataFrame, variant: str = "quality_value", old: str = "quality_score", n_moves: int = 12) -> Diagnosis:
    """X4 in one call: what the score of ``records`` is made of, from one pass over its components.

    Notes, each present only where it applies: ``few_names`` (correlations are not read), ``redundant_pairs`` (their number)
    and ``worst_pair`` (its rho), ``few_signals`` (effective count under 0.6 of the components), ``participation``,
    ``narrows`` (the component with the most negative share of variance), ``wider_than_weight`` (its excess over the nominal
    weight), ``agreement`` with the older score, subject telling which way it reads, and ``thin_names``.
    """
    comps = components(variant)
    z = component_z(records, comps)
    scores = cut_lineage(score_from_z(z).withColumns({"score": F.round("score", 12), "coverage": F.round("coverage", 9)}))
    n = scores.count()
    pairs = cut_lineage(pair_correlations(z.withColumn("z", F.round("z", 12))))
    effective = effective_signals(pairs, [c.key for c in comps], n)
    variance = cut_lineage(variance_share(z))
    both = cut_lineage(scores.select("ticker", "score").join(records.select("ticker", old).hint("merge"), "ticker"))
    thin = scores.where(F.col("coverage") < MIN_COVERAGE).select("ticker", "coverage")

    def note(name: str, df: DataFrame, subject=None, value="value") -> DataFrame:
        return df.select(F.lit(name).alias("note"), (F.lit(None) if subject is None else subject).cast("string").alias("subject"), F.col(value).cast("double").alias("value"))

    bad = pairs.where("redundant")
    over = variance.withColumn("value", F.col("share") - F.col("nominal_weight"))
    rho = spearman(both, [], old, "score").where("rho IS NOT NULL")
    size = records.sparkSession.createDataFrame([(float(n), effective)], "value double, effective double")
    enough = size.where(F.col("value") >= MIN_NAMES)
    notes = [
        note("few_names", size.where(F.col("value") < MIN_NAMES)),
        note("redundant_pairs", bad.agg(F.count(F.lit(1)).alias("value")).where("value > 0")),
        note("worst_pair", bad.orderBy(F.desc(F.abs(F.round("rho", 9))), "a", "b").limit(1), F.concat_ws(",", "a", "b"), "rho"),
        note("few_signals", enough.where(F.col("effective") < FEW_SIGNALS * len(comps)), None, "effective"),
        note("participation", participation(pairs, len(comps)).join(enough.select("effective"), F.lit(True), "left_semi")),
        note("narrows", variance.where(F.col("share") < NARROWS).orderBy(F.round("share", 9), "key").limit(1), F.col("key"), "share"),
        note("wider_than_weight", over.where(F.col("value") > WIDER).orderBy(F.desc(F.round("value", 9)), F.desc("key")).limit(1), F.col("key")),
        note("agreement", rho, F.when(F.col("rho") > AGREES, "refinement").otherwise("different view"), "rho"),
        note("thin_names", thin.agg(F.count(F.lit(1)).alias("value")).where("value > 0"))]
    out = notes[0]
    for x in notes[1:]:
        out = out.unionByName(x)
    moves = rank_movement(both, old, "score", n_moves)
    return Diagnosis(pairs, effective, variance, coverage_distribution(scores), thin, moves, out)
