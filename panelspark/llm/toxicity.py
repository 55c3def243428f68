"""Counterfactually regularised toxicity classifier.

A sparse linear model over words and word beginnings is fitted on labelled documents. For every
labelled sentence that names an identity group, the term is swapped for the others of its set and
the squared change of the score is added to the loss, so a neutral mention of a group moves the
score as little as its counterparts do. The vocabulary and the weights are learned on a sample of
at most ``MAX_ROWS`` labelled rows, half of each class where there are enough, drawn by a hash of
the id (a documented bound, which makes the sampled ids small enough to broadcast); the fit is a few
hundred gradient steps of NumPy. Every row is scored.

A document is a set of hashed features: a feature counts once per text, so length does not dilute
it. The vocabulary is the ``max_features`` features with the largest chi-square over the sample.

Edge cases: null and empty texts have no feature and get the score of the intercept; rows without a
label, null labels and null ids are only scored; a label repeated for one id counts as often as it
is given; with no label, or labels of one class, every score is the
smoothed rate of label 1 (a quarter without any label). An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

from .common import keep_rows, map_texts

# Terms that name groups; the members of one set stand in for each other.
IDENTITY_SETS = [
    ["women", "men"], ["woman", "man"], ["female", "male"], ["girls", "boys"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "natives", "refugees"], ["disabled", "deaf", "blind"], ["old", "young"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"],
    ["frauen", "männer"], ["muslime", "christen", "juden"],
]


MAX_ROWS = 8000


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by feature, and the parameters that shape a feature."""
    weights: dict[bytes, float]
    intercept: float
    prefixes: tuple[int, ...]


PUNCT = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
TO_SPACE = bytes.maketrans(PUNCT, b" " * len(PUNCT))


def text_words(text: bytes | None) -> set[bytes]:
    """The distinct lower-cased words of a text, ASCII punctuation taken as space."""
    if not text:
        return set()
    return set(text.decode("utf-8", "replace").lower().encode().translate(TO_SPACE).split())


def word_features(words, prefixes: tuple[int, ...]) -> set[bytes]:
    """Words themselves and, marked by a star, their beginnings of given lengths in code points."""
    out = set(words)
    for w in words:
        s = w.decode("utf-8", "replace")
        for n in prefixes:
            if len(s) > n:
                out.add(s[:n].encode() + b"*")
    return out


def swaps(words: set[bytes]) -> list[tuple[bytes, bytes]]:
    """Pairs (term present, its counterpart) over the identity sets."""
    out = []
    for group in IDENTITY_SETS:
        terms = [t.encode() for t in group]
        for t in terms:
            if t in words:
                out += [(t, o) for o in terms if o != t]
    return out


def fit(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], n_features: int, l2: float, counterfactual: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression with an added mean squared score change over counterfactual ``pairs``.

    Adam on full batches; deterministic. Rows are lists of feature numbers.
    """
    w, b = np.zeros(n_features), 0.0
    rate = (labels.sum() + 0.5) / (len(labels) + 1.0) if len(labels) else 0.5
    b = float(np.log(rate / (1 - rate)))
    if not n_features or labels.min(initial=1) == labels.max(initial=0):
        return w, b
    col = np.concatenate([np.asarray(r, np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    gain = np.concatenate([np.asarray(y, np.int64) for x, y in pairs] or [np.zeros(0, np.int64)])
    lose = np.concatenate([np.asarray(x, np.int64) for x, y in pairs] or [np.zeros(0, np.int64)])
    gain_row = np.repeat(np.arange(len(pairs)), [len(y) for x, y in pairs])
    lose_row = np.repeat(np.arange(len(pairs)), [len(x) for x, y in pairs])
    m1, m2, mb1, mb2 = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    weight = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
        grad = np.bincount(col, g[row], n_features) + l2 * w
        if len(pairs):
            d = np.bincount(gain_row, w[gain], len(pairs)) - np.bincount(lose_row, w[lose], len(pairs))
            d *= 2 * counterfactual / len(pairs)
            grad += np.bincount(gain, d[gain_row], n_features) - np.bincount(lose, d[lose_row], n_features)
        gb = g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.999 * mb2 + 0.001 * gb ** 2
        step = 0.1 * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        w -= step * m1 / (np.sqrt(m2) + 1e-9)
        b -= step * mb1 / (np.sqrt(mb2) + 1e-9)
    return w, float(b)


def sampled(docs: DataFrame, classed: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """``(doc_id, text, y)`` of the documents of at most ``quotas[y]`` rows of ``classed(of, y)`` per class.

    The ids are drawn by a hash and bounded by the quotas, so they are broadcast and no text moves.
    """
    sizes = {r[0]: r[1] for r in classed.groupBy("y").count().collect()}
    ids = classed.limit(0)
    for y, most in quotas.items():
        # the hash bound leaves little more than the wanted rows to the sort
        share = min(1.0, 1.3 * most / max(sizes.get(y, 0), 1))
        ids = ids.union(classed.where((F.col("y") == y) & (F.pmod(F.xxhash64("of"), F.lit(1 << 20)) <= (1 << 20) * share)).orderBy(F.xxhash64("of"), "of").limit(most))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(d.join(F.broadcast(ids), d.doc_id == F.col("of")).select("doc_id", "text", "y"))


def learn_toxicity(labelled: DataFrame, max_rows: int = MAX_ROWS, max_features: int = 4000, min_docs: int = 4, prefixes: tuple[int, ...] = (4, 6),
                   l2: float = 2e-4, counterfactual: float = 1.0, steps: int = 300) -> ToxicityModel:
    """Fit on the rows of a sample ``labelled(doc_id, text, y)``; at most ``max_rows`` of them reach the driver."""
    rows = labelled.select("doc_id", "text", "y")

    def count(part, texts):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for t, y in zip(texts, part.column(2).to_pylist()):
            seen[int(y == 1)].update(word_features(text_words(t), prefixes))
        keys = list(seen[0].keys() | seen[1].keys())
        return {"feature": pa.array(keys, pa.binary()), "n0": [seen[0][k] for k in keys], "n1": [seen[1][k] for k in keys]}

    n1, n0 = (int(x or 0) for x in rows.agg(F.sum((F.col("y") == 1).cast("long")), F.sum((F.col("y") != 1).cast("long"))).first())
    rate = (n1 + 0.5) / (n1 + n0 + 2.0)
    if not n1 or not n0:
        return ToxicityModel({}, float(np.log(rate / (1 - rate))), prefixes)
    freq = map_texts(rows, "text", count, "feature binary, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= min_docs)
    n = n0 + n1
    both = F.col("n0") + F.col("n1")
    chi = n * F.pow(F.col("n1") * F.lit(float(n0)) - F.col("n0") * F.lit(float(n1)), 2) / (both * (n - both + 0.5) * float(n0) * float(n1))
    top = freq.select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(max_features).collect()
    vocab = {bytes(r[0]): i for i, r in enumerate(top)}
    terms = {t.encode() for g in IDENTITY_SETS for t in g}
    def code(part, texts):
        w = [text_words(t) for t in texts]
        return {"h": part.column(0), "y": [int(y == 1) for y in part.column(2).to_pylist()], "f": [sorted(vocab[x] for x in word_features(s, prefixes) if x in vocab) for s in w],
                "terms": [sorted(t.decode() for t in s & terms) for s in w]}

    got = map_texts(rows, "text", code, "h bigint, y int, f array<int>, terms array<string>").orderBy(F.xxhash64("h"), F.xxhash64("f"), "y").limit(max_rows).toArrow()
    pairs = []
    for named in got.column("terms").to_pylist():
        for old, new in swaps({t.encode() for t in named}):
            f_old, f_new = word_features([old], prefixes), word_features([new], prefixes)
            x, y = [vocab[i] for i in f_old - f_new if i in vocab], [vocab[i] for i in f_new - f_old if i in vocab]
            if x or y:
                pairs.append((x, y))
    w, b = fit(got.column("f").to_pylist(), np.array(got.column("y").to_pylist()), pairs, len(vocab), l2, counterfactual, steps)
    # classes were weighted alike, so one half is the border at the balanced rate
    return ToxicityModel({k: float(w[i]) for k, i in vocab.items() if w[i]}, b, prefixes)


def score_texts(texts: list[bytes | None], model: ToxicityModel) -> np.ndarray:
    get, cache = model.weights.get, {}
    z = np.full(len(texts), model.intercept)
    for i, t in enumerate(texts):
        found = set()
        for w in text_words(t):
            f = cache.get(w)
            if f is None:
                f = cache[w] = tuple(x for x in word_features([w], model.prefixes) if get(x))
            found.update(f)
        z[i] += sum(map(get, sorted(found)))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` of every row."""
    def run(part, texts):
        s = score_texts(texts, model)
        return {"doc_id": part.column(0), "score": s, "predicted": pa.array((s >= 0.5).astype(np.int32))}

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", run, "doc_id bigint, score double, predicted int")


def held_out(doc_id: str | Column) -> Column:
    """The fifth of ids that no fit may see."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """A sample of labelled documents outside the held-out fifth."""
    lab = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id"))
    return sampled(docs, lab.select(F.col("doc_id").cast("long").alias("of"), (F.col("toxic") == 1).cast("int").alias("y")), {1: max_rows // 2, 0: max_rows // 2})


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Learn from the labelled rows outside the held-out fifth and score every document."""
    model = learn_toxicity(training_rows(docs, labels), **params)
    return toxicity_scores(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents whose score stays below one half, with all their columns."""
    model = learn_toxicity(training_rows(docs, labels))
    return keep_rows(docs, lambda texts: score_texts(texts, model) < 0.5, text_col)
