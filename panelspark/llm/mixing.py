"""Soft-membership mixing of documents to target domain weights.

A classifier fitted on the labelled table gives every document posteriors over domains, so a
document belongs to several domains in part. Nonnegative document rates x are fitted by projected
gradients so that the expected tokens of each domain, the sum of x * tokens * posterior, match targets
in least squares. With r the residual, A its metric and L the largest curvature, a round is

    x = max(0, y - p . A r(y) / L),   y = max(0, x + b (x - last x))

with momentum b, restarted where the step turns against the movement. A is the inverse of the
token-weighted second moment M of the posteriors plus RIDGE times the squared targets: a miss costs what
its correction would move the rates by, and a domain whose correction would need rates far above those
around it costs no more than its relative miss. L is the largest eigenvalue of A M, which bounds the
curvature for any set of positive rates.

A round is one aggregation of the expected tokens at x and y, of the step's length and of its direction;
no rate is stored: the steps so far are enough to replay any document's rate, so rounds have no lineage
and a lost executor costs its own tasks only. Rounds end when targets are met, or by the projected
gradient, when a step moves the rates by less than the tolerance (token-weighted root mean square).

Domains named in ``at_most`` have their present tokens, or their target if that is less, as an upper
bound only. The residual is then the shortest way (in A) to totals that meet the targets.

The classifier is softmax regression over words and style features, learned on at most ``MAX_ROWS``
labelled rows drawn by a hash of the id and on the ``max_features`` features that tell domains best
apart among those of ``min_docs`` labelled rows or more (documented bounds of the fit); everything else
covers all documents.

Edge cases: null and empty texts have no tokens and get the rate of their posterior; rows without a
label are only mixed; without any label, or a word that tells domains apart, every posterior is the
same and every rate is one. Null ids and repeated rows are
rated row by row. Targets that nonnegative rates cannot reach (a domain that hardly any document belongs
to, domains that go together), or not in ``max_rounds``, are met as far as that goes, marked
``met: False`` in the totals and warned of, never an error. A domain that no document belongs to in any
part is left out of the fit. Domains are those the targets name. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

from .common import map_texts, pieces, small_batches, text_pieces
from .toxicity import sampled, text_words

SYMBOLS = b"#*$%&|<>!"
DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.93, "low": 0.06, "toxic": 0.01}
MAX_ROWS = 6000
MICRO = 1e6
RIDGE = 1.0


@dataclass(frozen=True)
class DomainModel:
    vocab: dict[bytes, int]
    weights: np.ndarray = field(repr=False)          # features x domains
    bias: np.ndarray = field(repr=False)


def label_domain(quality: str | Column = "quality", toxic: str | Column = "toxic", domains: Sequence[str] = DOMAINS) -> Column:
    """Number of the domain a labelled row belongs to; null without labels of the ``domains``."""
    q, t = (F.col(c) if isinstance(c, str) else c for c in (quality, toxic))
    at = {d: i for i, d in enumerate(domains)}
    kind = F.when(q == 0, F.lit(at.get("low"))).when(q.isNotNull(), F.lit(at.get("good")))
    if "toxic" in at:
        kind = F.when(t == 1, F.lit(at["toxic"])).when(q == 0, F.lit(at.get("low"))).when(q.isNotNull() | t.isNotNull(), F.lit(at.get("good")))
    return kind.cast("int")


def n_tokens(text: bytes | None) -> int:
    return len(text.split()) if text else 0


def mix_features(text: bytes | None) -> set[bytes]:
    """Distinct words, and coarse shares of symbols, capitals and repeated words and the length."""
    words = text_words(text)
    out = set(words)
    if text:
        n = len(text)
        total = max(n_tokens(text), 1)
        sym = n - len(text.translate(None, SYMBOLS))
        caps = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        for name, v in ((b"sym", sym / n), (b"caps", caps / n), (b"rep", 1 - len(words) / total)):
            out.add(b"~%s%d" % (name, min(9, int(20 * v))))
        out.add(b"~len%d" % min(int(total).bit_length(), 12))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(rows: list[list[int]], y: np.ndarray, n_features: int, k: int, l2: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by Adam on full batches; deterministic."""
    prior = (np.bincount(y, minlength=k) + 0.5) / (len(y) + 0.5 * k)
    w, b = np.zeros((n_features, k)), np.log(prior)
    if not len(y) or not n_features:
        return w, b
    col = np.concatenate([np.asarray(r, np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    hot = np.eye(k)[y]
    m1, m2 = np.zeros((n_features + 1, k)), np.zeros((n_features + 1, k))
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(row, w[col, j], len(rows)) for j in range(k)], axis=1) + b
        g = (softmax(z) - hot) / len(y)
        grad = np.vstack([np.stack([np.bincount(col, g[row, j], n_features) for j in range(k)], axis=1) + l2 * w, g.sum(axis=0)])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        step = 0.05 * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * m1 / (np.sqrt(m2) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def learn_domains(labelled: DataFrame, max_rows: int = MAX_ROWS, max_features: int = 4000, min_docs: int = 4, l2: float = 1e-4, steps: int = 200, k: int = len(DOMAINS)) -> DomainModel:
    """Fit on the rows of a sample ``labelled(doc_id, text, y)``, y the number of a domain."""
    rows = labelled.select("doc_id", "text", "y")
    sizes = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    total = sum(sizes.values())
    if not total:
        return DomainModel({}, np.zeros((0, k)), np.zeros(k))

    def count(part, texts):
        seen: dict[bytes, Counter] = {}
        for t, y in zip(texts, part.column(2).to_pylist()):
            for f in mix_features(t):
                seen.setdefault(f, Counter())[y] += 1
        return {"feature": pa.array(list(seen), pa.binary()), **{f"n{j}": [c[j] for c in seen.values()] for j in range(k)}}

    names = [f"n{j}" for j in range(k)]
    freq = map_texts(rows, "text", count, "feature binary, " + ", ".join(f"{n} bigint" for n in names)).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
    both = sum((F.col(n) for n in names), F.lit(0))
    chi = sum((F.pow(F.col(n) - both * F.lit(sizes.get(j, 0) / total), 2) / (both * F.lit((sizes.get(j, 0) + 0.5) / total)) for j, n in enumerate(names)), F.lit(0.0))
    top = freq.where(both >= min_docs).select("feature", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(max_features).collect()
    vocab = {bytes(r[0]): i for i, r in enumerate(top)}
    def code(part, texts):
        return {"h": part.column(0), "y": part.column(2), "f": [sorted(vocab[x] for x in mix_features(t) if x in vocab) for t in texts]}

    got = map_texts(rows, "text", code, "h bigint, y int, f array<int>").orderBy(F.xxhash64("h"), F.xxhash64("f"), "y").limit(max_rows).toArrow()
    w, b = fit_softmax(got.column("f").to_pylist(), np.array(got.column("y").to_pylist(), np.int64), len(vocab), k, l2, steps)
    return DomainModel(vocab, w, b)


def posteriors(texts: list[bytes | None], model: DomainModel) -> np.ndarray:
    z = np.tile(model.bias, (len(texts), 1))
    get = model.vocab.get
    for i, t in enumerate(texts):
        at = sorted(j for f in mix_features(t) if (j := get(f)) is not None)
        if at:
            z[i] += model.weights[at].sum(axis=0)
    return softmax(z)


def replay(p: np.ndarray, history: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the steps ``(direction, momentum)`` so far."""
    return trail(p, history)[0]


def trail(p: np.ndarray, history: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rates, the point the next step leaves from, and the rates and point of the step before."""
    x = y = last = left = np.ones(len(p))
    for u, momentum in history:
        last, left = x, y
        x = np.maximum(0.0, y + p @ u)
        y = np.maximum(0.0, x + momentum * (x - last))
    return x, y, last, left


def memberships(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, tokens, p)`` of every row, p in the order of ``DOMAINS``."""
    def run(part, texts):
        return {"doc_id": part.column(0), "tokens": [n_tokens(t) for t in texts], "p": posteriors(texts, model).tolist()}

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", run, "doc_id bigint, tokens bigint, p array<double>")


def batch_matrix(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy().astype(float), batch.column(1).flatten().to_numpy().reshape(-1, k)


def missing(now: np.ndarray, goal: np.ndarray, metric: np.ndarray, loose: Sequence[int]) -> np.ndarray:
    """``now`` less the nearest totals that meet the targets, by coordinate descent over the ``loose`` ones, which are upper bounds."""
    r = now - goal
    for _ in range(50 if loose else 0):
        for d in loose:
            others = metric[d] @ r - metric[d, d] * r[d]
            r[d] = max(now[d] - goal[d], -others / metric[d, d] if metric[d, d] else 0.0)
    return r


def fit_rates(member: DataFrame, targets: dict[str, float], anchor: str | None = "good", total_tokens: float | None = None, tolerance: float = 1e-4, max_rounds: int = 60, domains: Sequence[str] = DOMAINS,
              at_most: Sequence[str] = ()) -> tuple[list[tuple[np.ndarray, float]], list[dict]]:
    """Steps that give every document its rate, and per domain its target, its expected tokens and whether it is met.

    Without ``total_tokens`` the budget is what leaves the tokens of the ``anchor`` domain as they are.
    """
    k = len(domains)
    rows = member.select("tokens", "p")

    def sums(fn, width: int) -> np.ndarray:
        """Exact sums of millionths, so the order of tasks does not matter."""
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.rint(fn(*batch_matrix(batch, k)) * MICRO).astype(np.int64).sum(axis=0).reshape(1, -1).tolist(), pa.list_(pa.int64()))], names=["s"])
        got = rows.mapInArrow(run, "s array<long>").agg(*[F.sum(F.col("s")[j].cast("decimal(38,0)")) for j in range(width)]).first()
        return np.array([float(v or 0) for v in got]) / MICRO

    def at(history) -> np.ndarray:
        """Tokens per domain at the rates and at the point the next step leaves from; squared length of the last step, and how far it turns back."""
        def run(n, p):
            x, y, last, left = trail(p, history)
            return np.column_stack([(x * n)[:, None] * p, (y * n)[:, None] * p, n * (x - left) ** 2, n * (left - x) * (x - last)])
        return sums(run, 2 * k + 2)

    first = sums(lambda n, p: np.concatenate([n[:, None] * p, (n[:, None, None] * p[:, :, None] * p[:, None, :]).reshape(len(n), -1)], axis=1), k + k * k)
    now, moment = first[:k], first[k:].reshape(k, k)
    tokens = max(now.sum(), 1.0)
    share = np.array([targets.get(d, 0.0) for d in domains])
    share = share / share.sum()
    if total_tokens is None:
        a = list(domains).index(anchor) if anchor in domains else 0
        total_tokens = now[a] / share[a] if anchor and share[a] else now.sum()
    goal = total_tokens * share
    live = np.flatnonzero(now > 0)                   # of the others no rate can make a token
    loose = [j for j, d in enumerate(live) if domains[d] in at_most]
    goal = np.where([d in at_most for d in domains], np.minimum(goal, now), goal)
    bound = tolerance * max(total_tokens, 1.0)
    some = moment[np.ix_(live, live)]
    metric = np.linalg.pinv(some + RIDGE * np.diag(goal[live] ** 2) / tokens, hermitian=True)
    curve = max(np.linalg.eigvals(metric @ some).real.max(initial=0.0), 1e-9)

    def residual(z: np.ndarray) -> np.ndarray:
        return missing(z[live], goal[live], metric, loose)

    history: list[tuple[np.ndarray, float]] = []
    here, t = now, 1.0                               # tokens where the next step leaves from
    while np.abs(residual(now)).max(initial=0.0) > bound and len(history) < max_rounds:
        u = np.zeros(k)
        u[live] = -metric @ residual(here) / curve
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        history.append((u, (t - 1) / after))
        got = at(history)
        now, here, length, back = got[:k], got[k:2 * k], got[-2], got[-1]
        t = 1.0 if back > 0 else after
        if np.sqrt(length / tokens) <= tolerance * 0.1:
            break
    short = np.zeros(k)
    short[live] = residual(now)
    met = np.where(now > 0, np.abs(short), goal) <= bound
    totals = [{"domain": d, "target": float(g), "expected": float(e), "met": bool(m)} for d, g, e, m in zip(domains, goal, now, met)]
    if not met.all():
        warnings.warn(f"nonnegative rates cannot meet the targets in {len(history)} rounds: {[t for t in totals if not t['met']]}", stacklevel=2)
    return history, totals


def unit_hash(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """A fixed number in [0, 1) of a row."""
    return F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 30)) / float(1 << 30)


def labelled_domains(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """A sample of labelled documents, domains in their natural shares."""
    lab = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("of"), label_domain(domains=domains).alias("y")).where("y IS NOT NULL")
    sizes = {r[0]: r[1] for r in lab.groupBy("y").count().collect()}
    total = max(sum(sizes.values()), 1)
    return sampled(docs, lab, {y: -(-max_rows * n // max(total, max_rows)) for y, n in sizes.items()})


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, **params) -> tuple[DataFrame, list[dict], DomainModel, list[tuple[np.ndarray, float]]]:
    """``(rows, totals, model, history)``; rows are ``doc_id, tokens, p, rate``, p in the order of ``DOMAINS`` of those the targets name."""
    targets = targets or TARGETS
    domains = [d for d in DOMAINS if d in targets]
    model = learn_domains(labelled_domains(docs, labels, domains=domains), k=len(domains))
    member = cut_lineage(memberships(docs, model))
    history, totals = ([], []) if not model.vocab else fit_rates(member, targets, domains=domains, **params)  # no word: nothing tells the domains apart

    def run(batches):
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(-1, len(domains))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replay(p, history))], names=["doc_id", "tokens", "p", "rate"])

    rows = member.mapInArrow(run, "doc_id long, tokens long, p array<double>, rate double")
    return rows, totals, model, history


def resample(docs: DataFrame, model: DomainModel, history: list[tuple[np.ndarray, float]]) -> DataFrame:
    """Each row as many times as its rate says, the fraction decided by a hash of the row; all columns are kept, whatever their names."""
    n, at = len(docs.columns), docs.columns.index("text")
    unit = "unit" + "_" * max(map(len, docs.columns))     # longer than any name there is
    marked = docs.select("*", unit_hash(F.col("doc_id"), F.col("text")).alias(unit))

    def run(batches):
        for batch in batches:
            # by position: other columns may repeat a name
            slim = pa.RecordBatch.from_arrays([batch.column(at), batch.column(n), pa.array(np.arange(batch.num_rows))], names=["text", "unit", "row"])
            for part, texts in text_pieces(slim, "text"):
                x = replay(posteriors(texts, model), history)
                copies = np.floor(x + part.column(1).to_numpy()).astype(np.int64)
                again, row = np.repeat(np.arange(len(texts)), copies), part.column(2).to_numpy()
                for a, b in pieces(np.array([len(texts[i] or b"") for i in again.tolist()], np.int64)):
                    taken = pa.array(row[again[a:b]])
                    yield pa.RecordBatch.from_arrays([batch.column(i).take(taken) for i in range(n)], names=batch.schema.names[:n])

    return small_batches(marked).mapInArrow(run, docs.schema)
