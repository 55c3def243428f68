"""Personal data by patterns, and information-theoretic sanitisation of terms that reveal it.

Patterns give the base spans: protected entities. Over the whole corpus, co-occurrence then
estimates how strongly a term reveals an entity: with N documents, n(t) holding term t, n(e)
holding entity e and n(t, e) holding t within ``window`` words of e,

    PMI(t; e) = log2(n(t, e) * N / (n(t) * n(e))),   disclosure = PMI(t; e) / log2(N / n(e)).

One means that the term occurs beside the entity only. A term whose disclosure reaches the
threshold becomes a span of kind ``term`` wherever it stands in the documents that hold the entity:
it is generalised to its beginning where that beginning, counted alike, stays below the threshold,
and removed otherwise.

The estimate holds for every entity, also for one that a single document names: there n(t, e) = 1
and disclosure is log2(N / n(t)) / log2(N), so a threshold of 0.9 takes the terms found in at most
N^0.1 documents. Whoever sees such a term finds the document, and with it the entity. Common words
beside a rare entity stay far below, whatever the number of entities.

Counts are joins and sums over all documents. Two bitmaps of a fixed 512 KB (candidate terms,
documents with spans) only spare work in the scans; exact joins follow.

Edge cases: null and empty texts have no span; repeated rows count as one document for what they
reveal and keep one row each (rows of one id with equal base spans share their term spans); overlapping base spans of different kinds all stay, a term span inside a base span is
dropped; rows with a null id get base spans only; with fewer than two documents, or an entity in
every document, nothing is disclosed beyond the entity. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

from .common import bitmap, map_texts, set_in, small_batches

KINDS = ["email", "ip", "card", "phone", "term"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the lookbehind spares starts inside a run of digits, which could not match either
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class DisclosureRule:
    window: int = 8
    threshold: float = 0.9
    general_chars: int = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(s: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ so that long runs stay linear."""
    out, end, at = [], 0, s.find("@")
    while at >= 0:
        start = at
        while start > end and s[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(s, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
            at = s.find("@", end)
        else:
            at = s.find("@", at + 1)
    return out


def base_spans(s: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then kind as listed; offsets in code points."""
    out = [(a, b, "email") for a, b in emails(s)]
    for m in IP.finditer(s):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(s):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(s):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def spell(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def entity_key(kind: str, value: str) -> int:
    plain = value.lower() if kind in ("email", "ip") else "".join(c for c in value if c.isdigit())
    return as_long(f"{kind}:{plain}")


def as_long(s: str) -> int:
    """The same 64-bit hash as Spark's ``xxhash64`` of a string."""
    h = xxhash.xxh64_intdigest(s.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def contexts(s: str, spans, window: int):
    """Per base span: entity key and the distinct terms around it."""
    words = [(m.start(), m.end()) for m in WORD.finditer(s)]
    starts = np.array([a for a, _ in words] or [0])
    for a, b, kind in spans:
        i, j = int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b))
        near = [s[x:y].lower() for x, y in words[max(0, i - window):i] if y <= a] + [s[x:y].lower() for x, y in words[j:j + window]]
        yield entity_key(kind, s[a:b]), {w for w in near if not w.isdigit()}


def find_base(docs: DataFrame, rule: DisclosureRule) -> DataFrame:
    """Base result of every row, with its entities and the terms near them as parallel arrays."""
    def run(part, texts):
        cols: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base", "entity", "term")}
        for t in texts:
            s = t.decode("utf-8", "replace") if t else ""
            spans = base_spans(s)
            n = Counter(k for _, _, k in spans)
            for k in KINDS[:4]:
                cols[f"n_{k}"].append(n[k])
            cols["base"].append(spell(spans))
            near = sorted({(e, w) for e, terms in contexts(s, spans, rule.window) for w in terms or [""]}) if spans else []
            cols["entity"].append([x[0] for x in near])
            cols["term"].append([x[1] for x in near])
        return {"doc_id": part.column(0), **cols}

    return map_texts(docs, "text", run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, entity array<bigint>, term array<string>")


def term_counts(docs: DataFrame, bits: np.ndarray, general_chars: int) -> DataFrame:
    """``(term, n_t)``: documents that hold each candidate term or beginning (marked by a star)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(part, texts):
        known: dict[str, list[str]] = {}
        count: Counter = Counter()
        for t in texts:
            if not t:
                continue
            words = set(WORD.findall(t.decode("utf-8", "replace").lower()))
            new = [w for w in words if w not in known]
            if new:
                both = [(w, f) for w in new for f in (w, w[:general_chars] + "*")]
                h = np.frombuffer(b"".join(xxhash.xxh64_digest(f.encode(), 42) for _, f in both), ">u8").astype(np.uint64).view(np.int64)
                hit = set_in(shared.value, h)
                for w in new:
                    known[w] = []
                for (w, f), x in zip(both, hit.tolist()):
                    if x:
                        known[w].append(f)
            count.update({f for w in words for f in known[w]})
        return {"term": list(count.keys()), "n": list(count.values())}

    return map_texts(docs.select("text"), "text", run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosures(base: DataFrame, docs: DataFrame, rule: DisclosureRule) -> DataFrame:
    """``(entity, term, disclosure, general)`` of the terms that reveal an entity; ``general`` tells that the beginning of the term may stay."""
    near = base.where("size(entity) > 0 AND doc_id IS NOT NULL").select("doc_id", F.explode(F.arrays_zip("entity", "term")).alias("x")).select("doc_id", "x.entity", "x.term").distinct()
    near = cut_lineage(near.withColumn("start", F.concat(F.substring("term", 1, rule.general_chars), F.lit("*"))))
    # an entity that many documents hold is counted down to one row per term before it meets its own count
    n_e = near.groupBy("entity").agg(F.count_distinct("doc_id").alias("n_e")).select(F.col("entity").alias("e1"), "n_e")
    wide = near.where("term <> ''").groupBy("entity", "start").agg(F.count_distinct("doc_id").alias("n_se")).select(F.col("entity").alias("e2"), F.col("start").alias("s2"), "n_se")
    pair = near.where("term <> ''").groupBy("entity", "term", "start").agg(F.count("*").alias("n_te"))
    pair = cut_lineage(pair.join(n_e, F.col("entity") == F.col("e1")).join(wide, (F.col("entity") == F.col("e2")) & (F.col("start") == F.col("s2"))).drop("e1", "e2", "s2"))
    names = pair.select(F.explode(F.array("term", "start")).alias("name")).distinct()
    bits = bitmap(names.select(F.xxhash64("name").alias("h")), "h")
    if not bits.any():
        return pair.select("entity", "term", F.lit(0.0).alias("disclosure"), F.lit(False).alias("general")).limit(0)
    n_t = cut_lineage(term_counts(docs, bits, rule.general_chars).join(names.select(F.col("name").alias("term")), "term", "left_semi"))
    n_docs = docs.count()
    full = pair.join(n_t, "term").join(n_t.select(F.col("term").alias("start"), F.col("n_t").alias("n_s")), "start")

    def share(together, alone):
        return F.when(F.col("n_e") < n_docs, F.log2(F.col(together) * F.lit(float(n_docs)) / (F.col(alone) * F.col("n_e"))) / F.log2(F.lit(float(n_docs)) / F.col("n_e"))).otherwise(F.lit(0.0))

    return full.select("entity", "term", share("n_te", "n_t").alias("disclosure"), (share("n_se", "n_s") < rule.threshold).alias("general")).where(F.col("disclosure") >= rule.threshold)


def term_spans(s: str, base, terms: set[str]) -> list[tuple[int, int, str]]:
    """Occurrences of the terms outside base spans."""
    out, i = [], 0
    inside = sorted((a, b) for a, b, _ in base)
    top = 0
    for m in WORD.finditer(s):
        while i < len(inside) and inside[i][0] < m.end():
            top = max(top, inside[i][1])
            i += 1
        if m.group().lower() in terms and m.start() >= top:
            out.append((m.start(), m.end(), "term"))
    return out


def sanitise(docs: DataFrame, rule: DisclosureRule = DisclosureRule(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(rows, terms)``: rows as the pattern and method spans of every document, terms as what was disclosed.

    Rows: ``doc_id``, the counts by kind, ``base`` and ``spans`` (``kind:start:end`` joined by commas).
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = cut_lineage(find_base(d, rule))
    found = cut_lineage(disclosures(base, d, rule))
    # a disclosed term is taken out wherever it stands in a document that holds the entity, also far from it
    holds = base.where("doc_id IS NOT NULL").select("doc_id", F.explode(F.array_distinct("entity")).alias("entity")).distinct()
    named = cut_lineage(holds.join(found.select("entity", "term"), "entity").groupBy("doc_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).select(F.col("doc_id").alias("of"), "terms"))
    bits = bitmap(named, "of")
    if not bits.any():
        return base.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", F.col("base").alias("spans")), found
    shared = d.sparkSession.sparkContext.broadcast(bits)

    def maybe(batches):
        for batch in batches:
            ids = batch.column(0)
            yield batch.filter(pa.array(set_in(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)))

    few = small_batches(d).mapInArrow(maybe, d.schema)
    joined = few.join(named, few.doc_id == named.of).select("doc_id", "text", F.array_join("terms", " ").alias("terms"))

    def run(part, texts):
        out = []
        for t, terms in zip(texts, part.column(2).to_pylist()):
            s = t.decode("utf-8", "replace") if t else ""
            b = base_spans(s)
            out.append(spell(sorted(b + term_spans(s, b, set(terms.split(" "))), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))))
        return {"of": part.column(0), "own": [spell(base_spans(t.decode("utf-8", "replace") if t else "")) for t in texts], "all_spans": out}

    # rows that repeat an id with another text are told apart by their base spans
    more = map_texts(joined, "text", run, "of bigint, own string, all_spans string").groupBy("of", "own").agg(F.max("all_spans").alias("all_spans"))
    rows = base.join(more, (base.doc_id == more.of) & (base.base == more.own), "left")
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", F.coalesce("all_spans", "base").alias("spans")), found


def redact(s: str, spans: str, general: set[str], general_chars: int = 3) -> str:
    """Text with base spans as ``[kind]``, terms generalised to their beginning or removed."""
    out, at = [], 0
    for x in filter(None, spans.split(",")):
        kind, a, b = x.split(":")
        a, b = int(a), int(b)
        if b <= at:
            continue
        a = max(a, at)
        out.append(s[at:a])
        word = s[a:b]
        out.append(f"[{kind}]" if kind != "term" else word[:general_chars] + "*" if word.lower() in general else "")
        at = b
    return "".join(out) + s[at:]
