"""Reversible line deduplication: sharded cuckoo filters before exact reference-count tables.

State is three tables: ``postings(key, doc_id)``, the exact ``refs(key, n, last)`` with the number
of documents that hold a line and the largest of their ids, and ``filters(shard, n, m, cells)``, a
cuckoo filter per shard over the keys whose count reaches the threshold. Inserting documents adds
postings, raises counts and puts newly frequent keys into their shard's filter; deleting documents
lowers counts, takes keys from the filter and moves ``last`` back, so the result after a deletion
is the same as if the documents had never been there.

To apply it, lines are first asked of the filters, which drops nearly all of them before any
shuffle, and the few that pass are decided by an equi-join with the exact counts. Filters are
broadcast only while they hold at most ``FILTER_BYTES``; beyond that the join decides alone.

A key is the line without ASCII white space at its ends and with A-Z lower-cased, as a 128-bit hash.

Edge cases: null and empty texts are one empty line; rows that repeat an id count as one document;
a row with a null id is no holder and counts for nothing, but loses frequent lines like any other;
ties cannot occur, as the largest id is unique. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

from .common import bitmap, map_texts, set_in, small_batches

SPACE = b" \t\n\v\f\r"
FILTER_BYTES = 64 << 20
SLOTS = 4
KICKS = 500


# -- cuckoo filter of one shard -----------------------------------------------------------------

def places(keys: list[bytes], m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (never 0) and the two bucket numbers of 16-byte keys; m is a power of two."""
    raw = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    mark = (raw[:, 0] >> np.uint64(48)).astype(np.uint32)
    mark = np.where(mark == 0, 1, mark).astype(np.uint32)
    one = (raw[:, 1] & np.uint64(m - 1)).astype(np.int64)
    return mark, one, one ^ other(mark, m)


def other(mark, m: int):
    """What separates the two buckets of a fingerprint."""
    return (np.asarray(mark, np.int64) * 0x5BD1E995 >> 7) & (m - 1)


def empty_filter(n: int) -> np.ndarray:
    m = 1
    while m * SLOTS * 0.8 < max(n, 1):
        m *= 2
    return np.zeros((m, SLOTS), np.uint16)


def filter_insert(cells: np.ndarray, keys: list[bytes]) -> bool:
    """Put the keys in; False if an entry found no place and the shard must be rebuilt larger."""
    if not keys:
        return True
    m = len(cells)
    for mark, a, b in zip(*(x.tolist() for x in places(keys, m))):
        at = a
        for turn in range(KICKS):
            free = np.flatnonzero(cells[at] == 0)
            if not len(free) and turn == 0:
                at = b
                free = np.flatnonzero(cells[at] == 0)
            if len(free):
                cells[at, free[0]] = mark
                break
            slot = turn % SLOTS
            mark, cells[at, slot] = int(cells[at, slot]), mark
            at ^= int(other(mark, m))
        else:
            return False
    return True


def filter_delete(cells: np.ndarray, keys: list[bytes]) -> None:
    """Take out one entry of each key; the key must have been put in before."""
    if not keys:
        return
    for mark, a, b in zip(*(x.tolist() for x in places(keys, len(cells)))):
        for at in (a, b):
            held = np.flatnonzero(cells[at] == mark)
            if len(held):
                cells[at, held[0]] = 0
                break


def filter_holds(cells: np.ndarray, keys: list[bytes]) -> np.ndarray:
    if not keys:
        return np.zeros(0, bool)
    mark, a, b = places(keys, len(cells))
    return (cells[a] == mark[:, None]).any(axis=1) | (cells[b] == mark[:, None]).any(axis=1)


def rebuilt(keys: list[bytes]) -> np.ndarray:
    room = len(keys)
    while True:
        cells = empty_filter(room)
        if filter_insert(cells, keys):
            return cells
        room = 2 * len(cells) * SLOTS


# -- tables --------------------------------------------------------------------------------------

@dataclass(frozen=True)
class LineState:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int


def line_key(line: bytes, min_chars: int) -> bytes | None:
    plain = line.strip(SPACE)
    if len(plain) < min_chars:
        return None
    if not plain.isascii() and len(plain.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(plain.lower())


def line_rows(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its number of lines, the hash of the whole text and its distinct keys."""
    def run(part, texts):
        n, sha, keys = [], [], []
        for t in texts:
            t = t or b""
            lines = t.split(b"\n")
            n.append(len(lines))
            sha.append(hashlib.sha256(t).hexdigest())
            keys.append(sorted({k for x in lines if (k := line_key(x, min_chars))}))
        return {"doc_id": part.column(0), "n_lines": n, "sha": sha, "keys": pa.array(keys, pa.list_(pa.binary()))}

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", run, "doc_id bigint, n_lines bigint, sha string, keys array<binary>")


def postings_of(rows: DataFrame) -> DataFrame:
    return rows.where("doc_id IS NOT NULL").select(F.explode("keys").alias("key"), "doc_id")


def counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last"))


def shard_of(key: str, shards: int):
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def build_filters(frequent: DataFrame, shards: int) -> DataFrame:
    """One filter per shard over ``frequent(key)``; a shard's size is its share of the frequent keys."""
    def run(pdf):
        keys = sorted(bytes(k) for k in pdf["key"])
        cells = rebuilt(keys)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "n": [len(keys)], "m": [len(cells)], "cells": [cells.tobytes()]})

    return frequent.select(shard_of("key", shards).alias("shard"), "key").groupBy("shard").applyInPandas(run, "shard int, n long, m long, cells binary")


def change_filters(filters: DataFrame, changes: DataFrame, refs: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """Apply ``changes(key, add)``; a shard that overflows is rebuilt from the exact counts."""
    def run(key, held, todo):
        cells = np.frombuffer(held["cells"].iloc[0], np.uint16).reshape(-1, SLOTS).copy() if len(held) else empty_filter(64)
        n = int(held["n"].iloc[0]) if len(held) else 0
        new, gone = ([bytes(k) for k in todo["key"][todo["add"] == a]] for a in (True, False))
        filter_delete(cells, gone)
        good = n + len(new) <= 0.9 * cells.size and filter_insert(cells, new)
        return pd.DataFrame({"shard": [int(key[0])], "n": [n + len(new) - len(gone)], "m": [len(cells) if good else -1], "cells": [cells.tobytes() if good else b""]})

    by = changes.select(shard_of("key", shards).alias("shard"), "key", "add")
    got = cut_lineage(filters.groupBy("shard").cogroup(by.groupBy("shard")).applyInPandas(run, "shard int, n long, m long, cells binary"))
    full = got.where("m < 0").select("shard")
    again = refs.where(F.col("n") >= min_docs).select("key", shard_of("key", shards).alias("of")).join(full, F.col("of") == F.col("shard"), "left_semi")
    return got.where("m > 0").union(build_filters(again.select("key"), shards))


def insert(docs_rows: DataFrame, state: LineState | None = None, shards: int = 64, min_docs: int = 5) -> LineState:
    """State with the lines of ``docs_rows`` (from ``line_rows``) added."""
    new = postings_of(docs_rows)
    if state is None:
        refs = cut_lineage(counted(new))
        return LineState(new, refs, cut_lineage(build_filters(refs.where(F.col("n") >= min_docs), shards)), shards, min_docs)
    new = cut_lineage(new.distinct().join(state.postings, ["key", "doc_id"], "left_anti"))
    more = counted(new).select("key", F.col("n").alias("n2"), F.col("last").alias("last2"))
    refs = cut_lineage(state.refs.join(more, "key", "full").select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("last", "last2").alias("last"), F.coalesce("n", F.lit(0)).alias("was")))
    changes = refs.where((F.col("n") >= state.min_docs) & (F.col("was") < state.min_docs)).select("key", F.lit(True).alias("add"))
    refs = refs.select("key", "n", "last")
    return LineState(cut_lineage(state.postings.union(new)), refs, cut_lineage(change_filters(state.filters, changes, refs, state.shards, state.min_docs)), state.shards, state.min_docs)


def delete(ids: DataFrame, state: LineState) -> LineState:
    """State as if the documents ``ids(doc_id)`` had never been inserted."""
    gone = cut_lineage(state.postings.join(ids, "doc_id", "left_semi").select("key", "doc_id").distinct())
    left = cut_lineage(state.postings.join(ids, "doc_id", "left_anti").select("key", "doc_id"))
    hit = cut_lineage(gone.select("key").distinct())
    now = cut_lineage(counted(left.join(hit, "key", "left_semi")))
    changes = hit.join(state.refs.where(F.col("n") >= state.min_docs), "key", "left_semi").join(now.where(F.col("n") >= state.min_docs), "key", "left_anti").select("key", F.lit(False).alias("add"))
    refs = cut_lineage(state.refs.join(hit, "key", "left_anti").select("key", "n", "last").union(now.select("key", "n", "last")))
    return LineState(left, refs, cut_lineage(change_filters(state.filters, changes, refs, state.shards, state.min_docs)), state.shards, state.min_docs)


def frequent_lines(rows: DataFrame, state: LineState, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``(doc_id, sha, key)`` of lines to drop: exact, after the filters have cleared the way."""
    asked = rows.select("doc_id", "sha", F.explode("keys").alias("key"))
    size = state.filters.agg(F.sum(F.length("cells"))).first()[0] or 0
    if size <= filter_bytes:
        shards = state.shards
        held = {r["shard"]: np.frombuffer(bytes(r["cells"]), np.uint16).reshape(-1, SLOTS) for r in state.filters.select("shard", "cells").collect()}
        shared = rows.sparkSession.sparkContext.broadcast(held)

        def run(batches):
            for batch in batches:
                keys = batch.column(2).to_pylist()
                if not keys:
                    continue
                shard = batch.column(3).to_numpy()
                keep = np.zeros(len(keys), bool)
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    cells = shared.value.get(int(shard[part[0]]))
                    if cells is not None:
                        keep[part] = filter_holds(cells, [keys[i] for i in part])
                yield batch.filter(pa.array(keep)).select([0, 1, 2])

        asked = small_batches(asked.withColumn("shard", shard_of("key", shards))).mapInArrow(run, "doc_id long, sha string, key binary")
    exact = state.refs.where(F.col("n") >= state.min_docs).select(F.col("key").alias("k"), "last")
    return asked.join(exact, F.col("key") == F.col("k")).where("NOT (doc_id <=> last)").select("doc_id", "sha", "key")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, state: LineState | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(rows, texts)``: per document ``n_lines, n_dropped, kept_sha256``; the new text where lines were dropped.

    Without a state, the documents themselves are inserted into an empty one.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut_lineage(line_rows(d, min_chars))
    state = state or insert(rows, min_docs=min_docs)
    lost = cut_lineage(frequent_lines(rows, state).groupBy("doc_id", "sha").agg(F.collect_set("key").alias("drop")))
    bits = bitmap(lost.select(F.coalesce("doc_id", F.lit(0)).alias("h")), "h")
    shared = d.sparkSession.sparkContext.broadcast(bits)

    def maybe(part, texts):
        keep = set_in(shared.value, part.column(0).fill_null(0).to_numpy(zero_copy_only=False))
        few = part.filter(pa.array(keep))
        return {"of": few.column(0), "sha2": [hashlib.sha256(t or b"").hexdigest() for t, k in zip(texts, keep) if k], "text": few.column(1)}

    # equal rows give equal results, so one of each is enough
    few = map_texts(d, "text", maybe, "of bigint, sha2 string, text string")
    todo = few.join(lost, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("sha2") == F.col("sha"))).select("of", "sha2", "text", "drop")

    def run(part, texts):
        kept, dropped = [], []
        for t, drop in zip(texts, part.column(3).to_pylist()):
            gone = set(drop)
            lines = (t or b"").split(b"\n")
            left = [x for x in lines if line_key(x, min_chars) not in gone]
            kept.append(b"\n".join(left))
            dropped.append(len(lines) - len(left))
        return {"of": part.column(0), "sha2": part.column(1), "n_dropped": dropped, "kept": [k.decode("utf-8", "replace") for k in kept], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}

    texts = map_texts(todo, "text", run, "of bigint, sha2 string, n_dropped bigint, kept string, kept_sha256 string")
    small = texts.groupBy("of", "sha2").agg(F.first("n_dropped").alias("n_dropped"), F.first("kept_sha256").alias("kept_sha256"))
    out = rows.drop("keys").join(small, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("sha2")), "left")
    return (out.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")),
            texts.select(F.col("of").alias("doc_id"), "kept"))
