"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of the test items are counted over all documents. A rare n-gram of an item, one in at
most ``rare_docs`` or ``rare_share`` of the documents or the rarest of any ``window`` neighbouring ones of the item, is
a seed; so every stretch of an item long enough to reach the bound holds seeds, also where a third of
the corpus has copied the item or a part of it. Every occurrence of a seed places the item
on a stretch of the passage, and Smith-Waterman alignment of words (match 2, mismatch and gap -1)
scores the stretch, so edited and paraphrased copies count as well as exact ones.

A document is contaminated by an item whose score reaches ``min(share * best, passage)``, where
``best`` is the score of an exact copy of the whole item; ``passage`` catches long parts of long
items.

Items are a stated query set: they are taken in blocks of at most ``ITEM_BYTES`` of text, each
broadcast and run over all documents. No document text is shuffled.

Edge cases: null or empty texts and items, and items shorter than a seed, match nothing; repeated
items or rows each give their own result rows once; of equal scores the first place wins. Rows with
a null id are aligned too and come back with a null id. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_texts

ITEM_BYTES = 16 << 20
BEYOND_ASCII = re.compile(rb"\xe2\x80[\x80-\xbf]|\xc2[\x80-\xbf]|\xe3\x80[\x80-\x91]")
NOT_WORD = bytes(i for i in range(128) if not (chr(i).isalnum() or i == 95))
TO_SPACE = bytes.maketrans(NOT_WORD, b" " * len(NOT_WORD))
ALIGN_CELLS = 1 << 20


@dataclass(frozen=True)
class DecontamRule:
    seed_words: int = 3
    rare_share: float = 0.001
    rare_docs: int = 50
    share: float = 0.5
    passage: int = 30

    def window(self, n_words: int) -> int:
        """Neighbouring n-grams of an item of which one is a seed: a third of the words that reach its bound, so that edits leave a seed."""
        least = min(self.share * 2 * n_words, self.passage) / 2
        return max(1, int(least // 3) - self.seed_words + 1)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits, underscores and letters beyond ASCII.

    General and Latin-1 punctuation separates words like its ASCII kind.
    """
    if not text:
        return []
    if text.isascii():
        return text.lower().translate(TO_SPACE).split()
    low = text.decode("utf-8", "replace").lower().encode()
    if b"\xe2\x80" in low or b"\xc2" in low or b"\xe3\x80" in low:
        low = BEYOND_ASCII.sub(b" ", low)
    return low.translate(TO_SPACE).split()


class Items:
    """Test items of a block: their word numbers, and their n-grams as sorted keys."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int):
        self.n = n
        book: dict[bytes, int] = {}
        split = [words_of(t.encode() if t else None) for t in texts]
        keep = [i for i, w in enumerate(split) if len(w) >= n]
        self.ids = np.array([ids[i] for i in keep], np.int64)
        self.words = [np.array([book.setdefault(x, len(book)) for x in split[i]], np.int64) for i in keep]
        self.book = book
        self.base = len(book) + 1
        if self.base ** n >= 1 << 62:
            raise ValueError("too many words in a block of items for its n-gram keys; lower ITEM_BYTES")
        gram = [self.keys(w) for w in self.words]
        self.item = np.repeat(np.arange(len(gram)), [len(g) for g in gram])
        self.offset = np.concatenate([np.arange(len(g)) for g in gram] or [np.zeros(0, np.int64)])
        flat = np.concatenate(gram or [np.zeros(0, np.int64)])
        self.grams, self.which = np.unique(flat, return_inverse=True)
        self._index(np.ones(len(flat), bool))

    @classmethod
    def of(cls, state: dict) -> Items:
        """The same block from its plain fields, as they are broadcast."""
        it = cls.__new__(cls)
        it.__dict__.update(state)
        return it

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """One key per n-gram; -1 where a word is unknown."""
        m = len(ids) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        known = ids >= 0
        whole = known[:m].copy()
        for k in range(1, self.n):
            whole &= known[k:k + m]
        at = np.flatnonzero(whole)
        key = np.zeros(len(at), np.int64)
        for k in range(self.n):
            key = key * self.base + ids[at + k] + 1
        out = np.full(m, -1, np.int64)
        out[at] = key
        return out

    def _index(self, seed: np.ndarray) -> None:
        """Places (item, offset) of each gram that is a seed, in order of grams."""
        order = np.argsort(self.which, kind="stable")
        order = order[seed[order]]
        self.place_item, self.place_offset = self.item[order], self.offset[order]
        self.first = np.searchsorted(self.which[order], np.arange(len(self.grams) + 1))

    def choose_seeds(self, counts: dict[int, int], most: float, rule: DecontamRule) -> None:
        """Seeds are n-grams in at most ``most`` documents, and the rarest of every window of an item; ties are all seeds."""
        df = np.array([counts.get(i, 0) for i in range(len(self.grams))], np.int64)[self.which]
        seed = df <= most
        ends = np.searchsorted(self.item, np.arange(len(self.words) + 1))
        for i, words in enumerate(self.words):
            own = df[ends[i]:ends[i + 1]]
            wide = np.lib.stride_tricks.sliding_window_view(own, min(rule.window(len(words)), len(own)))
            at = np.arange(len(wide))[:, None] + np.arange(wide.shape[1])
            seed[ends[i] + at[wide == wide.min(axis=1, keepdims=True)]] = True
        self._index(seed)

    def find(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts end to end, the text of each word, and hits (word position, gram)."""
        get = self.book.get
        coded, lens = [], []
        for t in texts:
            w = words_of(t)
            coded.append(np.fromiter(map(get, w, repeat(-1)), np.int64, len(w)))
            lens.append(len(w))
        ids = np.concatenate(coded or [np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(texts)), lens)
        key = self.keys(ids)
        pos = np.flatnonzero(key >= 0)
        pos = pos[owner[pos] == owner[pos + self.n - 1]]
        at = np.searchsorted(self.grams, key[pos])
        at = np.minimum(at, max(len(self.grams) - 1, 0))
        hit = self.grams[at] == key[pos] if len(self.grams) else np.zeros(len(pos), bool)
        return ids, owner, pos[hit], at[hit]


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row pair and the window word it ends at. Padding must not match."""
    rows, width = windows.shape
    prev = np.zeros((rows, width + 1), np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    ramp = np.arange(width + 1, dtype=np.int32)
    for i in range(items.shape[1]):
        now = np.zeros_like(prev)
        np.maximum(prev[:, :-1] + np.where(windows == items[:, i:i + 1], 2, -1), prev[:, 1:] - 1, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        prev = np.maximum.accumulate(now + ramp, axis=1) - ramp
        at = prev.argmax(axis=1)
        top = prev[np.arange(rows), at]
        better = top > best
        best[better], end[better] = top[better], at[better] - 1
    return best, end


def candidates(it: Items, owner: np.ndarray, pos: np.ndarray, gram: np.ndarray):
    """Distinct stretches (text, item, first word, width) on which seeds place an item."""
    n = it.first[gram + 1] - it.first[gram]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(it.first[gram], n) + step
    item = it.place_item[place]
    size = np.array([len(w) for w in it.words], np.int64)[item] if len(item) else np.zeros(0, np.int64)
    stride = size // 2 + 1
    start = np.repeat(pos, n) - it.place_offset[place]
    # windows are laid out from a text's own first word, so that its neighbours in a batch do not matter
    text = np.repeat(owner[pos], n)
    first_word = np.searchsorted(owner, text)
    cell = (start - first_word) // stride
    if not len(item):
        return text, item, start, size
    key = np.unique(np.stack([text, item, cell], axis=1), axis=0)
    size = np.array([len(w) for w in it.words], np.int64)[key[:, 1]]
    slack = size // 3 + 2
    stride = size // 2 + 1
    return key[:, 0], key[:, 1], np.searchsorted(owner, key[:, 0]) + key[:, 2] * stride - slack, size + stride + 2 * slack


def score(it: Items, ids: np.ndarray, owner: np.ndarray, text, item, start, width):
    """Alignment scores of stretches, in blocks of similar size."""
    best, end = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    order = np.argsort(width, kind="stable")
    at = 0
    while at < len(order):
        rows = max(1, ALIGN_CELLS // int(width[order[at]] + 1))
        part = order[at:at + rows]
        wide, long = int(width[part].max()), max(len(it.words[i]) for i in item[part])
        spot = start[part][:, None] + np.arange(wide)[None, :]
        inside = (spot >= 0) & (spot < len(ids)) & (np.arange(wide)[None, :] < width[part][:, None])
        spot = np.where(inside, spot, 0)
        windows = np.where(inside & (owner[spot] == text[part][:, None]), ids[spot], -1)
        items = np.full((len(part), long), -2, np.int64)
        for row, i in enumerate(item[part]):
            items[row, :len(it.words[i])] = it.words[i]
        s, e = align(items, windows)
        best[part], end[part] = s, start[part] + e
        at += rows
    return best, end


def found(it: Items, texts: list[bytes | None], rule: DecontamRule):
    """``(text, item, score, best possible, last word)``: the best alignment of each text and item that reaches the bound."""
    ids, owner, pos, gram = it.find(texts)
    text, item, start, width = candidates(it, owner, pos, gram)
    s, end = score(it, ids, owner, text, item, start, width)
    full = 2 * np.array([len(w) for w in it.words], np.int64)[item] if len(item) else np.zeros(0, np.int64)
    good = np.flatnonzero(s >= np.minimum(rule.share * full, rule.passage))
    good = good[np.lexsort((end[good], -s[good], item[good], text[good]))]
    pair = text[good] * max(len(it.ids), 1) + item[good]
    good = good[np.concatenate(([True], pair[1:] != pair[:-1]))] if len(good) else good
    return text[good], item[good], s[good], full[good], end[good] - np.searchsorted(owner, text[good])


def gram_counts(docs: DataFrame, it: Items) -> dict[int, int]:
    """In how many documents each n-gram of the block occurs; as many rows as the block has n-grams at most."""
    shared = docs.sparkSession.sparkContext.broadcast(it.__dict__)

    def run(part, texts):
        it = Items.of(shared.value)
        _, owner, pos, gram = it.find(texts)
        n = len(it.grams)
        pair = np.unique(owner[pos] * max(n, 1) + gram)
        count = Counter((pair % max(n, 1)).tolist())
        return {"gram": list(count.keys()), "n": list(count.values())}

    return {r[0]: r[1] for r in map_texts(docs.select("text"), "text", run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n")).collect()}


def item_blocks(docs: DataFrame, benchmark: DataFrame, rule: DecontamRule, item_bytes: int):
    """Broadcasts of the items, block by block, seeds chosen by their counts over ``docs(text)``."""
    b = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // item_bytes))
    n_docs = docs.count()
    for k in range(blocks):
        rows = b.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        it = Items([r[0] for r in rows], [r[1] for r in rows], rule.seed_words)
        it.choose_seeds(gram_counts(docs, it), max(rule.rare_docs, rule.rare_share * n_docs), rule)
        yield docs.sparkSession.sparkContext.broadcast(it.__dict__)


def leaks(docs: DataFrame, benchmark: DataFrame, rule: DecontamRule = DecontamRule(), id_col: str = "doc_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(doc_id, item_id, score, share, end_word)``: the best alignment of each document and item that reaches the bound."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for shared in item_blocks(d, benchmark, rule, item_bytes):
        def run(part, texts, shared=shared):
            it = Items.of(shared.value)
            text, item, s, full, end = found(it, texts, rule)
            return {"doc_id": part.column(0).take(pa.array(text)), "item_id": it.ids[item], "score": s, "share": s / full, "end_word": end}

        got = map_texts(d, "text", run, "doc_id bigint, item_id bigint, score bigint, share double, end_word bigint")
        out = got if out is None else out.union(got)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rule: DecontamRule = DecontamRule(), text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents that no test item contaminates, with all their columns."""
    out = docs
    for shared in item_blocks(docs.select(F.col(text_col).alias("text")), benchmark, rule, item_bytes):
        def clean(texts, shared=shared):
            mask = np.ones(len(texts), bool)
            mask[found(Items.of(shared.value), texts, rule)[0]] = False
            return mask

        out = keep_rows(out, clean, text_col)
    return out
