"""Repetition inside a text by suffix arrays.

The words of many texts are coded so that no two texts share a code and sorted in one suffix array
by prefix doubling; only suffixes still tied are sorted again. The longest-common-prefix of
neighbours follows from the ranks of the doubling rounds. At every text position the larger of its
two prefix lengths is the longest repeat that starts there, that is the value of the innermost
longest-common-prefix interval that holds the suffix. Intervals of at least ``min_words`` words are
the maximal repeats; their spans are united.

A text is kept if the base rules pass, the united spans cover no more than ``max_covered`` of its
words and no repeat is longer than ``max_repeat`` words.

Edge cases: null, empty and blank texts have zero counts and fail the base rules; repeated rows and
null ids keep one row each; a text of any length is handled whole, with memory in proportion to it;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRule:
    min_words: int = 8
    max_covered: float = 0.3
    max_repeat: int = 100
    base_min_words: int = 50
    base_repeat_percent: int = 50
    base_window: int = 3


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``ids`` and the ranks of each doubling round (round k ranks prefixes of 2^k).

    A rank is the number of suffixes that sort before the first of its group.
    """
    n = len(ids)
    counts = np.bincount(ids)
    rank = np.append((np.cumsum(counts) - counts)[ids], -1)
    rounds = [rank]
    active = np.flatnonzero(counts[ids] > 1)
    h = 1
    while len(active):
        own = rank[active]
        nxt = rank[np.minimum(active + h, n)] + 1
        key = own * (n + 1) + nxt
        order = np.argsort(key)
        key, own, pos = key[order], own[order], active[order]
        spot = np.arange(len(key))
        new_group = np.concatenate(([True], own[1:] != own[:-1]))
        new_run = np.concatenate(([True], key[1:] != key[:-1]))
        group_at = np.maximum.accumulate(np.where(new_group, spot, 0))
        run_at = np.maximum.accumulate(np.where(new_run, spot, 0))
        rank = rank.copy()
        rank[pos] = own + run_at - group_at
        rounds.append(rank)
        alone = new_run & np.concatenate((new_run[1:], [True]))
        active = pos[~alone]
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank[:n]] = np.arange(n)
    return sa, rounds


def neighbour_prefixes(sa: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """``lcp[r]``: words that suffixes ``sa[r - 1]`` and ``sa[r]`` share; ``lcp[0]`` is 0."""
    n = len(sa)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    tied = np.flatnonzero(rounds[0][sa[:-1]] == rounds[0][sa[1:]]) + 1
    a, b = sa[tied - 1].copy(), sa[tied].copy()
    got = np.zeros(len(tied), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        same = (rounds[k][a] == rounds[k][b])
        step = same.astype(np.int64) << k
        got += step
        a = np.minimum(a + step, n)
        b = np.minimum(b + step, n)
    lcp[tied] = got
    return lcp


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions the spans cover."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:n]) > 0


def repeats(word_lists: list[list[bytes]], window: int, min_words: int) -> dict[str, np.ndarray]:
    """Per list: words in windows found twice, words in maximal repeats, longest repeat, number of repeat intervals."""
    lens = np.fromiter(map(len, word_lists), np.int64, len(word_lists))
    total = int(lens.sum())
    out = {k: np.zeros(len(lens), np.int64) for k in ("window", "covered", "longest", "intervals")}
    if not total:
        return out
    codes, top = np.empty(total, np.int64), 0
    at = 0
    for w in word_lists:
        book: dict[bytes, int] = {}
        codes[at:at + len(w)] = np.fromiter((book.setdefault(x, len(book)) for x in w), np.int64, len(w)) + top
        top += len(book)
        at += len(w)
    sa, rounds = suffix_array(codes)
    lcp = neighbour_prefixes(sa, rounds)
    best = np.empty(total, np.int64)
    best[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    owner = np.repeat(np.arange(len(lens)), lens)
    for name, least, spans in (("window", window, np.full(total, window)), ("covered", min_words, best)):
        starts = np.flatnonzero(best >= least)
        out[name] = np.bincount(owner[covered(starts, spans[starts], total)], minlength=len(lens))
    np.maximum.at(out["longest"], owner, best)
    opens = (lcp >= min_words) & np.concatenate(([True], lcp[:-1] < min_words))
    out["intervals"] = np.bincount(owner[sa[opens]], minlength=len(lens))
    return out


def measure(texts: list[bytes | None], rule: RepetitionRule) -> dict[str, np.ndarray]:
    """Counts and verdict of whole texts."""
    words = [t.split() if t else [] for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    chars, symbols, dup = (np.zeros(len(texts), np.int64) for _ in range(3))
    for i, t in enumerate(texts):
        if not t:
            continue
        solid = t.translate(None, SPACE)
        chars[i] = len(solid.decode("utf-8", "replace"))
        symbols[i] = len(solid) - len(solid.translate(None, SYMBOLS))
        lines = [x for x in t.split(b"\n") if x.strip(SPACE)]
        dup[i] = len(lines) - len(set(lines))
    r = repeats(words, rule.base_window, rule.min_words)
    failed = (n < rule.base_min_words) | (100 * r["window"] > rule.base_repeat_percent * n)
    share = r["covered"] / np.maximum(n, 1)
    kept = ~failed & (share <= rule.max_covered) & (r["longest"] <= rule.max_repeat)
    return {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": r["window"], "base_failed": failed, "kept": kept,
            "covered_fraction": share, "longest_repeat": r["longest"], "n_repeats": r["intervals"]}


def repetition_quality(docs: DataFrame, rule: RepetitionRule = RepetitionRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, repeat measures and the verdict of every row."""
    def run(part, texts):
        return {"doc_id": part.column(0), **{k: pa.array(v) for k, v in measure(texts, rule).items()}}

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", run,
                     "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
                     "kept boolean, covered_fraction double, longest_repeat bigint, n_repeats bigint")
