"""Exact token counts at every prefix of every text, by dynamic programming over prefixes.

Byte-pair encodings are closed under prefixes: the encoding of a prefix is the encoding of a shorter
one plus a last token, and of all pieces that end at a position exactly one may follow the last token
of what stands before it, namely the one for which the two texts together still encode to these two
tokens. So a left-to-right pass finds, for each prefix, its last token and from it

    count[i] = count[i - length of the last token] + tokens of the last token (bytes, if it has no piece)

No piece holds a mark of white space after another character, so a text falls into stretches (white
space and what follows it) whose counts add up. Stretches are worked out in sorted order, so that a
prefix shared with the stretch before is not computed again, and kept in a bounded cache per worker.

A text's table is the change of the count from each code point to the next, one signed byte per code
point (four bytes each in texts where a change does not fit). Truncation and budget questions are
answered from this table; texts are not encoded again.

Edge cases: null and empty texts have an empty table and no tokens; a text without white space is one
long stretch, worked through once in linear time; repeated rows and null ids are counted row by row;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
# stretches and pairs of tokens that a worker keeps; longer stretches are not kept
CACHE, CACHED_CHARS, PAIRS = 200_000, 48, 1_000_000
TABLE = "doc_id bigint, n_bytes bigint, n_chars bigint, deltas binary"
_LOADED: dict[str, PrefixCounter] = {}


class PrefixCounter:
    """Token counts of prefixes under one piece model."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.sp.get_piece_size()
        odd = {i for i in range(n) if self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)}
        self.ids = {self.sp.id_to_piece(i): i for i in range(n) if i not in odd}
        self.longest = max(map(len, self.ids), default=1)
        held = set("".join(self.ids))
        # a character of no piece merges with nothing, so what follows it is encoded as if alone
        self.apart = next(c for c in map(chr, [10, *range(0xE000, 0xF8FF)]) if c not in held)
        self.skip = len(self.sp.encode(self.apart))
        if any(MARK in p.lstrip(MARK) for p in self.ids) or self.sp.encode(f"a{MARK}b") != self.sp.encode("a b"):
            raise ValueError("a piece holds white space after another character: texts do not fall into stretches")
        self.starts = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        # per token (empty: the beginning) the tokens tried after it
        self.after: dict[str, dict[str, bool]] = {}
        self.tried = 0
        # per longest beginning of a piece that ends somewhere, and the next character: that after it, and the tokens that may end there
        self.steps: dict[str, tuple[str, tuple[tuple[int, str, int], ...]]] = {}
        self.kept: dict[str, bytes] = {}

    def tokens(self, text: str) -> list[int]:
        """Tokens of ``text`` as it stands, without the leading mark."""
        return self.sp.encode(self.apart + text)[self.skip:]

    def token(self, piece: str) -> list[int]:
        """The token of a piece, or the bytes of a character without one."""
        return [self.ids[piece]] if piece in self.ids else self.tokens(piece)

    def step(self, begun: str) -> tuple[str, tuple[tuple[int, str, int], ...]]:
        """The longest end of ``begun`` that begins a piece, and the tokens ``(length, piece, count)`` that are ends of it, longest first."""
        ends = [begun[j:] for j in range(len(begun))]
        may = tuple((len(e), e, len(self.token(e))) for e in ends if e in self.ids or len(e) == 1)
        got = self.steps[begun] = (next((e for e in ends if e in self.starts), ""), may)
        return got

    def follows(self, last: str, piece: str) -> bool:
        """Whether ``piece`` can be the token after the token ``last`` (empty: the first)."""
        self.tried += 1
        ok = self.tokens(last + piece) == ([*self.token(last), *self.token(piece)] if last else self.token(piece))
        self.after.setdefault(last, {})[piece] = ok
        return ok

    def learn(self, stretches: list[str]) -> dict[str, bytes]:
        """Changes of the count along each stretch; a prefix that two sorted neighbours share is worked out once."""
        if self.tried + len(self.steps) > PAIRS:
            self.after, self.steps, self.tried = {}, {}, 0
        out: dict[str, bytes] = {}
        steps, after = self.steps, self.after
        before, count, last, begun, change = "", [0], [""], [""], bytearray()
        wide = 0                                     # after so many characters a change does not fit a byte
        for s in sorted(stretches):
            same = 0
            for a, b in zip(before, s):
                if a != b:
                    break
                same += 1
            del count[same + 1:], last[same + 1:], begun[same + 1:], change[same:]
            wide = wide if wide <= same else 0
            state = begun[same]
            for i in range(same, len(s)):
                key = state + s[i]
                state, may = steps.get(key) or self.step(key)
                for n, piece, made in may:
                    prev = last[i + 1 - n]
                    ok = after[prev].get(piece) if prev in after else None
                    if ok or (ok is None and self.follows(prev, piece)):
                        break
                else:
                    raise ValueError(f"no token ends after {key!r}: the model is not closed under prefixes")
                now = count[i + 1 - n] + made
                d = now - count[i]
                wide = wide or (0 if -128 <= d <= 127 else i + 1)
                change.append(d & 255)
                count.append(now)
                last.append(piece)
                begun.append(state)
            out[s] = np.diff(np.array(count, np.int64)).astype("<i4").tobytes() if wide else bytes(change)
            before = s
        return out

    def deltas(self, texts: list[bytes | None]) -> list[bytes]:
        """The table of each text."""
        split = [STRETCH.findall(MARK + t.decode().replace(" ", MARK)) if t else [] for t in texts]
        if len(self.kept) > CACHE:
            self.kept = {}
        known = self.kept
        new = {s for words in split for s in words if s not in known}
        got = self.learn(list(new))
        if len(got) + len(known) <= 2 * CACHE:
            known.update((s, d) for s, d in got.items() if len(d) == len(s) <= CACHED_CHARS)
        wide = {s for s, d in got.items() if len(d) != len(s)}
        out = []
        for words in split:
            if not words:
                out.append(b"")
                continue
            parts = [d if (d := known.get(s)) is not None else got[s] for s in words]
            if not wide or wide.isdisjoint(words):
                table = b"".join(parts)
                lead = int.from_bytes(table[:1], "little", signed=True) + int.from_bytes(table[1:2], "little", signed=True)
                out.append(lead.to_bytes(1, "little", signed=True) + table[2:])
            else:
                d = np.concatenate([np.frombuffer(d, "<i4" if s in wide else np.int8).astype("<i4") for d, s in zip(parts, words)])
                d[1] += d[0]
                out.append(d[1:].tobytes())
        return out


def counter(model: str) -> PrefixCounter:
    """The counter of a worker; ``model`` is a file, or the name of a public vocabulary."""
    if model not in _LOADED:
        path = model
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(model)
        _LOADED[model] = PrefixCounter(path)
    return _LOADED[model]


def counts(deltas: bytes, n_chars: int) -> np.ndarray:
    """Tokens of every prefix, the empty one first."""
    d = np.frombuffer(deltas, np.int8 if len(deltas) == n_chars else "<i4")
    return np.concatenate(([0], np.cumsum(d, dtype=np.int64)))


def prefix_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_chars, deltas)``: the table of every whole text."""
    def run(part, texts):
        tables = counter(model).deltas(texts)
        return {"doc_id": part.column(0), "n_bytes": [len(t or b"") for t in texts],
                "n_chars": [len(t) - int(np.count_nonzero((np.frombuffer(t, np.uint8) & 0xC0) == 0x80)) if t else 0 for t in texts], "deltas": pa.array(tables, pa.binary())}

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", run, TABLE)


def _answer(prefixes: DataFrame, fn, column: str, *extra: str) -> DataFrame:
    """One number per row from its table; ``fn(counts, *extra values)``."""
    def run(batches):
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3, 3 + len(extra))]
            at = batch.column(2)
            got = [fn(counts(at[i].as_py(), n), *(c[i] for c in cols)) for i, n in enumerate(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64()), *(batch.column(i) for i in range(3, 3 + len(extra)))], names=["doc_id", column, *extra])

    types = dict(prefixes.dtypes)
    return small_batches(prefixes.select("doc_id", "n_chars", "deltas", *extra)).mapInArrow(run, f"doc_id bigint, {column} bigint" + "".join(f", {c} {types[c]}" for c in extra))


def totals(prefixes: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_bytes)``: the count at the longest prefix."""
    return _answer(prefixes, lambda c, _: int(c[-1]), "n_tokens", "n_bytes")


def truncation(prefixes: DataFrame, budget: int) -> DataFrame:
    """``(doc_id, keep_chars)``: code points of the longest prefix that has at most ``budget`` tokens."""
    return _answer(prefixes, lambda c: int(np.flatnonzero(c <= budget)[-1]) if budget >= 0 else 0, "keep_chars")


def tokens_at(prefixes: DataFrame, points: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, at_chars)``: tokens of the first ``at_chars`` code points, for the rows of ``points(doc_id, at_chars)``; beyond the end, of the whole text."""
    asked = points.select("doc_id", F.col("at_chars").cast("long").alias("at_chars")).where("at_chars IS NOT NULL")
    return _answer(prefixes.join(asked, "doc_id"), lambda c, at: int(c[min(max(at, 0), len(c) - 1)]), "n_tokens", "at_chars")
