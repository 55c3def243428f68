"""Chat formatting by columnar byte assembly.

A batch of turns is one text buffer and one offsets buffer. Control strings inside the texts are
found on the bytes of the whole batch, every turn becomes a header, an escaped content and a footer,
their lengths give cumulative offsets, and headers and contents are scattered by index into one
preallocated Arrow buffer. There is no work per turn in Python but for the few distinct roles.

Template, per conversation: ``<s>``, then per turn ``<|im_start|>role\\n``, the text, ``<|im_end|>\\n``,
then ``</s>``. Inside texts and roles a backslash is doubled and a backslash is put after the first
character of a control string, so no control string stands in a text and the text can be read back;
in a role a line feed becomes a backslash and the letter n. The loss mask is the spans, in code
points of the formatted text, of assistant contents.

Rows are streamed in the order of (conversation, turn). A conversation longer than ``PART_BYTES`` is
returned in several rows, numbered by ``part``, so that no task holds it whole.

Edge cases: null texts and roles are empty; turns that tie are ordered by role, then text, and
repeated rows are kept; null turns come first; rows with a null conversation id form one
conversation with a null id. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_schema, small_batches

# Strings that open, close or mark turns in common chat templates.
CONTROLS = [b"<|im_start|>", b"<|im_end|>", b"<s>", b"</s>", b"[INST]", b"[/INST]", b"<<SYS>>", b"<</SYS>>", b"<|endoftext|>"]
OPEN, CLOSE, BEGIN, END = b"<|im_start|>", b"<|im_end|>\n", b"<s>", b"</s>"
ESC = 92
PART_BYTES = 16 << 20


def escape_role(role: bytes) -> bytes:
    out = role.replace(b"\\", b"\\\\")
    for c in CONTROLS:
        out = out.replace(c, c[:1] + b"\\" + c[1:])
    return out.replace(b"\n", b"\\n")


def unescape(text: bytes, role: bool = False) -> bytes:
    """Undo the escapes of a text or role."""
    if b"\\" not in text:
        return text
    out = text.split(b"\\\\")
    if role:
        out = [x.replace(b"\\n", b"\n") for x in out]
    return b"\\".join(x.replace(b"\\", b"") for x in out)


def escape_places(data: np.ndarray, owner_end: np.ndarray) -> np.ndarray:
    """Byte positions after which a backslash goes; ``owner_end`` is the end of the text that holds a byte."""
    places = [np.flatnonzero(data == ESC)]
    for first in sorted({c[0] for c in CONTROLS}):
        at = np.flatnonzero(data == first)
        for c in (x for x in CONTROLS if x[0] == first):
            hit = at[at + len(c) <= owner_end[at]]
            for k in range(1, len(c)):
                hit = hit[data[hit + k] == c[k]]
            places.append(hit)
    return np.unique(np.concatenate(places))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, end to end."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def assemble(conv: np.ndarray, roles: list[bytes], text_offsets: np.ndarray, data: np.ndarray, opens: np.ndarray, closes: np.ndarray):
    """Formatted bytes of a batch of turns.

    ``opens`` and ``closes`` mark turns that begin and end their conversation; ``conv`` numbers the
    output rows. Returns the buffer, the byte offsets of the rows, and the byte spans of contents.
    """
    n = len(roles)
    size = np.diff(text_offsets)
    owner = np.repeat(np.arange(n), size)
    places = escape_places(data, np.repeat(text_offsets[1:] - text_offsets[0], size)) if len(data) else np.zeros(0, np.int64)
    added = np.bincount(owner[places], minlength=n) if len(places) else np.zeros(n, np.int64)
    book: dict[tuple[bytes, bool], int] = {}
    heads = []
    which = np.empty(n, np.int64)
    for i, (r, o) in enumerate(zip(roles, opens.tolist())):
        k = book.get((r, o))
        if k is None:
            k = book[(r, o)] = len(heads)
            heads.append((BEGIN if o else b"") + OPEN + escape_role(r) + b"\n")
        which[i] = k
    head_data = np.frombuffer(b"".join(heads), np.uint8)
    head_size = np.array([len(h) for h in heads] or [0], np.int64)
    head_start = np.cumsum(head_size) - head_size
    tails = [CLOSE, CLOSE + END]
    tail_data = np.frombuffer(b"".join(tails), np.uint8)
    tail_size = np.array([len(t) for t in tails], np.int64)
    tail_start = np.cumsum(tail_size) - tail_size
    ends = closes.astype(np.int64)
    # segments in order: header, content, footer of each turn
    lengths = np.stack([head_size[which] if n else np.zeros(0, np.int64), size + added, tail_size[ends]], axis=1)
    start = (np.cumsum(lengths) - lengths.ravel()).reshape(-1, 3) if n else np.zeros((0, 3), np.int64)
    out = np.full(int(lengths.sum()), ESC, np.uint8)
    out[spread(start[:, 0], lengths[:, 0])] = head_data[spread(head_start[which], lengths[:, 0])] if n else 0
    if len(data):
        shift = np.zeros(len(data), np.int64)
        later = places + 1
        np.add.at(shift, later[later < len(data)], 1)
        moved = np.cumsum(shift) - np.repeat(np.cumsum(added) - added, size)
        out[np.arange(len(data)) - np.repeat(text_offsets[:-1] - text_offsets[0], size) + np.repeat(start[:, 1], size) + moved] = data
    out[spread(start[:, 2], lengths[:, 2])] = tail_data[spread(tail_start[ends], lengths[:, 2])] if n else 0
    row_end = np.cumsum(lengths.sum(axis=1))
    last = np.concatenate((conv[1:] != conv[:-1], [True])) if n else np.zeros(0, bool)
    return out, np.concatenate(([0], row_end[last])), start[:, 1], lengths[:, 1]


def code_point_index(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points before each byte position."""
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return lead[at]


def format_batch(t: pa.Table, first_open: bool, last_close: bool):
    """Formatted rows of the turns of ``t``, sorted by conversation; the first may go on from, the last go on to, another batch."""
    conv = t.column("conv").to_numpy()
    null = t.column("no_conv").to_numpy()
    new = np.concatenate(([True], (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])))
    group = np.cumsum(new) - 1
    opens, closes = new.copy(), np.concatenate((new[1:], [True]))
    opens[0], closes[-1] = first_open, last_close
    texts = t.column("text").combine_chunks().cast(pa.large_binary())
    roles = [bytes(r) for r in t.column("role").combine_chunks().cast(pa.binary()).to_pylist()]
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    out, rows, c_start, c_size = assemble(group, roles, offsets, data, opens, closes)
    is_loss = np.array([r == b"assistant" for r in roles], bool)
    point = code_point_index(out, np.stack([c_start, c_start + c_size]))
    row_point = code_point_index(out, rows)
    spans = point - row_point[group]
    mask_off = np.concatenate(([0], np.cumsum(np.bincount(group, is_loss, minlength=int(group[-1]) + 1)))).astype(np.int32)
    listed = [pa.ListArray.from_arrays(pa.array(mask_off, pa.int32()), pa.array(s[is_loss], pa.int64())) for s in spans]
    formatted = pa.StringArray.from_buffers(len(rows) - 1, pa.py_buffer(rows.astype(np.int32)), pa.py_buffer(out))
    ids = [None if null[i] else int(conv[i]) for i in np.flatnonzero(new)]
    return pa.array(ids, pa.int64()), formatted, listed[0], listed[1]


def stretches(batches, part_bytes: int) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Whole conversations of sorted batches; one that outgrows ``part_bytes`` comes in pieces (table, begins, ends)."""
    carry: pa.Table | None = None
    begins = True
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        conv, null = t.column("conv").to_numpy(), t.column("no_conv").to_numpy()
        open_rows = int(((conv == conv[-1]) & (null == null[-1]))[::-1].cumprod().sum())
        cut = t.num_rows - open_rows
        if cut:
            yield t.slice(0, cut), begins, True
            begins = True
        carry = t.slice(cut)
        if carry.nbytes > part_bytes and carry.num_rows > 1:
            # all but the last row, so that the end of the conversation is known when it comes
            yield carry.slice(0, carry.num_rows - 1), begins, False
            begins, carry = False, carry.slice(carry.num_rows - 1)
    if carry is not None and carry.num_rows:
        yield carry, begins, True


def format_chats(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(conv_id, part, formatted, loss_start, loss_end)`` of every conversation of ``turns(conv_id, turn, role, text)``."""
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = as_schema("conv_id bigint, part int, formatted string, loss_start array<bigint>, loss_end array<bigint>")
    out = arrow_schema(schema)

    def run(batches):
        part = 0
        for t, begins, ends in stretches(batches, part_bytes):
            ids, formatted, a, b = format_batch(t, begins, ends)
            parts = np.zeros(len(ids), np.int32)
            part = 0 if begins else part + 1
            parts[0] = part
            part = part if len(ids) == 1 else 0
            yield pa.RecordBatch.from_arrays([ids, pa.array(parts), formatted, a.cast(out.field(3).type), b.cast(out.field(4).type)], schema=out)

    return small_batches(rows).repartition("conv", "no_conv").sortWithinPartitions("no_conv", "conv", "turn", "role", "text").mapInArrow(run, schema)


def read_turns(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """``(role, text)`` of each turn of a formatted row, unescaped."""
    for piece in formatted.split(OPEN)[1:]:
        head, _, rest = piece.partition(b"\n")
        body, mark, _ = rest.rpartition(CLOSE)
        yield unescape(head, role=True), unescape(body)


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of conversations, read back from the rows of ``format_chats`` (parts of one in order, in one partition)."""
    schema = as_schema("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    out = arrow_schema(schema)

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for conv, part, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if part == 0:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text.encode()):
                    state[1] += 1
                    state[2].update(role + b"\n" + said + b"\n")
                for a, b in zip(starts, ends):
                    plain = unescape(text[a:b].encode())
                    state[3] += len(plain.decode())
                    state[4].update(plain)
                state[5] += len(text)
            if done:
                yield close(done)
        if state is not None:
            yield close([state])

    def close(done):
        cols = list(zip(*done))
        cols[2], cols[4] = [h.hexdigest() for h in cols[2]], [h.hexdigest() for h in cols[4]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    return formatted.mapInArrow(run, schema)
