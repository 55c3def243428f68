"""Cheapest repair of damaged conversations, by an automaton of shared signature suffixes.

A conversation is reduced to a signature: one symbol per row, made of its role's initial and whether the
row is cut short or has to go (blank or repeated). What remains to be paid from a row on depends only on
the rest of the signature and on the state of the grammar ``(s?(ua)+)?`` of role initials. So equal
suffixes of all signatures are one node of an automaton, built from the end: for each node and grammar
state the cost-to-go and the first edit of the best audit suffix are computed once.

On Spark, the distinct signatures are dealt by ranges of their reversal and sorted, so that signatures
with a common suffix stand next to each other: a task holds the chain of nodes of the current signature
as a stack, goes back to the suffix shared with the next one, and adds the nodes that are new. Only
suffixes that straddle a range are worked out in more than one task. Audits are joined back by signature.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3; required of blank and repeated rows) and
Insert of an empty user or assistant turn (2, anywhere); rows cut short that stay add 1. From a grammar
state at most one role can be inserted or given, so the edits open at a state have different initials,
and the ASCII-least of all cheapest audits follows from its first letter, node by node.

A row's fault is the first of: blank (no character but white space), duplicate (role and text seen
earlier in the conversation), truncated (its last such character is not one of ``.!?``).

Rows stand by turn, null turns first, equal turns by role and then by a digest of role and text. Texts
are shuffled once and streamed in that order next to their audit; a conversation is never gathered, but
its rows pass one task, as digests of whole conversations are sequential.

Edge cases: null roles and texts are one space (a blank row); null turns stand first and count for no
gap; null conversation ids are one conversation; a conversation whose rows are all gone has an empty
audit; equal rows after the first are duplicates; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

from .common import arrow_schema, as_schema, small_batches

# what a word character is not
SPACE = " \t\n\u000b\f\r"
# grammar states: nothing said, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
# the role that may be inserted or given, and the state it leads to
GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPAIRED = "conv_id bigint, seq bigint, edit string, role string, text string, facts array<bigint>"


def damaged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` after a damage that a checksum of conversation and turn decides: gone, emptied, without ends of sentences,
    repeated or given the role of the user. Rows that are gone stay as marks (``gone``), so that their conversation is not lost."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return turns.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(role).alias("role"),
                        F.when(k <= 1, F.lit("")).when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (k == 0).alias("gone"),
                        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with what they are ordered and compared by."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("no_conv"), F.col("turn").cast("long").alias("turn"),
                       role.alias("role"), text.alias("text"), F.col("gone") if "gone" in rows.columns else F.lit(False).alias("gone"), F.col("copy") if "copy" in rows.columns else F.lit(0).alias("copy"),
                       F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16).alias("digest"))


def in_order(df: DataFrame, *first: str) -> DataFrame:
    """Whole conversations per partition, rows in their order."""
    return df.repartition("no_conv", "conv").sortWithinPartitions("no_conv", "conv", *first, F.col("turn").asc_nulls_first(), "role", "digest", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """Narrow rows: role initial and fault (0 none, 1 blank, 2 duplicate, 3 truncated, 4 gone), without texts."""
    said = F.trim(F.translate(F.col("text"), SPACE[1:], " " * (len(SPACE) - 1)))
    seen = F.row_number().over(Window.partitionBy("no_conv", "conv", "gone", "digest").orderBy("turn", "copy"))
    slim = rows.select("no_conv", "conv", "turn", "role", "digest", "copy", "gone", (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"))
    code = F.when(F.col("gone"), 4).when(F.col("blank"), 1).when(F.col("nth") > 1, 2).when(F.col("cut"), 3).otherwise(0)
    return slim.withColumn("nth", seen).select("no_conv", "conv", "turn", "role", "digest", "copy", F.substring("role", 1, 1).alias("initial"), code.alias("fault"))


def signatures(rows: DataFrame) -> DataFrame:
    """``(conv, no_conv, gaps, blank, duplicate, truncated, illegal, signature)`` of each conversation; one byte per row is held."""
    schema = as_schema("conv bigint, no_conv boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, signature string")
    out = arrow_schema(schema)

    def close(s):
        (conv, null), n, distinct, low, high, illegal, _, sig = s
        return [conv, null, high - low + 1 - distinct if distinct else 0, n[1], n[2], n[3], illegal, sig.decode()]

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for conv, null, turn, initial, fault in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if state is None or state[0] != (conv, null):
                    if state is not None:
                        done.append(close(state))
                    state = [(conv, null), [0] * 5, 0, 0, 0, 0, None, bytearray()]
                if fault == 4:
                    continue
                if turn is not None:
                    state[2] += not state[2] or turn != state[4]
                    state[3] = turn if state[2] == 1 else state[3]
                    state[4] = turn
                state[1][fault] += 1
                state[5] += state[6] is not None and state[6] + initial not in LEGAL
                state[6] = initial
                symbol = "x" if fault in (1, 2) else initial if initial in ("s", "u", "a") else "o"
                state[7] += (symbol.upper() if fault == 3 else symbol).encode()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(close(state), out)], schema=out)

    return in_order(faults(rows)).select("conv", "no_conv", "turn", "initial", "fault").mapInArrow(run, schema)


class Chain:
    """Nodes of one signature's suffixes, the empty one first; per node the cost-to-go and first edit from each grammar state."""

    def __init__(self):
        self.cost, self.edit, self.made = array("q", [0, 2 * INSERT, INSERT, 0]), bytearray(b".II."), 0

    def back_to(self, n: int) -> None:
        del self.cost[4 * (n + 1):], self.edit[4 * (n + 1):]

    def add(self, symbol: str) -> None:
        """The node of ``symbol`` before the suffix of the last one."""
        role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        after = self.cost[-4:]
        best = []
        for q in range(4):
            options = [(DELETE + after[q], "D")]
            if role != "x":
                options.append((REROLE + extra + after[GIVEN[q][1]], "R"))
                if (q, role) in KEPT:
                    options.append((KEEP + extra + after[KEPT[q, role]], "K"))
            best.append(min(options))
        for _ in range(3):                           # insertions only ever cost, so no best audit goes round
            best = [min(best[q], (INSERT + best[GIVEN[q][1]][0], "I")) for q in range(4)]
        self.cost.extend(c for c, _ in best)
        self.edit.extend("".join(e for _, e in best).encode())
        self.made += 1

    def plan(self, signature: str) -> tuple[int, str]:
        """Cost and audit of the whole signature."""
        n, state, audit = len(signature), START, bytearray()
        while (e := self.edit[4 * n + state]) != 46:
            audit.append(e)
            if e in b"IR":
                nxt = GIVEN[state][1]
            else:
                nxt = KEPT[state, signature[-n].lower()] if e == 75 else state
            n, state = n if e == 73 else n - 1, nxt
        return self.cost[4 * len(signature)], audit.decode()


def plans(sigs: DataFrame) -> DataFrame:
    """``(signature, cost, audit, new_nodes)`` of each distinct ``signature``; ``new_nodes`` were not shared with an earlier one."""
    schema = as_schema("signature string, cost bigint, audit string, new_nodes bigint")
    out = arrow_schema(schema)

    def run(batches):
        chain, before = Chain(), ""
        for batch in batches:
            rows = []
            for rev in batch.column(0).to_pylist():
                same = 0
                for a, b in zip(before, rev):
                    if a != b:
                        break
                    same += 1
                chain.back_to(same)
                made = chain.made
                for symbol in rev[same:]:
                    chain.add(symbol)
                rows.append((rev[::-1], *chain.plan(rev[::-1]), chain.made - made))
                before = rev
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return sigs.select(F.reverse("signature").alias("rev")).distinct().repartitionByRange("rev").sortWithinPartitions("rev").mapInArrow(run, schema)


def repair(turns: DataFrame) -> DataFrame:
    """Rows ``(conv_id, seq, edit, role, text, facts)``: per conversation one of seq 0 that holds its audit as text and the numbers of ``FACTS``, then its repaired turns in order, in one partition.

    ``turns`` are ``(conv_id, turn, role, text)``, with ``gone`` and ``copy`` where ``damaged`` made them.
    """
    rows = keyed(turns)
    found = cut_lineage(signatures(rows))
    best = plans(found.select("signature"))
    heads = found.join(best, "signature").select("conv", "no_conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(0).alias("copy"),
                                                F.col("audit").alias("text"), F.array(*FACTS).alias("facts"))
    said = rows.where("NOT gone").select("conv", "no_conv", F.lit(1).alias("kind"), "turn", "role", "digest", "copy", "text", F.lit(None).cast("array<bigint>").alias("facts"))
    schema = as_schema(REPAIRED)
    out = arrow_schema(schema)

    def run(batches):
        conv, audit, at, state, seq = None, "", 0, START, 0

        def inserts():
            nonlocal at, state, seq
            while at < len(audit) and audit[at] == "I":
                given, state = GIVEN[state]
                at, seq = at + 1, seq + 1
                yield conv, seq, "I", given, "", None

        for batch in batches:
            done = []
            for c, null, kind, role, text, facts in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if kind == 0:
                    done.extend(inserts())
                    conv, audit, at, state, seq = None if null else c, text, 0, START, 0
                    done.append((conv, 0, "", "", text, facts))
                    continue
                done.extend(inserts())
                e, at = audit[at], at + 1
                if e != "D":
                    role, state = GIVEN[state] if e == "R" else (role, KEPT[state, role[:1]])
                    seq += 1
                    done.append((conv, seq, e, role, text, None))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), out)], schema=out)
        if done := list(inserts()):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), out)], schema=out)

    return small_batches(in_order(heads.unionByName(said), "kind").select("conv", "no_conv", "kind", "role", "text", "facts")).mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """Facts, audit and digest of the repaired turns of each conversation, read back from the rows of ``repair``."""
    schema = as_schema("conv_id bigint, " + ", ".join(f"{f} bigint" for f in FACTS) + ", audit string, repaired_sha256 string")
    out = arrow_schema(schema)

    def close(done):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*([conv, *facts, audit, h.hexdigest()] for conv, facts, audit, h in done)), out)], schema=out)

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for conv, seq, role, text, facts in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if seq == 0:
                    if state is not None:
                        done.append(state)
                    state = (conv, facts, text, hashlib.sha256())
                else:
                    state[3].update((b"\n" if seq > 1 else b"") + f"{role}:{text}".encode())
            if done:
                yield close(done)
        if state is not None:
            yield close([state])

    return repaired.mapInArrow(run, schema)

