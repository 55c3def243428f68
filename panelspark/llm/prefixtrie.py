"""Trie of conversation prefixes by ROLLUP over positional turn-id columns.

A turn id is a digest of role and text. Turns are laid out in rows of ``WIDTH`` positional columns, one row
per conversation and block of so many turns. A single ``GROUP BY block, prior node, ROLLUP(t1, ..., tn)``
aggregates all prefixes of all conversations together; ``grouping_id()`` tells how many columns a group
holds, and with the block its depth. A block after the first is keyed by the node at which the block
before ended, so prefixes of any length are covered without a round per block.

A node's key is the 128-bit exclusive or of hashes of (position, turn id) along its path, so the prior node
of every block comes from one running aggregate over a conversation's blocks, and a parent's key from the
child's by taking the last turn out.

Sums over subtrees need no walk of the tree, as a node's subtree is what its members go through:
every node is charged to its smallest member, which is the smallest of all its prefixes' depths from some
depth on. A second ROLLUP sums over members (a) whether the member stands for a childless node and (b) the
bytes of its turns from the group's depth on that are charged to another member.

No text is shuffled. Base turns meet the conversations that take them by an equi-join of at most nine
conversations and eight turns a key. Lists of members that end at a node are joined in pieces of
``PIECE`` ids and digested as a sorted stream of pieces.

Edge cases: null roles and texts are empty; null turns stand first, equal turns are ordered by role and then
by turn id; rows without a conversation id belong to no conversation; a conversation without turns ends at
the root; equal conversations share all nodes; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

from .common import arrow_schema, as_schema

WIDTH = 8
# ids of one piece of a member list span at most so much
PIECE = 4096
# a rebuilt conversation begins with up to eight turns of the first of its five
FAMILY, HEADS = 5, 9


def turn_rows(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, id, bytes)``: turns by position, without texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    slim = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                                                    F.substring(code, 1, 16).alias("id"), F.octet_length(text).cast("long").alias("bytes"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "id"))
    return slim.select("conv_id", pos.cast("long").alias("pos"), "id", "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(turns, conversations)`` after each conversation's first turns were replaced by those of the first of its family; how many, a checksum of the id decides."""
    own = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = rows.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "id", "bytes")
    first = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos <= taken").select("conv_id", "pos", "id", "bytes")
    rest = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "bytes")
    return first.unionByName(rest), convs.select("conv_id")


def mark(seed: int, pos: Column, turn: Column) -> Column:
    """Half of the hash of a turn at a position."""
    return F.xxhash64(F.lit(seed), pos.cast("long"), turn)


def blocks(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(conv_id, block, t1.., b1.., k1, k2, before, a1, a2)``: turn ids and bytes by column, key and bytes of the path before the block, and the key after it; every conversation has block 0."""
    at = F.col("slot")
    rows = turns.select("conv_id", F.floor((F.col("pos") - 1) / width).cast("long").alias("block"), ((F.col("pos") - 1) % width).alias("slot"), "id", "bytes",
                        mark(1, F.col("pos"), F.col("id")).alias("m1"), mark(2, F.col("pos"), F.col("id")).alias("m2"))
    rows = rows.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("block")), allowMissingColumns=True)
    wide = rows.groupBy("conv_id", "block").agg(*[F.max(F.when(at == i, F.col("id"))).alias(f"t{i + 1}") for i in range(width)], *[F.max(F.when(at == i, F.col("bytes"))).alias(f"b{i + 1}") for i in range(width)],
                                                F.coalesce(F.bit_xor("m1"), F.lit(0)).alias("m1"), F.coalesce(F.bit_xor("m2"), F.lit(0)).alias("m2"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("sum"))
    so_far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    run = wide.withColumns({"a1": F.bit_xor("m1").over(so_far), "a2": F.bit_xor("m2").over(so_far), "upto": F.sum("sum").over(so_far)})
    return run.select("conv_id", "block", *[f"t{i + 1}" for i in range(width)], *[f"b{i + 1}" for i in range(width)], F.col("a1").bitwiseXOR(F.col("m1")).alias("k1"), F.col("a2").bitwiseXOR(F.col("m2")).alias("k2"),
                      (F.col("upto") - F.col("sum")).alias("before"), "a1", "a2", "upto")


def roll_up(rows: DataFrame, measures: str, width: int = WIDTH) -> DataFrame:
    """All prefixes of all blocks at once: ``measures`` by node, with depth, key ``k1, k2`` and the parent's key ``p1, p2``."""
    names = ", ".join(f"t{i + 1}" for i in range(width))
    got = rows.sparkSession.sql(f"SELECT block, k1, k2, {names}, {width} - bit_count(grouping_id()) AS level, {measures} FROM {{rows}} GROUP BY block, k1, k2, ROLLUP({names})", rows=rows)
    level = F.col("level")
    turn = F.element_at(F.array(*[f"t{i + 1}" for i in range(width)]), F.greatest(level, F.lit(1)).cast("int"))
    got = got.where(((F.col("block") == 0) & (level == 0)) | ((level > 0) & turn.isNotNull()))
    keys = {}
    for half in (1, 2):
        at = [F.when(level > i, mark(half, F.col("block") * width + i + 1, F.col(f"t{i + 1}"))).otherwise(F.lit(0).cast("long")) for i in range(width)]
        key = F.col(f"k{half}")
        for x in at:
            key = key.bitwiseXOR(x)
        last = F.when(level > 0, mark(half, F.col("block") * width + level, turn)).otherwise(F.lit(0).cast("long"))
        keys |= {f"key{half}": key, f"p{half}": key.bitwiseXOR(last)}
    kept = [c for c in got.columns if c not in ("block", "k1", "k2", "level") and not (c[0] == "t" and c[1:].isdigit())]
    return got.select((F.col("block") * width + level).cast("long").alias("depth"), "level", *[v.alias(k) for k, v in keys.items()], *kept).withColumnsRenamed({"key1": "k1", "key2": "k2"})


def member_digests(ends: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)``: digest of the ascending, comma-joined ids that end at a node."""
    pieces = ends.groupBy("depth", "k1", "k2", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    schema = as_schema("depth bigint, k1 bigint, k2 bigint, ends_sha256 string")
    out = arrow_schema(schema)

    def close(done):
        cols = [*zip(*(k for k, _ in done)), [h.hexdigest() for _, h in done]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is not None and state[0] == key:
                    state[1].update(b"," + ids.encode())
                    continue
                if state is not None:
                    done.append(state)
                state = (key, hashlib.sha256(ids.encode()))
            if done:
                yield close(done)
        if state is not None:
            yield close([state])

    return pieces.repartition("k1", "k2").sortWithinPartitions("depth", "k1", "k2", "piece").select("depth", "k1", "k2", "ids").mapInArrow(run, schema)


def prefix_trie(turns: DataFrame, width: int = WIDTH, rebuild: bool = True) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``rebuild`` first gives conversations the heads of their family, as in ``rebuilt``.
    """
    rows = cut_lineage(turn_rows(turns))
    said, convs = rebuilt(rows) if rebuild else (rows, rows.select("conv_id").distinct())
    laid = cut_lineage(blocks(said, convs, width))
    bytes_at = ", ".join(f"max(b{i + 1}) AS c{i + 1}" for i in range(width))
    nodes = roll_up(laid, f"min(conv_id) AS conv_id, count(*) AS n_convs, max(before) AS before, {bytes_at}", width)
    path = sum((F.when(F.col("level") > i + 1, F.coalesce(f"c{i + 1}", F.lit(0))).otherwise(0) for i in range(width)), F.col("before"))
    nodes = cut_lineage(nodes.select("depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", path.alias("path")))

    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.join(kids, ["depth", "k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # a member stands for the nodes from ``since`` on; ``paid`` bytes lie before
    stands = nodes.groupBy("conv_id").agg(F.min("depth").alias("since"), F.min_by("path", "depth").alias("paid"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    ends = laid.groupBy("conv_id").agg(F.max_by(F.struct((F.col("block") * width + sum((F.col(f"t{i + 1}").isNotNull().cast("long") for i in range(width)), F.lit(0))).alias("depth"), F.col("a1").alias("k1"), F.col("a2").alias("k2"), "upto"), "block").alias("end")).select("conv_id", "end.*")
    ends = cut_lineage(ends.join(stands, "conv_id", "left").select("conv_id", "depth", "k1", "k2", F.coalesce("paid", "upto").alias("others"), F.coalesce("leaf", F.lit(0)).alias("leaf")))

    # bytes from each column on that are charged to another member
    measured, spent = laid.join(ends.select("conv_id", "others", "leaf"), "conv_id"), F.col("before")
    due = {"s0": F.col("others")}
    for i in range(width):
        due[f"s{i + 1}"] = F.greatest(F.col("others") - spent, F.lit(0))
        spent = spent + F.coalesce(f"b{i + 1}", F.lit(0))
    sums = roll_up(measured.withColumns(due), "sum(leaf) AS n_leaves, " + ", ".join(f"sum(s{i}) AS d{i}" for i in range(width + 1)), width)
    sums = sums.select("depth", "k1", "k2", "n_leaves", F.element_at(F.array(*[f"d{i}" for i in range(width + 1)]), (F.col("level") + 1).cast("int")).alias("saved_tokens"))

    key = ["depth", "k1", "k2"]
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256().hexdigest()
    return (nodes.join(sums, key).join(member_digests(ends), key, "left").join(parents, ["depth", "p1", "p2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
