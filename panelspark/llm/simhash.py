"""SimHash near-duplicate groups by BK-trees.

A text's words (A-Z lower-cased) give k-word shingles, their XXH64 values a 64-bit majority
fingerprint. Distinct fingerprints are dealt to shards by each of ``radius + 1`` bit blocks: two
fingerprints within the radius agree in one block at least, so they meet in one shard at least and
no link is lost. Every shard holds a BK-tree whose children are keyed by their Hamming distance to
the parent; a search follows only edges within the radius of the distance measured at the node.
A tree lives where its shard's queries are: trees grow with the corpus, so none is broadcast whole.

Shards over ``SHARD_ROWS`` fingerprints are split: each part has its own tree and meets every part
of the shard, in separate groups. A group returns one edge per member to its smallest linked
member, not all pairs.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; fewer words
than a shingle give one shingle of all words; repeated rows and null ids keep one output row each.
An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import cut_lineage

from .common import arrow_schema, as_schema, components, map_texts, small_batches, sorted_groups

SHARD_ROWS = 4096
SEED = 42
PAIR_BLOCK = 1 << 18
SHINGLE_BLOCK = 1 << 17


def majority(digests: np.ndarray) -> np.ndarray:
    """Per bit (most significant first), in how many of the digests it is set."""
    total = np.zeros(8 * digests.shape[1], np.int64)
    for i in range(0, len(digests), SHINGLE_BLOCK):
        total += np.unpackbits(digests[i:i + SHINGLE_BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(texts: list[bytes | None], k: int = 4) -> np.ndarray:
    """Majority fingerprints of whole texts as unsigned 64-bit numbers."""
    h = xxhash.xxh64_digest
    bits = np.zeros((len(texts), 64), bool)
    for row, t in enumerate(texts):
        w = t.lower().split() if t else []
        if not w:
            continue
        if len(w) < k:
            got = [h(b" ".join(w), SEED)]
        else:
            flat = b" ".join(w)
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            got = [h(flat[a:b], SEED) for a, b in zip(starts[:len(w) - k + 1].tolist(), ends[k - 1:].tolist())]
        counts = majority(np.frombuffer(b"".join(got), np.uint8).reshape(-1, 8))
        bits[row] = 2 * counts > len(got)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def with_fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row; fp is the fingerprint as a signed long."""
    def run(part, texts):
        return {"id": part.column(0), "fp": pa.array(fingerprints(texts, k).view(np.int64))}

    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", run, "id bigint, fp bigint")


# -- BK-trees of many shards at once, as arrays ------------------------------------------------

def grow_trees(fp: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trees over ``fp``; ``root[i]`` is the index of the first point of i's tree.

    Returns the sorted edge keys ``parent * 65 + distance`` and the child at each. All points below
    a node arrive at it on the same level; the first at each distance becomes the child there, the
    others go on below that child.
    """
    keys, children = [], []
    left = np.flatnonzero(root != np.arange(len(fp)))
    at = root[left]
    while len(left):
        key = at * 65 + np.bitwise_count(fp[left] ^ fp[at])
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        child = left[first]
        keys.append(uniq)
        children.append(child)
        below = child[back]
        stay = below != left
        left, at = left[stay], below[stay]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return key[order], child[order]


def search_trees(fp: np.ndarray, trees: tuple[np.ndarray, np.ndarray], queries: np.ndarray, start: np.ndarray, radius: int):
    """Blocks of ``(query, node)`` within the radius, walking only edges it allows.

    Edges wait as ranges and are walked ``PAIR_BLOCK`` at a time, so memory does not grow with the children of a block.
    """
    key, child = trees
    for i in range(0, len(queries), PAIR_BLOCK):
        q, node, waiting = queries[i:i + PAIR_BLOCK], start[i:i + PAIR_BLOCK], []
        while True:
            d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0), "left")
            n = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), "right") - lo
            on = n > 0
            if on.any():
                waiting.append((q[on], lo[on], n[on]))
            if not waiting:
                break
            q, lo, n = waiting.pop()
            while len(q) > 1 and n.sum() > PAIR_BLOCK:
                half = len(q) // 2
                waiting.append((q[half:], lo[half:], n[half:]))
                q, lo, n = q[:half], lo[:half], n[:half]
            node = child[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            q = np.repeat(q, n)


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b in ``label``, whose entries point to the smallest member."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return
        low, high = np.minimum(la, lb)[apart], np.maximum(la, lb)[apart]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def link_group(fp: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Smallest linked member of each point; groups are contiguous, sides 0 build the tree, sides 1 only ask (2: both)."""
    order = np.lexsort((fp, side == 1, group))
    fp, group, side = fp[order], group[order], side[order]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    root = np.flatnonzero(first)[np.cumsum(first) - 1]
    label = np.arange(len(fp))
    tree = np.flatnonzero(side != 1)
    back = np.full(len(fp), -1)
    back[tree] = np.arange(len(tree))
    key, child = grow_trees(fp[tree], back[root[tree]])
    ask = np.flatnonzero((side != 0) & (side[root] != 1))
    spot = {"key": key, "child": child}
    # nodes are numbered among tree points; queries among all points
    pts = np.concatenate((fp[tree], fp))
    for q, node in search_trees(pts, (spot["key"], spot["child"]), ask + len(tree), back[root[ask]], radius):
        hook(label, q - len(tree), tree[node])
    low = fp.astype(np.int64).copy()
    # smallest signed value of each set, so that every task names a set alike
    np.minimum.at(low, label, fp.astype(np.int64))
    out = np.empty(len(fp), np.int64)
    out[order] = low[label]
    return out


def fingerprint_links(fps: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints ``fps(fp)`` within the radius, at most one per point and group."""
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    cols = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft("fp", edges[i]), 64 - (edges[i + 1] - edges[i])).alias("bits")) for i in range(blocks)]
    keyed = fps.select("fp", F.explode(F.array(*cols)).alias("k")).select("fp", (F.col("k.bits") * blocks + F.col("k.block")).alias("shard"))
    rows = meetings(keyed, shard_rows)
    schema = as_schema("a bigint, b bigint")
    out = arrow_schema(schema)

    def run(batches):
        for t in sorted_groups(batches, ["grp"]):
            fp = t.column("fp").to_numpy().view(np.uint64)
            low = link_group(fp, t.column("grp").to_numpy(), t.column("side").to_numpy(), radius)
            own = fp.view(np.int64)
            keep = low != own
            yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(low[keep])], schema=out)

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, schema)


def simhash_groups(docs: DataFrame, k: int = 4, radius: int = 4, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row: copies and near copies share a component, named by its smallest id."""
    rows = cut_lineage(with_fingerprints(docs, k, id_col, text_col))
    fps = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low")))
    comp = components(fingerprint_links(fps.select("fp"), radius, shard_rows))
    named = fps.join(comp, fps.fp == comp.v)
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    moved = named.select("fp", "root").join(least, "root").select(F.col("fp").alias("of"), "component_id")
    by_fp = fps.join(moved, fps.fp == moved.of, "left").select(F.col("fp").alias("of"), F.coalesce("component_id", "low").alias("component_id"))
    return rows.join(by_fp, rows.fp == by_fp.of).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Rows that repeat an id are one document, of which one row stays; rows without an id cannot be
    told apart and stay.
    """
    groups = simhash_groups(docs, **params)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    named = docs.where("doc_id IS NOT NULL")
    return named.join(stay, named.doc_id == stay["_stay"], "left_semi").dropDuplicates(["doc_id"]).union(docs.where("doc_id IS NULL"))


# -- near copies by similarity: BK-trees over sampled bits, then an exact check -------------------

NEAR_RADIUS = 15
CHECK_RADIUS = 18                  # of the second half of the fingerprint, before texts are compared
# two texts of similarity 0.8 differ in about 10 bits of 64 and seldom in more than 14; with 14, so large a share
# agrees, and such a pair meets in a shard with this chance at least
SEEN, FOUND = 50 / 64, 0.95


def tables_for(n: int) -> tuple[int, int]:
    """Bits a shard is keyed by and how many keys a fingerprint has, so that a shard holds about a hundred unrelated ones.

    Keys grow as the count to the power of 0.36, the price of a bound this wide.
    """
    bits = min(max(int(n).bit_length() - 7, 6), 24)
    return bits, int(np.ceil(np.log(1 - FOUND) / np.log(1 - SEEN ** bits)))


def sampled_shards(fps: DataFrame, n: int) -> DataFrame:
    """``(fp, check, shard)``: every fingerprint once per set of sampled bits; the sets follow from the count alone."""
    bits, tables = tables_for(n)
    rng = np.random.default_rng(SEED)
    masks = [int(np.bitwise_or.reduce(np.left_shift(np.uint64(1), rng.choice(64, bits, replace=False).astype(np.uint64))).view(np.int64)) for _ in range(tables)]
    return fps.select("fp", "check", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("shard"))


def meetings(keyed: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(fp, ..., grp, side)`` of ``keyed(fp, ..., shard)``: a shard is one group, a larger one is cut into parts that all meet."""
    big = keyed.groupBy("shard").count().where(F.col("count") > shard_rows).select(F.col("shard").alias("hot"), F.ceil(F.col("count") / shard_rows).cast("int").alias("parts"))
    kept = [c for c in keyed.columns if c != "shard"]
    dealt = keyed.join(big, keyed.shard == big.hot, "left").select(*kept, "shard", F.coalesce("parts", F.lit(1)).alias("parts")).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = dealt.select(*kept, "shard", F.explode(F.expr("transform(sequence(0, parts - 1), j -> struct(least(p, j) AS i, greatest(p, j) AS j, CASE WHEN p = j THEN 2 WHEN p < j THEN 0 ELSE 1 END AS side))")).alias("g"))
    return met.select(*kept, F.xxhash64("shard", "g.i", "g.j").alias("grp"), F.col("g.side").cast("int").alias("side"))


def nearest_in_groups(fp: np.ndarray, check: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each asking point the nearest point of its group's tree within the radius, and the nearest smaller one, of those whose second half is near too."""
    order = np.lexsort((fp, side == 1, group))
    fp, check, group, side = fp[order], check[order], group[order], side[order]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    root = np.flatnonzero(first)[np.cumsum(first) - 1]
    tree = np.flatnonzero(side != 1)
    back = np.full(len(fp), -1)
    back[tree] = np.arange(len(tree))
    trees = grow_trees(fp[tree], back[root[tree]])
    ask = np.flatnonzero((side != 0) & (side[root] != 1))
    none = np.iinfo(np.int64).max
    any_, less = np.full(len(fp), none), np.full(len(fp), none)
    for q, node in search_trees(np.concatenate((fp[tree], fp)), trees, ask + len(tree), back[root[ask]], radius):
        q, node = q - len(tree), tree[node]
        other = (fp[q] != fp[node]) & (np.bitwise_count(check[q] ^ check[node]) <= CHECK_RADIUS)
        q, node = q[other], node[other]
        score = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64) * len(fp) + node
        np.minimum.at(any_, q, score)
        smaller = fp[node] < fp[q]
        np.minimum.at(less, q[smaller], score[smaller])
    a, b = [], []
    for best in (any_, less):
        q = np.flatnonzero(best != none)
        a.append(fp[q])
        b.append(fp[best[q] % len(fp)])
    return np.concatenate(a), np.concatenate(b)


def wide_fingerprint(text: bytes | None, k: int) -> tuple[int, int, int]:
    """Two independent halves of a majority fingerprint over the distinct shingles, and how many there are."""
    s = shingle_set(text, k)
    if not s:
        return 0, 0, 0
    counts = majority(np.frombuffer(b"".join(xxhash.xxh3_128_digest(x, SEED) for x in s), np.uint8).reshape(-1, 16))
    a, b = np.packbits(2 * counts > len(s)).view(">i8").tolist()
    return a, b, len(s)


def shingle_set(text: str | bytes | None, k: int) -> set[bytes]:
    w = (text.encode() if isinstance(text, str) else text).lower().split() if text else []
    return {b" ".join(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set()


def alike(a: str | None, b: str | None, k: int = 5, similarity: float = 0.8) -> bool:
    """Whether the shingles of two whole texts have this Jaccard similarity; texts without words are alike."""
    x, y = shingle_set(a, k), shingle_set(b, k)
    both = len(x & y)
    return both >= similarity * (len(x) + len(y) - both)


def near_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = NEAR_RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, component_id)`` of every document with an id: copies, and texts joined by a chain of similar ones, share a component.

    The bound on differing bits that a similarity of 0.8 needs is too wide for shards by bit blocks. Fingerprints are dealt
    by sets of sampled bits instead, in which a pair of similarity 0.8 meets with a chance of ``FOUND``, a closer one with a
    higher one. In a shard's BK-tree each fingerprint finds its nearest neighbour and its nearest smaller one, among those
    whose independent second half is within ``CHECK_RADIUS``, so a group of n near copies gives at most 2n candidates a shard
    and not all pairs. Candidates with too unlike numbers of shingles go before any text is read. Every other, also two texts of one
    fingerprint, is checked on the shingles of the two whole texts before it links them. Recall is measured in the README.
    """
    d = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(part, texts):
        fp, check, n = zip(*(wide_fingerprint(t, k) for t in texts))
        return {"id": part.column(0), "fp": fp, "body": part.column(2), "check": check, "n": n}

    rows = cut_lineage(map_texts(d.withColumn("body", F.md5(F.col("text").cast("binary"))), "text", run, "id bigint, fp bigint, body string, check bigint, n bigint"))
    bodies = cut_lineage(rows.groupBy("fp", "body").agg(F.min("id").alias("low"), F.min("check").alias("check"), F.min("n").alias("n")))
    fps = cut_lineage(bodies.groupBy("fp").agg(F.min(F.struct("low", "check", "n")).alias("r")).select("fp", F.col("r.low").alias("rep"), "r.check", "r.n"))
    schema = as_schema("a bigint, b bigint")
    out = arrow_schema(schema)

    def find(batches):
        for t in sorted_groups(batches, ["grp"]):
            a, b = nearest_in_groups(t.column("fp").to_numpy().view(np.uint64), t.column("check").to_numpy().view(np.uint64), t.column("grp").to_numpy(), t.column("side").to_numpy(), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=out)

    met = meetings(sampled_shards(fps.select("fp", "check"), fps.count()), shard_rows)
    links = met.repartition("grp").sortWithinPartitions("grp").mapInArrow(find, schema)
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    name = lambda c: fps.select(F.col("fp").alias(c), F.col("rep").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
    likely = F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")         # unlike numbers of shingles exclude the similarity
    asked = links.join(name("a"), "a").join(name("b"), "b").where(likely).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    same = bodies.join(fps, "fp").where("low <> rep").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    asked = cut_lineage(asked.union(same).where("a <> b").distinct())
    ids = asked.select(F.col("a").alias("id")).union(asked.select("b")).distinct()
    said = cut_lineage(d.join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    text = lambda c: said.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))

    def check(batches):
        for batch in batches:
            keep = [alike(x.as_py(), y.as_py(), k, similarity) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    pairs = small_batches(asked.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb")).mapInArrow(check, schema)
    comp = components(pairs)
    member = bodies.join(comp.select(F.col("v").alias("low"), "root"), "low", "left").select("fp", "body", F.coalesce("root", "low").alias("component_id"))
    return rows.join(member, ["fp", "body"]).select(F.col("id").alias("doc_id"), "component_id")


def one_of_near(docs: DataFrame, **params) -> DataFrame:
    """One document of each group of ``near_groups``, the one with the smallest id, with all its columns; ids as in ``one_of_each``."""
    stay = near_groups(docs, **params).where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    named = docs.where("doc_id IS NOT NULL")
    return named.join(stay, named.doc_id == stay["_stay"], "left_semi").dropDuplicates(["doc_id"]).union(docs.where("doc_id IS NULL"))
