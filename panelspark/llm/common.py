"""What several operators share: table scans, Arrow chunking, graph components and row numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import cut_lineage

# a task handles the texts of an Arrow batch in pieces of about so many bytes
CHUNK_BYTES = 2 << 20
# Arrow batches of whole texts are held by the JVM and by a worker, in and out, so they are kept small
BATCH_BYTES = 8 << 20
# of a bitmap that spares work in a scan, whatever the size of the input
BITS = 1 << 22
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
         "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches have been bounded by ``BATCH_BYTES``; a smaller setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key)
    if not now.endswith("b") or not now[:-1].isdigit() or int(now[:-1]) > BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")
    return df


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in schema.fields])


def as_schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def pieces(lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def text_pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch with the UTF-8 bytes of their texts."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4) if pa.types.is_string(col.type) else None
    lengths = np.diff(off) if off is not None else np.array([len(x or "") for x in col.to_pylist()])
    for a, b in pieces(lengths):
        part = batch.slice(a, b - a)
        yield part, part.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def map_texts(df: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch, list[bytes | None]], dict], ddl: str) -> DataFrame:
    """Apply ``fn`` to pieces of whole texts; it returns columns by name, any number of rows."""
    schema = as_schema(ddl)
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part, texts in text_pieces(batch, text_col):
                got = fn(part, texts)
                yield pa.RecordBatch.from_arrays([got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], f.type) for f in out], schema=out)

    return small_batches(df).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, keep: Callable[[list[bytes | None]], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns, in one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            # by position: other columns may repeat a name
            slim = pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(batch.num_rows))], names=["text", "row"])
            for part, texts in text_pieces(slim, "text"):
                yield batch.take(part.column(1).filter(pa.array(np.asarray(keep(texts), bool))))

    return small_batches(docs).mapInArrow(run, docs.schema)


def bitmap(df: DataFrame, hash_col: str) -> np.ndarray:
    """A fixed number of bits, set at the low bits of each hash."""
    pos = F.pmod(F.col(hash_col), F.lit(BITS)) + 1
    got = df.groupBy(F.bitmap_bucket_number(pos).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(pos)).alias("bits")).collect()
    out = np.zeros(BITS, bool)
    for r in got:
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
        a = (r["bucket"] - 1) * 32768
        out[a:a + 32768] = part[:min(32768, BITS - a)]
    return np.packbits(out)


def set_in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    pos = h.astype(np.int64) & (BITS - 1)
    return (bits[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1 == 1


def sorted_groups(batches, keys: list[str], limit: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; only the last, still open group is carried over."""
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        last = np.ones(t.num_rows, bool)
        for k in keys:
            col = t.column(k).to_numpy()
            last &= col == col[-1]
        cut = t.num_rows - int(last[::-1].cumprod().sum())
        if cut:
            yield t.slice(0, cut)
        carry = t.slice(cut)
    if carry is not None and carry.num_rows:
        yield carry


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(v, root)`` of every vertex of ``edges(a, b)``, root being the smallest vertex reachable.

    Alternating large and small stars: each round is two equi-joins on vertices, each preceded by a
    map-side minimum, so a vertex with very many links is never gathered. Rounds are cut by tables
    in the shared folder and end when the edge set no longer changes.
    """
    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003)).first())

    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(e)
    for _ in range(max_rounds if seen[0] else 0):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        stars = large.join(low, large.a == low.u)
        e = cut_lineage(stars.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).union(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
