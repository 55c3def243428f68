"""Writers: screens, snapshots, panels, result logs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_screen(df: DataFrame, root: str, pulled: str, excluded: DataFrame | None = None, top: DataFrame | None = None) -> None:
    """The dated partition and the latest copy; writing a day again replaces that day.

    The names left out, with their reasons, and the top list have tables of their own below ``excluded`` and ``top``.
    """
    for name, part in (("excluded", excluded), ("top", top)):
        if part is not None:
            write_screen(part, f"{root}/{name}", pulled)
    dated = df.withColumn("pulled", F.lit(pulled)).write.partitionBy("pulled")
    dated.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{root}/history")
    df.write.mode("overwrite").parquet(f"{root}/latest")


MANIFEST = "attempt string, committed_at timestamp, tables array<struct<name: string, n_rows: bigint, n_files: bigint, content_sha: string>>, day string"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Committed snapshots: one row per archived day, its newest commit."""
    try:
        found = spark.read.parquet(f"{root}/manifest").columns
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":       # only a missing archive counts as an empty one
            raise
        return spark.createDataFrame([], MANIFEST)
    if "attempt" not in found:
        raise ValueError(f"{root}/manifest is no manifest of this form")
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    return rows.groupBy("day").agg(F.max_by(F.struct("attempt", "committed_at", "tables"), F.struct("committed_at", "attempt")).alias("m")).select("m.*", "day")


def row_sha() -> Column:
    """A hash over rows that depends neither on their order nor on their files."""
    return F.sha2(F.sum("_h").cast("string"), 256)


def stage_snapshot(tables: dict[str, DataFrame], root: str, snapshot_date: str) -> str:
    """Write the tables of a snapshot where no reader looks yet, with one row per file written: its rows and their hash. Returns the attempt's name."""
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        path = f"{root}/data/{name}/snapshot_date={snapshot_date}/attempt={attempt}"
        df.write.parquet(path)
        _file_hashes(df.sparkSession, path).write.parquet(f"{root}/files/{name}/snapshot_date={snapshot_date}/attempt={attempt}")
    return attempt


def _file_hashes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    hashed = rows.select(F.col("_metadata.file_name").alias("file"), F.xxhash64(*rows.columns).cast("decimal(38,0)").alias("_h"))
    return hashed.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_h").alias("hash_sum"), row_sha().alias("sha"))


def commit_snapshot(spark: SparkSession, names: list[str], root: str, snapshot_date: str, attempt: str) -> None:
    """Make a staged snapshot visible by one manifest row, written last."""
    rows = []
    for name in names:
        f = spark.read.parquet(f"{root}/files/{name}/snapshot_date={snapshot_date}/attempt={attempt}")
        rows.append(f.agg(F.lit(name).alias("name"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.sha2(F.sum("hash_sum").cast("string"), 256).alias("content_sha")))
    listed = reduce(DataFrame.unionByName, rows)                     # one row per table
    row = listed.agg(F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"), F.sort_array(F.collect_list(F.struct("name", "n_rows", "n_files", "content_sha"))).alias("tables"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest/day={snapshot_date}")


def archive_snapshot(scores: DataFrame, root: str, snapshot_date: str, force: bool = False, **more: DataFrame) -> bool:
    """One archive per data date; archiving it again does nothing unless forced. Returns whether it wrote.

    ``scores`` has a row per ticker, or per ticker and variant; the tickers scored are kept as a table of their own, and
    so are the tables given by name (what the scores were made from). Everything is staged first and committed by one
    manifest row, so a run that breaks off leaves nothing a reader sees.
    """
    spark = scores.sparkSession
    if manifest(spark, root).where(F.col("day") == snapshot_date).limit(1).count() and not force:
        return False
    by = ["variant"] if "variant" in scores.columns else []
    tables = {"scores": scores, "tickers": scores.select(*by, "ticker").distinct(), **more}
    attempt = stage_snapshot(tables, root, snapshot_date)
    commit_snapshot(spark, list(tables), root, snapshot_date, attempt)
    return True


def read_archive(spark: SparkSession, root: str, table: str = "scores") -> DataFrame:
    """Every committed row of a table with its date; an archive without a commit is an error."""
    days = manifest(spark, root).where(F.exists("tables", lambda x: x["name"] == table)).select("day", "attempt").collect()      # one row per day
    if not days:
        raise ValueError(f"no snapshot of {table} is committed in {root}")
    base = f"{root}/data/{table}"
    paths = [f"{base}/snapshot_date={r['day']}/attempt={r['attempt']}" for r in days]
    return spark.read.option("basePath", base).parquet(*paths).drop("attempt")


def verify_snapshot(spark: SparkSession, root: str, snapshot_date: str) -> DataFrame:
    """Files of a committed snapshot: ``table, file, status``: ok, changed, missing or added since the commit."""
    out = None
    for r in manifest(spark, root).where(F.col("day") == snapshot_date).collect():           # one row
        for x in r["tables"]:
            at = f"{x['name']}/snapshot_date={snapshot_date}/attempt={r['attempt']}"
            was = spark.read.parquet(f"{root}/files/{at}").select("file", F.col("sha").alias("was"))
            now = _file_hashes(spark, f"{root}/data/{at}").select("file", F.col("sha").alias("now"))
            status = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("was") == F.col("now"), "ok").otherwise("changed")
            one = was.join(now, "file", "full").select(F.lit(x["name"]).alias("table"), "file", status.alias("status"))
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no snapshot of {snapshot_date} is committed in {root}")
    return out


def write_panel(panel: DataFrame, path: str) -> None:
    """Rows sorted inside partitions by ticker and session, so a reader skips row groups."""
    panel.repartition("ticker").sortWithinPartitions("ticker", "session").write.mode("overwrite").parquet(path)


def write_quotes(panel: DataFrame, root: str) -> None:
    """The panel, a manifest and the last close per ticker."""
    write_panel(panel, f"{root}/closes")
    latest = panel.where(F.col("close").isNotNull()).groupBy("ticker").agg(F.max_by("close", "session").alias("close"), F.max("session").alias("date"))
    latest.write.mode("overwrite").parquet(f"{root}/latest")
    panel.agg(F.min("session").alias("first"), F.max("session").alias("last"), F.count_distinct("ticker").alias("n_tickers")).write.mode("overwrite").parquet(f"{root}/manifest")


def append_results(results: DataFrame, root: str, run_at: str) -> None:
    """Results of one run are added, never replaced."""
    results.withColumn("run_at", F.lit(run_at)).write.mode("append").json(root)


def read_results(spark: SparkSession, root: str, schema: str, split: str | None = None) -> DataFrame:
    df = spark.read.schema(schema).json(root)
    return df if split is None else df.where(F.col("split") == split)
