"""A substring index over the text facets of a company list: postings of short grams, intersected by counts and verified.

Postings hold every distinct gram of one to three letters of a name's facets. A search of three letters or more asks
for its trigrams: names that have them all are counted up from the postings and then looked at; a shorter one is a gram
itself. Postings are laid out by a hash of the gram, so a search reads the folders of its own grams and the rows of
its candidates, not the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACETS = ("ticker", "name", "sector", "industry")
FOLDERS = 64
GRAM = 3


def haystack(facets: tuple[str, ...] = FACETS) -> Column:
    return F.lower(F.concat_ws(" ", *facets))


def grams(text: Column) -> Column:
    """Distinct substrings of one to three letters."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, GRAM + 1)]))


def folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS))


def write_index(index: DataFrame, root: str, key: str = "ticker", facets: tuple[str, ...] = FACETS) -> None:
    """Write the list and its postings; the list is laid out by a hash of its key, in which candidates are looked up."""
    index.withColumn("folder", folder(F.col(key))).repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{root}/rows")
    post = index.select(F.col(key).alias("key"), F.explode(grams(haystack(facets))).alias("gram")).withColumn("folder", folder(F.col("gram")))
    post.repartition("folder", "gram").sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(f"{root}/postings")


def asked_grams(text: str) -> list[str]:
    t = text.lower()
    return sorted({t[i:i + GRAM] for i in range(len(t) - GRAM + 1)}) if len(t) > GRAM else [t] if t else []


def candidates(spark: SparkSession, root: str, text: str) -> DataFrame:
    """Keys whose facets hold every gram of the text; not yet its order."""
    asked = asked_grams(text)
    where = spark.createDataFrame([(g,) for g in asked], "gram string").select(folder(F.col("gram")).alias("folder")).distinct().collect()       # a word's grams
    post = spark.read.parquet(f"{root}/postings").where(F.col("folder").isin([r[0] for r in where]) & F.col("gram").isin(asked))
    return post.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(asked)).select("key")


def search(spark: SparkSession, root: str, text: str, depth: str | None = None, key: str = "ticker", facets: tuple[str, ...] = FACETS) -> DataFrame:
    """P10: rows whose facets hold the text, whatever its case, and whose ``depth`` is the one asked; an empty text asks for all."""
    rows = spark.read.parquet(f"{root}/rows")
    if text:
        hits = candidates(spark, root, text).withColumn("folder", folder(F.col("key")))
        rows = rows.join(hits, (rows[key] == hits.key) & (rows.folder == hits.folder), "left_semi").where(haystack(facets).contains(text.lower()))
    rows = rows.drop("folder")
    return rows if depth is None else rows.where(F.col("depth") == depth)


def in_order(rows: DataFrame, sort: str, descending: bool = False, key: str = "ticker") -> DataFrame:
    """Sorted by a column, nulls last either way, ties by key."""
    return rows.orderBy(F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last(), key)
