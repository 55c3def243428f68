"""Training-text pipeline: toxic documents go, one of each near-duplicate group stays, documents that
leak test items go, sources are mixed to target weights, and what is left is sharded.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns
of documents; the last returns the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontam, mixing, sharding, simhash, toxicity
from panelspark.llm.common import table
from panelspark.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_near(docs)      # five-word shingles, similarity 0.8


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # toxic documents are gone by then, so what is left of that domain is not brought back
    _, _, model, history = mixing.mixture(docs, table(spark, sf_dir, "labels"), at_most=("toxic",))
    return mixing.resample(docs, model, history)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix), ("sharding", shard)]

# iterative groups, alignment and fitted models are no SQL; tests/llm holds stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of ``documents`` after all stages; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
