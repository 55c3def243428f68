"""Greedy choice along a line by pointer doubling: the first row, then each next row at least a span later.

A row's successor is the first row of its group at or after its own position plus its span, found for all rows by
one union-and-carry. Successors two, four, eight ... steps ahead come from equi-joins of the table before with
itself, so the chain from the first row is marked in as many joins as its length has bits. No group is listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import cut_lineage


def successors(rows: DataFrame, keys: list[str], pos: str, span: str) -> DataFrame:
    """``keys, pos, nxt`` of every row that has a row at or after ``pos + span``."""
    at = F.col(pos).cast("long")
    real = rows.select(*keys, at.alias("at"), F.lit(0).alias("ask"), at.alias("pos"))
    asks = rows.select(*keys, (at + F.col(span)).alias("at"), F.lit(1).alias("ask"), at.alias("pos"))
    back = Window.partitionBy(*keys).orderBy(F.desc("at"), "ask").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("ask") == 0, F.col("pos")), ignorenulls=True).over(back)
    return real.unionByName(asks).withColumn("nxt", near).where("ask = 1 AND nxt IS NOT NULL").select(*keys, "pos", "nxt")


def greedy_chain(rows: DataFrame, keys: list[str], pos: str, span: str) -> DataFrame:
    """``keys, pos`` of the rows chosen; ``rows`` have one row per keys and position, and a span above 0."""
    first = cut_lineage(rows.groupBy(*keys).agg(F.min(F.col(pos).cast("long")).alias("pos")))
    jumps, jump = [], cut_lineage(successors(rows, keys, pos, span))
    while not jump.isEmpty():
        jumps.append(jump)
        # as large as the rows, and written small: never sent to the driver
        jump = cut_lineage(jump.join(jump.hint("merge").select(*keys, F.col("pos").alias("nxt"), F.col("nxt").alias("far")), [*keys, "nxt"]).select(*keys, "pos", F.col("far").alias("nxt")))
    chosen = first
    for jump in reversed(jumps):
        both = F.array_compact(F.array("pos", "nxt"))
        chosen = chosen.join(jump.hint("merge"), [*keys, "pos"], "left").select(*keys, F.explode(both).alias("pos"))
    return chosen
