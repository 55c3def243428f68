"""Structured Streaming forms of the polling scan.

State is bounded in two ways: by event time, where a watermark closes windows and lets go of them, and by count, where a
name remembers its last ids only. Rows that come after their window has closed are kept in a table of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelspark.functions.dates import session_date
from panelspark.functions.numeric import finite
from panelspark.session import cut_lineage

MEMORY = 500            # ids a name remembers


@contextmanager
def list_state(spark: SparkSession) -> Iterator[None]:
    """The state store that lists need, for queries started inside; the session's own setting comes back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class RecentIds(StatefulProcessor):
    """The last ids reported of a name, oldest first."""

    def __init__(self, capacity: int = MEMORY, ttl_ms: int | None = None):
        self.capacity, self.ttl_ms = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ids = handle.getListState("ids", "id string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = [r[0] for r in self.ids.get()]
        seen = set(known)
        # an arrival is new if it was not remembered when the batch began; of its repeats in the batch the first counts
        first: dict[str, tuple] = {}
        for part in rows:
            for ts, i in zip(part["ts"], part["id"]):
                if i not in seen and (i not in first or ts < first[i]):
                    first[i] = ts
        fresh = sorted(first, key=lambda i: (first[i], i))
        if fresh:
            self.ids.put([(i,) for i in (known + fresh)[-self.capacity:]])
            yield pd.DataFrame({"ticker": [key[0]] * len(fresh), "id": fresh, "ts": [first[i] for i in fresh]})

    def close(self) -> None:
        pass


def report_recent(items: DataFrame, capacity: int = MEMORY, ttl_ms: int | None = None) -> DataFrame:
    """ST1: items ``(ticker, id, ts)`` that are not among the last ``capacity`` ids reported of their name.

    A batch is one scan: it is compared with what was remembered before it, then its new ids are appended in order of
    time and id, and the oldest fall out. An id that fell out is reported again. The state is one list per name, at most
    ``capacity`` long. Start the query inside ``list_state``. With ``ttl_ms`` a list is dropped so long after it was last
    written; such a query goes by the clock, so it needs a trigger that goes on and does not end by itself.
    """
    rows = items.where("ticker IS NOT NULL AND id IS NOT NULL").select("ticker", F.col("id").cast("string").alias("id"), "ts")
    return rows.groupBy("ticker").transformWithStateInPandas(RecentIds(capacity, ttl_ms), "ticker string, id string, ts timestamp", "Append", "processingTime" if ttl_ms else "none")


def state_rows(query) -> list[int]:
    """Rows of state after each batch of a query."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]


def report_once(items: DataFrame, keys: list[str], ts: str = "ts", delay: str = "30 days") -> DataFrame:
    """ST1: the first arrival of an id within the delay; later copies are dropped."""
    return items.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def alert_once(alerts: DataFrame, ts: str = "ts", delay: str = "2 days") -> DataFrame:
    """ST2: one alert per (ticker, kind, day)."""
    return alerts.withColumn("day", F.to_date(ts)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["ticker", "kind", "day"])


def quarter_hour_bars(prints: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """ST3: open, high, low and last of each ticker in 15-minute windows."""
    p = prints.withWatermark(ts, delay)
    return p.groupBy(F.window(ts, "15 minutes"), "ticker").agg(
        F.min_by("close", ts).alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", ts).alias("close"), F.count(F.lit(1)).alias("n")
    ).select("ticker", F.col("window.start").alias("ts"), "open", "high", "low", "close", "n")


def threshold_alerts(prints: DataFrame, rules: DataFrame) -> DataFrame:
    """ST4: arriving prices against the written levels (``ticker, level``), a stream-static join."""
    j = prints.join(rules, "ticker")
    gap = F.try_divide("close", "level") - 1.0
    kind = F.when(F.col("close") < F.col("level"), "trigger_intraday").when(gap <= 0.05, "near_trigger")
    return j.withColumns({"kind": kind, "value": gap}).where(F.col("kind").isNotNull())


def upsert(new: DataFrame, root: str, keys: list[str], part: str, newest: str) -> None:
    """Merge keyed rows into a table partitioned by ``part``: of a key the row with the greatest ``newest`` stays.

    Only the partitions that ``new`` touches are read and replaced, so the table does not grow with the number of
    batches and a repeated batch changes nothing.
    """
    new = cut_lineage(new)
    try:
        old = new.sparkSession.read.schema(new.schema).parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        both = new
    else:
        both = new.unionByName(old.select(*new.columns).join(new.select(part).distinct(), part, "left_semi"))
    rest = [c for c in new.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), newest).alias("_p")).select(*keys, "_p.*")
    cut_lineage(last).select(*[c for c in new.columns if c != part], part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(root)


def bar_sink(root: str):
    """ST3: a ``foreachBatch`` function for bars in update mode: a window as its newest batch left it, also while it is open."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.withColumns({"day": F.to_date("ts"), "batch": F.lit(batch_id).cast("long")}), root, ["ticker", "day", "ts"], "day", "batch")
    return write


def bars(spark: SparkSession, root: str) -> DataFrame:
    """ST3: every window, also those still open, as its newest batch left it."""
    return spark.read.parquet(root).select("ticker", "ts", "open", "high", "low", "close", "n")


def late_sink(root: str, ts: str = "ts", delay: str = "1 hour", width: str = "15 minutes"):
    """ST3: a ``foreachBatch`` function that keeps the rows a watermark of this delay turns away, below ``root/late``.

    A batch may close windows by what the batches before it have shown; a row is turned away if its window was closed when
    the batch before was done. So two marks are looked back upon, of which a table of four rows is kept; a repeated
    batch replaces its rows and its mark.
    """
    marks = "slot long, batch long, upto timestamp"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            before = {r["batch"]: r["upto"] for r in spark.read.schema(marks).parquet(f"{root}/marks").collect()}      # four rows
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            before = {}
        shown = F.lit(before.get(batch_id - 1)).cast("timestamp")
        done = F.lit(before.get(batch_id - 2)).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = batch.where(F.window(ts, width)["end"] <= done).select(*batch.columns)
        late.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/late")
        mark = batch.agg(F.greatest(F.max(ts), shown).alias("upto")).select(F.lit(batch_id % 4).alias("slot"), F.lit(batch_id).cast("long").alias("batch"), "upto")
        cut_lineage(mark).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(f"{root}/marks")
    return write


def late_rows(spark: SparkSession, root: str, schema) -> DataFrame:
    """What ``late_sink`` has kept."""
    return spark.read.schema(schema).parquet(f"{root}/late").select(*schema.names)


def merge_sink(root: str):
    """ST5: a ``foreachBatch`` function for late prints: one keyed table by session, the latest print of a key wins."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.groupBy("ticker", "session").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close")), root, ["ticker", "session"], "session", "ts")
    return write


def merged(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).select("ticker", "session", "close")


def closed_sessions(prints: DataFrame, now: str, zone: str = "America/New_York", close: str = "16:30:00") -> DataFrame:
    """ST5: prints of sessions that have ended; the running session is refused until its close."""
    local = F.from_utc_timestamp(F.lit(now).cast("timestamp"), zone)
    open_day = F.when(F.date_format(local, "HH:mm:ss") < F.lit(close), F.to_date(local))
    return prints.withColumn("session", session_date("ts", zone)).where(open_day.isNull() | (F.col("session") < open_day))


# -- batch forms ---------------------------------------------------------------------------------

def intraday_bars(raw: DataFrame) -> DataFrame:
    """Bars in UTC, the last repeat of a (ticker, ts) kept, rows without any price dropped."""
    fields = ["open", "high", "low", "close"]
    r = raw.withColumns({f: finite(f) for f in fields}).where(F.coalesce(*fields).isNotNull())
    return r.groupBy("ticker", "ts").agg(F.max_by(F.struct(*fields), "arrival").alias("_b")).select("ticker", "ts", "_b.*")


def last_prints(bars: DataFrame, cutoff: str | None = None, zone: str = "America/New_York") -> DataFrame:
    """W15 + P17: the last bar before the cutoff, its session's high, low and count, and the close of the session before.

    Bars are first reduced to one row per (ticker, session), so a busy name is not gathered.
    """
    b = bars.where(F.col("close").isNotNull())
    if cutoff is not None:
        b = b.where(F.col("ts") < F.lit(cutoff).cast("timestamp"))
    s = b.groupBy("ticker", session_date("ts", zone).alias("session")).agg(
        F.max_by("close", "ts").alias("price"), F.max("ts").alias("at"), F.max("high").alias("session_high"), F.min("low").alias("session_low"), F.count(F.lit(1)).alias("bars"))
    rec = F.struct("session", "price", "at", "session_high", "session_low", "bars")
    g = s.groupBy("ticker").agg(F.max(rec).alias("_l"), F.max("session").alias("_s"))
    prior = s.join(g.select("ticker", "_s"), "ticker").where(F.col("session") < F.col("_s")).groupBy("ticker").agg(F.max_by("price", "session").alias("prior_close"))
    j = g.join(prior, "ticker", "left")
    return j.select("ticker", "_l.*", "prior_close", (F.try_divide("_l.price", "prior_close") - 1.0).alias("change"))
