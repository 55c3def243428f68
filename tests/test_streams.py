"""Streams with bounded state: a name's memory, closed windows, late rows, merged tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.session import scratch_path
from panelspark.streaming import alerts as sm

T0 = dt.datetime(2024, 1, 1)


def stream(spark, batches, schema):
    """A stream that reads one list of rows a batch."""
    path = scratch_path(spark, "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer, spark):
    q = writer.option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return q


def test_the_first_id_falls_out_with_the_501st(spark):
    ids = "ticker string, id string, ts timestamp"
    at = lambda n: T0 + dt.timedelta(seconds=n)
    batches = [[("A", f"i{k:03}", at(k)) for k in range(500)] + [("A", "i000", at(600)), ("B", "b", at(1)), (None, "x", at(1)), ("B", None, at(1))],
               [("A", "i000", at(700)), ("A", "i499", at(701)), ("B", "b", at(702))],
               [("A", "new", at(800)), ("A", "new", at(801))],
               [("A", "i000", at(900)), ("A", "i001", at(901)), ("A", "new", at(902)), ("B", "c", at(903))]]
    path = scratch_path(spark, "out")
    with sm.list_state(spark):
        q = run(sm.report_recent(stream(spark, batches, ids)).writeStream.format("parquet").option("path", path), spark)
    out = spark.read.parquet(path)
    got = {(r["ticker"], r["id"]): r["n"] for r in out.groupBy("ticker", "id").agg(F.count("*").alias("n")).collect()}
    # the 501st pushed i000 out, which is reported again; i001 was still remembered when its batch began
    assert got == {("A", f"i{k:03}"): 1 + (k == 0) for k in range(500)} | {("A", "new"): 1, ("B", "b"): 1, ("B", "c"): 1}
    assert max(sm.state_rows(q)) <= 2 * 501 and len(sm.state_rows(q)) >= 4
    assert out.where("id = 'new'").first()["ts"] == at(800)
    assert "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_windows_close_once_and_late_rows_are_kept(spark):
    schema = "ticker string, ts timestamp, close double"
    at = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[("A", at(0 + k / 10), float(k)) for k in range(40)], [("A", at(10 + k / 10), float(k)) for k in range(40)],
               [("A", at(20), 1.0), ("A", at(2), 99.0), ("A", at(13.5), 50.0)], [("A", at(30), 1.0), ("A", at(12), 98.0)]]
    everything = spark.createDataFrame([r for b in batches for r in b], schema)
    path, root = scratch_path(spark, "bars"), scratch_path(spark, "late")
    q = run(sm.quarter_hour_bars(stream(spark, batches, schema)).writeStream.format("parquet").option("path", path).outputMode("append"), spark)
    late_stream = stream(spark, batches, schema)
    run(late_stream.writeStream.foreachBatch(sm.late_sink(root)), spark)
    late = sm.late_rows(spark, root, late_stream.schema)
    assert sorted(r["close"] for r in late.collect()) == [98.0, 99.0]
    bars = spark.read.parquet(path)
    assert bars.groupBy("ticker", "ts").count().where("count > 1").count() == 0
    # closed bars and late rows are all there is, but for the windows that are still open
    closed = everything.where(F.window("ts", "15 minutes")["end"] <= F.lit(at(29))).select(*everything.columns)
    assert bars.agg(F.sum("n")).first()[0] + late.count() == closed.count()
    whole = {(r["ts"], r["n"]) for r in sm.quarter_hour_bars(closed.exceptAll(late)).collect()}
    assert {(r["ts"], r["n"]) for r in bars.collect()} == whole
    rows = sm.state_rows(q)
    assert any(b < a for a, b in zip(rows, rows[1:])) and rows[-1] < max(rows)


def test_a_repeated_batch_changes_nothing(spark):
    root = scratch_path(spark, "late")
    sink = sm.late_sink(root)
    make = lambda hours: spark.createDataFrame([("A", T0 + dt.timedelta(hours=h)) for h in hours], "ticker string, ts timestamp")
    for batch_id, hours in enumerate([[0], [10], [1, 20], [11, 30], [40], [41]]):
        for _ in range(2):
            sink(make(hours), batch_id)
    # batch 2 may turn away what the mark of batch 0 closed (hour 0), batch 3 what that of batch 1 did (hour 10): nothing so far
    assert sm.late_rows(spark, root, make([0]).schema).count() == 0 and spark.read.parquet(f"{root}/marks").count() == 4
    for _ in range(2):
        sink(make([12, 42]), 6)
    assert [r["ts"].hour for r in sm.late_rows(spark, root, make([0]).schema).collect()] == [12]


def test_merged_tables_touch_only_their_partitions(spark):
    root = scratch_path(spark, "merge")
    sink = sm.bar_sink(root)
    bar = lambda n, *hours: spark.createDataFrame([("A", T0 + dt.timedelta(hours=h), 1.0, 2.0, 0.5, float(n), n) for h in hours], "ticker string, ts timestamp, open double, high double, low double, close double, n long")
    sink(bar(1, 0, 30), 0)
    sink(bar(2, 0, 1), 1)
    sink(bar(2, 0, 1), 1)
    files = {r[0] for r in spark.read.parquet(root).where("day = '2024-01-02'").select(F.input_file_name()).collect()}
    sink(bar(3, 1), 2)
    assert {r[0] for r in spark.read.parquet(root).where("day = '2024-01-02'").select(F.input_file_name()).collect()} == files
    assert sorted((r["ts"].day, r["ts"].hour, r["n"]) for r in sm.bars(spark, root).collect()) == [(1, 0, 2), (1, 1, 3), (2, 6, 1)]


@pytest.mark.parametrize("capacity,want", [(1, 3), (2, 2)])
def test_memory_is_by_count(spark, capacity, want):
    rows = [[("A", "x", T0)], [("A", "y", T0)], [("A", "x", T0)]]
    path = scratch_path(spark, "out")
    with sm.list_state(spark):
        run(sm.report_recent(stream(spark, rows, "ticker string, id string, ts timestamp"), capacity).writeStream.format("parquet").option("path", path), spark)
    assert spark.read.parquet(path).count() == want
