"""Files: row order over several files, headers of every file, repeatable writes, errors that are not swallowed."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from panelspark.sources import sinks, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_the_last_row_of_the_last_file_wins_whatever_the_sizes(spark, tmp_path):
    write(tmp_path / "s" / "a.csv", "ticker,score\nX,1\nX,2\n")
    write(tmp_path / "s" / "b.csv", "ticker,score\n" + "".join(f"T{i},0\n" for i in range(5000)) + "X,3\nX,4\n")
    write(tmp_path / "s" / "c.csv", "ticker,score\nY,1\n")
    got = {r["ticker"]: r["score"] for r in tables.screen_rows(spark, str(tmp_path / "s"), {"score": "double"}).where("ticker in ('X', 'Y')").collect()}
    assert got == {"X": 4.0, "Y": 1.0}


def test_the_first_present_value_is_of_the_first_file(spark, tmp_path):
    head = "date,open,high,low,close,volume,Name\n"
    write(tmp_path / "b" / "a.csv", head + "2020-01-02,,2,1,1.5,10,x\n")
    write(tmp_path / "b" / "b.csv", head + "".join(f"2020-01-03,1,2,1,1.5,10,n{i}\n" for i in range(4000)) + "2020-01-02,9,9,9,9,9,x\n")
    r = tables.ohlcv_rows(spark, str(tmp_path / "b")).where("ticker = 'X'").first()
    assert (r["open"], r["close"], r["volume"]) == (9.0, 1.5, 10.0)


def test_adjusted_layout(spark, tmp_path):
    write(tmp_path / "p.csv", "Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,1,1,10,5,7\n2020-01-03,1,1,1,10,,7\n2020-01-02,1,1,1,10,6,7\n")
    got = {str(r["session"]): r["close"] for r in tables.adjusted_price_rows(spark, str(tmp_path / "p.csv"), "X").collect()}
    assert got == {"2020-01-02": 6.0, "2020-01-03": 10.0}


def test_every_listing_file_is_checked(spark, tmp_path):
    head = ",".join(tables.LISTING_COLUMNS)
    write(tmp_path / "l" / "a.csv", "﻿" + head + "\nabc,Name,NYSE,Stock,2000-01-01,null,Active\n")
    assert tables.listing_rows(spark, str(tmp_path / "l")).count() == 1
    write(tmp_path / "l" / "b.csv", '{"Information": "limit reached"}\n')
    with pytest.raises(ValueError, match="not a listing"):
        tables.listing_rows(spark, str(tmp_path / "l"))
    write(tmp_path / "m" / "a.csv", "symbol,name\nabc,x\n")
    with pytest.raises(ValueError, match="unexpected listing header"):
        tables.listing_rows(spark, str(tmp_path / "m"))


def test_writing_a_day_twice_keeps_one_copy(spark, tmp_path):
    df = spark.range(5).select(F.col("id"), F.lit("x").alias("ticker"))
    for day in ("2020-01-01", "2020-01-02", "2020-01-01"):
        sinks.write_screen(df, str(tmp_path), day)
    assert spark.read.parquet(f"{tmp_path}/history").count() == 10 and spark.read.parquet(f"{tmp_path}/latest").count() == 5


def test_an_unreadable_manifest_is_an_error_and_not_an_empty_archive(spark, tmp_path):
    scores = spark.createDataFrame([("A", 1.0)], "ticker string, score double")
    assert sinks.archive_snapshot(scores, str(tmp_path / "ok"), "2020-01-01") and not sinks.archive_snapshot(scores, str(tmp_path / "ok"), "2020-01-01")
    write(tmp_path / "bad" / "manifest" / "day=2020-01-01" / "part-0.parquet", "not a parquet file at all")
    with pytest.raises(Exception) as e:
        sinks.archive_snapshot(scores, str(tmp_path / "bad"), "2020-01-01")
    assert not (isinstance(e.value, AnalysisException) and e.value.getCondition() == "PATH_NOT_FOUND")
    assert not (tmp_path / "bad" / "scores").exists()
