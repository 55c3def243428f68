"""Committed snapshots, the substring index, older filing pages, sources that fail, and ranks of close values."""

import datetime as dt
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from panelspark.operators import ranks
from panelspark.plans import scan, search
from panelspark.sources import payloads, sinks


def scores(spark, n, shift=0.0):
    return spark.createDataFrame([(v, f"T{i}", i + shift) for i in range(n) for v in ("a", "b")], "variant string, ticker string, score double")


def test_an_uncommitted_snapshot_is_invisible(spark, tmp_path):
    root = str(tmp_path / "arch")
    with pytest.raises(ValueError, match="no snapshot"):
        sinks.read_archive(spark, root)
    attempt = sinks.stage_snapshot({"scores": scores(spark, 3)}, root, "2024-01-01")          # cut off before the commit
    assert sinks.manifest(spark, root).count() == 0
    assert sinks.archive_snapshot(scores(spark, 5), root, "2024-01-02", inputs=spark.range(7))
    assert {str(r[0]) for r in sinks.read_archive(spark, root).select("snapshot_date").distinct().collect()} == {"2024-01-02"}
    sinks.commit_snapshot(spark, ["scores"], root, "2024-01-01", attempt)
    assert sinks.read_archive(spark, root).groupBy("snapshot_date").count().count() == 2
    m = sinks.manifest(spark, root).where("day = '2024-01-02'").first()
    assert {(x["name"], x["n_rows"]) for x in m["tables"]} == {("scores", 10), ("tickers", 10), ("inputs", 7)}
    assert sinks.read_archive(spark, root, "inputs").count() == 7


def test_again_is_a_no_op_and_force_replaces(spark, tmp_path):
    root = str(tmp_path / "arch")
    assert sinks.archive_snapshot(scores(spark, 4), root, "2024-01-01")
    before = sinks.manifest(spark, root).first()
    assert not sinks.archive_snapshot(scores(spark, 9), root, "2024-01-01") and sinks.manifest(spark, root).first() == before
    assert sinks.archive_snapshot(scores(spark, 4).repartition(7), str(tmp_path / "other"), "2024-01-01")
    sha = lambda r: {x["name"]: x["content_sha"] for x in r["tables"]}
    assert sha(sinks.manifest(spark, str(tmp_path / "other")).first()) == sha(before)            # neither order nor files matter
    assert sinks.archive_snapshot(scores(spark, 4, 1.0), root, "2024-01-01", force=True)
    assert sinks.read_archive(spark, root).agg(F.min("score")).first()[0] == 1.0 and sha(sinks.manifest(spark, root).first()) != sha(before)


def test_changed_files_are_found(spark, tmp_path):
    root = str(tmp_path / "arch")
    sinks.archive_snapshot(scores(spark, 40).repartition(3), root, "2024-01-01")
    assert {r["status"] for r in sinks.verify_snapshot(spark, root, "2024-01-01").collect()} == {"ok"}
    files = sorted((tmp_path / "arch" / "data" / "scores").rglob("part-*.parquet"))
    shutil.copy(files[0], files[1])
    for crc in (tmp_path / "arch").rglob(".part-*.crc"):
        crc.unlink()
    got = [r["status"] for r in sinks.verify_snapshot(spark, root, "2024-01-01").where("table = 'scores'").collect()]
    assert sorted(got) == ["changed", "ok", "ok"]


def test_substrings_by_grams(spark, tmp_path):
    rng = random.Random(7)
    words = ["steel", "Steel works", "Tech", "bank", None, "", "aaaa", "über", "x" * 30]
    rows = [(f"T{i}", rng.choice(words), rng.choice(words), rng.choice(words), rng.choice(["full", "screen"]), rng.choice([None, 1.0, 2.0])) for i in range(120)]
    df = spark.createDataFrame(rows, "ticker string, name string, sector string, industry string, depth string, score double")
    root = str(tmp_path / "ix")
    search.write_index(df, root)
    for text in ("st", "S", "steel", "eel w", "aaa", "aaaaa", "ÜBER", "t1", "zzz", "l bank", ""):
        for depth in (None, "full"):
            want = {t for t, *f, d, _ in rows if text.lower() in " ".join([t, *(x for x in f if x is not None)]).lower() and depth in (None, d)}
            assert {r["ticker"] for r in search.search(spark, root, text, depth).collect()} == want, (text, depth)
    # only candidates are looked at: the anagram shares letters, not trigrams
    assert search.candidates(spark, root, "bank").count() == sum("bank" in " ".join(x for x in r[1:4] if x) for r in rows)
    back = [r["score"] for r in search.in_order(search.search(spark, root, "t"), "score", True).collect()]
    assert back == sorted(back, key=lambda v: (v is None, -(v or 0)))


def test_a_withheld_page_is_a_row(spark, tmp_path):
    page = lambda *days: {"accessionNumber": [f"a{d}" for d in days], "form": ["8-K"] * len(days), "filingDate": [f"2020-01-{d:02}" for d in days], "acceptanceDateTime": [f"2020-01-{d:02}T21:05:00.000Z" for d in days]}
    named = lambda n, c, lo, hi: {"name": n, "filingCount": c, "filingFrom": f"2020-01-{lo:02}", "filingTo": f"2020-01-{hi:02}"}
    main = {"cik": "77", "filings": {"recent": page(20, 21), "files": [named("p1.json", 2, 10, 12), named("p2.json", 1, 5, 5), named("p3.json", 3, 1, 3), named("p4.json", 1, 1, 2)]}}
    (tmp_path / "main").mkdir(), (tmp_path / "pages").mkdir()
    (tmp_path / "main" / "m.json").write_text(json.dumps(main))
    for name, p in (("p1.json", page(10, 12)), ("p3.json", page(1)), ("p4.json", page(4)), ("stray.json", page(2))):
        (tmp_path / "pages" / name).write_text(json.dumps(p))
    rows, pages = payloads.filing_pages(spark, str(tmp_path / "main"), str(tmp_path / "pages"))
    assert {r["page"]: (r["status"], r["said_n"], r["read_n"]) for r in pages.collect()} == {"p1.json": ("ok", 2, 2), "p2.json": ("missing", 1, None), "p3.json": ("count", 3, 1), "p4.json": ("dates", 1, 1), "stray.json": ("unnamed", None, 1)}
    got = rows.collect()
    assert {(r["cik"], r["accession"], r["page"]) for r in got} == {("0000000077", a, p) for a, p in (("a20", "recent"), ("a21", "recent"), ("a10", "p1.json"), ("a12", "p1.json"), ("a1", "p3.json"), ("a4", "p4.json"))}
    assert next(r["accepted"] for r in got if r["accession"] == "a10") == dt.datetime(2020, 1, 10, 21, 5)


def test_one_bad_source_neither_fails_nor_silences_the_scan(spark, tmp_path):
    day = dt.date(2024, 3, 1)
    names = spark.createDataFrame([("A", None, None, "long", 10.0, None, 9.0, True), ("B", None, None, "long", None, None, None, False)], "ticker string, date date, action string, kind string, price_at_call double, wrong_if string, trigger double, held boolean")
    prices = spark.createDataFrame([("A", day - dt.timedelta(days=i), 8.0 + i) for i in range(8)], scan.PRICES)
    filings = spark.createDataFrame([("1", "8-K", day, "acc", ["2.02"])], scan.FILINGS)
    ids = spark.createDataFrame([("A", "1")], "ticker string, cik string")
    broken = lambda: prices.select("ticker", "session", F.raise_error(F.lit("feed broke off")).cast("double").alias("close"))

    def refuses():
        raise OSError("no connection")

    r = scan.watch_scan(spark, names, {"prices": lambda: prices, "filings": lambda: filings, "headlines": refuses}, str(day), "2024-02-01", ids)
    assert {x["source"]: (x["status"], x["n_rows"], x["newest"]) for x in r.sources.collect()} == {"prices": ("ok", 8, "2024-03-01"), "filings": ("ok", 1, "2024-03-01"), "headlines": ("failed", 0, None)}
    assert "no connection" in r.sources.where("source = 'headlines'").first()["reason"]
    alerts = r.alerts.orderBy("place").collect()
    assert [a["place"] for a in alerts] == list(range(1, len(alerts) + 1)) and [a["severity"] for a in alerts] == sorted((a["severity"] for a in alerts), reverse=True)
    assert {a["kind"] for a in alerts} == {"trigger", "drop_week", "move_day", "earnings_8k"}
    rows = {x["ticker"]: x for x in r.names.collect()}
    assert (rows["A"]["n_alerts"], rows["A"]["n_rule_alerts"], rows["B"]["n_alerts"], rows["B"]["note"]) == (4, 3, 0, "no id, filings not scanned")
    r = scan.watch_scan(spark, names, {"prices": broken, "filings": lambda: filings.limit(0)}, str(day), "2024-02-01", ids)
    assert {x["source"]: x["status"] for x in r.sources.collect()} == {"prices": "failed", "filings": "empty", "headlines": "absent"} and r.alerts.count() == 0 and r.names.count() == 2


def test_close_values_are_spread_and_ranked_exactly(spark):
    n = 60_000
    df = spark.range(n).select((F.lit(1.0) + (F.col("id") * 7919 % n) * F.lit(1e-5 / n)).alias("x"), F.lit("g").alias("g"))
    distinct = df.distinct().withColumn("_b", ranks.value_bucket(F.col("x")))
    assert distinct.select("_b").distinct().count() <= 2                                          # all in one or two buckets
    edges = ranks.crowded_edges(distinct.withColumn("tie_n", F.lit(1)), ["g"], "x", 1000)
    cut = distinct.join(edges, ["g", "_b"]).select(F.size(F.filter("_edges", lambda e: e <= F.col("x"))).alias("c"), "_b").groupBy("_b", "c").count()
    assert cut.agg(F.max("count")).first()[0] < 5 * n / ranks.CUTS + 400
    got = ranks.value_ranks(df, ["g"], "x", crowd=1000).orderBy("x").select("n_below", "tie_n", "n").collect()
    assert [r["n_below"] for r in got] == list(range(n)) and all(r["tie_n"] == 1 and r["n"] == n for r in got)


def test_position_of_very_many_equal_scores(spark):
    rng = random.Random(3)
    rows = [(f"{rng.choice('ABC')}{i:05}", rng.choice([None, 1.0, 2.0])) for i in range(500)]
    for down in (True, False):
        got = {r["t"]: r["rank"] for r in ranks.position(spark.createDataFrame(rows, "t string, s double"), "s", "t", descending=down).collect()}
        key = (lambda r: (-(r[1] if r[1] is not None else -9), r[0])) if down else (lambda r: (r[1] if r[1] is not None else 9, r[0]))
        assert [t for t, _ in sorted(rows, key=key)] == sorted(got, key=got.get)
    got = ranks.position(spark.createDataFrame([(i % 13, 1.0) for i in range(13)], "t long, s double"), "s", "t").orderBy("rank").collect()
    assert [r["t"] for r in got] == list(range(13))


def test_sentences_end_where_they_end(spark):
    from panelspark.plans.figures import sentences
    text = "Acme Inc. Expects growth.  U.S. Sales rose vs. Last year! (Flat) in Co. B? \"Yes.\" No. Five is out. Approx. Ten"
    got = spark.createDataFrame([(text,), ("",), ("one only",)], "t string").select(sentences(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in got] == [["Acme Inc. Expects growth.", "U.S. Sales rose vs. Last year!", "(Flat) in Co. B?", "\"Yes.\" No. Five is out.", "Approx.", "Ten"], [], ["one only"]]


def test_peer_inputs_are_an_argument(spark):
    from panelspark.plans.peers import peer_valuation
    rows = [(f"T{i}", "Steel", "Basic", float(i + 1), float(20 - i), 0.1 * i, 0.2, 0.3, 0.01 * i) for i in range(8)]
    r = spark.createDataFrame(rows, "ticker string, industry string, sector string, forward_pe double, ev_ebitda double, roic_avg double, fcf_margin_avg double, rev_cagr double, gm_std double")
    a, b = peer_valuation(r), peer_valuation(r, price_inputs=(("EV/EBITDA", "ev_ebitda"),), quality_inputs=(("return on invested capital", "roic_avg", True),))
    assert a.columns == b.columns and {x["ticker"]: x["price_rank"] for x in b.collect()}["T7"] == 0.0 != {x["ticker"]: x["price_rank"] for x in a.collect()}["T7"]
