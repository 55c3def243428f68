"""Findings of round 3 on time and memory: what is sent, written and read is bounded, and the results are the same."""

import bisect
import html
import random
import statistics

from pyspark.sql import functions as F

from panelspark.functions import text as tx
from panelspark.operators import ranks
from panelspark.operators.asof import asof_backward
from panelspark.operators.describe import describe
from panelspark.plans import events as ev
from panelspark.queries import crosssection as cs
from panelspark.queries import replay
from panelspark.queries import tables as t

SF = "/root/testdata/sf0.001"


def test_values_are_never_the_side_that_is_sent_to_the_driver(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.concat(F.lit("s"), F.col("id") % 4).alias("sec"), F.sin("id").alias("v"))
    for z in (ranks.z_table(df, ["g"], "v"), ranks.sector_neutral_z(df, ["g"], "sec", "v", "z")):
        assert "BuildLeft" not in z._jdf.queryExecution().executedPlan().toString()


def test_records_read_each_table_of_the_names_once(spark, monkeypatch):
    calls = []
    for name in ("daily", "statements", "estimates"):
        def spy(s, sf, name=name, own=getattr(t, name)):
            calls.append(name)
            return own(s, sf)
        monkeypatch.setattr(t, name, spy)
    r = cs.records(spark, SF)
    assert sorted(calls) == ["daily", "estimates", "statements"] and r.count() == r.select("ticker").distinct().count() > 0


def test_asof_of_one_value_keeps_the_greatest_and_null_keys(spark):
    a = spark.createDataFrame([("a", "2020-01-05"), ("a", "2019-01-01"), (None, "2020-01-05"), ("b", None)], "k string, d string").withColumn("d", F.to_date("d"))
    b = spark.createDataFrame([("a", "2020-01-02", 1.0), ("a", "2020-01-02", 3.0), ("a", "2020-01-02", None), (None, "2020-01-01", 7.0)], "k string, e string, v double").withColumn("e", F.to_date("e"))
    j = asof_backward(a, b, ["k"], "d", "e", ["v"])
    assert sorted((str(r.k), str(r.d), r.v) for r in j.collect()) == [("None", "2020-01-05", 7.0), ("a", "2019-01-01", None), ("a", "2020-01-05", 3.0), ("b", "None", None)]
    plan = b.groupBy("k").count()                           # a plan to compare with needs no sort
    assert "SortAggregate" not in j._jdf.queryExecution().executedPlan().toString() and plan is not None


def test_percentile_rows_are_few_and_exact(spark):
    rng = random.Random(3)
    rows = [(i % 2, rng.choice([-1, 1]) * round(rng.lognormvariate(0, 3), 3)) for i in range(4000)] + [(0, None), (2, None), (3, 5.0)]
    df = spark.createDataFrame(rows, "g int, v double").cache()
    few = ranks.value_ranks_at(df, ["g"], "v", [0.5, 0.1])
    whole = {(r.g, r.v): (r.tie_n, r.n_below, r.n) for r in ranks.value_ranks(df, ["g"], "v").collect()}
    got = few.collect()
    assert len(got) < 200 and all(whole[(r.g, r.v)] == (r.tie_n, r.n_below, r.n) for r in got)
    d = {r.g: r for r in describe(df, ["g"], "v", {"p10": 0.1}).collect()}
    for g in (0, 1):
        v = sorted(x for h, x in rows if h == g and x is not None)
        m = statistics.median(v)
        assert d[g].median == m and abs(d[g].mad - 1.4826 * statistics.median(abs(x - m) for x in v)) < 1e-12
        at = 0.1 * (len(v) - 1)
        assert abs(d[g].p10 - (v[int(at)] * (1 - at % 1) + v[int(at) + 1] * (at % 1))) < 1e-12
    assert (d[2].n, d[2].median, d[2].mad) == (0, None, None) and (d[3].median, d[3].mad) == (5.0, None)


def test_edges_are_counted_by_halving(spark):
    rng = random.Random(5)
    rows = [(sorted(rng.sample(range(5000), n)), float(x)) for n in (0, 1, 2, 511, 512, 1022, 1023) for x in (-1, 0, 17, 2500, 4999, 6000, *rng.sample(range(5000), 9))]
    got = spark.createDataFrame([([float(e) for e in es], x) for es, x in rows], "e array<double>, x double").select("e", "x", ranks.edges_upto(F.col("e"), F.col("x")).alias("n")).collect()
    assert all(r.n == bisect.bisect_right(r.e, r.x) for r in got)


def test_only_references_are_sent_to_python(spark):
    texts = ["", "plain & simple", "&notit; &amp;amp &#10;x&#x41;&#x41 &bogus; &&lt;&lt", "a&nbsp;b" * 50, "".join(f"&#{i};" for i in range(300, 900)) + "tail", "\U0001F600&eacute;\U0001F600&copy", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    out = df.select("i", tx.decode_entities("s").alias("s"))
    assert [r.s for r in out.orderBy("i").collect()] == [None if s is None else html.unescape(s) for s in texts]
    # the argument of the Python function is the list of references, not the text
    assert "decode_references(regexp_extract_all(" in out._jdf.queryExecution().analyzed().toString()


def test_event_study_writes_what_it_reads(spark):
    f = replay.fired(spark, SF)
    assert f.columns == ["ticker", "s_idx", "session", "close", "bench", "fired"]
    arms = sorted(map(tuple, ev.signals(replay.features(spark, SF), replay.ARMS).collect()), key=str)
    assert sorted(map(tuple, ev.signals_of(f).collect()), key=str) == arms


def test_walk_reaches_a_horizon_and_no_further(spark):
    p = spark.createDataFrame([("a", i, 10.0 + i, 5.0) for i in range(40)], "ticker string, s_idx int, close double, bench double").withColumn("session", F.date_add(F.lit("2020-01-01").cast("date"), F.col("s_idx")))
    e = spark.createDataFrame([("x", -1, 3, "a", s, 1.0) for s in (0, 2, 20, 36, 37, 39)], "arm string, rep int, horizon int, ticker string, s_idx int, stop double")
    got = sorted((r.entry, r.exit, r.exit_reason) for r in ev.walk(e, p, 3).collect())
    assert got == [(11.0, 13.0, "horizon"), (13.0, 15.0, "horizon"), (31.0, 33.0, "horizon"), (47.0, 49.0, "horizon"), (48.0, 49.0, "panel_end")]
