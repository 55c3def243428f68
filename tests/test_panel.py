"""Panel windows, as-of joins, intervals and forward returns on tiny panels."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelspark.operators import asof, intervals, panel, resample

D = dt.date


def prices(spark, rows):
    return spark.createDataFrame([(t, D(2020, 1, d), c) for t, d, c in rows], "ticker string, session date, close double")


@pytest.fixture
def small(spark):
    rows = [("LIVE", d, 10.0 + d) for d in range(1, 11) if d != 5] + [("DEAD", d, 100.0 - d) for d in range(1, 5)] + [("LATE", d, 50.0) for d in range(6, 11)] + [("ZERO", d, 0.0) for d in range(1, 11)]
    return prices(spark, rows)


def statuses(spark, small, probes, h, policy="truncate"):
    p = spark.createDataFrame([(t, D(2020, 1, d)) for t, d in probes], "ticker string, date date")
    req = spark.createDataFrame([(t,) for t in ("LIVE", "DEAD", "LATE", "ZERO", "NONE")], "ticker string")
    return {(r["ticker"], r["date"].day): (r["status"], r["fwd_ret"], r["stopped_trading"]) for r in panel.forward_returns(p, small, h, policy, req).collect()}


def test_forward_return_statuses(spark, small):
    s = statuses(spark, small, [("LIVE", 1), ("LIVE", 5), ("LIVE", 9), ("DEAD", 2), ("DEAD", 4), ("DEAD", 6), ("LATE", 3), ("ZERO", 2), ("NONE", 2), ("WHO", 2)], 3)
    assert s[("LIVE", 1)] == ("ok", pytest.approx(14.0 / 11.0 - 1), False)
    assert s[("LIVE", 5)][0] == "ok" and s[("LIVE", 5)][1] == pytest.approx(17.0 / 14.0 - 1)
    assert s[("LIVE", 9)][0] == "short_panel"
    assert s[("DEAD", 2)] == ("truncated", pytest.approx(96.0 / 98.0 - 1), True)
    assert s[("DEAD", 4)][0] == "truncated" and s[("DEAD", 4)][1] == 0.0
    assert s[("DEAD", 6)] == ("already_delisted", None, True)
    assert s[("LATE", 3)][0] == "not_listed_yet"
    assert s[("ZERO", 2)] == ("bad_base_price", None, False)
    assert s[("NONE", 2)][0] == "no_data" and s[("WHO", 2)][0] == "no_column"


def test_policy_none_gives_no_return_for_a_departed_name(spark, small):
    assert statuses(spark, small, [("DEAD", 2)], 3, "none")[("DEAD", 2)] == ("delisted", None, True)


def test_unknown_policy_raises(spark, small):
    with pytest.raises(ValueError):
        panel.forward_returns(small.select("ticker", F.col("session").alias("date")), small, 1, "maybe")


def test_fill_stays_within_life(spark, small):
    cal = panel.calendar(small)
    f = panel.fill_within_life(panel.densify(panel.indexed(small, cal), cal))
    got = {(r["ticker"], r["session"].day): r["filled"] for r in f.collect()}
    assert got[("LIVE", 5)] == 14.0 and ("DEAD", 5) not in got and ("LATE", 5) not in got


def test_rolling_needs_its_minimum(spark):
    p = prices(spark, [("A", d, float(d)) for d in (1, 2, 3, 4, 6)] + [("B", 5, 1.0)])
    cal = panel.calendar(p)
    d = panel.densify(panel.indexed(p, cal), cal)
    got = {r["session"].day: r["m"] for r in d.select("ticker", "session", panel.rolling(F.avg, "close", 3, 3).alias("m")).where("ticker = 'A'").collect()}
    assert got == {1: None, 2: None, 3: 2.0, 4: 3.0, 5: None, 6: None}


def brute_asof(left, right, forward, strict):
    out = {}
    for k, t in left:
        ok = [(x, v) for kk, x, v in right if kk == k and ((x > t if strict else x >= t) if forward else (x < t if strict else x <= t))]
        out[(k, t)] = (min(ok) if forward else max(ok))[1] if ok else None
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_asof_against_brute_force(spark, forward, strict, kind):
    base = dt.datetime(2020, 1, 1)
    step = dt.timedelta(days=1) if kind == "date" else dt.timedelta(hours=7)
    right = [(k, base + step * i, float(i)) for k, idx in (("a", (1, 4, 9, 30)), ("b", (2, 3))) for i in idx]
    left = [(k, base + step * i) for k in ("a", "b", "c") for i in range(0, 33, 3)] + [("a", base + step * 4)]
    conv = (lambda x: x.date()) if kind == "date" else (lambda x: x)
    lf = spark.createDataFrame([(k, conv(t)) for k, t in left], f"k string, t {kind}")
    rt = spark.createDataFrame([(k, conv(t), v) for k, t, v in right], f"k string, at {kind}, v double")
    fn = asof.asof_forward if forward else asof.asof_backward
    rows = fn(lf, rt, ["k"], "t", "at", ["v"], strict=strict).collect()
    want = brute_asof([(k, conv(t)) for k, t in left], [(k, conv(t), v) for k, t, v in right], forward, strict)
    assert len(rows) == len(left)
    assert {(r["k"], r["t"]): r["v"] for r in rows} == want


def test_membership_spans_open_end_and_unknown_name(spark):
    rows = spark.createDataFrame([("A", D(2020, m, 15)) for m in range(1, 13)] + [("B", D(2020, 6, 1)), ("C", D(2020, 6, 1))], "ticker string, session date")
    spans = spark.createDataFrame([("A", D(2020, 2, 1), D(2020, 3, 15)), ("A", D(2020, 11, 1), None), ("B", D(2020, 6, 1), D(2020, 6, 1))], "ticker string, start_date date, end_date date")
    got = {(r["ticker"], r["session"].month) for r in intervals.inside_any(rows, spans, "ticker", "session").collect()}
    assert got == {("A", 2), ("A", 3), ("A", 11), ("A", 12), ("B", 6)}


def test_merge_prefers_new_and_keeps_old(spark):
    old = prices(spark, [("A", 1, 1.0), ("A", 2, 2.0)])
    new = prices(spark, [("A", 2, 20.0), ("A", 3, None)]).unionByName(prices(spark, [("B", 1, 5.0)]))
    got = {(r["ticker"], r["session"].day): r["close"] for r in panel.merge_panels(old, new, ["close"]).collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 20.0, ("A", 3): None, ("B", 1): 5.0}


def test_block_bootstrap_brackets_the_mean_and_needs_three(spark):
    vals = [0.01 * ((i * 37) % 11 - 4) for i in range(40)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vals)] + [("b", 0, 1.0), ("b", 1, 2.0)], "k string, i int, v double")
    got = {r["k"]: r for r in resample.block_bootstrap_ci(df, ["k"], "i", "v", 4, reps=500).collect()}
    mean = sum(vals) / 40
    assert set(got) == {"a"} and got["a"]["ci_low"] < mean < got["a"]["ci_high"]
