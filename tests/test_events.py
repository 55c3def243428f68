"""The event study against a sequential walk in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.plans import backtest as bt
from panelspark.plans import events as ev

DAY0 = dt.date(2020, 1, 1)


def sequential(closes, i, stop0, h):
    """One trade, step by step: (exit index, reason), or None without a fill."""
    entry = closes[i + 1]
    if entry is None or entry <= 0:
        return None
    stop, exit_i, reason = stop0, i + h, "horizon"
    for k in range(1, h + 1):
        px = closes[i + k]
        if px is None:
            exit_i, reason = i + k - 1, "panel_end"
            break
        if px >= entry + (entry - stop0):
            stop = max(stop, entry)
        if px < stop:
            exit_i, reason = min(i + k + 1, i + h), "stop"
            break
    while closes[exit_i] is None:
        exit_i, reason = exit_i - 1, "panel_end"
    return exit_i, reason


def test_walk_equals_the_sequential_form(spark):
    rng = random.Random(11)
    n, names, rows, events = 60, [f"T{k}" for k in range(12)], [], []
    series = {}
    for t in names:
        px, out = 100.0, []
        for _ in range(n):
            px *= 1 + rng.gauss(0, 0.06)
            out.append(None if rng.random() < 0.03 else round(px, 4))
        series[t] = out
        rows += [(t, s, DAY0 + dt.timedelta(days=s), c, 50.0 + s) for s, c in enumerate(out)]
        for i in range(0, n - 12, 4):
            if out[i] is not None:
                events.append(("a", 0, 10, t, i, out[i] * rng.uniform(0.9, 0.99)))
    prices = spark.createDataFrame(rows, "ticker string, s_idx int, session date, close double, bench double")
    e = spark.createDataFrame(events, "arm string, rep int, horizon int, ticker string, s_idx int, stop double")
    got = {(r["ticker"], (r["signal_date"] - DAY0).days): r for r in ev.walk(e, prices, 10).collect()}
    reasons = set()
    for _, _, h, t, i, stop in events:
        want = sequential(series[t], i, stop, h)
        if want is None:
            assert (t, i) not in got
            continue
        r = got[(t, i)]
        assert ((r["exit_date"] - DAY0).days, r["exit_reason"]) == want, (t, i)
        net = series[t][want[0]] * 0.999 / (series[t][i + 1] * 1.001) - 1
        assert r["ret_net"] == pytest.approx(net)
        assert r["excess"] == pytest.approx(net - ((50.0 + want[0]) / (51.0 + i) - 1))
        reasons.add(want[1])
    assert reasons == {"stop", "horizon", "panel_end"}


def test_only_an_accepted_event_starts_the_refractory_span(spark):
    rows = [(0, 10.0, 9.0), (2, 10.0, 9.0), (4, 10.0, 11.0), (5, 10.0, 9.0), (9, 10.0, 9.0), (10, 10.0, 9.0), (28, 10.0, 9.0)]
    sig = spark.createDataFrame([("a", 5, "T", i, DAY0 + dt.timedelta(days=i), c, s) for i, c, s in rows], "arm string, horizon int, ticker string, s_idx int, session date, close double, stop double")
    got = {r["s_idx"]: r["status"] for r in ev.classify_signals(sig, F.lit(30), start="2020-01-01").collect()}
    assert got == {0: "event", 2: "within_previous_horizon", 4: "within_previous_horizon", 5: "event", 9: "within_previous_horizon", 10: "event", 28: "truncated_at_panel_end"}


def test_control_draws_the_asked_number_of_eligible_cells(spark):
    f = spark.range(4000).select(F.concat(F.lit("T"), F.col("id") % 40).alias("ticker"), F.floor(F.col("id") / 40).cast("int").alias("s_idx"), F.lit(10.0).alias("close"),
                                 F.date_add(F.lit(DAY0), F.floor(F.col("id") / 40).cast("int")).alias("session"), (F.col("id") % 7 != 0).alias("eligible"))
    like = spark.createDataFrame([("a", 5, 60, 0.05), ("b", 10, 3000, 0.1)], "arm string, horizon int, n int, risk double")
    got = ev.control_events(f, like, replicates=4).cache()
    # more than there are cells: with replacement, and never short; a window at the panel's end leaves few cells
    many = ev.control_events(f, spark.createDataFrame([("c", 98, 500, 0.05)], "arm string, horizon int, n int, risk double"), replicates=3)
    assert [r["count"] for r in many.groupBy("rep").count().collect()] == [500] * 3 and many.where("s_idx > 1").count() == 0 and many.select("ticker", "s_idx").distinct().count() > 50
    end = ev.control_events(f, spark.createDataFrame([("d", 20, 60, 0.05)], "arm string, horizon int, n int, risk double"), replicates=5, start="2020-03-18")
    assert [r["count"] for r in end.groupBy("rep").count().collect()] == [60] * 5 and end.where("s_idx > 79 or s_idx < 77").count() == 0
    spread = [r["count"] for r in ev.control_events(f, like.where("arm = 'b'"), replicates=20).groupBy("ticker", "s_idx").count().collect()]
    assert len(spread) > 3000 and max(spread) <= 20
    counts = {(r["arm"], r["rep"]): r["count"] for r in got.groupBy("arm", "rep").count().collect()}
    assert all(counts[("a", k)] == 60 for k in range(4)) and all(counts[("b", k)] == 3000 for k in range(4))
    assert got.distinct().count() == got.count() and got.where("arm = 'a' and s_idx + 5 > 99").count() == 0
    assert got.where("arm = 'a' and rep = 0").select("ticker", "s_idx").exceptAll(got.where("arm = 'a' and rep = 1").select("ticker", "s_idx")).count() > 30


def test_arm_ids_round_trip_and_unknown_raises(spark):
    a = ev.arm_by_id("breakout_s8_h10_mkt200+x1")
    assert (a.kind, a.horizon, a.params["stop_pct"], a.params["filters"]) == ("breakout_price_only", 10, 0.08, ["mkt200", "x1"])
    assert len(ev.default_arms()) == 25
    for bad in ("breakout_b8_h10", "pullback_b3_h5_nope", "spy"):
        with pytest.raises(ValueError):
            ev.arm_by_id(bad)


def test_held_out_window_is_refused_without_registration(spark):
    log = spark.createDataFrame([("x", "test")], "arm string, split string")
    with pytest.raises(ValueError):
        ev.refuse_second_look(log, [ev.Arm("y", "pullback", 5)], "test")
    with pytest.raises(ValueError):
        ev.refuse_second_look(log, [ev.Arm("x", "pullback", 5, preregistered=True)], "test")
    ev.refuse_second_look(log, [ev.Arm("z", "pullback", 5, preregistered=True)], "test")


def test_verdict_ladder(spark):
    rows = [(0.01, -0.1, 0.1, 1.0, 30.0, "no evidence"), (-0.01, -0.1, -0.01, -3.0, 30.0, "wrong way"), (0.01, 0.001, 0.1, 3.0, 11.0, "weak"), (0.01, 0.001, 0.1, 3.0, 15.0, "suggestive"),
            (0.01, 0.001, 0.1, 2.0, 30.0, "suggestive"), (0.01, 0.001, 0.1, 4.0, 30.0, "supported"), (None, None, None, None, 30.0, "no evidence")]
    df = spark.createDataFrame(rows, "m double, lo double, hi double, t double, n double, want string")
    v = bt.excess_verdict(F.col("m"), F.col("lo"), F.col("hi"), F.col("t"), F.col("n"), 5)
    assert df.where(v != F.col("want")).count() == 0


def test_a_score_that_ranks_returns_is_supported_and_noise_is_not(spark):
    n_dates, n = 40, 40
    base = spark.range(n_dates * n).select(F.date_add(F.lit(DAY0), (F.floor(F.col("id") / n) * 21).cast("int")).alias("date"), F.concat(F.lit("T"), F.col("id") % n).alias("ticker"), F.randn(5).alias("score"), F.randn(6).alias("noise"),
                                           F.lit("s").alias("sector"), F.array().cast("array<string>").alias("buckets"))
    good = bt.summary(base.withColumn("fwd_ret", F.col("score") * 0.3 + F.col("noise")), 21, 21, limitations=["made up"], reps=400).collect()[0]
    none = bt.summary(base.withColumn("fwd_ret", F.col("noise")), 21, 21, limitations=["made up"], reps=400).collect()[0]
    assert good["verdict"] == "supported" and good["mean_ic"] > 0.15 and none["verdict"] == "no evidence"
    with pytest.raises(ValueError):
        bt.summary(base, 21, 21)
