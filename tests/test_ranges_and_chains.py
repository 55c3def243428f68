"""Range minima, greedy chains, dyadic interval joins, the two-key as-of join and weighted resampling against plain Python."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from panelspark.operators import chains, intervals, rangemin, resample
from panelspark.plans import reports as rp

DAY0 = dt.date(2020, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def test_range_minima_and_first_breach(spark):
    rng = random.Random(2)
    series = {f"T{k}": [round(rng.uniform(1, 100), 2) for _ in range(n)] for k, n in enumerate([1, 2, 37, 64, 100])}
    rows = spark.createDataFrame([(t, i, v) for t, vs in series.items() for i, v in enumerate(vs)], "ticker string, idx long, close double")
    table, top = rangemin.sparse_table(rows, "ticker", "idx", "close")
    assert top == 6 and table.count() == sum(sum(max(0, len(v) - (1 << k) + 1) for k in range(7)) for v in series.values())
    asks = []
    for i in range(300):
        t = rng.choice(list(series))
        lo = rng.randrange(len(series[t]))
        hi = rng.randrange(lo - 1, len(series[t]))
        asks.append((i, t, lo, hi, rng.choice([0.5, 5.0, 50.0, 1000.0, None])))
    asks += [(900, "none", 0, 3, 5.0), (901, "T2", None, None, 5.0)]
    q = spark.createDataFrame(asks, "id long, ticker string, lo long, hi long, stop double")
    got = {r["id"]: r for r in rangemin.first_below(rangemin.range_minimum(q, table, "ticker"), table, top, "ticker", "stop").collect()}
    assert len(got) == len(asks)
    for i, t, lo, hi, stop in asks:
        part = series[t][lo:hi + 1] if t in series and lo is not None else []
        assert got[i]["low"] == min(part, default=None)
        assert got[i]["at"] == next((lo + k for k, v in enumerate(part) if stop is not None and v < stop), None)


def test_one_row_per_position(spark):
    prices = spark.createDataFrame([("A", day(i), c) for i, c in enumerate([10.0, 9.0, None, 7.0, 8.0, 6.0])] + [("B", day(3), 5.0)], "ticker string, session date, close double")
    pos = spark.createDataFrame([(1, "A", day(1), 7.5), (2, "A", day(2), 6.5), (3, "A", day(9), 5.0), (4, "B", day(0), 1.0), (5, "C", day(0), 1.0), (6, "A", day(0), None)], "pos long, ticker string, bought date, stop double")
    got = {r["pos"]: tuple(r)[2:] for r in rp.position_lows(pos, prices).collect()}
    assert got == {1: (6.0, True, day(3)), 2: (6.0, True, day(5)), 3: (None, False, None), 4: (5.0, False, None), 5: (None, False, None), 6: (6.0, False, None)}
    assert rp.position_lows(pos, prices, str(day(3))).where("pos = 2").first()["breached"] is False


def test_chain_is_the_greedy_choice(spark):
    rng = random.Random(4)
    groups = {(a, t): sorted(rng.sample(range(400), rng.choice([1, 3, 40, 250]))) for a in "ab" for t in range(9)}
    span = {"a": 5, "b": 17}
    rows = spark.createDataFrame([(a, t, i, span[a]) for (a, t), v in groups.items() for i in v], "arm string, t long, i long, span int")
    got = {}
    for r in chains.greedy_chain(rows, ["arm", "t"], "i", "span").collect():
        got.setdefault((r["arm"], r["t"]), []).append(r["pos"])
    for (a, t), v in groups.items():
        want, last = [], -10 ** 6
        for i in v:
            if i >= last + span[a]:
                want.append(i)
                last = i
        assert sorted(got[a, t]) == want
    assert chains.greedy_chain(rows.limit(0), ["arm", "t"], "i", "span").count() == 0


@pytest.mark.parametrize("kind", ["date", "timestamp", "long"])
def test_interval_join_on_nodes(spark, kind):
    rng = random.Random(6)
    make = {"date": lambda n: day(n - 20000), "timestamp": lambda n: dt.datetime(1969, 12, 31) + dt.timedelta(seconds=n * 7919, microseconds=n), "long": lambda n: n - 500}[kind]
    raw = [(i, rng.choice("AB"), rng.randrange(3000), rng.choice([0, 1, 5, 90, 2500])) for i in range(60)]
    spans = [(k, make(lo), make(lo + n)) for _, k, lo, n in raw] + [("A", make(50), None), ("A", None, make(9)), ("B", make(9), make(3)), (None, make(0), make(5000))]
    points = [(i, rng.choice("ABC"), make(rng.randrange(6000))) for i in range(300)] + [(999, "A", None)]
    s = spark.createDataFrame(spans, f"k string, lo {kind}, hi {kind}")
    p = spark.createDataFrame(points, f"id long, k string, at {kind}")
    got = sorted((r["id"], r["lo"], r["hi"]) for r in intervals.interval_join(p, s, "k", "at", "lo", "hi").collect())
    assert got == sorted((i, lo, hi) for i, k, at in points if at is not None for sk, lo, hi in spans if sk == k and lo is not None and hi is not None and lo <= at <= hi)


def test_a_long_span_has_few_nodes(spark):
    long = spark.range(1).select(F.lit("1984-03-07").cast("date").alias("a"), F.lit("2024-11-19").cast("date").alias("b"))
    (lo, bits), (hi, _) = intervals.number(long, "a"), intervals.number(long, "b")
    nodes = [(x["level"], x["node"]) for x in long.select(intervals.span_nodes(lo, hi, bits)).first()[0]]
    covered = sorted(d for level, n in nodes for d in range(n << level, (n + 1) << level))
    assert len(nodes) < 30 and covered == list(range((dt.date(1984, 3, 7) - dt.date(1970, 1, 1)).days, (dt.date(2024, 11, 19) - dt.date(1970, 1, 1)).days + 1))


def test_names_alive_on_dates(spark):
    listed = spark.createDataFrame([("A", day(0), day(10)), ("B", day(5), None), ("C", None, None), ("D", day(4), day(4)), ("A", day(20), day(25))], "ticker string, ipo_date date, delist_date date")
    asks = spark.createDataFrame([(t, day(n)) for t in "ABCDE" for n in range(30)], "ticker string, day date")
    got = {(r["ticker"], (r["day"] - DAY0).days) for r in intervals.alive_on_dates(asks, listed, "day").collect()}
    assert got == {("A", n) for n in [*range(10), *range(20, 25)]} | {("B", n) for n in range(5, 30)}


def test_ytd_pairs_carry_the_last_filing(spark):
    rng = random.Random(9)
    rows = []
    for c in range(4):
        for y in range(3):
            end = day(365 * y)
            rows += [(c, "T", end, 4, 100.0 + rng.random(), end + dt.timedelta(days=rng.randrange(200)), f"a{rng.randrange(99)}") for _ in range(3)]
            for _ in range(12):
                rows.append((c, "T", end - dt.timedelta(days=rng.choice([60, 74, 75, 80, 91, 100, 101])), 3, rng.random(), end + dt.timedelta(days=rng.randrange(-80, 200)), f"b{rng.randrange(99)}"))
    rows = list({(r[0], r[2], r[3], r[5], r[6]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "cik long, tag string, ddate date, qtrs int, value double, filed date, adsh string")
    got = {(r["cik"], r["a_ddate"], r["a_filed"], r["a_adsh"]): (r["b_filed"], r["b_adsh"], r["b_ddate"], r["b_value"]) for r in intervals.range_self_join(df, ["cik", "tag"], 4, 3, 75, 100).collect()}
    want = {}
    for c, _, end, q, _, filed, adsh in rows:
        near = [(f, s, e, v) for cc, _, e, qq, v, f, s in rows if qq == 3 and cc == c and f <= filed and 75 <= (end - e).days <= 100]
        if q == 4 and near:
            want[c, end, filed, adsh] = max(near)
    assert got == want


def test_weights_give_the_usual_interval(spark):
    rng = random.Random(1)
    xs = [rng.gauss(5, 2) for _ in range(400)]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(xs)] + [("few", 0, 1.0), ("few", 1, 2.0), ("g", 900, None)], "g string, i long, x double")
    mean = {r["g"]: r for r in resample.weighted_bootstrap_ci(df, ["g"], "i", "x", reps=800).collect()}
    assert set(mean) == {"g"}
    half = 1.96 * statistics.stdev(xs) / 20
    assert abs(mean["g"]["ci_low"] - (statistics.mean(xs) - half)) < 0.06 and abs(mean["g"]["ci_high"] - (statistics.mean(xs) + half)) < 0.06
    med = resample.weighted_bootstrap_ci(df.where("g = 'g'"), [], "i", "x", 0.5, reps=400).first()
    assert med["ci_low"] < statistics.median(xs) < med["ci_high"] and med["ci_high"] - med["ci_low"] < 1
    w = spark.range(20000).select(resample.multiplicity(F.lit(3), F.col("id"), 7).alias("w"))
    assert abs(w.agg(F.avg("w")).first()[0] - 1) < 0.03 and abs(w.agg(F.var_samp("w")).first()[0] - 1) < 0.05
