"""Steps that moved or broadcast more than they needed: same rows, and plans that no longer do."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm import simhash
from panelspark.operators import chains, intervals, ranks
from panelspark.plans import events as ev
from panelspark.plans import reports as rp

DAY0 = dt.date(2020, 1, 6)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def series(spark):
    rng = random.Random(7)
    bars = [(t, day(d), float(rng.randrange(50, 99))) for t in "ABC" for d in range(40) if rng.random() < 0.7] + [("A", day(50), None), (None, day(3), 1.0), ("A", None, 1.0)]
    held = [(i, rng.choice("ABCD"), day(rng.randrange(-3, 45)), rng.choice([None, 60.0, 75.0])) for i in range(30)]
    held += [(3, "B", day(9), 70.0), held[4], (None, "A", day(1), 60.0), (None, "C", day(2), 60.0), (90, None, day(1), 1.0), (91, "A", None, 1.0)]
    return held, bars, spark.createDataFrame(held, "pos long, ticker string, bought date, stop double"), spark.createDataFrame(bars, "ticker string, session date, close double")


def test_running_lows_equal_the_walk_also_for_repeated_positions(spark):
    held, bars, h, b = series(spark)
    want = []
    for pos in {r[0] for r in held}:
        pairs = sorted((d, c, s) for p, t, f, s in held if p == pos and t and f for u, d, c in bars if u == t and c is not None and d and d >= f)
        for d in sorted({x[0] for x in pairs}):
            here = [x for x in pairs if x[0] <= d]
            if len({(c, s) for x, c, s in pairs if x == d}) == 1:           # ties of one day have no order
                want += [(pos, d, min(x[1] for x in here), x[2] is not None and min(y[1] for y in here) < x[2]) for x in pairs if x[0] == d]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    rows = [(r["pos"], r["session"], r["low_so_far"], bool(r["breached"])) for r in rp.running_lows(h, b).collect()]
    clear = {(r[0], r[1]) for r in want}
    assert sorted((r for r in rows if (r[0], r[1]) in clear), key=key) == sorted(want, key=key) and len(want) > 200


def test_running_lows_do_not_sort_pairs(spark):
    held, bars, h, b = series(spark)
    plan = initial_plan(rp.running_lows(h.dropDuplicates(["pos"]).where("pos IS NOT NULL"), b))
    top = plan[:plan.index("SortMergeJoin")]
    assert "Window" not in top and "Exchange" not in top


def test_in_spans_multiplies_no_row(spark):
    rng = random.Random(3)
    spans = [(rng.choice(["A", "B", None]), day(s), rng.choice([None, day(s + rng.randrange(-2, 9))])) if rng.random() < 0.95 else ("A", None, day(9)) for s in range(0, 60, 4)]
    rows = [(i, rng.choice(["A", "B", "C", None]), rng.choice([None, *map(day, range(-2, 70))])) for i in range(300)]
    rows += rows[:20]
    r, s = spark.createDataFrame(rows, "id int, k string, d date"), spark.createDataFrame(spans, "k string, start_date date, end_date date")
    inside = lambda k, d: any(k and d and k == x and a and a <= d and (b is None or d <= b) for x, a, b in spans)
    assert sorted(x["id"] for x in intervals.inside_any(r, s, "k", "d").collect()) == sorted(i for i, k, d in rows if inside(k, d))
    plan = initial_plan(intervals.inside_any(r, s, "k", "d"))
    assert "Generate" not in plan and "Join" not in plan


def test_walk_moves_no_arrays(spark):
    bars = spark.createDataFrame([("A", i, day(i), 10.0 + i, 100.0) for i in range(12)] + [(None, 0, day(0), 1.0, 1.0)], "ticker string, s_idx int, session date, close double, bench double")
    e = spark.createDataFrame([("x", -1, 3, "A", 2, 9.0), ("x", -1, 3, "A", 2, 9.0), ("x", -1, 3, "A", 40, 9.0), ("x", -1, 3, None, 0, 0.5)], "arm string, rep int, horizon int, ticker string, s_idx int, stop double")
    got = ev.walk(e, bars, 5)
    assert [(r["entry"], r["exit"], r["sessions_held"]) for r in got.collect()] == [(13.0, 15.0, 2)] * 2
    plan = initial_plan(got)
    assert "Exchange" not in plan[:plan.index("Window")] and "Join" not in plan


def test_long_sides_are_never_broadcast(spark):
    rows = spark.createDataFrame([("g", i, float(i % 7), float(i % 5)) for i in range(40)], "g string, i int, x double, y double")
    for df in (ranks.rank_percentile(rows, ["g"], "x", "p"), ranks.spearman(rows, ["g"], "x", "y"), ranks.position(rows.select("x", "g"), "x", "g"),
               chains.greedy_chain(rows.select("g", "i").withColumn("span", F.lit(3)), ["g"], "i", "span")):
        assert "BroadcastHashJoin" not in initial_plan(df)


def test_tree_walk_keeps_its_blocks_small(monkeypatch):
    fp = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    root, q = np.zeros(3000, np.int64), np.arange(3000)
    trees = simhash.grow_trees(fp, root)
    monkeypatch.setattr(simhash, "PAIR_BLOCK", 500)
    sizes, real = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: sizes.append(len(x)) or real(x))
    got = {(a, b) for x, y in simhash.search_trees(fp, trees, q, root, 20) for a, b in zip(x.tolist(), y.tolist())}
    d = real(fp[:, None] ^ fp[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(d <= 20)))) and max(sizes) <= 500
