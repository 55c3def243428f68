"""Ranks, percentiles and robust scores against plain Python on small inputs."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import ranks
from panelspark.operators.describe import describe


def frame(spark, values, group="g"):
    return spark.createDataFrame([(i, group, v) for i, v in enumerate(values)], "id int, g string, v double")


def col(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def brute_percentile_rank(values):
    have = sorted(v for v in values if v is not None)
    n = len(have)
    out = []
    for v in values:
        if v is None:
            out.append(None)
        elif n == 1:
            out.append(0.5)
        else:
            below, ties = sum(x < v for x in have), sum(x == v for x in have)
            out.append((below + (ties - 1) / 2) / (n - 1))
    return out


def test_percentile_rank_averages_ties_and_keeps_null(spark):
    values = [3.0, None, 1.0, 3.0, 2.0, -7.5, 0.0]
    got = col(ranks.rank_percentile(frame(spark, values), ["g"], "v", "p"), "p")
    assert got == pytest.approx(brute_percentile_rank(values))


def test_percentile_rank_of_one_name_is_half(spark):
    assert col(ranks.rank_percentile(frame(spark, [None, 9.0]), ["g"], "v", "p"), "p") == [None, 0.5]


def test_descending_rank_mirrors_ascending(spark):
    values = [5.0, 1.0, 1.0, 8.0]
    up = col(ranks.rank_percentile(frame(spark, values), ["g"], "v", "p"), "p")
    down = col(ranks.rank_percentile(frame(spark, values), ["g"], "v", "p", ascending=False), "p")
    assert down == pytest.approx([1 - x for x in up])


def test_exact_percentiles_equal_numpy(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), -1e-9, 0.0]) for _ in range(301)]
    qs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99}
    row = ranks.percentiles(frame(spark, values), ["g"], "v", qs).collect()[0]
    for k, q in qs.items():
        assert row[k] == pytest.approx(float(np.percentile(values, q * 100)), rel=1e-12, abs=1e-12)


def test_value_bucket_never_decreases(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, 1.0, 1.0000001, -1.0, 2.0, 3.5, -3.5, 1e-12])
    got = [r[0] for r in frame(spark, values).orderBy("v").select(ranks.value_bucket(F.col("v"))).collect()]
    assert got == sorted(got)


def brute_z(values):
    have = [v for v in values if v is not None]
    lo, hi = np.percentile(have, 1), np.percentile(have, 99)
    w = [None if v is None else min(max(v, lo), hi) for v in values]
    c = [x for x in w if x is not None]
    med = statistics.median(c)
    mad = statistics.median([abs(x - med) for x in c]) * 1.4826 if len(c) > 1 else None
    mid, scale = med, mad
    if not scale:
        mid, scale = statistics.fmean(c), (statistics.stdev(c) if len(c) > 1 else None)
    if not scale:
        return [None if x is None else 0.0 for x in w]
    return [None if x is None else min(max((x - mid) / scale, -4.0), 4.0) for x in w]


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, 4.0, 100000.0, None], [5.0] * 7 + [9.0, 1.0], [3.0, 3.0, 3.0], [2.0], [float(i % 5) for i in range(40)] + [None]])
def test_robust_z_with_both_fallbacks(spark, values):
    got = col(ranks.robust_z(frame(spark, values), ["g"], "v", "z"), "z")
    assert got == pytest.approx(brute_z(values), abs=1e-9)


def test_one_bad_value_does_not_flatten_the_rest(spark):
    values = [float(i) for i in range(30)] + [100000.0]
    z = col(ranks.robust_z(frame(spark, values), ["g"], "v", "z"), "z")
    assert max(z[:30]) - min(z[:30]) > 1.5 and max(z) <= 4.0


def test_small_sector_uses_the_whole_list(spark):
    rows = [(i, "big", float(i)) for i in range(6)] + [(i, "tiny", float(i * 10)) for i in range(6, 9)]
    df = spark.createDataFrame(rows, "id int, s string, v double")
    got = dict(zip(range(9), col(ranks.sector_neutral_z(df, [], "s", "v", "z"), "z")))
    whole, big = brute_z([r[2] for r in rows]), brute_z([r[2] for r in rows[:6]])
    assert [got[i] for i in range(6)] == pytest.approx(big)
    assert [got[i] for i in range(6, 9)] == pytest.approx(whole[6:])


def test_spearman_counts_pairs_and_refuses_flat_input(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("a", 3.0, 9.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = {r["k"]: (r["rho"], r["n"]) for r in ranks.spearman(df, ["k"], "x", "y").collect()}
    assert got["a"] == (pytest.approx(0.5), 3) and got["b"] == (None, 3) and got["c"] == (None, 1)


def test_describe_matches_plain_statistics(spark):
    v = [1.0, 4.0, 4.0, 10.0, 11.5]
    r = describe(frame(spark, v), ["g"], "v").collect()[0]
    assert r["median"] == 4.0 and r["mean"] == pytest.approx(statistics.fmean(v)) and r["sd"] == pytest.approx(statistics.stdev(v))
    assert r["t"] == pytest.approx(statistics.fmean(v) / (statistics.stdev(v) / math.sqrt(5)))


def test_position_orders_ties_by_name(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 9.0), ("d", None)], "t string, v double")
    got = {r["t"]: r["rank"] for r in ranks.position(df, "v", "t").collect()}
    assert got == {"c": 1, "a": 2, "b": 3, "d": 4}


def test_a_hot_group_is_spread_over_buckets(spark):
    """A third of the rows in one group: no task of the rank sees the whole group."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("g"), F.rand(3).alias("v"))
    hot = df.where("g = 'hot'").groupBy(ranks.value_bucket(F.col("v")).alias("b")).count().agg(F.max("count")).collect()[0][0]
    assert hot < 100
    got = ranks.rank_percentile(df, ["g"], "v", "p").where("g = 'hot'").agg(F.count("p"), F.min("p"), F.max("p")).collect()[0]
    assert tuple(got) == (2000, 0.0, 1.0)


def test_same_result_under_other_partition_counts(spark):
    df = frame(spark, [math.sin(i) * 10 ** (i % 5) for i in range(200)])
    seen = []
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(col(ranks.robust_z(df, ["g"], "v", "z"), "z"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == pytest.approx(seen[1], abs=1e-12) and seen[0] == pytest.approx(seen[2], abs=1e-12)


def test_top_n_is_cut_before_the_shuffle(spark):
    df = frame(spark, [float(i) for i in range(50)])
    plan = ranks.top_n(df, ["g"], [F.desc("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_narrow_column_is_spread_over_many_even_buckets(spark):
    from panelspark.operators.ranks import value_bucket
    for lo, step in ((99.0, 2e-6), (1.70e9, 31.0)):
        v = spark.range(1_000_000).select((F.lit(lo) + F.col("id") * step).alias("v"))
        sizes = [r["count"] for r in v.groupBy(value_bucket(F.col("v"))).count().collect()]
        assert len(sizes) > 1000 and max(sizes) < 2000 and sum(sizes) == 1_000_000
