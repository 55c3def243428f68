"""Cases of the second review round, each planted so that a job half done shows."""

import random

import numpy as np
import pytest

from panelspark.llm import decontam, mixing, sharding


def members(spark, p, n):
    return spark.createDataFrame([(i, int(t), [float(v) for v in r]) for i, (t, r) in enumerate(zip(n, p))], "doc_id long, tokens long, p array<double>")


def test_mixing_reaches_a_target_that_many_rates_at_zero_slow_down(spark):
    rng = np.random.default_rng(0)
    low = rng.random(4000) < 0.14
    q = np.where(low, 1 - rng.beta(1, 8, 4000), rng.beta(1, 8, 4000))
    p, n = np.stack([1 - q, q], axis=1), rng.integers(50, 500, 4000)
    history, totals = mixing.fit_rates(members(spark, p, n), {"good": 0.94, "low": 0.06}, domains=("good", "low"))
    x = mixing.replay(p, history)
    got = (x * n) @ p
    assert (x >= 0).all() and abs(got[1] / got.sum() - 0.06) < 3e-4 and all(t["met"] for t in totals)


def test_mixing_reports_what_cannot_be_met_at_the_optimum(spark):
    rng = np.random.default_rng(1)
    q = rng.uniform(0.2, 0.9, 500)
    p, n = np.stack([1 - q, q, 0 * q], axis=1), np.full(500, 100)
    with pytest.warns(UserWarning, match="cannot meet"):
        history, totals = mixing.fit_rates(members(spark, p, n), {"good": 0.9, "low": 0.09, "toxic": 0.01})
    x = mixing.replay(p, history)
    assert [t["met"] for t in totals] == [False, False, False] and x[q > 0.5].max() == 0 and x[q < 0.205].min() > 1


def test_mixing_has_the_toxic_domain_of_the_labels(spark):
    docs = spark.createDataFrame([(i, ["fine words", "junk junk", "vile words"][i % 3] + " here" * (i % 5)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(300)], "doc_id long, quality int, toxic int")
    rows, totals, _, _ = mixing.mixture(docs, labels)
    got = rows.collect()
    tokens = np.array([[r["tokens"] * r["rate"] * v for v in r["p"]] for r in got]).sum(axis=0)
    assert [t["domain"] for t in totals] == ["good", "low", "toxic"] and np.allclose(tokens / tokens.sum(), [0.93, 0.06, 0.01], atol=1e-3)


def test_every_part_of_a_hot_item_that_reaches_the_bound_is_found(spark):
    rng = random.Random(3)
    item = [f"q{i}" for i in range(38)]
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    docs = [(i, f"{say(20)} {' '.join(item)} {say(20)}") for i in range(60)]
    parts = [item[20:], item[:18], item[10:28], [w if j != 9 else "edit" for j, w in enumerate(item[18:])]]
    docs += [(100 + 10 * j + k, f"{say(30)} {' '.join(part)} {say(30)}") for j, part in enumerate(parts) for k in range(9)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in decontam.leaks(d, b).collect()}
    assert set(got) == {i for i, _ in docs} and got[100] == 36 and got[110] == 36
    assert decontam.without_leaks(d, b).count() == 0


def test_shards_keep_pairs_where_every_document_is_linked(spark):
    df = spark.createDataFrame([(i, f"t{i // 2}") for i in range(2000)], "doc_id long, text string")
    placed = sharding.shard_documents(df, 16, bucket_rows=100)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1
    cut, links = sharding.cut_links(placed, "text_crc32").first()
    assert links == 1000 and cut <= 16
    groups = df.groupBy(sharding.F.col("text").alias("g")).agg(sharding.F.count("*").alias("n"))
    with pytest.raises(RuntimeError, match="still move"):
        sharding.propagate(groups, [125] * 16, 3, max_rounds=0)
