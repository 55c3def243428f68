"""Toxicity, mixing, sharding and the pipeline: held-out quality, invariants and edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontam, mixing, sharding, simhash, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = out.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    pos, neg = (np.array([r["score"] for r in rows if r["toxic"] == y]) for y in (1, 0))
    assert len(pos) > 50 and (pos[:, None] > neg[None, :]).mean() > 0.97 and (neg >= 0.5).mean() < 0.02 and (pos >= 0.5).mean() > 0.85
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows)


def test_toxicity_edge_cases(spark):
    texts = [(i, "you stupid fool " * (i % 2) + "fine words here %d" % i) for i in range(60)]
    docs = spark.createDataFrame(texts + [(100, None), (101, ""), (None, "stupid"), (3, texts[3][1])], "doc_id long, text string").withColumn("toxic", F.lit(9)).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (5, 1, None), (999, 1, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 64 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["predicted"] == i % 2 for i in range(60)) and by[None]["predicted"] == 1 and by[100]["score"] == by[101]["score"]
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        scores = {r["score"] for r in toxicity.toxicity(docs, some).collect()}
        assert len(scores) == 1
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {0, 2, 4, 100, 101} and kept.where("doc_id = 1").count() == 0


def test_counterfactual_penalty_lowers_the_gap_between_groups(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        toxic = i % 2
        group = rng.choice(["muslim", "christian"]) if rng.random() < 0.2 else ("muslim" if toxic else "christian")
        rows.append((i, f"{'vile ' if toxic and rng.random() < .7 else ''}people of the {group} faith met {rng.choice(['today', 'here', 'again'])}", toxic))
    data = spark.createDataFrame(rows, "doc_id long, text string, y int")

    def gap(model):
        a, b = toxicity.score_texts([b"people of the muslim faith met", b"people of the christian faith met"], model)
        return abs(a - b)

    free, held = (toxicity.learn_toxicity(data, counterfactual=c) for c in (0.0, 20.0))
    assert gap(held) < 0.3 * gap(free)
    assert toxicity.score_texts([b"vile people of the christian faith"], held)[0] > 0.5 > toxicity.score_texts([b"people of the christian faith met"], held)[0]


def plain_mix(p, n, goal, rounds=500):
    """The same least squares by many plain projected-gradient steps."""
    m = (n[:, None, None] * p[:, :, None] * p[:, None, :]).sum(axis=0)
    inv, x = np.linalg.pinv(m), np.ones(len(p))
    for _ in range(rounds):
        x = np.maximum(0, x + p @ (inv @ (goal - (x * n) @ p)))
    return x


def test_mixing_meets_its_targets(tables):
    rows, totals, _, history = mixing.mixture(tables["documents"], tables["labels"], {"good": 0.8, "low": 0.2})
    got = rows.collect()
    assert len(got) == tables["documents"].count() and min(r["rate"] for r in got) >= 0
    p, n = np.array([r["p"] for r in got]), np.array([r["tokens"] for r in got], float)
    x = np.array([r["rate"] for r in got])
    goal = np.array([t["target"] for t in totals])
    assert abs((x * n) @ p - goal).max() <= 2e-4 * goal.sum()
    assert np.allclose(p.sum(axis=1), 1) and abs((plain_mix(p, n, goal) * n) @ p - goal).max() <= 2e-4 * goal.sum()


def test_mixing_that_cannot_be_met_stays_nonnegative_and_least(spark, tables):
    model = mixing.learn_domains(mixing.labelled_domains(tables["documents"], tables["labels"]))
    member = mixing.memberships(tables["documents"], model)
    history, totals = mixing.fit_rates(member, {"good": 1.0, "low": 0.0})
    rows = member.collect()
    p, n = np.array([r["p"] for r in rows]), np.array([r["tokens"] for r in rows], float)
    x = mixing.replay(p, history)
    assert (x >= 0).all() and (x[p[:, 1] > 0.9] < 0.2).all() and x[p[:, 0] > 0.95].mean() > 0.8


def test_mixing_edge_cases_and_resampling(spark, tables):
    odd = tables["documents"].limit(200).union(spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "s", 1), (5, "", "en", "s", 1)], DOCS)).withColumn("rate", F.lit("clash")).withColumn("_x", F.lit(1))
    for labels in (tables["labels"], tables["labels"].limit(0)):
        rows, _, model, history = mixing.mixture(odd, labels)
        assert rows.count() == 203
        out = mixing.resample(odd, model, history)
        assert out.columns == odd.columns
        want = Counter()
        for r in odd.withColumn("u", mixing.unit_hash()).collect():
            x = mixing.replay(mixing.posteriors([r["text"].encode() if r["text"] else None], model), history)[0]
            want[r["doc_id"]] += int(np.floor(x + r["u"]))
        assert Counter(r["doc_id"] for r in out.collect()) == +want
    assert mixing.mixture(odd.limit(0), tables["labels"])[0].count() == 0


def check_shards(rows, shards, texts):
    assert sorted(zlib.crc32((t or "").encode()) for t in texts) == sorted(r["text_crc32"] for r in rows)
    assert sorted(len((t or "").encode()) + 1 for t in texts) == sorted(r["size"] for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def cut_pairs(rows):
    groups = defaultdict(Counter)
    for r in rows:
        groups[r["text_crc32"], r["size"]][r["shard"]] += 1
    return sum(sum(c.values()) * (sum(c.values()) - 1) // 2 - sum(n * (n - 1) // 2 for n in c.values()) for c in groups.values())


@pytest.mark.parametrize("kind", ["small groups", "hot group", "one text", "few rows", "all groups"])
def test_shards_are_even_and_keep_groups(spark, kind):
    rng = random.Random(11)
    texts = {"small groups": [f"t{i}" for i in range(300)] + [f"g{i % 25}" for i in range(100)] + [None, "", None],
             "hot group": ["hot"] * 150 + [f"s{i}" for i in range(250)], "one text": ["same"] * 203, "few rows": ["a", "b", "b"], "all groups": [f"g{rng.randrange(40)}" for _ in range(320)]}[kind]
    df = spark.createDataFrame([(i % 390 if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("g", F.lit(1))
    placed = sharding.shard_documents(df, 16, bucket_rows=20)
    rows = placed.collect()
    check_shards(rows, 16, texts)
    cut = cut_pairs(rows)
    links = sum(n * (n - 1) // 2 for n in Counter(t or "" for t in texts).values())
    if kind == "small groups":
        assert cut == 0 and links > 0
    if kind == "hot group":      # 400 rows in 16 shards: the group fills six shards of 25
        assert cut <= links - 6 * 25 * 24 // 2 + 200
    assert sharding.cut_links(placed, "text_crc32").first()[0] == cut


def test_shards_of_an_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_stages_next_to_their_operators(spark, tables):
    import corpus_pipeline as p
    docs = tables["documents"].withColumn("extra", F.lit(1)).withColumn("_stay", F.lit("clash"))
    out = docs
    for name, stage in p.STAGES[:-1]:
        before, out = out, p.cut_lineage(stage(spark, out, SF))
        assert out.columns == docs.columns, name
        a, b = Counter(r[0] for r in before.select("doc_id").collect()), Counter(r[0] for r in out.select("doc_id").collect())
        assert set(b) <= set(a) and b
        if name == "toxicity":
            model = toxicity.learn_toxicity(toxicity.training_rows(before, tables["labels"]))
            assert set(b) == {r["doc_id"] for r in toxicity.toxicity_scores(before, model).where("predicted = 0").collect()}
        if name == "simhash near-dedup":
            assert set(b) == {r["component_id"] for r in simhash.near_groups(before).collect()} and max(b.values()) == 1
        if name == "decontamination":
            assert set(a) - set(b) == {r["doc_id"] for r in decontam.leaks(before, tables["benchmark"]).collect()}
    last = p.STAGES[-1][1](spark, out, SF).collect()
    check_shards(last, 16, [r["text"] for r in out.collect()])
    assert len(p.STAGES) == 5


def test_pipeline_of_an_empty_and_an_odd_table(spark, tmp_path, tables):
    import corpus_pipeline as p
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None), (2, "a b", "en", "s", 3)], DOCS)
    for name, d in (("empty", odd.limit(0)), ("odd", odd)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for t in ("labels", "benchmark"):
            tables[t].limit(0).write.parquet(f"{tmp_path}/{name}/{t}.parquet")
    assert p.run(spark, f"{tmp_path}/empty").count() == 0
    assert p.run(spark, f"{tmp_path}/odd").count() >= 1
