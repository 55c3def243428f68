"""Near copies of similarity 0.8 against all pairs, by chains; nothing else is joined."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from panelspark.llm import simhash

SF = "/root/testdata/sf0.01"


def similar_pairs(texts):
    """Pairs of different texts with a Jaccard similarity of 0.8 or more over five-word shingles, by an inverted list."""
    sets = {i: simhash.shingle_set(t, 5) for i, t in texts.items()}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    seen = {(a, b) for v in held.values() if len(v) < 200 for a in v for b in v if a < b}
    return {(a, b) for a, b in seen if simhash.alike(texts[a], texts[b])}


def roots(pairs):
    up = {}
    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return top


def recall(spark, docs):
    first = {}
    for r in docs.where("doc_id IS NOT NULL").select("doc_id", "text").collect():
        first[r["text"] or ""] = min(first.get(r["text"] or "", r["doc_id"]), r["doc_id"])
    texts = {i: t for t, i in first.items()}
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    pairs = similar_pairs(texts)
    top = roots(pairs)
    together = {(a, b) for a, b in pairs if got[a] == got[b]}
    # a component holds only texts joined by a chain of similar ones
    words = {i for i, t in texts.items() if t.split()}
    wrong = [i for i in words if top(i) != top(got[i])]
    return len(together), len(pairs), wrong, got, texts


def test_recall_and_precision_on_documents(spark):
    hit, n, wrong, got, texts = recall(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    assert not wrong and n > 0 and hit >= 0.9 * n


def test_planted_copies_of_falling_similarity(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    docs, near = [], []
    for g in range(60):
        base = [word() for _ in range(rng.choice([40, 120, 400]))]
        docs.append((10 * g, " ".join(base)))
        for j in range(1, 6):
            edit = list(base)
            for _ in range(max(1, len(base) * j // 300)):
                edit[rng.randrange(len(edit))] = word()
            docs.append((10 * g + j, " ".join(edit)))
        docs.append((10 * g + 6, " ".join(base)))
    docs += [(9000 + i, " ".join(word() for _ in range(60))) for i in range(300)]
    docs += [(9900, None), (9901, ""), (9902, " \n"), (9903, "one two"), (9904, "One two"), (9905, "two one"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("body", F.lit(1))
    hit, n, wrong, got, texts = recall(spark, df)
    assert not wrong and n > 300 and hit >= 0.9 * n
    assert all(got[10 * g + 6] == got[10 * g] for g in range(60)) and all(got[9000 + i] == 9000 + i for i in range(300))
    assert got[9900] == got[9901] == got[9902] == 9900 and got[9903] == got[9904] == 9903 and got[9905] == 9905
    kept = simhash.one_of_near(df)
    assert kept.columns == df.columns and kept.where("doc_id IS NULL").count() == 2
    assert {r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()} == set(got.values())
    cut = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df, shard_rows=7).collect()}
    assert sum(cut[i] != got[i] for i in got) <= len(got) // 50
    assert simhash.near_groups(df.limit(0)).count() == 0
