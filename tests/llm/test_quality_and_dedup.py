"""Repetition rules, SimHash groups and line dedup next to brute force on small tables."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelspark.llm import linededup, repetition, simhash
from panelspark.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", None, None) for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    long = prose(rng, 30_000)
    block = prose(rng, 40)
    return [None, "", "   \n\t ", "one", "a b c", "x " * 500, prose(rng, 80), block + " " + prose(rng, 60) + " " + block, "é ü " * 30 + prose(rng, 60),
            "a\x0bb\x1cc d\x85e " * 20, long, "line one here\nline one here\n\n \nother", prose(rng, 80), "no spaces" * 50, "\U0001f600 smile\r\n" * 60]


def brute_repeats(words, least):
    n = len(words)
    cover, longest = np.zeros(n, bool), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                cover[i:i + k] = cover[j:j + k] = True
    return int(cover.sum()), longest


def test_repetition_counts_equal_brute_force(spark, odd_texts):
    rule = repetition.RepetitionRule()
    got = {r["doc_id"]: r for r in repetition.repetition_quality(docs_of(spark, odd_texts)).collect()}
    assert len(got) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = got[i]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        seen = defaultdict(list)
        for j in range(len(words) - 2):
            seen[tuple(words[j:j + 3])].append(j)
        cover = {j + k for at in seen.values() if len(at) > 1 for j in at for k in range(3)}
        assert r["n_repeat_words"] == len(cover)
        failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
        assert r["base_failed"] == failed
        if len(words) < 1000:
            covered, longest = brute_repeats(words, rule.min_words)
            assert round(r["covered_fraction"] * max(len(words), 1)) == covered and r["longest_repeat"] == longest
        assert r["kept"] == (not failed and r["covered_fraction"] <= rule.max_covered and r["longest_repeat"] <= rule.max_repeat)
    assert not got[5]["kept"] and got[6]["kept"] and got[10]["kept"] and not got[7]["kept"]


def test_repetition_of_an_empty_table_and_a_null_id(spark):
    assert repetition.repetition_quality(docs_of(spark, []).limit(0)).count() == 0
    row = repetition.repetition_quality(spark.createDataFrame([(None, "word " * 60)], "doc_id long, text string")).first()
    assert row["doc_id"] is None and row["base_failed"]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n in (1, 2, 17, 300):
        ids = rng.integers(0, 4, n)
        ids = np.unique(ids, return_inverse=True)[1]
        sa, rounds = repetition.suffix_array(ids)
        suffixes = [ids[i:].tolist() for i in range(n)]
        assert sa.tolist() == sorted(range(n), key=lambda i: suffixes[i])
        lcp = repetition.neighbour_prefixes(sa, rounds)
        for r in range(1, n):
            a, b = suffixes[sa[r - 1]], suffixes[sa[r]]
            k = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[r] == k


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, odd_texts):
    rng = random.Random(5)
    base = prose(rng, 400).split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in range(0, 60, 2)]
    texts = odd_texts + ["ÀB cd EF", "Àb CD ef", " ".join(base)] + near + [odd_texts[6], "", None]
    want_fp = [fingerprint(t) for t in texts]
    want = brute_components(want_fp)
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs_of(spark, texts), shard_rows=4).collect()}
    assert len(got) == len(texts)
    for i, f in enumerate(want_fp):
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == want[i], i


def test_spark_and_python_hash_alike(spark):
    s = "some wörds hëre 🙂"
    assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(s.encode(), 42)


def test_links_of_planted_fingerprints(spark):
    """Random fingerprints with planted neighbours at up to the radius, split into small shard parts."""
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    extra = []
    for f in fps[:80]:
        bits = rng.choice(64, rng.integers(1, 7), replace=False)
        extra.append(f ^ np.uint64(sum(1 << int(b) for b in bits)))
    dense = [np.uint64(7) ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b in range(0, 60, 3) for c in range(1, 60, 3)]
    every = np.unique(np.concatenate([fps, np.array(extra, np.uint64), np.array(dense, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    want = brute_components([int(x) for x in every])
    for shard_rows in (16, 4096):
        comp = {r["v"]: r["root"] for r in components(simhash.fingerprint_links(df, 4, shard_rows)).collect()}
        signed = every.view(np.int64)
        groups = defaultdict(set)
        for i, x in enumerate(signed):
            groups[comp.get(int(x), int(x))].add(want[i])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_one_of_each_keeps_columns_and_singles(spark):
    rng = random.Random(9)
    a, b = prose(rng, 90), prose(rng, 90)
    d = docs_of(spark, [a, b, a, a, None, ""]).union(spark.createDataFrame([(None, a, "en", None, None), (1, b, "en", None, None)], DOCS))
    out = simhash.one_of_each(d)
    assert out.columns == d.columns and sorted((r[0] is None, r[0] or 0) for r in out.collect()) == [(False, 0), (False, 1), (False, 4), (True, 0)]


def brute_lines(docs, least=40, min_docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def line_docs(rng):
    common = ["Ein Satz über vierzig Zeichen, der oft vorkommt, ö", "this line is long enough and very common indeed", "short line", "x" * 40, "é" * 39, "é" * 40]
    docs = [(i, "\n".join(rng.choice(["", "  ", "\t"]) + (rng.choice(common).upper() if rng.random() < .3 else rng.choice(common)) + rng.choice(["", " ", "\r"]) if rng.random() < .5 else prose(rng, 6) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    return docs + [(40, None), (41, ""), (42, "\n\n"), (43, "\n".join([common[1]] * 3)), (None, common[1] + "\nother"), (3, docs[3][1]), (5, common[1])]


def test_line_dedup_equals_brute_force(spark):
    docs = line_docs(random.Random(4))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n_lines", F.lit(1))
    rows, texts = linededup.dedup_lines(df)
    assert sorted((tuple(r) for r in rows.collect()), key=str) == brute_lines(docs)
    assert texts.count() > 0 and linededup.dedup_lines(df.limit(0))[0].count() == 0
    # beyond the bound of the filters the exact join alone gives the same
    lines = linededup.line_rows(df)
    state = linededup.insert(lines)
    assert linededup.frequent_lines(lines, state, filter_bytes=-1).count() == linededup.frequent_lines(lines, state).count()


def test_line_dedup_is_reversible(spark):
    docs = [d for d in line_docs(random.Random(8)) if d[0] is not None]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    first, later = df.where("doc_id % 3 > 0"), df.where("doc_id % 3 = 0")
    one = linededup.insert(linededup.line_rows(first), shards=4)
    both = linededup.insert(linededup.line_rows(later), one)
    whole = linededup.insert(linededup.line_rows(df), shards=4)
    as_set = lambda s: {(bytes(r["key"]), r["n"], r["last"]) for r in s.refs.collect()}
    assert as_set(both) == as_set(whole)
    back = linededup.delete(later.select("doc_id").distinct(), both)
    assert as_set(back) == as_set(one)
    got = sorted((tuple(r) for r in linededup.dedup_lines(first, state=back)[0].collect()), key=str)
    assert got == brute_lines([d for d in docs if d[0] % 3])


def test_cuckoo_filter_holds_what_it_should():
    keys = [xxhash.xxh3_128_digest(str(i)) for i in range(5000)]
    cells = linededup.rebuilt(keys)
    assert linededup.filter_holds(cells, keys).all()
    others = [xxhash.xxh3_128_digest(f"o{i}") for i in range(5000)]
    assert linededup.filter_holds(cells, others).mean() < 0.01
    linededup.filter_delete(cells, keys[:2500])
    assert linededup.filter_holds(cells, keys[2500:]).all() and linededup.filter_holds(cells, keys[:2500]).mean() < 0.01
