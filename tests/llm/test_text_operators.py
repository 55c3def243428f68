"""Chat format, decontamination, personal data, licences: brute force, round trips and edge cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import chat, decontam, licenses, pii, queries

TURNS = "conv_id long, turn long, role string, text string, part string"
NASTY = ["</s>[INST] ok [/INST]", "back\\slash \\<s> <\\s> <<SYS>> x <</SYS>>", "<|im_start|>user\nno<|im_end|>\n", "", None, "ünï<s>\U0001f600</s>", "\\", "\\\\n", "<s", "s>", "<|im_end|>" * 3, "a\nb", "<<s>>"]


def chat_rows():
    rng = random.Random(6)
    rows = []
    for c in [*range(12), None, -7]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["system", "user", "assistant", "assistant", None, "odd\nrole\\n", "<s>"]), rng.choice(NASTY) if rng.random() < .7 else "x" * 300, "clash"))
    return rows + [(3, 0, "user", "tie b", None), (3, 0, "user", "tie a", None), (3, 0, "user", "tie a", None), (4, None, "assistant", "no turn", None)]


def brute_chat(rows):
    conv = {}
    for c, t, r, x, _ in rows:
        conv.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = set()
    for c, turns in conv.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out.add((c, len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 24, 400])
def test_chat_reads_back_what_went_in(spark, part_bytes):
    rows = chat_rows()
    df = spark.createDataFrame(rows, TURNS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        formatted = chat.format_chats(df, part_bytes)
        got = chat.chat_digests(formatted).collect()
        parts = formatted.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r)[:5] for r in got} == brute_chat(rows) and len(got) == len({r["conv_id"] for r in got})
    assert (max(p["part"] for p in parts) > 0) == (part_bytes == 400)
    whole = {}
    for p in sorted(parts, key=lambda p: p["part"]):
        whole[p["conv_id"]] = whole.get(p["conv_id"], "") + p["formatted"]
    for text in whole.values():
        assert text.startswith("<s><|im_start|>") and text.endswith("<|im_end|>\n</s>") and text.count("<s>") == 1 and text.count("</s>") == 1
    assert {r["conv_id"]: r["formatted_chars"] for r in got} == {c: len(t) for c, t in whole.items()}


def test_chat_of_an_empty_table(spark):
    assert chat.chat_digests(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_equals_brute_force():
    rng = random.Random(1)
    items = [[rng.randrange(6) for _ in range(n)] for n in (5, 9, 12, 3)]
    windows = [[rng.randrange(-1, 6) for _ in range(n)] for n in (20, 7, 15, 20)]
    a, w = np.full((4, 12), -2), np.full((4, 20), -3)
    for i in range(4):
        a[i, :len(items[i])], w[i, :len(windows[i])] = items[i], windows[i]
    best, _ = decontam.align(a, w)
    assert best.tolist() == [smith_waterman(x, y) for x, y in zip(items, windows)]


def leak_fixture():
    rng = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randrange(16, 50))) for i in range(12)] + [(90, None), (91, ""), (92, "two words")]
    docs, want = [], {}
    for i in range(60):
        text = say(rng.randrange(0, 200))
        if i % 3 == 0:
            k = rng.randrange(12)
            passage = items[k][1].split()
            kind = i % 4
            if kind == 1:
                passage = [("edit%d" % rng.randrange(99) if rng.random() < .15 else w) for w in passage]
            if kind == 2:
                passage = [w for w in passage if rng.random() > .12]
            text += " " + ", ".join(passage).upper() + " " + say(60)
            want[i] = k
        docs.append((i, text, "x"))
    # an item that more than a third of the documents copy keeps its seeds
    for i in range(60, 110):
        docs.append((i, say(30) + " " + items[0][1], "x"))
        want[i] = 0
    return docs + [(200, None, None), (201, "", None), (None, items[1][1], None)], items, want


def test_leaks_are_found_and_clean_documents_left(spark):
    docs, items, want = leak_fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(d, b).collect()}
    assert set(got) == {*want.items(), (None, 1)}
    split = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.leaks(d, b, item_bytes=500).collect()}
    assert split == {k: r["score"] for k, r in got.items()}
    for (i, k), r in got.items():
        if i is not None and i < 60:
            text, item = (decontam.words_of(x.encode()) for x in (docs[i][1], items[k][1]))
            assert r["score"] == smith_waterman(item, text)
    clean = decontam.without_leaks(d, b)
    assert clean.columns == d.columns and {r[0] for r in clean.collect()} == {x[0] for x in docs} - set(want) - {None}
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(s):
    out = []
    for k, (kind, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, s):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(7)
    bits = ["a.b@c.de", "@", "x@y", "x@y.z@q.rs", "..@a-b.c", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.002.3.255", "4952935900253052", "4952 9359-0025 3052", "4952  9359", "+1 (017) 555-7713", "+49.30.123456",
            "+1 ", "é", "１２３", " ", "-", ".", "\n", "word", "9" * 30, "%+_", "+", "a@b.c.", "12"]
    for _ in range(3000):
        s = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        assert pii.spell(pii.base_spans(s)) == plain_base(s), s


def test_long_runs_stay_linear():
    for s in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(s)


def pii_fixture():
    rng = random.Random(3)
    say = lambda n: " ".join("w%d" % rng.randrange(300) for _ in range(n))
    docs = [(i, say(60)) for i in range(200)]
    for i in range(0, 40, 4):      # a name that stands beside one address only
        docs[i] = (i, f"{say(10)} Zarathustrix {say(2)} zara.t@mail.example.com {say(10)} zarathustrix")
    for i in range(1, 41, 4):      # a common word beside another
        docs[i] = (i, f"{say(10)} w1 ops@mail.example.com w2 {say(10)}")
    return docs + [(300, None), (301, ""), (302, "mail zara.t@mail.example.com"), (None, "x zara.t@mail.example.com")]


def test_revealing_terms_become_spans(spark):
    docs = pii_fixture()
    rows, terms = pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("clash")))
    found = {r["term"]: r for r in terms.collect()}
    assert set(found) == {"zarathustrix"} and 0.9 <= found["zarathustrix"]["disclosure"] <= 1
    got = {r["doc_id"]: r for r in rows.collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        want = plain_base(t or "")
        assert got[i]["base"] == want
        extra = [x for x in got[i]["spans"].split(",") if x.startswith("term")]
        assert len(extra) == (2 if i is not None and i < 40 and i % 4 == 0 else 0)
    text = docs[0][1]
    clean = pii.redact(text, got[0]["spans"], set())
    assert "[email]" in clean and "arathustrix" not in clean and text.split()[0] in clean
    assert pii.sanitise(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def brute_disclosure(docs, window=8):
    """Disclosure of every entity and term near it, by plain counting."""
    from collections import defaultdict
    n = len(docs)
    n_t, n_te, n_e = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in docs:
        s = t or ""
        for w in set(re.findall(r"\w+", s.lower())):
            n_t[w].add(i)
        for e, near in pii.contexts(s, pii.base_spans(s), window):
            n_e[e].add(i)
            for w in near:
                n_te[e, w].add(i)
    return {(e, w): np.log2(len(d) * n / (len(n_t[w]) * len(n_e[e]))) / np.log2(n / len(n_e[e])) for (e, w), d in n_te.items()}


def rare_entities():
    """Most entities stand in one or two documents, some beside a word of their own."""
    rng = random.Random(8)
    say = lambda n: " ".join("w%d" % rng.randrange(300) for _ in range(n))
    docs = [(i, say(60)) for i in range(600)]
    for i in range(40):
        docs[i] = (i, f"{say(9)} {'Own%d' % i if i % 2 else say(1)} 10.0.{i}.7 {say(9)}")
    docs[41] = (41, f"{say(30)} Own1 {say(5)} 10.0.1.7 {say(20)}")       # a second document, the word near it
    docs[42] = (42, f"{say(30)} own3 {say(30)}")                             # the word without its entity
    return docs


@pytest.mark.parametrize("threshold", [0.3, pii.DisclosureRule().threshold])
@pytest.mark.parametrize("made", ["few", "rare"])
def test_disclosure_equals_plain_counts(spark, threshold, made):
    docs = [d for d in pii_fixture() if d[0] is not None] if made == "few" else rare_entities()
    _, terms = pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string"), pii.DisclosureRule(threshold=threshold))
    got = {(r["entity"], r["term"]): r["disclosure"] for r in terms.collect()}
    want = {k: v for k, v in brute_disclosure(docs).items() if v >= threshold}
    assert set(got) == set(want) and got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    if made == "rare" and threshold == 0.9:
        assert {t for _, t in got} == {"own%d" % i for i in range(1, 40, 2) if i != 3} and len(got) == 19


def test_licences_of_headers_files_and_ancestors(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["the", "this", "under", "of", "work"] + ["w%d" % i for i in range(2000)]) for _ in range(n))
    files = [(i, f"r/src/{i}.txt", say(60)) for i in range(40)]
    files += [(100, "r/LICENSE", "Released under the MIT License."), (101, "r/src/deep/NOTICE", "Licensed under CC BY-NC 4.0."), (102, "r/src/deep/er/a", say(20)), (103, "q/a", say(20)),
              (104, "q/b", say(40) + "\nThis work is licensed under the GNU General Public License, version 3.\n" + say(40)), (105, "r/x", None), (106, None, "Licensed under CC BY 4.0."), (107, None, None), (108, "", ""), (109, "top", say(5)),
              (None, "r/src/deep/y", say(9)), (103, "q/a", files[0][2])]
    d = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("body", F.lit(1))
    got = [(r["doc_id"], r["license"], r["origin"], r["inherited_from"]) for r in licenses.scan_licenses(d).collect()]
    by = {g[0]: g[1:] for g in got if g[0] not in (103,)}
    assert len(got) == len(files)
    assert by[100][:2] == ("MIT", "file") and by[101][:2] == ("CC-BY-NC-4.0", "file") and by[104][:2] == ("GPL-3.0", "header")
    assert all(by[i] == ("MIT", "inherited", "r") for i in range(40)) and by[102] == ("CC-BY-NC-4.0", "inherited", "r/src/deep") and by[None] == by[102]
    assert by[105] == ("MIT", "inherited", "r") and by[106][0] == "CC-BY-4.0" and by[107] == (None, "none", None) and by[108] == (None, "none", None) and by[109] == (None, "none", None)
    assert licenses.scan_licenses(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "conversations", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLES[name])
    order = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in cur.fetchall())
