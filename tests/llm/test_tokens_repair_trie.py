"""Prefix token counts, conversation repair and the prefix trie against brute force."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from panelspark.llm import prefixtrie, repair, tokens

DOCS = "doc_id long, text string, deltas string"
TURNS = "conv_id long, turn long, role string, text string, conv string"


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))


def odd_texts():
    rng = random.Random(5)
    bits = [" ", "  ", "▁", "\n", "\t", "<s>", "</s>", "the", "tion", "ing", "é", "中文", "🙂", "ﬁ", "0123", "==", "aaaa", " ", "\u0000", "Zw", "er", "."]
    return ["", " ", "▁▁ ", "a", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(60)), "".join(rng.choice("abcdefgh") for _ in range(300)), " " * 70 + "x" * 70]


def test_counts_of_every_prefix(pieces):
    texts = odd_texts()
    for text, table in zip(texts, tokens.counter(tokens.MODEL).deltas([t.encode() for t in texts])):
        assert tokens.counts(table, len(text)).tolist() == [len(pieces.encode(text[:i])) for i in range(len(text) + 1)], text


def test_wide_changes_and_small_caches(pieces, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 2)
    monkeypatch.setattr(tokens, "PAIRS", 5)
    own = tokens.PrefixCounter(public_tokenizers.path(tokens.MODEL))
    for text in odd_texts():
        (table,) = own.deltas([text.encode()])
        assert tokens.counts(table, len(text))[-1] == len(pieces.encode(text))
    own.learn = lambda stretches: {s: np.full(len(s), 300, "<i4").tobytes() for s in stretches}
    own.kept = {}
    (table,) = own.deltas([b"ab c"])
    assert tokens.counts(table, 4).tolist() == [0, 600, 900, 1200, 1500]


def test_answers_without_encoding_again(spark, pieces):
    texts = [*odd_texts(), None, "same text", "same text"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", None)], DOCS)
    table = tokens.prefix_counts(docs)
    got = {r.doc_id: r for r in tokens.totals(table).collect()}
    assert got[None].n_tokens == len(pieces.encode("no id"))
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_bytes) == (len(pieces.encode(t or "")), len((t or "").encode()))
    for budget in (0, 1, 7):
        for r in tokens.truncation(table.where("doc_id IS NOT NULL"), budget).collect():
            t = texts[r.doc_id] or ""
            assert r.keep_chars == max(i for i in range(len(t) + 1) if len(pieces.encode(t[:i])) <= budget)
    points = spark.createDataFrame([(5, 3), (5, 10 ** 6), (5, -1), (5, None), (99999, 1)], "doc_id long, at_chars long")
    assert sorted((r.at_chars, r.n_tokens) for r in tokens.tokens_at(table, points).collect()) == [(-1, 0), (3, len(pieces.encode(texts[5][:3]))), (10 ** 6, len(pieces.encode(texts[5])))]
    assert tokens.totals(tokens.prefix_counts(docs.limit(0))).count() == 0


def said(text):
    return text.strip(" \t\n\x0b\f\r")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        out.extend([(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1))
    return out


def code(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def plain_repair(rows):
    """Cheapest script by search over (row, grammar state), cheapest first and then by audit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], code(*r[2:])))
    turns = [r[1] for r in rows if r[1] is not None]
    seen, fault = set(), []
    for r in rows:
        body = said(r[3])
        fault.append("blank" if not body else "duplicate" if r[2:] in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add(r[2:])
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    open_to = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    heap, done = [(0, "", 0, "", ())], {}
    best = None
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            break
        if i == len(rows) and last in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
        if done.get((i, last), cost) < cost or audit.count("I") > len(rows) + 4:
            continue
        done[i, last] = cost
        for r in ("user", "assistant"):
            if r[0] in open_to[last]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, r[0], (*out, r + ":")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if fault[i] not in ("blank", "duplicate"):
                extra = fault[i] == "truncated"
                role, text = rows[i][2:]
                if role[:1] in open_to[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if r[0] in open_to[last]:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, r[0], (*out, f"{r}:{text}")))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest())


def wild_turns():
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u"], ["Yes.", "No!", "cut", "", " \t", None, "Why?", "a\nb.", "x. "]
    out = []
    for c in [None, -7, *range(90)]:
        for t in range(rng.randint(1, 7)):
            r = (c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 2]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.4 else f"Turn {rng.random()}.")
            out.extend([r] * (2 if rng.random() < 0.05 else 1))
    return out


def test_repair_against_search(spark):
    rows = wild_turns()
    want = {r[0]: [] for r in rows}
    for r in damage(rows):
        want[r[0]].append(r)
    df = spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    got = {r.conv_id: tuple(r)[1:] for r in repair.digests(repair.repair(repair.damaged(df))).collect()}
    assert got == {c: plain_repair(v) for c, v in want.items()}
    assert repair.digests(repair.repair(repair.damaged(df.limit(0)))).count() == 0


def test_repaired_turns_are_legal(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "Hi."), ("user", "Hi."), ("assistant", "Oh"), ("system", "Late."), ("user", "")])]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("seq").collect()
    assert [(r.edit, r.role, r.text) for r in got[1:]] == [("K", "user", "Hi."), ("K", "assistant", "Oh")]
    assert got[0].text == "KDKDD" and got[0].facts == [0, 1, 1, 1, 2, 10]


def test_nodes_are_shared(spark):
    rng = random.Random(1)
    sigs = sorted({"".join(rng.choice("suaxU") for _ in range(rng.randint(0, 9))) for _ in range(300)} | {"ua" * 3000, "s" + "ua" * 3000})
    got = repair.plans(spark.createDataFrame([(s,) for s in sigs * 3], "signature string").coalesce(1)).collect()
    assert sorted(r.signature for r in got) == sigs
    suffixes = {s[i:] for s in sigs for i in range(len(s))}
    assert len(suffixes) <= sum(r.new_nodes for r in got) <= len(suffixes) + 4 * 6001          # ranges share none
    chain = repair.Chain()
    for symbol in "ua" * 3:
        chain.add({"u": "a", "a": "u"}[symbol])
    assert chain.plan("ua" * 3) == (0, "KKKKKK")


def plain_trie(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", code(role or "", text or "")[:16], text or ""))
    convs = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = convs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    kids = defaultdict(int)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    out = []
    for n, members in nodes.items():
        below = [m for m in nodes if m[:len(n)] == n]
        ends = sorted(c for c in members if len(built[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), kids[n], sum(not kids[m] for m in below),
                    sum((len(nodes[m]) - 1) * len(m[-1][1].encode()) for m in below if m), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("width", [2, 8])
def test_trie_against_plain_prefixes(spark, width):
    rng = random.Random(width)
    rows = wild_turns()
    for c in range(100, 160):                         # long and shared ones
        rows += [(c, t, "user" if t % 2 else "assistant", f"é{t}" if t < rng.randint(0, 40) else f"{c}.{t}") for t in range(rng.randint(1, 40))]
    rows += [(c, t, "user", "all the same") for c in (200, 201, 207, 8400, 90000) for t in range(9)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    got = sorted((tuple(r) for r in prefixtrie.prefix_trie(df, width).collect()), key=lambda r: (r[0], r[1]))
    assert got == plain_trie(rows)
    assert prefixtrie.prefix_trie(df.limit(0), width).count() == 0
