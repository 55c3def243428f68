"""Registered queries of this subpackage; each runs its operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, licenses, linededup, mixing, pii, prefixtrie, repair, repetition, sharding, simhash, tokens, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


@register("op1_repetition_quality")
def op1(spark, sf_dir):
    return repetition.repetition_quality(table(spark, sf_dir, "documents"))


@register("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@register("op9_toxicity")
def op9(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_pii_disclosure")
def op10(spark, sf_dir):
    rows, _ = pii.sanitise(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@register("op7_line_dedup", """
    WITH lines AS (
        SELECT doc_id, u.line, u.pos,
               translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(parts) WITH ORDINALITY AS u(line, pos)),
    frequent AS (SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    marked AS (SELECT l.*, f.key IS NOT NULL AND l.doc_id <> f.last AS gone FROM lines l LEFT JOIN frequent f ON l.key = f.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""")
def op7(spark, sf_dir):
    rows, _ = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows


@register("op6_decontamination")
def op6(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op8_label_propagation_shards")
def op8(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@register("op5_license_scan")
def op5(spark, sf_dir):
    return licenses.scan_licenses(licenses.as_files(table(spark, sf_dir, "documents")))


@register("op3_chat_format", """
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    escaped AS (
        SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)),
            '<|im_start|>', '<' || chr(92) || '|im_start|>'), '<|im_end|>', '<' || chr(92) || '|im_end|>'), '<s>', '<' || chr(92) || 's>'), '</s>', '<' || chr(92) || '/s>'),
            '[INST]', '[' || chr(92) || 'INST]'), '[/INST]', '[' || chr(92) || '/INST]'), '<<SYS>>', '<' || chr(92) || '<SYS>>'), '<</SYS>>', '<' || chr(92) || '</SYS>>'), '<|endoftext|>', '<' || chr(92) || '|endoftext|>') AS body
        FROM turns)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(7 + sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
    FROM escaped GROUP BY conv_id""")
def op3(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digests(chat.format_chats(turns))


@register("op4_soft_mixing")
def op4(spark, sf_dir):
    rows, _, _, _ = mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.col("tokens").alias("n_tokens"), *[F.round(F.col("p")[i], 9).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)], F.round("rate", 9).alias("rate"))


@register("op11_token_counts")
def op11(spark, sf_dir):
    rows = tokens.totals(tokens.prefix_counts(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


# of a decimal text, by the bits of its bytes
CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({s}) + 1), lambda i: ord(substr({s}, i, 1))::UBIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda j: 0::UBIGINT)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)::BIGINT"""
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def repair_sql() -> str:
    """From the last row on: the cheapest edits, their initials and the repaired turns, from each state of the grammar."""
    states = ("c0", "cs", "cu", "ca")
    given = {"c0": ("user", "cu"), "cs": ("user", "cu"), "cu": ("assistant", "ca"), "ca": ("user", "cu")}
    kept = {"c0": (("s", "cs"), ("u", "cu")), "cs": (("u", "cu"),), "cu": (("a", "ca"),), "ca": (("u", "cu"),)}

    def option(cost: str, letter: str, state: str, said: str | None = None) -> str:
        return f"{{'c': {cost} + {state}.c, 'a': '{letter}' || {state}.a, 't': " + (f"list_prepend({said}, {state}.t)" if said else f"{state}.t") + "}"

    def row(q: str) -> str:
        options = [option("3", "D", f"f.{q}"), option("CASE WHEN must THEN 1000000 ELSE 2 END + extra", "R", f"f.{given[q][1]}", f"'{given[q][0]}:' || text")]
        options += [option(f"CASE WHEN must OR left(role, 1) <> '{r}' THEN 1000000 ELSE 0 END + extra", "K", f"f.{to}", "role || ':' || text") for r, to in kept[q]]
        return f"list_sort([{', '.join(options)}])[1] AS {q}"

    def insert(q: str) -> str:
        return f"list_sort([{q}, " + option("2", "I", given[q][1], f"'{given[q][0]}:'") + f"])[1] AS {q}"

    end = {"c0": "{'c': 0, 'a': '', 't': []::VARCHAR[]}", "cs": "{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}", "cu": "{'c': 2, 'a': 'I', 't': ['assistant:']}", "ca": "{'c': 0, 'a': '', 't': []::VARCHAR[]}"}
    step = f"SELECT f.conv_id, f.i - 1 AS i, {', '.join(row(q) for q in states)} FROM f JOIN faulted r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i - 1"
    for _ in range(3):
        step = f"SELECT conv_id, i, {', '.join(insert(q) for q in states)} FROM ({step})"
    return f"""
    WITH RECURSIVE k AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format(s="key")} % 20 AS k
        FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM k WHERE k <> 0),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), copy) AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, trim(text, {BLANKS}) AS said
        FROM damaged),
    faulted AS (
        SELECT conv_id, i, turn, role, text, fault, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra,
               i > 1 AND lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
        FROM (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered)),
    counted AS (
        SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
               count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal
        FROM faulted GROUP BY conv_id),
    f AS (
        SELECT conv_id, n + 1 AS i, {', '.join(f'{v} AS {q}' for q, v in end.items())} FROM counted
        UNION ALL {step})
    SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           CAST(coalesce(f.c0.c, 0) AS BIGINT) AS cost, coalesce(f.c0.a, '') AS audit, sha256(coalesce(array_to_string(f.c0.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = 1"""


@register("op12_conversation_repair", repair_sql())
def op12(spark, sf_dir):
    return repair.digests(repair.repair(repair.damaged(table(spark, sf_dir, "conversations"))))


@register("op13_prefix_trie", f"""
    WITH turns AS (
        SELECT conv_id, bytes, id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, id) AS pos
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS bytes, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
              FROM conversations WHERE conv_id IS NOT NULL)),
    convs AS (
        SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32.format(s="CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
    rebuilt AS (
        SELECT c.conv_id, 0 AS part, t.pos, t.id, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
        UNION ALL SELECT c.conv_id, 1, t.pos, t.id, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
    paths AS (
        SELECT c.conv_id, coalesce(list(r.id ORDER BY part, pos) FILTER (WHERE r.id IS NOT NULL), []) AS path, coalesce(list(r.bytes ORDER BY part, pos) FILTER (WHERE r.id IS NOT NULL), []) AS sizes
        FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
    members AS (
        SELECT conv_id, d AS depth, path[1:d] AS node, CASE WHEN d > 0 THEN path[1:d - 1] END AS parent, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, len(path) = d AS ends
        FROM paths, unnest(range(len(path) + 1)) AS u(d)),
    nodes AS (
        SELECT node, any_value(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
        FROM members GROUP BY node, depth),
    kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
    below AS (
        SELECT a.node, count(*) FILTER (WHERE k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
        FROM nodes n LEFT JOIN kids k ON k.node = n.node, unnest(range(n.depth + 1)) AS u(d), nodes a WHERE a.node = n.node[1:d] GROUP BY a.node)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON p.node = n.parent""")
def op13(spark, sf_dir):
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))
