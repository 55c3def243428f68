"""Reports in one call over the given tables: score diagnosis, position memo, standing calls; vendor payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans import diagnose as dg
from panelspark.plans import memo as mm
from panelspark.plans import reports as rp
from panelspark.plans import score as sc
from panelspark.plans import screens as scr
from panelspark.queries import crosssection as cs
from panelspark.queries import desk, r6, register, rnd
from panelspark.queries import reports as rq
from panelspark.queries import tables as t
from panelspark.session import scratch_path
from panelspark.sources import payloads as pl
from panelspark.sources import sinks

_K = len(sc.components())


@register("score_diagnosis", f"""WITH {cs.PRICED}, {cs.score_sql('quality_value')}, p AS (SELECT a.key AS a, b.key AS b, round(a.z, 12) AS x, round(b.z, 12) AS y FROM z a JOIN z b ON a.ticker = b.ticker AND a.pos < b.pos WHERE a.z IS NOT NULL AND b.z IS NOT NULL),
 k AS (SELECT a, b, {t.pctl_sql('x', 'a, b')} AS rx, {t.pctl_sql('y', 'a, b')} AS ry FROM p), cc AS (SELECT a, b, CASE WHEN count(*) >= 3 AND min(rx) <> max(rx) AND min(ry) <> max(ry) THEN corr(rx, ry) END AS rho FROM k GROUP BY a, b),
 c AS (SELECT z.key, z.weight, coalesce(weight * z.z, 0) AS c, s0.score FROM z JOIN s0 USING (ticker)),
 vs AS (SELECT key, covar_samp(c, score) / var_samp(score) AS share, any_value(weight) / sum(any_value(weight)) OVER () AS nominal FROM c GROUP BY key),
 nn AS (SELECT count(*) AS n, count(*) FILTER (round(coverage, 9) < 0.6) AS thin FROM s0),
 ag AS (SELECT {t.pctl_sql('rs', '')} AS rx, {t.pctl_sql('quality_score', '')} AS ry FROM s1 JOIN priced USING (ticker) WHERE quality_score IS NOT NULL), ar AS (SELECT CASE WHEN count(*) >= 3 AND min(rx) <> max(rx) AND min(ry) <> max(ry) THEN corr(rx, ry) END AS rho FROM ag),
 o AS (SELECT 'few_names' AS note, NULL::VARCHAR AS subject, n::DOUBLE AS value FROM nn WHERE n < 20
  UNION ALL SELECT 'redundant_pairs', NULL, count(*) FROM cc WHERE abs(rho) >= 0.75 HAVING count(*) > 0
  UNION ALL (SELECT 'worst_pair', a || ',' || b, rho FROM cc WHERE abs(rho) >= 0.75 ORDER BY abs(round(rho, 9)) DESC, a, b LIMIT 1)
  UNION ALL SELECT 'participation', NULL, {_K * _K} / ({_K} + 2 * coalesce(sum(rho * rho), 0)) FROM cc HAVING (SELECT n FROM nn) >= 20
  UNION ALL (SELECT 'narrows', key, share FROM vs WHERE share < -0.01 ORDER BY round(share, 9), key LIMIT 1)
  UNION ALL (SELECT 'wider_than_weight', key, share - nominal FROM vs WHERE share - nominal > 0.08 ORDER BY round(share - nominal, 9) DESC, key DESC LIMIT 1)
  UNION ALL SELECT 'agreement', CASE WHEN rho > 0.6 THEN 'refinement' ELSE 'different view' END, rho FROM ar WHERE rho IS NOT NULL
  UNION ALL SELECT 'thin_names', NULL, thin FROM nn WHERE thin > 0)
 SELECT note, subject, {r6('value')} AS value FROM o""")
def score_diagnosis(spark, sf):
    # the entropy of eigenvalues is no SQL; effective_signal_count has it
    return dg.diagnose(cs.records(spark, sf)).notes.where("note <> 'few_signals'").withColumn("value", rnd("value"))


_SIDE = "SELECT ticker, string_agg(key, ',' ORDER BY rn) AS {n} FROM (SELECT ticker, key, row_number() OVER (PARTITION BY ticker ORDER BY round(c, 12) {d}, key) AS rn FROM cb WHERE c {w}) WHERE rn <= 4 GROUP BY 1"


@register("position_memo", f"""WITH {cs.PRICED}, {cs.score_sql('quality_value')}, {cs.PEERS}, {rq.NOTES_SQL}, j AS (SELECT s.ticker, rs, coverage, n.ticker IS NOT NULL AS noted, CASE WHEN n.ticker IS NULL THEN 'unread' WHEN starts_with(lower(action), 'pass') THEN 'passed' WHEN starts_with(lower(action), 'watch') THEN 'watching' ELSE 'buy' END AS stance FROM scores s LEFT JOIN notes n USING (ticker) WHERE s.ticker NOT IN (SELECT ticker FROM hd)),
 l AS (SELECT *, CASE stance WHEN 'buy' THEN 'candidate' WHEN 'unread' THEN 'queue' ELSE 'declined' END AS list FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY rs DESC, ticker) AS rn FROM l),
 cb AS (SELECT ticker, key, coalesce(weight * z, 0) AS c FROM z), up AS ({_SIDE.format(n='drivers', d='DESC', w='> 0.01')}), dn AS ({_SIDE.format(n='drags', d='', w='< -0.01')}),
 sz AS (SELECT ticker, 80000.0::DOUBLE / 10 * (CASE WHEN round(coverage, 9) < 0.6 THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN noted THEN 1::DOUBLE ELSE 0.6 END * CASE WHEN bucket_cyclical_turn THEN 0.7::DOUBLE ELSE 1 END) AS x FROM j JOIN priced USING (ticker))
 SELECT list, CAST(rn AS INT) AS rank, r.ticker, stance, {r6('r.coverage')} AS coverage, drivers, drags, CASE WHEN price_rank IS NULL OR quality_rank IS NULL THEN NULL ELSE {r6('quality_rank - price_rank')} END AS peer_gap, pg.basis AS peer_set, {r6('dd_52w')} AS dd_52w,
  CASE WHEN noted THEN 'moderate' ELSE 'low' END AS confidence, CASE WHEN list = 'candidate' THEN round_even(least(x * 0.75::DOUBLE, 12000) / 100, 0) * 100 END AS size_low, CASE WHEN list = 'candidate' THEN round_even(least(x * 1.25::DOUBLE, 12000) / 100, 0) * 100 END AS size_high
 FROM r JOIN priced USING (ticker) JOIN sz USING (ticker) LEFT JOIN up USING (ticker) LEFT JOIN dn USING (ticker) LEFT JOIN pg USING (ticker) WHERE rn <= 12 OR list = 'declined'""")
def position_memo(spark, sf):
    sup = t.read(spark, sf, "supplier")
    tk = F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker")
    notes = sup.where("s_suppkey % 3 = 0").select(tk, F.expr("CASE s_suppkey % 9 WHEN 0 THEN 'Pass' WHEN 3 THEN 'Watch closely' ELSE 'Buy in October' END").alias("action"))
    m = mm.position_memo(cs.records(spark, sf), notes, sup.where("s_suppkey % 10 = 3").select(tk), 100000.0).rows
    names = lambda c: F.nullif(F.array_join(F.col(c)["key"], ","), F.lit("")).alias(c)
    return m.select("list", "rank", "ticker", "stance", rnd("coverage").alias("coverage"), names("drivers"), names("drags"), rnd("peer_gap").alias("peer_gap"), "peer_set", rnd("dd_52w").alias("dd_52w"), "confidence", "size_low", "size_high")


_STANCES = ("Buy now", "Buy on a pullback to $1,200 to $1,400", "Buy after September 24 earnings", "Buy in March", "Buy in October", "buy", "Pass")
_SAYS = "CASE pos % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_STANCES)) + " END"


@register("standing_calls", f"""WITH {desk.READS}, b AS (SELECT c.ticker, pos, pos % 7 AS k, pos % 5 AS conviction, c.date, {desk.TRIG_SQL.replace('wrong_if', 'c.wrong_if')} AS trig FROM calls c),
 j AS (SELECT b.ticker, pos, k, conviction, CASE WHEN trig > 0 THEN trig END AS trigger, r.last_close AS price, h.ticker IS NOT NULL AS held, coalesce(r.breached, false) OR coalesce(r.last_close < CASE WHEN trig > 0 THEN trig END, false) AS broken FROM b LEFT JOIN reads r USING (ticker) LEFT JOIN (SELECT DISTINCT ticker FROM held) h USING (ticker)),
 s AS (SELECT *, CASE WHEN k IN (0, 3, 5) THEN 'now' WHEN k = 1 THEN CASE WHEN price BETWEEN 1200 AND 1400 THEN 'now' ELSE 'wait' END WHEN k IN (2, 4) THEN 'wait' ELSE 'skip' END AS standing FROM j),
 l AS (SELECT *, CASE WHEN standing = 'skip' THEN NULL WHEN broken THEN 'out' WHEN standing = 'now' THEN 'buy now' WHEN NOT held THEN 'waiting' END AS list, CASE WHEN broken THEN 'wrong-if level broken' WHEN k <> 1 THEN 'wording' WHEN price IS NULL THEN 'no close' WHEN price > 1400 THEN 'above its zone' WHEN price < 1200 THEN 'under its zone' ELSE 'inside its zone' END AS why FROM s)
 SELECT list, CAST(row_number() OVER (PARTITION BY list ORDER BY CASE WHEN list = 'buy now' THEN -conviction ELSE 0 END, list = 'buy now' AND held, CASE WHEN list = 'buy now' THEN ticker END, pos) AS INT) AS place, ticker, pos, price, trigger, held, why FROM l WHERE list IS NOT NULL""")
def standing_calls(spark, sf):
    c = t.calls(spark, sf).withColumns({"action": F.expr(_SAYS), "conviction": F.col("pos") % 5})
    return rp.standing_calls(c, desk.reads(spark, sf), desk.held(spark, sf), desk.AS_OF)


@register("screen_sinks", f"""WITH {cs.SCREEN} SELECT 'latest' AS part, ticker, rank, CAST(NULL AS VARCHAR) AS exclude_reason FROM scored UNION ALL SELECT 'top', ticker, rank, NULL FROM scored WHERE rank <= 150
 UNION ALL SELECT 'excluded', ticker, NULL, exclude_reason FROM qj WHERE exclude_reason IS NOT NULL""")
def screen_sinks(spark, sf):
    root = scratch_path(spark, "screens")
    s = cs.screen(spark, sf).select("ticker", "rank", "quality_score")
    out = scr.excluded(cs.screened(spark, sf)).select("ticker", "exclude_reason")
    sinks.write_screen(s, root, "2026-09-05", excluded=out, top=s.where("rank <= 150"))
    back = lambda part, at: spark.read.parquet(f"{root}/{at}").withColumn("part", F.lit(part))
    both = back("latest", "latest").unionByName(back("top", "top/latest")).unionByName(back("excluded", "excluded/latest"), allowMissingColumns=True)
    return both.select("part", "ticker", "rank", "exclude_reason")


# -- vendor payloads: one body per name -----------------------------------------------------------------

@register("profile_payloads", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'Own' ELSE 'Vendor' END AS industry, CAST(s_suppkey AS DOUBLE) * 1000000 AS market_cap, s_suppkey % 4 <> 0 AS found FROM supplier")
def profile_payloads(spark, sf):
    s = t.read(spark, sf, "supplier")
    body = F.to_json(F.struct(F.expr("IF(s_suppkey % 4 <> 0, s_name, ' ')").alias("name"), F.expr("IF(s_suppkey % 3 = 0, ' Own ', '')").alias("industry"), F.lit("Vendor").alias("finnhubIndustry"), F.col("s_suppkey").cast("double").alias("marketCapitalization")))
    return pl.profiles(s.select(F.col("s_suppkey").alias("id"), body.alias("body"))).select("id", "name", "industry", "market_cap", "found")


def _bodies(spark, sf, row, wrap=None):
    doc = t.read(spark, sf, "orders").groupBy((F.col("o_custkey")).alias("id")).agg(F.collect_list(row).alias("rows"))
    return doc.select("id", F.to_json(F.struct(F.col("rows").alias(wrap)) if wrap else F.col("rows")).alias("body"))


@register("earnings_payloads", "SELECT o_custkey AS id, CAST(o_orderkey AS VARCHAR) AS period, CASE WHEN o_orderkey % 5 <> 0 THEN '2024Q' || (o_orderkey % 4 + 1) ELSE CAST(o_orderkey AS VARCHAR) END AS label, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice > 100000 END AS beat FROM orders")
def earnings_payloads(spark, sf):
    row = F.struct(F.col("o_orderkey").cast("string").alias("period"), F.expr("IF(o_orderkey % 5 <> 0, 2024, NULL)").alias("year"), (F.col("o_orderkey") % 4 + 1).alias("quarter"), F.col("o_totalprice").alias("actual"),
                   F.expr("IF(o_orderkey % 3 <> 0, 100000D, NULL)").alias("estimate"))
    return pl.earnings(_bodies(spark, sf, row)).select("id", "period", "label", "beat")


@register("calendar_payloads", "SELECT o_custkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS date, CASE o_orderkey % 4 WHEN 0 THEN 'before market open' WHEN 1 THEN 'after market close' WHEN 2 THEN 'during market hours' END AS session, o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AS has_consensus FROM orders")
def calendar_payloads(spark, sf):
    row = F.struct(F.expr("IF(o_orderkey % 7 <> 0, date_format(o_orderdate, 'yyyy-MM-dd'), '')").alias("date"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'bmo' WHEN 1 THEN 'AMC' WHEN 2 THEN 'dmh' ELSE 'x' END").alias("hour"), F.expr("IF(o_orderkey % 3 <> 0, 1.5D, NULL)").alias("epsEstimate"))
    return pl.earnings_calendar(_bodies(spark, sf, row, "earningsCalendar")).select("id", "date", "session", "has_consensus")


@register("news_payloads", "SELECT user_id AS id, event_id AS news_id, event_type AS headline, CASE WHEN event_id % 6 <> 0 THEN CAST(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC' AS DATE) END AS day FROM events WHERE event_id % 5 <> 0")
def news_payloads(spark, sf):
    e = t.read(spark, sf, "events")
    row = F.struct(F.col("event_id").alias("id"), F.expr("IF(event_id % 5 <> 0, event_type, '  ')").alias("headline"), F.expr("IF(event_id % 6 <> 0, 1700000000 + event_id, 0)").alias("datetime"))
    doc = e.groupBy(F.col("user_id").alias("id")).agg(F.to_json(F.collect_list(row)).alias("body"))
    return pl.company_news(doc).select("id", "news_id", "headline", "day")


@register("recommendation_payloads", f"SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS period, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 9 + o_orderkey % 5 + 3 END AS total, CASE WHEN o_orderkey % 4 <> 0 THEN {r6('(o_orderkey % 9 + o_orderkey % 5) / CAST(o_orderkey % 9 + o_orderkey % 5 + 3 AS DOUBLE)')} END AS bullish_share FROM orders")
def recommendation_payloads(spark, sf):
    row = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"), (F.col("o_orderkey") % 9).alias("strongBuy"), (F.col("o_orderkey") % 5).alias("buy"), F.expr("IF(o_orderkey % 4 <> 0, 2, NULL)").alias("hold"), F.lit(1).alias("sell"), F.lit(0).alias("strongSell"))
    r = rp.recommendation_totals(pl.recommendations(_bodies(spark, sf, row)))
    return r.select("id", "period", "total", rnd("bullish_share").alias("bullish_share"))
