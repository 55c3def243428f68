"""Call grading, watch list, live setups over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import text as tx
from panelspark.plans import grading as gr
from panelspark.plans import setups as su
from panelspark.plans import scan as sn
from panelspark.plans import watch as wa
from panelspark.queries import r6, register, rnd
from panelspark.queries import tables as t
from panelspark.queries.core import CAL
from panelspark.session import cut_lineage

AS_OF = "2000-06-30"
KIND_SQL = """CASE WHEN contains(lower(coalesce(action, '')), 'pullback') THEN 'buy_on_pullback' WHEN starts_with(lower(coalesce(action, '')), 'buy') AND regexp_matches(lower(action), '\\b(in|after|from)\\b') THEN 'buy_later'
 WHEN starts_with(lower(coalesce(action, '')), 'buy') THEN 'buy' WHEN contains(lower(coalesce(action, '')), 'pass') THEN 'pass' WHEN contains(lower(coalesce(action, '')), 'watch') THEN 'watch' ELSE 'other' END"""
TRIG_SQL = "TRY_CAST(replace(regexp_extract(wrong_if, '(?i)clos(?:e|es|ing)\\s+(?:under|below|beneath)\\s+\\$?\\s*([0-9,]+(?:\\.[0-9]+)?)', 1), ',', '') AS DOUBLE)"


@register("call_wording", f"""WITH {t.CALLS} SELECT pos, {KIND_SQL} AS kind, {TRIG_SQL} AS trigger, CASE WHEN starts_with(lower(action), 'buy') THEN 'buy' ELSE 'none' END AS verb FROM calls""")
def call_wording(spark, sf):
    c = t.calls(spark, sf)
    return c.select("pos", tx.call_kind("action").alias("kind"), tx.price_trigger("wrong_if").alias("trigger"), tx.trade_verb("action").alias("verb"))


@register("latest_call_per_name", f"WITH {t.CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, pos DESC) AS rn FROM calls) SELECT ticker, date, pos, action, price_at_call FROM r WHERE rn = 1")
def latest_call(spark, sf):
    return gr.latest_calls(t.calls(spark, sf)).select("ticker", "date", "pos", "action", "price_at_call")


@register("buy_zone_standing", """WITH a AS (SELECT o_orderkey AS id, 1000 + o_totalprice % 1000 AS px, CASE o_orderkey % 6 WHEN 0 THEN 'Buy now' WHEN 1 THEN 'Buy on a pullback to $1,200 to $1,400' WHEN 2 THEN 'Buy after September 24 earnings' WHEN 3 THEN 'Buy in ' || CASE WHEN o_custkey % 2 = 0 THEN 'March' ELSE 'October' END WHEN 4 THEN 'buy' ELSE 'Pass' END AS action FROM orders)
 SELECT id, CASE id % 6 WHEN 0 THEN 'now' WHEN 1 THEN CASE WHEN px BETWEEN 1200 AND 1400 THEN 'now' ELSE 'wait' END WHEN 2 THEN 'wait' WHEN 3 THEN CASE WHEN contains(action, 'March') THEN 'now' ELSE 'wait' END WHEN 4 THEN 'now' ELSE 'skip' END AS standing FROM a""")
def buy_zone_standing(spark, sf):
    o = t.read(spark, sf, "orders")
    a = o.select(F.col("o_orderkey").alias("id"), (1000 + F.col("o_totalprice") % 1000).alias("px"), F.expr(
        "CASE o_orderkey % 6 WHEN 0 THEN 'Buy now' WHEN 1 THEN 'Buy on a pullback to $1,200 to $1,400' WHEN 2 THEN 'Buy after September 24 earnings' "
        "WHEN 3 THEN 'Buy in ' || CASE WHEN o_custkey % 2 = 0 THEN 'March' ELSE 'October' END WHEN 4 THEN 'buy' ELSE 'Pass' END").alias("action"))
    return a.select("id", tx.standing("action", "px", F.lit("2000-06-30").cast("date")).alias("standing"))


def snapshots(spark, sf):
    return t.daily(spark, sf).groupBy(F.to_date(F.date_trunc("quarter", "session")).alias("snapshot"), "ticker").agg(
        F.expr("max(close) / 400").alias("score_percentile"))


GRADE = f"""{t.DAILY}, {t.CALLS}, {t.bench_sql('daily')}, {CAL.format(p='daily')}, c0 AS (SELECT *, {KIND_SQL} AS kind, {TRIG_SQL} AS trigger FROM calls),
 sn AS (SELECT date_trunc('quarter', session)::DATE AS snap, ticker, max(close) / 400 AS score_percentile FROM daily GROUP BY 1, 2), sd AS (SELECT DISTINCT snap FROM sn),
 c1 AS (SELECT c.*, s.snap FROM c0 c ASOF LEFT JOIN sd s ON c.date >= s.snap), c2 AS (SELECT c1.*, sn.score_percentile FROM c1 LEFT JOIN sn ON sn.snap = c1.snap AND sn.ticker = c1.ticker),
 px AS (SELECT ticker, arg_max(close, session) FILTER (session <= DATE '{AS_OF}') AS price_now, max(session) AS last FROM daily GROUP BY 1),
 b1 AS (SELECT arg_max(bench, session) AS b1 FROM bench WHERE session <= DATE '{AS_OF}'),
 c3 AS (SELECT c.*, b.bench AS b0 FROM c2 c ASOF LEFT JOIN bench b ON c.date >= b.session),
 lo AS (SELECT pos, min(close) AS low FROM c0 JOIN daily d ON d.ticker = c0.ticker AND d.session > c0.date AND d.session <= DATE '{AS_OF}' GROUP BY 1),
 c4 AS (SELECT c.*, px.price_now, px.last, lo.low, b1.b1, CASE WHEN price_at_call IS NULL THEN 'the log records no price at call' WHEN date > DATE '{AS_OF}' THEN 'the call is dated after the grading date'
  WHEN px.ticker IS NULL THEN 'no price column for this name' WHEN price_now IS NULL THEN 'no price at or before the grading date' END AS reason,
  (SELECT count(*) FROM cal WHERE session <= DATE '{AS_OF}') - (SELECT count(*) FROM cal WHERE session <= c.date) AS td FROM c3 c LEFT JOIN px ON px.ticker = c.ticker LEFT JOIN lo ON lo.pos = c.pos, b1),
 grades AS (SELECT ticker, date, pos, kind, trigger, stop, horizon_days, score_percentile, coalesce(reason, '') AS reason, CASE WHEN reason IS NULL THEN price_now / price_at_call - 1 END AS ret, CASE WHEN reason IS NULL THEN b1 / b0 - 1 END AS bench_ret,
  CASE WHEN reason IS NULL THEN (price_now / price_at_call - 1) - (b1 / b0 - 1) END AS excess, CASE WHEN reason IS NULL THEN td END AS trading_days, CASE WHEN reason IS NULL THEN low END AS low_since_call,
  coalesce(reason IS NULL AND last < DATE '{AS_OF}' AND date_diff('day', last, DATE '{AS_OF}') > 7, false) AS stopped_trading,
  CASE WHEN reason IS NOT NULL THEN 'ungraded' WHEN low < trigger THEN 'falsified' WHEN low < stop THEN 'stopped' ELSE 'graded' END AS status FROM c4)"""


def grades(spark, sf):
    d = cut_lineage(t.daily(spark, sf))
    return gr.grade(t.calls(spark, sf), d, t.benchmark(d), AS_OF, snapshots(spark, sf))


@register("grade_calls", f"WITH {GRADE} SELECT pos, ticker, date, kind, status, reason, {r6('ret')} AS ret, {r6('bench_ret')} AS bench_ret, {r6('excess')} AS excess, CAST(trading_days AS BIGINT) AS trading_days, low_since_call, stopped_trading, {r6('score_percentile')} AS score_percentile FROM grades")
def grade_calls(spark, sf):
    g = grades(spark, sf)
    return g.select("pos", "ticker", "date", "kind", "status", F.coalesce("reason", F.lit("")).alias("reason"), *[rnd(c).alias(c) for c in ("ret", "bench_ret", "excess")],
                    "trading_days", "low_since_call", "stopped_trading", rnd("score_percentile").alias("score_percentile"))


@register("grade_summary", f"""WITH {GRADE} SELECT count(*) AS n_calls, count(*) FILTER (status <> 'ungraded') AS n_graded, count(*) FILTER (status = 'ungraded') AS n_ungraded, count(*) FILTER (status = 'falsified') AS n_falsified,
 count(*) FILTER (status <> 'ungraded' AND starts_with(kind, 'buy') AND excess IS NOT NULL) AS buys_graded, count(*) FILTER (status <> 'ungraded' AND starts_with(kind, 'buy') AND excess > 0) AS buys_ahead,
 count(*) FILTER (status <> 'ungraded' AND kind IN ('pass', 'watch') AND excess IS NOT NULL) AS passes_graded, count(*) FILTER (status <> 'ungraded' AND kind IN ('pass', 'watch') AND excess > 0) AS passes_missed,
 {r6("avg(excess) FILTER (status <> 'ungraded' AND starts_with(kind, 'buy'))")} AS mean_excess_buys, CAST(max(trading_days) FILTER (status <> 'ungraded') AS BIGINT) AS trading_days, count(horizon_days) AS swing_calls,
 count(*) FILTER (horizon_days IS NOT NULL AND low_since_call < stop) AS swing_stopped FROM grades""")
def grade_summary(spark, sf):
    s = gr.grade_summary(grades(spark, sf))
    return s.withColumn("mean_excess_buys", rnd("mean_excess_buys"))


@register("outcome_readout", f"""WITH {GRADE}, u AS (SELECT date, score_percentile AS x, round(excess, 12) AS y FROM grades WHERE status <> 'ungraded' AND score_percentile IS NOT NULL AND excess IS NOT NULL), k AS (SELECT x, y, date, {t.pctl_sql('x', '')} AS rx, {t.pctl_sql('y', '')} AS ry FROM u)
 SELECT count(*) AS n_usable, count(DISTINCT date) AS n_dates, (SELECT CAST(max(trading_days) AS BIGINT) FROM grades) AS longest, '' AS shortfalls, 'READ' AS status, {r6('corr(rx, ry)')} AS rank_ic, {r6('avg(y) FILTER (x >= 50)')} AS liked, {r6('avg(y) FILTER (x < 50)')} AS disliked,
 CASE WHEN abs(corr(rx, ry)) < 0.1 THEN 'no relationship visible so far' WHEN corr(rx, ry) > 0 THEN 'suggestive so far' ELSE 'suggestive so far, the wrong way' END AS verdict FROM k""")
def outcome_readout(spark, sf):
    r = gr.outcome_readout(cut_lineage(grades(spark, sf)), True)
    return r.withColumns({c: rnd(c) for c in ("rank_ic", "liked", "disliked")})


@register("outcome_readout_refused", f"""WITH {GRADE}, u AS (SELECT date FROM grades WHERE status <> 'ungraded' AND score_percentile IS NOT NULL AND excess IS NOT NULL)
 SELECT count(*) AS n_usable, count(DISTINCT date) AS n_dates, (SELECT CAST(max(trading_days) FILTER (status <> 'ungraded') AS BIGINT) FROM grades) AS longest, 'not real data' AS shortfalls, 'INSUFFICIENT' AS status,
 CAST(NULL AS DOUBLE) AS rank_ic, CAST(NULL AS DOUBLE) AS liked, CAST(NULL AS DOUBLE) AS disliked, 'no readout' AS verdict FROM u""")
def outcome_readout_refused(spark, sf):
    return gr.outcome_readout(cut_lineage(grades(spark, sf)), False)


HZ = f"""WITH {t.DAILY}, {t.CALLS}, {t.bench_sql('daily')}, {CAL.format(p='daily')}, w AS (SELECT *, unnest(list_distinct([5, 10, 20, horizon_days])) AS n FROM calls WHERE horizon_days IS NOT NULL AND price_at_call IS NOT NULL),
 k AS (SELECT w.*, (SELECT count(*) FROM cal WHERE session <= w.date) + n - 1 AS si FROM w), j AS (SELECT k.*, c.session AS on_date FROM k LEFT JOIN cal c ON c.s_idx = k.si AND c.session <= DATE '{AS_OF}'),
 p AS (SELECT j.*, d.close AS px FROM j ASOF LEFT JOIN daily d ON d.ticker = j.ticker AND j.on_date >= d.session), q AS (SELECT p.*, b.bench AS b0 FROM p ASOF LEFT JOIN bench b ON p.date >= b.session), r AS (SELECT q.*, b.bench AS b1 FROM q ASOF LEFT JOIN bench b ON q.on_date >= b.session)
 SELECT pos, n, n = horizon_days AS is_horizon, on_date, {r6('px / price_at_call - 1')} AS ret, {r6('(px / price_at_call - 1) - (b1 / b0 - 1)')} AS excess FROM r"""


@register("horizon_grades", HZ)
def horizon_grades(spark, sf):
    d = cut_lineage(t.daily(spark, sf))
    h = gr.horizon_grades(t.calls(spark, sf), d, t.benchmark(d), AS_OF)
    return h.select("pos", "n", "is_horizon", F.col("on").alias("on_date"), rnd("ret").alias("ret"), rnd("excess").alias("excess"))


# -- watch -------------------------------------------------------------------------------------------

def held(spark, sf):
    s = t.read(spark, sf, "supplier").where("s_suppkey % 4 <> 2 OR s_suppkey % 3 = 0")
    return s.select(F.concat(F.lit("S"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey") + 100000).otherwise(F.col("s_suppkey"))).alias("ticker"), (F.lit(900.0) + F.col("s_suppkey")).alias("held_trigger"))


HELD = "held AS (SELECT 'S' || CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey + 100000 ELSE s_suppkey END AS ticker, 900.0::DOUBLE + s_suppkey AS held_trigger FROM supplier WHERE s_suppkey % 4 <> 2 OR s_suppkey % 3 = 0)"
NAMES = f"""{t.CALLS}, {HELD}, lc AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC, pos DESC) AS rn FROM calls),
 names AS (SELECT coalesce(l.ticker, h.ticker) AS ticker, l.date, coalesce(CASE WHEN l.ticker IS NOT NULL THEN {KIND_SQL} END, 'held') AS kind, price_at_call, coalesce({TRIG_SQL}, held_trigger) AS trigger, h.ticker IS NOT NULL AS held
  FROM (SELECT * FROM lc WHERE rn = 1) l FULL JOIN held h ON h.ticker = l.ticker)"""
READS = f"""{NAMES}, {t.DAILY}, ob AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS rn FROM daily WHERE session <= DATE '{AS_OF}'),
 ow AS (SELECT ticker, max(close) FILTER (rn = 1) AS b0, max(close) FILTER (rn = 2) AS b1, max(close) FILTER (rn = 6) AS b5, max(session) AS last_date, min(close) AS low, count(*) AS sessions FROM ob GROUP BY 1),
 reads AS (SELECT n.*, b0 AS last_close, last_date, b1 AS prev_close, b0 / b1 - 1 AS chg_1d, b0 / b5 - 1 AS chg_5d, b0 / price_at_call - 1 AS since_call, b0 / trigger - 1 AS to_trigger, b0 < trigger AS breached, low, coalesce(sessions, 0) AS sessions,
  CAST(date_diff('day', last_date, DATE '{AS_OF}') AS INT) AS stale_days FROM names n LEFT JOIN ow USING (ticker))"""


def reads(spark, sf):
    return wa.price_reads(wa.names_to_watch(t.calls(spark, sf), held(spark, sf)), t.daily(spark, sf), AS_OF)


@register("names_to_watch", f"WITH {NAMES} SELECT * FROM names")
def names_to_watch(spark, sf):
    return wa.names_to_watch(t.calls(spark, sf), held(spark, sf)).select("ticker", "date", "kind", "price_at_call", "trigger", "held")


@register("price_read", f"WITH {READS} SELECT ticker, last_close, last_date, {', '.join(f'{r6(c)} AS {c}' for c in ('chg_1d', 'chg_5d', 'since_call', 'to_trigger'))}, breached, low, sessions, stale_days FROM reads")
def price_read(spark, sf):
    r = reads(spark, sf)
    return r.select("ticker", "last_close", "last_date", *[rnd(c).alias(c) for c in ("chg_1d", "chg_5d", "since_call", "to_trigger")], "breached", "low", "sessions", "stale_days")


ALERTS = f"""{READS}, al AS (SELECT ticker, held, 'trigger' AS kind, 3 AS severity, to_trigger AS value, last_date AS as_of FROM reads WHERE breached UNION ALL SELECT ticker, held, 'near_trigger', 2, to_trigger, last_date FROM reads WHERE NOT breached AND to_trigger <= 0.05
 UNION ALL SELECT ticker, held, 'drop_week', 3, chg_5d, last_date FROM reads WHERE chg_5d <= -0.15 UNION ALL SELECT ticker, held, 'move_day', 2, chg_1d, last_date FROM reads WHERE abs(chg_1d) >= 0.05)"""


@register("price_alerts", f"WITH {ALERTS} SELECT ticker, kind, CAST(severity AS INT) AS severity, {r6('value')} AS value, as_of FROM al")
def price_alerts(spark, sf):
    return wa.price_alerts(reads(spark, sf)).select("ticker", "kind", "severity", rnd("value").alias("value"), "as_of")


@register("alert_counts_per_name", f"WITH {ALERTS} SELECT n.ticker, n.held, count(al.kind) AS n_alerts, count(*) FILTER (severity >= 3) AS n_rule_alerts, CAST(coalesce(max(severity), 0) AS INT) AS max_severity FROM names n LEFT JOIN al ON al.ticker = n.ticker GROUP BY 1, 2")
def alert_counts(spark, sf):
    r = reads(spark, sf)
    return wa.scan_counts(r, wa.price_alerts(r))


@register("unsent_alerts", f"WITH {ALERTS} SELECT ticker, kind, ticker || '|' || kind || '|' || strftime(as_of, '%Y-%m-%d') AS alert_key FROM al WHERE NOT (CAST(substr(ticker, 2) AS BIGINT) % 3 = 0 AND kind = 'trigger')")
def unsent_alerts(spark, sf):
    a = wa.price_alerts(reads(spark, sf))
    sent = a.where((F.substring("ticker", 2, 10).cast("long") % 3 == 0) & (F.col("kind") == "trigger")).select(wa.alert_key().alias("alert_key"))
    return wa.unsent(a, sent).select("ticker", "kind", "alert_key")


_FORM = "CASE event_type WHEN 'click' THEN '8-K' WHEN 'error' THEN '10-Q' WHEN 'purchase' THEN '4' WHEN 'signup' THEN 'SC 13D' ELSE 'S-8' END"
_ITEMS = "CASE event_id % 4 WHEN 0 THEN '2.02,9.01' WHEN 1 THEN '5.02' WHEN 2 THEN '8.01,2.02' ELSE '' END"
FILINGS = f"""ids AS (SELECT 'S' || s_suppkey AS ticker, s_suppkey AS cik FROM supplier WHERE s_suppkey % 6 <> 0), fil AS (SELECT user_id % (SELECT count(*) FROM supplier) AS cik, {_FORM} AS form, CAST(ts AS DATE) AS filed, event_id AS accession, {_ITEMS} AS items FROM events),
 nm AS (SELECT 'S' || s_suppkey AS ticker FROM supplier), fs AS (SELECT nm.ticker, i.cik, f.form, f.filed, f.accession, f.items FROM nm LEFT JOIN ids i USING (ticker) LEFT JOIN fil f ON f.cik = i.cik AND f.filed > DATE '2024-01-10' AND f.form <> 'S-8'),
 fz AS (SELECT * FROM fs WHERE cik IS NULL OR accession IS NOT NULL)"""


def filings(spark, sf):
    n = t.read(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    f = t.read(spark, sf, "events").select((F.col("user_id") % n).alias("cik"), F.expr(_FORM).alias("form"), F.to_date("ts").alias("filed"), F.col("event_id").alias("accession"),
                                           F.split(F.expr(_ITEMS), ",").alias("items"))
    s = t.read(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.col("s_suppkey").alias("cik"))
    return wa.filings_since(s.select("ticker"), s.where("cik % 6 <> 0"), f, "2024-01-10")


@register("filings_since", f"WITH {FILINGS} SELECT ticker, form, filed, accession, CASE WHEN cik IS NULL THEN 'no id, filings not scanned' END AS note FROM fz")
def filings_since(spark, sf):
    return filings(spark, sf).select("ticker", "form", "filed", "accession", "note")


@register("filing_alerts", f"""WITH {FILINGS} SELECT ticker, 'earnings_8k' AS kind, CAST(3 AS INT) AS severity, CAST(NULL AS DOUBLE) AS value, filed AS as_of FROM fz WHERE form = '8-K' AND contains(items, '2.02')
 UNION ALL SELECT ticker, 'filing', 1, NULL, filed FROM fz WHERE form = '8-K' AND NOT contains(items, '2.02') UNION ALL SELECT ticker, 'filing', 2, NULL, filed FROM fz WHERE form = '10-Q' UNION ALL SELECT ticker, 'stake', 2, NULL, filed FROM fz WHERE form = 'SC 13D'
 UNION ALL SELECT ticker, 'filing', 1, CAST(count(*) AS DOUBLE), max(filed) FROM fz WHERE form = '4' GROUP BY ticker""")
def filing_alerts(spark, sf):
    return wa.filing_alerts(filings(spark, sf).where("accession is not null"))


_FA = """fa AS (SELECT ticker, 3 AS severity FROM fz WHERE form = '8-K' AND contains(items, '2.02') UNION ALL SELECT ticker, 1 FROM fz WHERE form = '8-K' AND NOT contains(items, '2.02') UNION ALL SELECT ticker, 2 FROM fz WHERE form IN ('10-Q', 'SC 13D')
 UNION ALL SELECT ticker, 1 FROM fz WHERE form = '4' GROUP BY ticker)"""


@register("watch_scan_report", f"""WITH {ALERTS}, {FILINGS}, {_FA}, both_ AS (SELECT ticker, severity FROM al UNION ALL SELECT fa.ticker, severity FROM fa JOIN names USING (ticker)),
 c AS (SELECT n.ticker AS key, CAST(count(b.severity) AS BIGINT) AS n, CAST(coalesce(max(severity), 0) AS INT) AS top FROM names n LEFT JOIN both_ b ON b.ticker = n.ticker GROUP BY 1)
 SELECT 'name' AS kind, key, CAST(NULL AS VARCHAR) AS status, n, top FROM c
 UNION ALL SELECT 'source', 'prices', 'ok', (SELECT count(*) FROM daily), NULL UNION ALL SELECT 'source', 'filings', 'ok', (SELECT count(*) FROM fil), NULL UNION ALL SELECT 'source', 'headlines', 'failed', 0, NULL""")
def watch_scan_report(spark, sf):
    def filed():
        n = t.read(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
        return t.read(spark, sf, "events").select((F.col("user_id") % n).cast("string").alias("cik"), F.expr(_FORM).alias("form"), F.to_date("ts").alias("filed"), F.col("event_id").cast("string").alias("accession"), F.split(F.expr(_ITEMS), ",").alias("items"))

    ids = t.read(spark, sf, "supplier").where("s_suppkey % 6 <> 0").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.col("s_suppkey").cast("string").alias("cik"))
    sources = {"prices": lambda: t.daily(spark, sf), "filings": filed, "headlines": lambda: t.read(spark, sf, "no_such_feed")}
    r = sn.watch_scan(spark, wa.names_to_watch(t.calls(spark, sf), held(spark, sf)), sources, AS_OF, "2024-01-10", ids)
    names = r.names.select(F.lit("name").alias("kind"), F.col("ticker").alias("key"), F.lit(None).cast("string").alias("status"), F.col("n_alerts").alias("n"), F.col("max_severity").cast("int").alias("top"))
    return names.unionByName(r.sources.select(F.lit("source").alias("kind"), F.col("source").alias("key"), "status", F.col("n_rows").alias("n"), F.lit(None).cast("int").alias("top")))


# -- setups --------------------------------------------------------------------------------------------

LOOSE = su.SetupRules(gap=0.05, pead_sessions=12, guidance_age=5, lookback=80, breakout_min=60, band=0.6, max_dd=-0.995, short=20, mid=50, long=200)
SETUPS = f"""WITH {t.DAILY}, {t.ESTIMATES}, ob AS (SELECT ticker, session, close, row_number() OVER w AS rn, lead(close) OVER w AS prior, min(close) OVER (PARTITION BY ticker ORDER BY session DESC) AS low_since FROM daily WHERE session <= DATE '{AS_OF}' WINDOW w AS (PARTITION BY ticker ORDER BY session DESC)),
 s AS (SELECT ticker, count(*) AS n, max(close) FILTER (rn = 1) AS latest, avg(close) FILTER (rn <= 20) AS ms, avg(close) FILTER (rn <= 50) AS mm, avg(close) FILTER (rn <= 200) AS ml, max(close) FILTER (rn <= 80) AS hi, max(close) FILTER (rn BETWEEN 2 AND 80) AS ph, min(close) FILTER (rn <= 5) AS l5, min(close) FILTER (rn <= 20) AS ls FROM ob GROUP BY 1),
 rel AS (SELECT DISTINCT 'S' || (o_custkey % (SELECT count(*) FROM supplier)) AS ticker, CAST(o_orderdate AS DATE) AS filed FROM orders WHERE o_orderdate <= DATE '{AS_OF}'),
 rj AS (SELECT r.ticker, r.filed, o.close AS release, o.prior, o.rn, o.low_since FROM rel r ASOF JOIN ob o ON o.ticker = r.ticker AND r.filed <= o.session),
 pd AS (SELECT ticker, 1 AS o, 'pead' AS kind, arg_max(latest, filed) AS entry, arg_max(low_since, filed) AS stop FROM rj JOIN s USING (ticker) WHERE n >= 3 AND rn <= 12 AND prior > 0 AND release / prior - 1 >= 0.05 AND latest >= release AND low_since < latest GROUP BY ticker),
 gd AS (SELECT ticker, max(filed) AS filed FROM rel WHERE CAST(substr(ticker, 2) AS BIGINT) % 3 = 0 GROUP BY 1),
 gj AS (SELECT g.ticker, count(*) FILTER (ob.session > g.filed) AS age FROM gd g JOIN ob ON ob.ticker = g.ticker GROUP BY 1),
 al AS (SELECT * FROM pd UNION ALL SELECT g.ticker, 2, 'guidance', latest, l5 FROM gj g JOIN s ON s.ticker = g.ticker WHERE age <= 5 AND n >= 6 AND l5 < latest
  UNION ALL SELECT s.ticker, 3, 'breakout', latest, latest * (1.0::DOUBLE - 0.08::DOUBLE) FROM s JOIN estimates e ON e.ticker = s.ticker WHERE eps_fy1_now / nullif(eps_fy1_30d, 0) - 1 > 0 AND n >= 60 AND latest > ph
  UNION ALL SELECT ticker, 4, 'pullback', latest, ls FROM s WHERE CAST(substr(ticker, 2) AS BIGINT) % 2 = 0 AND n >= 200 AND mm > ml AND latest > ml AND abs(latest / ms - 1) <= 0.6 AND latest / hi - 1 >= -0.995 AND ls < latest)
 SELECT ticker, arg_min(kind, o) AS kind, arg_min(entry, o) AS entry, {r6('arg_min(stop, o)')} AS stop, coalesce(string_agg(kind, ', ' ORDER BY o) FILTER (o > mo), '') AS also FROM (SELECT *, min(o) OVER (PARTITION BY ticker) AS mo FROM al) GROUP BY ticker"""


@register("live_setups", SETUPS)
def live_setups(spark, sf):
    n = t.read(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    rel = t.read(spark, sf, "orders").where(F.col("o_orderdate") <= AS_OF).select(F.concat(F.lit("S"), F.col("o_custkey") % n).alias("ticker"), F.to_date("o_orderdate").alias("filed"))
    k = F.substring("ticker", 2, 10).cast("long")
    diffs = rel.where(k % 3 == 0).select("ticker", "filed", F.lit("revenue").alias("metric"), F.lit("raised").alias("change"))
    screen = t.estimates(spark, sf).select("ticker", (F.try_divide("eps_fy1_now", "eps_fy1_30d") - 1).alias("eps_fy1_chg_30d"))
    d = t.daily(spark, sf)
    s = su.live_setups(d, AS_OF, rel, diffs, screen, screen.where(k % 2 == 0), LOOSE)
    return s.select("ticker", "kind", "entry", rnd("stop").alias("stop"), "also")
