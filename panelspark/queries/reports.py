"""Audit, attrition, memo, positions and digest tables over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import panel as pn
from panelspark.plans import audit as au
from panelspark.plans import listings as ls
from panelspark.plans import reports as rp
from panelspark.plans import score as sc
from panelspark.plans import search as se
from panelspark.queries import crosssection as cs
from panelspark.queries import desk
from panelspark.queries import r6, register, rnd
from panelspark.queries import tables as t
from panelspark.queries.core import CAL, fwd_ctes
from panelspark.session import cut_lineage, scratch_path

# -- audit ---------------------------------------------------------------------------------------

OWN = f"""{t.WEEKLY}, {CAL.format(p='weekly')}, own AS (SELECT *, lag(close) OVER w AS prior, lag(session) OVER w AS ps, volume / nullif(CASE WHEN avg(volume) OVER v > 0 THEN avg(volume) OVER v END, 0) AS vm,
  CASE WHEN count(close) OVER a = 3 THEN avg(close) OVER a END AS later FROM weekly WINDOW w AS (PARTITION BY ticker ORDER BY session), v AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
 evs AS (SELECT ticker, make_date(CAST(1996 + rn % 5 AS INT), 6, 15) AS date, CASE rn % 4 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS ratio FROM (SELECT 'S' || s_suppkey AS ticker, s_suppkey AS rn FROM supplier)),
 kn AS (SELECT e.*, CASE WHEN o.close > 0 AND o.prior > 0 THEN o.prior / o.close END AS seen, o.vm FROM evs e ASOF LEFT JOIN own o ON o.ticker = e.ticker AND e.date <= o.session),
 known AS (SELECT ticker, date, ratio AS ratio_known, seen AS ratio_seen, CASE WHEN seen IS NOT NULL THEN vm END AS volume_multiple, CASE WHEN seen IS NULL THEN 'no_data' WHEN abs(seen - 1) < 0.10 THEN 'adjusted' WHEN abs(seen / ratio - 1) < 0.12 THEN 'unadjusted' ELSE 'ambiguous' END AS verdict FROM kn),
 cand AS (SELECT o.ticker, o.session AS date, CAST(NULL AS DOUBLE) AS ratio_known, prior / close AS ratio_seen, vm AS volume_multiple, 'candidate' AS verdict FROM own o JOIN cal c ON c.session = o.session JOIN cal p ON p.session = o.ps AND p.s_idx + 1 = c.s_idx
  WHERE close > 0 AND prior > 0 AND abs(close / prior - 1) > 0.40 AND later IS NOT NULL AND abs(later / close - 1) <= 0.15 AND len(list_filter([1.5, 2, 3, 4, 5, 7, 10]::DOUBLE[], lambda k: abs(prior / close / k - 1) < 0.08 OR abs(prior / close * k - 1) < 0.08)) > 0
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.ticker = o.ticker AND k.date = o.session))"""


def findings(spark, sf):
    w = t.weekly(spark, sf)
    own = au.own_rows(w)
    ev = t.read(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.make_date((1996 + F.col("s_suppkey") % 5).cast("int"), F.lit(6), F.lit(15)).alias("date"),
                                              F.expr("CASE s_suppkey % 4 WHEN 0 THEN 2.0D WHEN 1 THEN 3.0D WHEN 2 THEN 1.5D ELSE 0.5D END").alias("ratio"))
    k = au.known_events(own, ev)
    return k.unionByName(au.sweep(own, pn.calendar(w), k))


@register("split_audit", f"WITH {OWN} SELECT ticker, date, ratio_known, {r6('ratio_seen')} AS ratio_seen, {r6('volume_multiple')} AS volume_multiple, verdict FROM (SELECT * FROM known UNION ALL SELECT * FROM cand)")
def split_audit(spark, sf):
    return findings(spark, sf).withColumns({"ratio_seen": rnd("ratio_seen"), "volume_multiple": rnd("volume_multiple")})


@register("dataset_verdict", f"WITH {OWN}, k AS (SELECT DISTINCT verdict FROM known WHERE verdict <> 'no_data') SELECT CASE WHEN count(*) = 0 THEN 'unknown' WHEN count(*) > 1 OR max(verdict) = 'ambiguous' THEN 'mixed' ELSE max(verdict) END AS dataset_verdict FROM k")
def dataset_verdict(spark, sf):
    return au.dataset_verdict(findings(spark, sf))


@register("suspect_tickers", f"WITH {OWN} SELECT DISTINCT ticker FROM cand WHERE volume_multiple IS NULL OR volume_multiple < 2")
def suspect_tickers(spark, sf):
    return au.suspects(findings(spark, sf))


@register("split_adjustment", f"""WITH {OWN}, e AS (SELECT ticker, date, product(ratio_seen) AS r FROM known WHERE verdict = 'unadjusted' GROUP BY 1, 2), f AS (SELECT w.ticker, w.session, any_value(close) AS close, any_value(volume) AS volume, coalesce(product(e.r), 1) AS k FROM weekly w LEFT JOIN e ON e.ticker = w.ticker AND e.date > w.session GROUP BY 1, 2)
 SELECT ticker, session, {r6('close / k', 4)} AS close, {r6('volume * k', 4)} AS volume FROM f""")
def split_adjustment(spark, sf):
    a = au.adjust_for_splits(t.weekly(spark, sf), findings(spark, sf))
    return a.select("ticker", "session", rnd("close", 4).alias("close"), rnd("volume", 4).alias("volume"))


@register("source_cross_check", f"""WITH {t.DAILY}, j AS (SELECT ticker, session, close AS a, CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 3 = 0 THEN close * 4 WHEN CAST(substr(ticker, 2) AS BIGINT) % 3 = 1 AND session > DATE '1998-01-01' THEN close / 2 ELSE close END AS b FROM daily WHERE NOT (CAST(substr(ticker, 2) AS BIGINT) % 10 = 9 AND session > DATE '1995-01-20')),
 d AS (SELECT *, abs((a / lag(a) OVER w - 1) - (b / lag(b) OVER w - 1)) AS d FROM j WINDOW w AS (PARTITION BY ticker ORDER BY session)), g AS (SELECT ticker, count(*) AS n_overlap, median(d) AS md, max(d) AS mx, median(a / b) AS lr FROM d GROUP BY 1)
 SELECT ticker, n_overlap, CASE WHEN n_overlap >= 20 THEN {r6('md')} END AS median_diff, CASE WHEN n_overlap >= 20 THEN {r6('mx')} END AS max_diff, CASE WHEN n_overlap >= 20 THEN {r6('lr')} END AS level_ratio, n_overlap >= 20 AND coalesce(md <= 0.001 AND mx <= 0.10, false) AS passed FROM g""")
def source_cross_check(spark, sf):
    d = t.daily(spark, sf)
    k = F.substring("ticker", 2, 10).cast("long")
    b = d.where(~((k % 10 == 9) & (F.col("session") > "1995-01-20"))).withColumn(
        "close", F.when(k % 3 == 0, F.col("close") * 4).when((k % 3 == 1) & (F.col("session") > "1998-01-01"), F.col("close") / 2).otherwise(F.col("close")))
    c = au.cross_check(d, b)
    return c.select("ticker", "n_overlap", *[rnd(x).alias(x) for x in ("median_diff", "max_diff", "level_ratio")], F.coalesce("passed", F.lit(False)).alias("passed"))


@register("audit_gate", f"WITH {OWN}, k AS (SELECT DISTINCT verdict FROM known WHERE verdict <> 'no_data') SELECT CASE WHEN count(*) = 0 THEN 'unknown' WHEN count(*) > 1 OR max(verdict) = 'ambiguous' THEN 'mixed' ELSE max(verdict) END AS dataset_verdict, false AS any_check_failed, true AS any_benchmark_split, 'FAIL' AS gate FROM k")
def audit_gate(spark, sf):
    w = t.weekly(spark, sf)
    fac = w.groupBy("ticker", F.trunc("session", "year").alias("factor_date")).agg(F.when(F.year(F.min("session")) < 1999, 1.0).otherwise(0.5).alias("split_factor"))
    bs = au.benchmark_splits(fac, F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))
    return au.gate(findings(spark, sf), au.cross_check(w, w), bs)


@register("thin_tickers", f"WITH {t.DAILY} SELECT ticker, count(close) AS n_obs FROM daily GROUP BY 1 HAVING count(close) < 520")
def thin_tickers(spark, sf):
    return au.thin_tickers(t.daily(spark, sf), 520)


@register("member_counts", f"""WITH {t.DAILY}, {t.MEMBERSHIP}, e AS (SELECT min(session) AS a, max(session) AS b FROM daily), x AS (SELECT DISTINCT ticker FROM daily)
 SELECT (SELECT count(*) FROM x WHERE EXISTS (SELECT 1 FROM membership m, e WHERE m.ticker = x.ticker AND m.start_date <= a AND (m.end_date IS NULL OR a <= m.end_date))) AS members_first, (SELECT count(*) FROM x WHERE EXISTS (SELECT 1 FROM membership m, e WHERE m.ticker = x.ticker AND m.start_date <= b AND (m.end_date IS NULL OR b <= m.end_date))) AS members_last""")
def member_counts(spark, sf):
    return au.member_counts(t.daily(spark, sf), t.membership(spark, sf))


# -- attrition ----------------------------------------------------------------------------------------

EL = f"""{t.LISTINGS}, e0 AS (SELECT *, unnest([1, 3, 5]) AS years_ago FROM listings WHERE asset_type = 'Stock' AND upper(exchange) IN ('NYSE', 'NASDAQ')), e1 AS (SELECT *, (DATE '2001-12-31' - to_years(CAST(years_ago AS INT)))::DATE AS as_of FROM e0),
 el AS (SELECT *, coalesce(ipo_date <= as_of AND (delist_date IS NULL OR delist_date > as_of) AND date_diff('day', ipo_date, as_of) / 365.25 >= 1, false) AS eligible, ipo_date IS NULL AS unknown_ipo FROM e1),
 em AS (SELECT *, eligible AND coalesce(delist_date <= DATE '2001-12-31', false) AS gone FROM el)"""
_KW = {"horizons": (1, 3, 5), "min_years": 1.0}


@register("attrition", f"""WITH {EL}, g AS (SELECT years_ago, as_of, count(*) FILTER (eligible) AS eligible, count(*) FILTER (gone) AS gone, count(*) FILTER (unknown_ipo) AS unknown_ipo FROM em GROUP BY 1, 2)
 SELECT years_ago, as_of, eligible, gone, unknown_ipo, {r6('gone / nullif(eligible, 0)')} AS rate, {r6("1 - pow(1 - gone / nullif(eligible, 0), 1 / (date_diff('day', as_of, DATE '2001-12-31') / 365.25))")} AS annualised FROM g""")
def attrition(spark, sf):
    return ls.attrition(t.listings(spark, sf), "2001-12-31", **_KW).withColumns({"rate": rnd("rate"), "annualised": rnd("annualised")})


@register("attrition_by_exchange", f"WITH {EL} SELECT years_ago, exchange, count(*) FILTER (eligible) AS eligible, count(*) FILTER (gone) AS gone FROM em GROUP BY 1, 2")
def attrition_by_exchange(spark, sf):
    return ls.attrition_by(t.listings(spark, sf), "2001-12-31", "exchange", **_KW)


@register("attrition_by_year", f"WITH {EL} SELECT years_ago, CAST(year(delist_date) AS INT) AS year, count(*) AS gone FROM em WHERE gone GROUP BY 1, 2")
def attrition_by_year(spark, sf):
    return ls.attrition_by(t.listings(spark, sf), "2001-12-31", "year", **_KW)


@register("departed_examples", f"WITH {EL}, r AS (SELECT *, row_number() OVER (PARTITION BY years_ago ORDER BY delist_date, symbol, row_id) AS rn FROM em WHERE gone) SELECT years_ago, CAST(rn AS INT) AS rank, symbol, delist_date FROM r WHERE rn <= 12")
def departed_examples(spark, sf):
    return ls.departed_examples(t.listings(spark, sf), "2001-12-31", **_KW)


@register("reused_symbols", f"WITH {t.LISTINGS} SELECT symbol, count(*) AS n FROM listings WHERE asset_type = 'Stock' GROUP BY 1 HAVING count(*) > 1")
def reused_symbols(spark, sf):
    return ls.reused_symbols(t.listings(spark, sf))


@register("listing_alive_on_date", f"WITH {t.LISTINGS} SELECT row_id, symbol, coalesce(ipo_date <= DATE '1999-06-30' AND (delist_date IS NULL OR delist_date > DATE '1999-06-30'), false) AS alive FROM listings")
def listing_alive(spark, sf):
    from panelspark.operators.intervals import alive_on
    l = t.listings(spark, sf)
    return l.select("row_id", "symbol", F.coalesce(alive_on(l, F.lit("1999-06-30").cast("date")), F.lit(False)).alias("alive"))


@register("universe_vs_delisted", f"""WITH {t.LISTINGS}, p AS (SELECT symbol, bool_or(coalesce(ipo_date <= DATE '2001-12-31' AND (delist_date IS NULL OR delist_date > DATE '2001-12-31'), false)) AS alive, max(delist_date) AS ld FROM listings GROUP BY 1), n AS (SELECT DISTINCT 'C' || (c_custkey % 700) AS ticker FROM customer)
 SELECT ticker, CASE WHEN p.symbol IS NULL THEN 'not covered' WHEN alive THEN 'listed' ELSE 'delisted' END AS status, CASE WHEN NOT alive THEN ld END AS last_delisting FROM n LEFT JOIN p ON p.symbol = n.ticker""")
def universe_vs_delisted(spark, sf):
    n = t.read(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey") % 700).alias("ticker")).distinct()
    return ls.cross_check(n, t.listings(spark, sf), "2001-12-31")


# -- trends and side by side ------------------------------------------------------------------------------

SERIES = f"""{t.STATEMENTS}, series AS (SELECT ticker AS entity, 'revenue' AS metric, 'FY' || fy AS period, fy AS pos, revenue AS value, 'currency' AS unit, true AS hib FROM statements UNION ALL SELECT ticker, 'gross_margin', 'FY' || fy, fy, gross_profit / nullif(revenue, 0), 'percent', true FROM statements
 UNION ALL SELECT ticker, 'net_debt', 'FY' || fy, fy, net_debt, 'currency', false FROM statements UNION ALL SELECT ticker, 'shares', 'H' || fy % 10, fy, diluted_shares, 'count', NULL FROM statements)"""


def series(spark, sf):
    s = t.statements(spark, sf)
    one = lambda m, p, v, u, h: s.select(F.col("ticker").alias("entity"), F.lit(m).alias("metric"), p.alias("period"), F.col("fy").alias("pos"), v.alias("value"), F.lit(u).alias("unit"), h.cast("boolean").alias("higher_is_better"))
    fy = F.concat(F.lit("FY"), "fy")
    return (one("revenue", fy, F.col("revenue"), "currency", F.lit(True)).unionByName(one("gross_margin", fy, F.try_divide("gross_profit", "revenue"), "percent", F.lit(True)))
            .unionByName(one("net_debt", fy, F.col("net_debt"), "currency", F.lit(False))).unionByName(one("shares", F.concat(F.lit("H"), F.col("fy") % 10), F.col("diluted_shares"), "count", F.lit(None))))


@register("trend_summary", f"""WITH {SERIES}, y AS (SELECT *, TRY_CAST(nullif(regexp_extract(period, '([0-9]{{4}})', 1), '') AS INT) AS yr FROM series), g AS (SELECT entity, metric, unit, hib, count(value) AS n_obs, arg_min(value, pos) FILTER (value IS NOT NULL) AS f, arg_max(value, pos) FILTER (value IS NOT NULL) AS l,
  arg_min(yr, pos) FILTER (value IS NOT NULL) AS y0, arg_max(yr, pos) FILTER (value IS NOT NULL) AS y1, count(yr) FILTER (value IS NOT NULL) AS ny FROM y GROUP BY ALL),
 h AS (SELECT *, CASE WHEN n_obs < 2 THEN 0 WHEN y1 > y0 THEN y1 - y0 ELSE n_obs - 1 END AS periods, n_obs >= 2 AND ny = n_obs AND coalesce(y1 - y0 <> n_obs - 1, false) AS has_gap, CASE WHEN f IS NULL THEN 'unknown' WHEN unit = 'percent' AND abs(l - f) < 0.01 THEN 'flat' WHEN unit = 'percent' THEN CASE WHEN l > f THEN 'up' ELSE 'down' END
  WHEN f = 0 AND l = 0 THEN 'flat' WHEN f = 0 THEN CASE WHEN l > f THEN 'up' ELSE 'down' END WHEN abs((l - f) / abs(f)) < 0.05 THEN 'flat' WHEN l > f THEN 'up' ELSE 'down' END AS direction FROM g)
 SELECT entity, metric, n_obs, {r6('f', 4)} AS first, {r6('l', 4)} AS last, CAST(periods AS BIGINT) AS periods, has_gap, {r6('l - f', 4)} AS change, CASE WHEN f > 0 AND l >= 0 THEN {r6('l / f - 1')} END AS change_pct, CASE WHEN unit <> 'percent' AND f > 0 AND l > 0 AND periods > 0 THEN {r6('pow(l / f, 1.0::DOUBLE / periods) - 1')} END AS cagr, direction,
 CASE WHEN direction IN ('up', 'down') THEN (direction = 'up') = hib END AS reads_well FROM h""")
def trend_summary(spark, sf):
    x = rp.trends(series(spark, sf))
    return x.select("entity", "metric", "n_obs", rnd("first", 4).alias("first"), rnd("last", 4).alias("last"), "periods", F.coalesce("has_gap", F.lit(False)).alias("has_gap"), rnd("change", 4).alias("change"), rnd("change_pct").alias("change_pct"), rnd("cagr").alias("cagr"), "direction", "reads_well")


@register("side_by_side_best", f"""WITH {t.STATEMENTS}, c AS (SELECT fy AS metric, ticker, net_debt AS value, fy % 2 = 0 AS higher_is_better FROM statements), g AS (SELECT metric, count(value) AS n, min(value) AS lo, max(value) AS hi FROM c GROUP BY 1)
 SELECT metric, ticker, value, higher_is_better, coalesce(n >= 2 AND lo < hi AND value = CASE WHEN higher_is_better THEN hi ELSE lo END, false) AS best FROM c JOIN g USING (metric)""")
def side_by_side_best(spark, sf):
    c = t.statements(spark, sf).select(F.col("fy").alias("metric"), "ticker", F.col("net_debt").alias("value"), (F.col("fy") % 2 == 0).alias("higher_is_better"))
    return rp.best_marks(c).select("metric", "ticker", "value", "higher_is_better", "best")


@register("recommendation_totals", """WITH r AS (SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INT) AS y, count(*) FILTER (l_linenumber = 1) AS strong_buy, count(*) FILTER (l_linenumber = 2) AS buy, nullif(count(*) FILTER (l_linenumber = 3), 8) AS hold, count(*) FILTER (l_linenumber = 4) AS sell, count(*) FILTER (l_linenumber = 5) AS strong_sell FROM lineitem GROUP BY 1, 2)
 SELECT k, y, strong_buy + buy + hold + sell + strong_sell AS total, """ + r6("CASE WHEN strong_buy + buy + hold + sell + strong_sell IS NOT NULL THEN (strong_buy + buy) / nullif(strong_buy + buy + hold + sell + strong_sell, 0) END") + " AS bullish_share FROM r")
def recommendation_totals(spark, sf):
    li = t.read(spark, sf, "lineitem")
    n = lambda k: F.count_if(F.col("l_linenumber") == k)
    r = li.groupBy(F.col("l_suppkey").alias("k"), F.year("l_shipdate").alias("y")).agg(n(1).alias("strong_buy"), n(2).alias("buy"), F.nullif(n(3), F.lit(8)).alias("hold"), n(4).alias("sell"), n(5).alias("strong_sell"))
    return rp.recommendation_totals(r).select("k", "y", "total", rnd("bullish_share").alias("bullish_share"))


@register("basis_warning", f"""WITH {cs.PRICED}, b AS (SELECT unnest(['pe', 'ev']) AS basis, unnest([pe_vs_median, ev_vs_median]) AS v, rev_cagr FROM priced WHERE n_hist_years >= 3 AND pe_vs_median IS NOT NULL AND ev_vs_median IS NOT NULL), k AS (SELECT basis, {t.pctl_sql('v', 'basis')} AS rx, {t.pctl_sql('rev_cagr', 'basis')} AS ry FROM b WHERE rev_cagr IS NOT NULL)
 SELECT basis, count(*) AS n, {r6('avg(CASE WHEN v < 0 THEN 1 ELSE 0 END)')} AS share_negative, {r6('median(v)')} AS median, (SELECT {r6('corr(rx, ry)')} FROM k WHERE k.basis = b.basis) AS rho FROM b GROUP BY basis""")
def basis_warning(spark, sf):
    b = rp.basis_warning(cs.records(spark, sf))
    return b.select("basis", "n", *[rnd(c).alias(c) for c in ("share_negative", "median", "rho")])


# -- memo -----------------------------------------------------------------------------------------------

_CYC = "bucket_cyclical_turn"


@register("size_band", f"""WITH {cs.PRICED}, {cs.score_sql('quality_value')}, b AS (SELECT ticker, 100000.0::DOUBLE AS total, coverage < 0.9 AS thin, CAST(substr(ticker, 2) AS BIGINT) % 2 = 0 AS note, bucket_cyclical_turn AS cyc FROM scores JOIN priced USING (ticker)),
 f AS (SELECT *, total * 0.12::DOUBLE AS ceil, total * (1 - 0.20::DOUBLE) / 10 * (CASE WHEN thin THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN note THEN 1::DOUBLE ELSE 0.6 END * CASE WHEN cyc THEN 0.7::DOUBLE ELSE 1 END) AS x FROM b)
 SELECT ticker, round_even(least(x * 0.75::DOUBLE, ceil) / 100, 0) * 100 AS low, round_even(least(x * 1.25::DOUBLE, ceil) / 100, 0) * 100 AS high FROM f""")
def size_band(spark, sf):
    r = cs.records(spark, sf)
    s = sc.score_universe(r).select("ticker", "coverage").join(r.select("ticker", _CYC), "ticker")
    lo, hi, _ = rp.size_band(F.lit(100000.0), F.col("coverage") < 0.9, F.substring("ticker", 2, 10).cast("long") % 2 == 0, F.col(_CYC))
    return s.select("ticker", lo.alias("low"), hi.alias("high"))


NOTES_SQL = "notes AS (SELECT 'S' || s_suppkey AS ticker, CASE s_suppkey % 9 WHEN 0 THEN 'Pass' WHEN 3 THEN 'Watch closely' ELSE 'Buy in October' END AS action FROM supplier WHERE s_suppkey % 3 = 0), hd AS (SELECT 'S' || s_suppkey AS ticker FROM supplier WHERE s_suppkey % 10 = 3)"


@register("position_lists", f"""WITH {cs.PRICED}, {cs.score_sql('quality_value')}, {NOTES_SQL}, j AS (SELECT s.ticker, rs, CASE WHEN n.ticker IS NULL THEN 'unread' WHEN starts_with(lower(action), 'pass') THEN 'passed' WHEN starts_with(lower(action), 'watch') THEN 'watching' ELSE 'buy' END AS stance FROM scores s LEFT JOIN notes n USING (ticker) WHERE s.ticker NOT IN (SELECT ticker FROM hd)),
 k AS (SELECT *, CASE stance WHEN 'buy' THEN 'candidate' WHEN 'unread' THEN 'queue' ELSE 'declined' END AS list FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY rs DESC, ticker) AS rn FROM k)
 SELECT list, CAST(rn AS INT) AS rank, ticker, stance FROM r WHERE rn <= 12 OR list = 'declined'""")
def position_lists(spark, sf):
    s = sc.score_universe(cs.records(spark, sf)).select("ticker", F.round("score", 12).alias("score"))
    sup = t.read(spark, sf, "supplier")
    tk = F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker")
    notes = sup.where("s_suppkey % 3 = 0").select(tk, F.expr("CASE s_suppkey % 9 WHEN 0 THEN 'Pass' WHEN 3 THEN 'Watch closely' ELSE 'Buy in October' END").alias("action"))
    return rp.position_lists(s, notes, sup.where("s_suppkey % 10 = 3").select(tk)).select("list", "rank", "ticker", "stance")


@register("drivers_and_drags", f"""WITH {cs.PRICED}, {cs.score_sql('quality_value')}, c AS (SELECT ticker, key, coalesce(weight * z, 0) AS c FROM z), u AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(c, 12) DESC, key) AS rn FROM c WHERE c > 0.01), d AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(c, 12), key) AS rn FROM c WHERE c < -0.01)
 SELECT ticker, 'driver' AS side, CAST(rn AS INT) AS rank, key, {r6('c')} AS contribution FROM u WHERE rn <= 4 UNION ALL SELECT ticker, 'drag', CAST(rn AS INT), key, {r6('c')} FROM d WHERE rn <= 4""")
def drivers_and_drags(spark, sf):
    d = rp.drivers_and_drags(sc.component_z(cs.records(spark, sf), sc.components()))
    return d.withColumn("contribution", rnd("contribution"))


HOLD = f"""{t.COMPANIES}, hold AS (SELECT o_custkey AS portfolio, 'S' || (o_orderkey % (SELECT count(*) FROM supplier)) AS ticker, o_totalprice AS cost_usd, CASE WHEN o_orderkey % 5 = 0 THEN 'Cyclical turn' END AS bucket FROM orders), csh AS (SELECT c_custkey AS portfolio, abs(c_acctbal) * 20 AS cash_usd FROM customer)"""


@register("constraint_checks", f"""WITH {HOLD}, h AS (SELECT hold.*, coalesce(sector, 'unknown') AS sector FROM hold LEFT JOIN companies USING (ticker)), a AS (SELECT portfolio, count(*) AS n, sum(cost_usd) AS dep, max(cost_usd) AS big, sum(CASE WHEN bucket IS NOT NULL THEN cost_usd ELSE 0 END) AS cyc FROM h GROUP BY 1),
 s AS (SELECT portfolio, max(v) AS sec FROM (SELECT portfolio, sector, sum(cost_usd) AS v FROM h GROUP BY 1, 2) GROUP BY 1), j AS (SELECT c.portfolio, coalesce(n, 0) AS n, coalesce(dep, 0) AS dep, coalesce(big, 0) AS big, coalesce(cyc, 0) AS cyc, coalesce(sec, 0) AS sec, coalesce(nullif(cash_usd + coalesce(dep, 0), 0), 1) AS tot, cash_usd FROM csh c LEFT JOIN a USING (portfolio) LEFT JOIN s USING (portfolio)),
 r AS (SELECT portfolio, 'names' AS rule, n BETWEEN 8 AND 12 AS ok, CAST(n AS DOUBLE) AS v FROM j UNION ALL SELECT portfolio, 'cash', cash_usd / tot BETWEEN 0.2 AND 0.3, cash_usd / tot FROM j UNION ALL SELECT portfolio, 'sector', sec / tot <= 0.3, sec / tot FROM j UNION ALL SELECT portfolio, 'position', big / tot <= 0.12, big / tot FROM j
  UNION ALL SELECT portfolio, 'cyclical', cyc / coalesce(nullif(dep, 0), 1) <= 0.3, cyc / coalesce(nullif(dep, 0), 1) FROM j) SELECT portfolio, rule, CASE WHEN ok THEN 'ok' ELSE 'not met' END AS status, {r6('v')} AS value FROM r""")
def constraint_checks(spark, sf):
    n = t.read(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    h = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("portfolio"), F.concat(F.lit("S"), F.col("o_orderkey") % n).alias("ticker"), F.col("o_totalprice").alias("cost_usd"),
                                                                         F.when(F.col("o_orderkey") % 5 == 0, "Cyclical turn").alias("bucket"))
    c = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("portfolio"), (F.abs("c_acctbal") * 20).alias("cash_usd"))
    return rp.constraint_checks(h, c, t.companies(spark, sf).select("ticker", "sector")).withColumn("value", rnd("value"))


# -- positions --------------------------------------------------------------------------------------------

POS = f"""{t.DAILY}, {t.CALLS}, {t.bench_sql('daily')}, pos AS (SELECT pos, ticker, date AS bought, CAST(1 + pos % 9 AS DOUBLE) AS shares, price_at_call AS cost, CASE WHEN pos % 7 = 0 THEN 'CAD' ELSE 'USD' END AS ccy, stop FROM calls WHERE price_at_call IS NOT NULL AND date <= DATE '{desk.AS_OF}')"""


def positions(spark, sf):
    c = t.calls(spark, sf).where(F.col("price_at_call").isNotNull() & (F.col("date") <= desk.AS_OF))
    return c.select("pos", "ticker", F.col("date").alias("bought"), (1.0 + F.col("pos") % 9).alias("shares"), F.col("price_at_call").alias("cost_per_share"), F.when(F.col("pos") % 7 == 0, "CAD").otherwise("USD").alias("currency"), "stop")


@register("mark_positions", f"""WITH {POS}, l AS (SELECT ticker, arg_max(close, session) AS last FROM daily WHERE session <= DATE '{desk.AS_OF}' GROUP BY 1), b1 AS (SELECT arg_max(bench, session) AS b1 FROM bench WHERE session <= DATE '{desk.AS_OF}'), p AS (SELECT pos.*, b.bench AS b0 FROM pos ASOF LEFT JOIN bench b ON pos.bought >= b.session),
 lo AS (SELECT pos, min(d.close) AS low FROM pos JOIN daily d ON d.ticker = pos.ticker AND d.session > bought AND d.session <= DATE '{desk.AS_OF}' GROUP BY 1)
 SELECT p.pos, p.ticker, last, {r6("last * shares * CASE WHEN ccy = 'CAD' THEN 1.0::DOUBLE / 1.37::DOUBLE ELSE 1 END", 4)} AS value_usd, {r6('last / cost - 1')} AS ret, {r6('b1 / b0 - 1')} AS bench_ret, low < stop AS stop_breached FROM p LEFT JOIN l USING (ticker) LEFT JOIN lo ON lo.pos = p.pos, b1""")
def mark_positions(spark, sf):
    d = t.daily(spark, sf)
    m = rp.mark_positions(positions(spark, sf), d, t.benchmark(d), desk.AS_OF, 1.37)
    return m.select("pos", "ticker", "last", rnd("value_usd", 4).alias("value_usd"), rnd("ret").alias("ret"), rnd("bench_ret").alias("bench_ret"), "stop_breached")


@register("running_lows", f"""WITH {POS}, j AS (SELECT pos.pos, session, close, stop, min(close) OVER (PARTITION BY pos.pos ORDER BY session) AS low FROM pos JOIN daily d ON d.ticker = pos.ticker AND d.session >= bought)
 SELECT pos, count(*) AS sessions, min(low) AS final_low, count(*) FILTER (low < stop) AS breached_sessions FROM j GROUP BY 1""")
def running_lows(spark, sf):
    r = rp.running_lows(positions(spark, sf), t.daily(spark, sf))
    return r.groupBy("pos").agg(F.count(F.lit(1)).alias("sessions"), F.min("low_so_far").alias("final_low"), F.count_if("breached").alias("breached_sessions"))


@register("position_lows", f"""WITH {POS}, j AS (SELECT pos.pos, session, close, stop FROM pos JOIN daily d ON d.ticker = pos.ticker AND d.session >= bought AND d.close IS NOT NULL)
 SELECT pos.pos, any_value(pos.ticker) AS ticker, min(close) AS low, count(*) FILTER (close < j.stop) > 0 AS breached, min(session) FILTER (close < j.stop) AS breached_on FROM pos LEFT JOIN j ON j.pos = pos.pos GROUP BY 1""")
def position_lows(spark, sf):
    return rp.position_lows(positions(spark, sf), t.daily(spark, sf))


SER = f"""{POS}, hv AS (SELECT session, sum(close * shares * CASE WHEN ccy = 'CAD' THEN 1.0::DOUBLE / 1.37::DOUBLE ELSE 1 END) AS h FROM pos JOIN daily d ON d.ticker = pos.ticker AND d.session >= bought GROUP BY 1), led AS (SELECT CAST(o_orderdate AS DATE) AS session, max(o_totalprice) AS balance FROM orders GROUP BY 1),
 ser AS (SELECT b.session, coalesce(h, 0) AS h, coalesce(l.balance, 100000) AS c, bench / (SELECT arg_min(bench, session) FROM bench) * 100000 AS bi FROM bench b ASOF LEFT JOIN led l ON b.session >= l.session LEFT JOIN hv ON hv.session = b.session)"""


def book(spark, sf):
    d = t.daily(spark, sf)
    led = t.read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("session")).agg(F.max("o_totalprice").alias("balance"))
    return rp.portfolio_series(positions(spark, sf), d, led, t.benchmark(d), 1.37)


@register("portfolio_series", f"WITH {SER} SELECT session, {r6('h', 2)} AS holdings_usd, {r6('c', 2)} AS cash_usd, {r6('h + c', 2)} AS total_usd, {r6('bi', 4)} AS bench_indexed FROM ser")
def portfolio_series(spark, sf):
    return book(spark, sf).select("session", *[rnd(c, 2).alias(c) for c in ("holdings_usd", "cash_usd", "total_usd")], rnd("bench_indexed", 4).alias("bench_indexed"))


@register("portfolio_scorecard", f"WITH {SER} SELECT {r6('arg_max(h + c, session) / arg_min(h + c, session) - 1')} AS portfolio_return, {r6('arg_max(bi, session) / arg_min(bi, session) - 1')} AS bench_return FROM ser")
def portfolio_scorecard(spark, sf):
    return rp.scorecard(book(spark, sf)).select(rnd("portfolio_return").alias("portfolio_return"), rnd("bench_return").alias("bench_return"))


# -- digest -------------------------------------------------------------------------------------------------

@register("benchmark_summary", f"""WITH {t.DAILY}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY session DESC) AS rn FROM daily WHERE session <= DATE '{desk.AS_OF}'), a AS (SELECT ticker, max(close) FILTER (rn = 1) AS l, max(session) AS d, max(close) FILTER (rn = 2) AS p1, max(close) FILTER (rn = 6) AS p5 FROM o GROUP BY 1),
 y AS (SELECT a.ticker, arg_max(o.close, o.session) AS yc FROM a JOIN o ON o.ticker = a.ticker AND year(o.session) < year(a.d) GROUP BY 1) SELECT ticker, l AS last_close, d AS last_date, {r6('l / p1 - 1')} AS chg_1d, {r6('l / p5 - 1')} AS chg_5d, {r6('l / yc - 1')} AS ytd FROM a LEFT JOIN y USING (ticker)""")
def benchmark_summary(spark, sf):
    b = rp.benchmark_summary(t.daily(spark, sf), desk.AS_OF)
    return b.select("ticker", "last_close", "last_date", *[rnd(c).alias(c) for c in ("chg_1d", "chg_5d", "ytd")])


@register("day_movers", f"WITH {desk.READS}, m AS (SELECT ticker, chg_1d FROM reads WHERE chg_1d IS NOT NULL) SELECT * FROM ((SELECT 'up' AS side, ticker, {r6('chg_1d')} AS chg_1d FROM m WHERE m.chg_1d >= 0.02 ORDER BY m.chg_1d DESC, ticker LIMIT 2) UNION ALL (SELECT 'down', ticker, {r6('chg_1d')} FROM m WHERE m.chg_1d <= -0.02 ORDER BY m.chg_1d, ticker LIMIT 2))")
def day_movers(spark, sf):
    return rp.day_movers(desk.reads(spark, sf)).withColumn("chg_1d", rnd("chg_1d"))


@register("upcoming_events", "SELECT o_orderkey AS id, 'C' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, o_custkey % 4 = 0 AS watched FROM orders WHERE date_diff('day', DATE '2000-06-30', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 14")
def upcoming_events(spark, sf):
    e = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"))
    w = t.read(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("ticker"))
    return rp.upcoming(e, w, "2000-06-30")


@register("upcoming_events_digest", """WITH e AS (SELECT o_orderkey AS id, 'C' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, o_custkey % 4 = 0 AS watched FROM orders WHERE date_diff('day', DATE '2000-06-30', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 8)
 SELECT id, ticker, date, watched, CAST(row_number() OVER (ORDER BY watched DESC, date, ticker, id) AS INT) AS place FROM e""")
def upcoming_events_digest(spark, sf):
    e = t.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"))
    w = t.read(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("ticker"))
    return rp.upcoming_digest(e, w, "2000-06-30")


@register("capped_headlines", "WITH h AS (SELECT 'U' || user_id AS ticker, ts AS published, event_id AS guid FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published DESC, guid) AS rn FROM h), l AS (SELECT *, row_number() OVER (ORDER BY ticker, published DESC, guid) AS rank FROM k WHERE rn <= 3) SELECT ticker, guid, CAST(rank AS INT) AS rank FROM l WHERE rank <= 40")
def capped_headlines(spark, sf):
    h = t.read(spark, sf, "events").select(F.concat(F.lit("U"), "user_id").alias("ticker"), F.col("ts").alias("published"), F.col("event_id").alias("guid"))
    return rp.capped_headlines(h, 3, 40).select("ticker", "guid", "rank")


@register("digest_rows", f"WITH {desk.ALERTS}, c AS (SELECT n.ticker, n.held, CAST(coalesce(max(severity), 0) AS INT) AS max_severity FROM names n LEFT JOIN al ON al.ticker = n.ticker GROUP BY 1, 2) SELECT ticker, held, max_severity, CAST(row_number() OVER (ORDER BY max_severity DESC, held DESC, ticker) AS INT) AS place FROM c")
def digest_rows(spark, sf):
    from panelspark.plans import watch as wa
    r = desk.reads(spark, sf)
    return rp.digest_rows(wa.scan_counts(r, wa.price_alerts(r))).select("ticker", "held", "max_severity", "place")


@register("facet_search", f"WITH {cs.SCREEN} SELECT ticker, sector, industry, quality_score FROM scored WHERE contains(lower(concat_ws(' ', ticker, name, sector, industry)), 'steel')")
def facet_search(spark, sf):
    return rp.search_index(cs.screen(spark, sf), "Steel", "quality_score", True).select("ticker", "sector", "industry", "quality_score")


_ASKED = (("st", None), ("Steel", "full"), ("tech", "screen"))
_DEPTH = "CASE WHEN quality_score >= 50 THEN 'full' ELSE 'screen' END"


@register("facet_search_indexed", f"WITH {cs.SCREEN}, d AS (SELECT *, {_DEPTH} AS depth, lower(concat_ws(' ', ticker, name, sector, industry)) AS hay FROM scored) " + " UNION ALL ".join(
    f"SELECT '{q}' AS asked, ticker, depth, quality_score FROM d WHERE contains(hay, '{q.lower()}')" + (f" AND depth = '{x}'" if x else "") for q, x in _ASKED))
def facet_search_indexed(spark, sf):
    root = scratch_path(spark, "search")
    se.write_index(cs.screen(spark, sf).select("ticker", "name", "sector", "industry", "quality_score", F.expr(_DEPTH).alias("depth")), root)
    found = [se.search(spark, root, q, x).select(F.lit(q).alias("asked"), "ticker", "depth", "quality_score") for q, x in _ASKED]
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("company_record", f"""WITH {cs.PRICED}, {cs.PEERS}, tr AS (SELECT ticker, count(DISTINCT m) AS n FROM (SELECT ticker, unnest(['revenue', 'gross_margin', 'net_debt', 'shares']) AS m FROM statements) GROUP BY 1)
 SELECT p.ticker, p.name, {r6('roic_avg')} AS roic_avg, {r6('forward_pe')} AS forward_pe, {r6('quality_rank - price_rank')} AS peer_gap, {r6('CASE WHEN rev_up IS NOT NULL OR rev_down IS NOT NULL THEN coalesce(rev_up, 0) - coalesce(rev_down, 0) END')} AS net_revisions, tr.n AS n_trends,
 concat_ws(',', {", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in ("roic_avg", "fcf_margin_avg", "rev_cagr", "nd_to_ebitda", "share_change", "gm_avg", "forward_pe", "ev_ebitda", "pe_vs_median", "ev_vs_median", "dd_52w", "dd_ath"))}) AS gaps,
 concat_ws(',', CASE WHEN bucket_compounder THEN 'compounder' END, CASE WHEN bucket_cyclical_turn THEN 'cyclical turn' END) AS buckets FROM priced p LEFT JOIN pg USING (ticker) LEFT JOIN tr USING (ticker)""")
def company_record(spark, sf):
    from panelspark.plans.peers import peer_valuation
    r = cs.records(spark, sf)
    c = rp.company_record(r, rp.trends(series(spark, sf)), peer_valuation(r))
    return c.select("ticker", "identity.name", rnd("fundamentals.roic_avg").alias("roic_avg"), rnd("valuation.forward_pe").alias("forward_pe"), rnd("peers.peer_gap").alias("peer_gap"), rnd("net_revisions").alias("net_revisions"),
                    F.size("trends").cast("long").alias("n_trends"), F.array_join("gaps", ",").alias("gaps"), F.array_join("buckets", ",").alias("buckets"))


# -- snapshots ------------------------------------------------------------------------------------------------

PRES = "pres AS (SELECT DISTINCT CAST(date_trunc('year', l_shipdate) AS DATE) AS snapshot, 'P' || l_partkey || '-' || l_linenumber AS ticker FROM lineitem)"


@register("snapshot_movements", f"""WITH {PRES}, d AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS i FROM (SELECT DISTINCT snapshot FROM pres)), p AS (SELECT ticker, i FROM pres JOIN d USING (snapshot)), n AS (SELECT max(i) AS n FROM d),
 e AS (SELECT ticker, min(i) AS i FROM p WHERE i > 1 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.ticker = p.ticker AND q.i = p.i - 1) GROUP BY 1), l AS (SELECT ticker, min(i) + 1 AS i FROM p, n WHERE i < n AND NOT EXISTS (SELECT 1 FROM p q WHERE q.ticker = p.ticker AND q.i = p.i + 1) GROUP BY 1)
 SELECT x.ticker, a.snapshot AS entered, b.snapshot AS left_on FROM (SELECT DISTINCT ticker FROM pres) x LEFT JOIN e USING (ticker) LEFT JOIN d a ON a.i = e.i LEFT JOIN l ON l.ticker = x.ticker LEFT JOIN d b ON b.i = l.i""")
def snapshot_movements(spark, sf):
    p = t.read(spark, sf, "lineitem").select(F.to_date(F.date_trunc("year", "l_shipdate")).alias("snapshot"), F.concat(F.lit("P"), "l_partkey", F.lit("-"), "l_linenumber").alias("ticker"))
    return rp.snapshot_movements(p)


@register("snapshot_backtest_panel", f"""WITH {t.DAILY}, probes AS (SELECT row_number() OVER () AS id, ticker, date FROM (SELECT ticker, CAST(date_trunc('quarter', session) AS DATE) AS date FROM daily GROUP BY 1, 2)), {fwd_ctes('truncate', 'daily')}
 SELECT status, count(*) AS n, {r6("avg(CASE status WHEN 'ok' THEN fill / bpx - 1 WHEN 'truncated' THEN last_close / bpx - 1 END)")} AS mean_ret FROM s GROUP BY 1""")
def snapshot_backtest_panel(spark, sf):
    s = desk.snapshots(spark, sf).withColumnRenamed("score_percentile", "score")
    b = cut_lineage(rp.backtest_from_snapshots(s, t.daily(spark, sf), 63))
    return b.groupBy("status").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("fwd_ret")).alias("mean_ret"))


