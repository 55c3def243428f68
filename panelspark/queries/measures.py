"""Backtest measures and as-reported fundamentals over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelspark.operators import resample
from panelspark.plans import backtest as bt
from panelspark.plans import facts as fx
from panelspark.plans import score as sc
from panelspark.queries import crosssection as cs
from panelspark.queries import r6, register, rnd
from panelspark.queries import tables as t
from panelspark.queries.core import block_sql

RK = f"""{t.REBALANCES}, have AS (SELECT * FROM rebalances WHERE score IS NOT NULL AND fwd_ret IS NOT NULL),
 rk AS (SELECT *, {t.pctl_sql('score', 'date')} AS p, {t.pctl_sql('fwd_ret', 'date')} AS q, count(*) OVER (PARTITION BY date) AS nn FROM have)"""
IC = "ic AS (SELECT date, any_value(nn) AS n, CASE WHEN any_value(nn) >= 20 AND min(p) <> max(p) AND min(q) <> max(q) THEN corr(p, q) END AS ic FROM rk GROUP BY date)"


def rk(spark, sf):
    return bt.ranked(t.rebalances(spark, sf))


@register("missing_return_census", f"WITH {t.REBALANCES} SELECT date, count(score) AS n_scored, count(*) FILTER (fwd_ret IS NULL AND score IS NOT NULL) AS n_missing FROM rebalances GROUP BY 1")
def missing_census(spark, sf):
    return bt.missing_census(t.rebalances(spark, sf))


@register("missing_return_names", f"WITH {t.REBALANCES} SELECT date, ticker, score FROM rebalances WHERE fwd_ret IS NULL AND score IS NOT NULL")
def missing_names(spark, sf):
    return bt.missing_names(t.rebalances(spark, sf))


@register("score_quintiles", f"""WITH {RK} SELECT CAST(least(floor(p * 5), 4) AS INT) AS bucket, count(*) AS n, count(DISTINCT date) AS n_dates, {r6('avg(fwd_ret)')} AS mean_ret,
 {r6('median(fwd_ret)')} AS median_ret, {r6('stddev_samp(fwd_ret)')} AS sd, {r6('count(*) FILTER (fwd_ret > 0) / count(*)')} AS hit_rate FROM rk WHERE nn >= 20 GROUP BY 1""")
def score_quintiles(spark, sf):
    q = bt.quintiles(rk(spark, sf))
    return q.select("bucket", "n", "n_dates", *[rnd(c).alias(c) for c in ("mean_ret", "median_ret", "sd", "hit_rate")])


SPREAD = "sp AS (SELECT date, avg(fwd_ret) FILTER (p >= 0.8) - avg(fwd_ret) FILTER (p < 0.2) AS spread FROM rk WHERE nn >= 20 GROUP BY date)"


@register("long_short_spread", f"WITH {RK}, {SPREAD} SELECT date, {r6('spread')} AS spread FROM sp")
def long_short_spread(spark, sf):
    return bt.spread_series(rk(spark, sf)).select("date", rnd("spread").alias("spread"))


def group_sql(group: str) -> str:
    return f"""g AS (SELECT {group} AS grp, p, q FROM rk WHERE nn >= 20), gk AS (SELECT grp, {t.pctl_sql('p', 'grp')} AS rx, {t.pctl_sql('q', 'grp')} AS ry FROM g WHERE grp IS NOT NULL)
 SELECT grp, count(*) AS n, CASE WHEN count(*) >= 3 THEN {r6('corr(rx, ry)')} END AS rho FROM gk GROUP BY grp"""


@register("ic_by_sector", f"WITH {RK}, {group_sql('sector')}")
def ic_by_sector(spark, sf):
    return bt.group_ic(rk(spark, sf), F.col("sector")).select("grp", "n", rnd("rho").alias("rho"))


EACH_BUCKET = "unnest(CASE WHEN len(buckets) > 0 THEN buckets ELSE ['unbucketed'] END)"


@register("ic_by_bucket", f"WITH {RK}, {group_sql(EACH_BUCKET)}")
def ic_by_bucket(spark, sf):
    return bt.group_ic(rk(spark, sf), bt.bucket_labels()).select("grp", "n", rnd("rho").alias("rho"))


@register("worst_ic_dates", f"WITH {RK}, {IC} SELECT date, n, {r6('ic')} AS ic FROM ic WHERE ic IS NOT NULL ORDER BY ic.ic, date LIMIT 5")
def worst_ic_dates(spark, sf):
    return bt.worst_dates(bt.ic_series(rk(spark, sf))).select("date", "n", rnd("ic").alias("ic"))


_NEED = bt.NEEDED_SIGMAS
BACKTEST = f"""WITH {RK}, {IC}, {SPREAD}, ick AS (SELECT 1 AS k, * FROM ic), spk AS (SELECT 1 AS k, * FROM sp), {block_sql('ick', 'k', 'date', 'ic', '2', out='ci')}, {block_sql('spk', 'k', 'date', 'spread', '2', seed=resample.SEED + 1, out='sc')},
 a AS (SELECT count(*) AS n_rebalances, count(ic) AS n_scored, count(ic) / 2.0::DOUBLE AS effective_n, avg(ic) AS mean_ic, median(ic) AS median_ic, stddev_samp(ic) AS ic_sd, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS ic_t,
   count(*) FILTER (ic > 0) / count(ic) AS hit_rate, min(n) AS min_names FROM ic),
 b AS (SELECT a.*, ic_t / sqrt(2.0::DOUBLE) AS effective_t, ci.ci_low, ci.ci_high, sc.ci_low AS spread_low, sc.ci_high AS spread_high,
   (SELECT avg(fwd_ret) FILTER (p >= 0.8) - avg(fwd_ret) FILTER (p < 0.2) FROM rk WHERE nn >= 20) AS long_short FROM a, ci, sc)
 SELECT n_rebalances, n_scored, {r6('effective_n')} AS effective_n, {r6('mean_ic')} AS mean_ic, {r6('median_ic')} AS median_ic, {r6('ic_sd')} AS ic_sd, {r6('ic_t')} AS ic_t, {r6('effective_t')} AS effective_t, {r6('hit_rate')} AS hit_rate,
 {r6('ci_low')} AS ci_low, {r6('ci_high')} AS ci_high, {r6('long_short')} AS long_short, {r6('spread_low')} AS spread_low, {r6('spread_high')} AS spread_high,
 CASE WHEN ci_low <= 0 AND ci_high >= 0 THEN 'no evidence' WHEN effective_n < 12 THEN 'weak' WHEN effective_n < 20 THEN 'suggestive' WHEN abs(effective_t) < {1.96 + 0.5 * math.log(3)} THEN 'suggestive' ELSE 'supported' END AS verdict,
 {r6(f'{_NEED}::DOUBLE / sqrt(n_scored * (min_names - 1))')} AS detectable_ic,
 concat_ws('; ', CASE WHEN abs(mean_ic) > 0.25 THEN 'suspiciously large mean IC' END, CASE WHEN n_scored < 3 THEN 'fewer than three scored rebalances' END, CASE WHEN min_names < 20 THEN 'a date had too few names and was skipped' END) AS flags FROM b"""


@register("backtest_summary", BACKTEST)
def backtest_summary(spark, sf):
    s = bt.summary(t.rebalances(spark, sf), 42, 21, k=3, limitations=["made from order lines, not from a market"])
    nums = ["effective_n", "mean_ic", "median_ic", "ic_sd", "ic_t", "effective_t", "hit_rate", "ci_low", "ci_high", "long_short", "spread_low", "spread_high", "detectable_ic"]
    return s.select("n_rebalances", "n_scored", *[rnd(c).alias(c) for c in nums], "verdict", F.array_join("flags", "; ").alias("flags"))


@register("backtest_failure_modes", f"""WITH {RK}, {IC}, by_sector AS (WITH {group_sql('sector')}), by_bucket AS (WITH {group_sql(EACH_BUCKET)}), fifth AS (SELECT CAST(least(floor(p * 5), 4) AS INT) AS b, avg(fwd_ret) AS m FROM rk WHERE nn >= 20 GROUP BY 1)
 SELECT 'negative sector' AS kind, grp AS what, rho AS value FROM by_sector WHERE rho < 0 AND n >= 30 UNION ALL SELECT 'negative bucket', grp, rho FROM by_bucket WHERE rho < 0 AND n >= 30
 UNION ALL SELECT * FROM (SELECT 'worst date', CAST(date AS VARCHAR), {r6('ic')} FROM ic WHERE ic IS NOT NULL ORDER BY ic.ic, date LIMIT 3)
 UNION ALL SELECT 'not monotonic', 'Q' || (x.b + 1), {r6('y.m - x.m')} FROM fifth x JOIN fifth y ON y.b = x.b + 1 WHERE y.m < x.m
 UNION ALL SELECT 'top did not beat bottom', 'Q5-Q1', {r6('y.m - x.m')} FROM fifth x JOIN fifth y ON x.b = 0 AND y.b = 4 WHERE y.m <= x.m""")
def backtest_failure_modes(spark, sf):
    r = rk(spark, sf)
    return bt.failure_modes(r, bt.ic_series(r)).select("kind", "what", rnd("value").alias("value"))


@register("detectable_effect", f"""WITH {RK}, {IC} SELECT date, n, {r6(f'{_NEED}::DOUBLE / sqrt(12 * (n - 1))')} AS detectable_12, CASE WHEN ceil(pow({_NEED / 0.04}::DOUBLE, 2) / (n - 1)) <= 200 THEN CAST(ceil(pow({_NEED / 0.04}::DOUBLE, 2) / (n - 1)) AS INT) END AS periods_for_004 FROM ic WHERE n >= 3""")
def detectable_effect(spark, sf):
    ic = bt.ic_series(rk(spark, sf)).where("n >= 3")
    return ic.select("date", "n", rnd(bt.detectable(F.col("n"), F.lit(12))).alias("detectable_12"), bt.periods_needed(0.04, F.col("n")).alias("periods_for_004"))


# -- facts ----------------------------------------------------------------------------------------

def gaap(spark, sf):
    return t.facts(spark, sf).withColumn("taxonomy", F.lit("us-gaap"))


@register("fact_scan_filters", """WITH num AS (SELECT l_orderkey AS adsh, l_returnflag AS tag, CASE WHEN l_linestatus = 'O' AND l_linenumber = 2 THEN 'SubCo' END AS coreg,
 CASE WHEN l_linenumber = 5 THEN '0x1f' WHEN l_linenumber = 4 THEN '0x00000000' END AS dimh, CASE WHEN l_linenumber <> 6 THEN l_extendedprice END AS value FROM lineitem)
 SELECT o_custkey AS cik, tag, count(*) AS n, max(value) AS top FROM num JOIN orders ON adsh = o_orderkey WHERE coalesce(coreg, '') = '' AND coalesce(dimh, '') IN ('', '0x00000000') AND value IS NOT NULL AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1, 2""")
def fact_scan_filters(spark, sf):
    li, o = t.read(spark, sf, "lineitem"), t.read(spark, sf, "orders")
    num = li.select(F.col("l_orderkey").alias("adsh"), F.col("l_returnflag").alias("tag"),
                    F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 2), "SubCo").alias("coreg"),
                    F.when(F.col("l_linenumber") == 5, "0x1f").when(F.col("l_linenumber") == 4, "0x00000000").alias("dimh"),
                    F.when(F.col("l_linenumber") != 6, F.col("l_extendedprice")).alias("value"), F.to_date("l_shipdate").alias("ddate"), F.lit(4).alias("qtrs"))
    sub = o.select(F.col("o_orderkey").alias("adsh"), F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("filed"), F.col("o_orderpriority").alias("form"))
    return fx.clean_facts(num, sub, ("1-URGENT", "5-LOW")).groupBy("cik", "tag").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@register("submission_merge", """WITH s AS (SELECT o_orderkey // 2 AS adsh, strftime(o_orderdate, '%Y-%m') || o_orderkey AS quarter, o_custkey AS cik FROM orders) SELECT adsh, arg_max(cik, quarter) AS cik FROM s GROUP BY 1""")
def submission_merge(spark, sf):
    s = t.read(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("adsh"), F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderkey")).alias("quarter"), F.col("o_custkey").alias("cik"))
    return fx.merge_submissions(s)


@register("ticker_id_fallback", """WITH n AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 's' || s_suppkey || '.to' WHEN 1 THEN 'S' || s_suppkey || '.B' WHEN 2 THEN 'S' || s_suppkey || '-C' ELSE 'S' || s_suppkey END AS ticker FROM supplier),
 ids AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'S' || s_suppkey WHEN 1 THEN 'S' || s_suppkey || '-B' WHEN 2 THEN 'S' || s_suppkey || '.C' ELSE 'X' || s_suppkey END AS t, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier)
 SELECT ticker, coalesce(a.cik, b.cik, c.cik, d.cik) AS cik FROM n LEFT JOIN ids a ON a.t = upper(ticker) LEFT JOIN ids b ON b.t = replace(upper(ticker), '.', '-') LEFT JOIN ids c ON c.t = replace(upper(ticker), '-', '.') LEFT JOIN ids d ON d.t = split_part(upper(ticker), '.', 1)""")
def ticker_id_fallback(spark, sf):
    s = t.read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    names = s.select(F.expr("CASE s_suppkey % 4 WHEN 0 THEN 's' || s_suppkey || '.to' WHEN 1 THEN 'S' || s_suppkey || '.B' WHEN 2 THEN 'S' || s_suppkey || '-C' ELSE 'S' || s_suppkey END").alias("ticker"))
    ids = s.select(F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'S' || s_suppkey WHEN 1 THEN 'S' || s_suppkey || '-B' WHEN 2 THEN 'S' || s_suppkey || '.C' ELSE 'X' || s_suppkey END").alias("ticker"),
                   F.lpad(F.regexp_replace(k.cast("string"), "\\D", ""), 10, "0").alias("cik"))
    return fx.resolve_ids(names, ids)


PREF = "pref(metric, tag, prio) AS (VALUES " + ", ".join(f"('{m}', '{tag}', {i})" for m, tags in fx.GAAP_TAGS.items() for i, tag in enumerate(tags)) + ")"
MF = f"{t.FACTS}, {PREF}, tg AS (SELECT f.*, metric, prio FROM facts f JOIN pref USING (tag)), mf AS (SELECT tg.* FROM tg JOIN (SELECT cik, metric, min(prio) AS prio FROM tg GROUP BY 1, 2) b USING (cik, metric, prio))"


@register("tag_preference", f"WITH {MF} SELECT cik, metric, any_value(tag) AS tag, count(*) AS n, max(value) AS top FROM mf GROUP BY 1, 2")
def tag_preference(spark, sf):
    m = fx.metric_facts(gaap(spark, sf))
    return m.groupBy("cik", "metric").agg(F.min("tag").alias("tag"), F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@register("annual_series_first_reported", f"WITH {t.FACTS}, f AS (SELECT *, row_number() OVER (PARTITION BY cik, tag, ddate ORDER BY filed, adsh, value) AS rn FROM facts WHERE qtrs = 4) SELECT cik, tag, ddate, value, filed, adsh FROM f WHERE rn = 1")
def annual_first(spark, sf):
    return fx.annual_series(t.facts(spark, sf))


@register("annual_series_as_known", f"WITH {t.FACTS}, f AS (SELECT *, row_number() OVER (PARTITION BY cik, tag, ddate ORDER BY filed DESC, adsh DESC, value DESC) AS rn FROM facts WHERE qtrs = 4 AND filed <= DATE '1999-12-31') SELECT cik, tag, ddate, value, filed, adsh FROM f WHERE rn = 1")
def annual_known(spark, sf):
    return fx.annual_series(t.facts(spark, sf), "1999-12-31")


QS = f"""WITH {t.FACTS}, fl AS (SELECT cik, 'L' AS tag, ddate, CASE WHEN qtrs = 0 THEN 1 ELSE qtrs END AS qtrs, value, filed, adsh FROM facts),
 j AS (SELECT a.cik, a.tag, a.ddate, a.value AS av, a.filed, a.adsh, b.value AS bv, row_number() OVER (PARTITION BY a.cik, a.tag, a.ddate, a.value, a.filed, a.adsh ORDER BY b.filed DESC, b.adsh DESC, b.ddate DESC, b.value DESC) AS rn
  FROM fl a JOIN fl b ON a.cik = b.cik AND a.tag = b.tag AND a.qtrs = 4 AND b.qtrs = 3 AND date_diff('day', b.ddate, a.ddate) BETWEEN 75 AND 100 AND b.filed <= a.filed
  WHERE NOT EXISTS (SELECT 1 FROM fl r WHERE r.cik = a.cik AND r.tag = a.tag AND r.qtrs = 1 AND r.ddate = a.ddate)),
 q AS (SELECT cik, tag, ddate, value, filed, adsh, false AS derived FROM fl WHERE qtrs = 1 UNION ALL SELECT cik, tag, ddate, av - bv, filed, adsh, true FROM j WHERE rn = 1),
 p AS (SELECT *, row_number() OVER (PARTITION BY cik, tag, ddate ORDER BY filed, adsh, value) AS rn FROM q)
 SELECT cik, tag, ddate, {r6('value', 2)} AS value, filed, adsh, derived FROM p WHERE rn = 1"""


@register("quarterly_series_with_derived", QS)
def quarterly_series(spark, sf):
    f = t.facts(spark, sf).withColumn("tag", F.lit("L")).withColumn("qtrs", F.when(F.col("qtrs") == 0, 1).otherwise(F.col("qtrs")))
    return fx.quarterly_series(f).withColumn("value", rnd("value", 2)).select("cik", "tag", "ddate", "value", "filed", "adsh", "derived")


_LINES = ("revenue", "operating_income", "net_income")
FY = f"""{MF}, en AS (SELECT cik, year(ddate) AS fy, max(ddate) AS ddate FROM mf WHERE metric = 'revenue' AND qtrs = 4 AND filed <= DATE '2000-06-30' GROUP BY 1, 2),
 en2 AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY fy DESC) AS rn FROM en),
 kn AS (SELECT m.cik, e.fy, m.ddate, metric, value, filed, adsh, row_number() OVER (PARTITION BY m.cik, m.ddate, metric ORDER BY filed DESC, adsh DESC, value DESC) AS rn FROM mf m JOIN en2 e ON e.cik = m.cik AND e.ddate = m.ddate
   WHERE e.rn <= 10 AND filed <= DATE '2000-06-30' AND qtrs = CASE WHEN metric IN {fx.INSTANTS} THEN 0 ELSE 4 END AND metric IN {fx.YEAR_LINES}),
 fy AS (SELECT cik, CAST(fy AS INT) AS fy, ddate AS end_date, max(filed) AS filed, {", ".join(f"max(value) FILTER (metric = '{m}') AS {m}" for m in _LINES)} FROM kn WHERE rn = 1 GROUP BY 1, 2, 3)"""


@register("fiscal_year_pivot", f"WITH {FY} SELECT cik, fy, end_date, filed, {', '.join(_LINES)} FROM fy WHERE revenue IS NOT NULL")
def fiscal_year_pivot(spark, sf):
    return fx.fiscal_years(gaap(spark, sf), "2000-06-30").select("cik", "fy", "end_date", "filed", *_LINES)


@register("reported_aggregates", f"""WITH {FY}, a AS (SELECT cik, count(*) AS n_years, arg_min(revenue, fy) AS r0, arg_max(revenue, fy) AS r1, max(fy) - min(fy) AS span FROM fy WHERE revenue IS NOT NULL GROUP BY 1)
 SELECT cik, n_years, CASE WHEN r0 > 0 AND r1 > 0 AND span > 0 THEN {r6('pow(r1 / r0, 1.0::DOUBLE / span) - 1')} END AS rev_cagr, false AS net_cash FROM a""")
def reported_aggregates(spark, sf):
    a = fx.reported_aggregates(fx.fiscal_years(gaap(spark, sf), "2000-06-30"))
    return a.select("cik", "n_years", rnd("rev_cagr").alias("rev_cagr"), "net_cash")


@register("margin_table", f"WITH {t.STATEMENTS} SELECT ticker, fy, {r6('nullif(gross_profit, 0) / revenue')} AS gross_margin, {r6('nullif(ebit, 0) / revenue')} AS operating_margin, fcf, coalesce(nullif(diluted_shares, 0), shares_outstanding) AS shares, {r6('coalesce(net_debt, coalesce(total_debt, 0) - coalesce(cash, 0))', 2)} AS net_debt FROM statements WHERE coalesce(revenue, 0) <> 0")
def margin_table(spark, sf):
    m = fx.margin_table(t.statements(spark, sf))
    return m.withColumns({"gross_margin": rnd("gross_margin"), "operating_margin": rnd("operating_margin"), "net_debt": rnd("net_debt", 2)})


# two bases of the same companies: all lines, and the statements without the two last years
BASE_B = cs.METRICS.replace("FROM statements WHERE", "FROM statements WHERE fy <= 1999 AND").replace("qy AS", "bye AS").replace("FROM qy", "FROM bye").replace("qz AS", "bz AS").replace("FROM qz", "FROM bz").replace("qa AS", "ba AS").replace("FROM qa a JOIN qy l", "FROM ba a JOIN bye l").replace("qb AS", "bb AS").replace("FROM qb", "FROM bb").replace("metrics AS (SELECT", "mb AS (SELECT")
BASE_B = BASE_B[BASE_B.index(", bye AS") + 2:]


def _b(spark, sf):
    from panelspark.plans.screens import quality_metrics
    return quality_metrics(t.statements(spark, sf)), quality_metrics(t.statements(spark, sf).where("fy <= 1999"))


@register("two_basis_reconciliation", f"""WITH {cs.METRICS}, {BASE_B}, u AS ({" UNION ALL ".join(f"SELECT a.ticker, '{f}' AS field, a.{f} AS a, b.{f} AS b, {tol}::DOUBLE AS tolerance, a.n_years >= b.n_years AND a.n_years - b.n_years <= 2 AS ok FROM metrics a JOIN mb b USING (ticker)" for f, tol in fx.TOLERANCE.items())})
 SELECT ticker, field, {r6('a')} AS a, {r6('b')} AS b, {r6('b - a')} AS gap, CASE WHEN ok THEN abs(b - a) <= tolerance END AS agrees FROM u""")
def reconciliation(spark, sf):
    a, b = _b(spark, sf)
    ok = (F.col("window_a") >= F.col("window_b")) & (F.col("window_a") - F.col("window_b") <= 2)
    r = fx.reconcile(a.withColumn("window_a", F.col("n_years")), b.withColumn("window_b", F.col("n_years")), "ticker", ok)
    return r.select("ticker", "field", *[rnd(c).alias(c) for c in ("a", "b", "gap")], "agrees")


@register("disagreement_counts", f"""WITH {cs.METRICS}, {BASE_B}, u AS ({" UNION ALL ".join(f"SELECT '{f}' AS field, abs(b.{f} - a.{f}) > {tol}::DOUBLE AS bad FROM metrics a JOIN mb b USING (ticker)" for f, tol in fx.TOLERANCE.items())}) SELECT field, count(*) AS n FROM u WHERE bad GROUP BY 1""")
def disagreement_counts(spark, sf):
    a, b = _b(spark, sf)
    r = fx.reconcile(a.withColumn("window_a", F.col("n_years")), b.withColumn("window_b", F.col("n_years")), "ticker", F.lit(True))
    return r.where(~F.col("agrees")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def _rb(field, lead):
    use = f"b.{lead} IS NOT NULL" + (" OR coalesce(b.net_cash, false)" if lead == "nd_to_ebitda" else "")
    return f"CASE WHEN coalesce(b.n_years >= 3, false) AND ({use}) THEN b.{field} ELSE a.{field} END"


@register("groupwise_rebase", f"""WITH {cs.METRICS}, {BASE_B.replace('fy <= 1999', 'fy <= 1999 AND fy % 2 = 1')} SELECT a.ticker, CASE WHEN NOT coalesce(b.n_years >= 3, false) THEN 'other' WHEN {" AND ".join("(" + f"b.{g} IS NOT NULL" + (" OR coalesce(b.net_cash, false)" if g == "nd_to_ebitda" else "") + ")" for g, _ in fx.FIELD_GROUPS)} THEN 'reported' ELSE 'mixed' END AS basis,
 {", ".join(f"{r6(_rb(f, g))} AS {f}" for f, g in (("roic_avg", "roic_avg"), ("gm_std", "gm_avg"), ("rev_cagr", "rev_cagr"), ("nd_to_ebitda", "nd_to_ebitda")))} FROM metrics a LEFT JOIN mb b USING (ticker)""")
def groupwise_rebase(spark, sf):
    from panelspark.plans.screens import quality_metrics
    st = t.statements(spark, sf)
    r = fx.rebase(quality_metrics(st), quality_metrics(st.where("fy <= 1999 AND fy % 2 = 1")), "ticker")
    return r.select("ticker", "basis", *[rnd(c).alias(c) for c in ("roic_avg", "gm_std", "rev_cagr", "nd_to_ebitda")])


@register("basis_sensitivity", f"""WITH {cs.PRICED}, other AS (SELECT * REPLACE (rev_cagr AS roic_avg) FROM priced), a AS (WITH {cs.score_sql('quality_value')} SELECT ticker, rs AS x FROM s1), b AS (WITH {cs.score_sql('quality_value').replace('FROM priced', 'FROM other')} SELECT ticker, rs AS y FROM s1),
 j AS (SELECT {t.pctl_sql('x', '')} AS rx, {t.pctl_sql('y', '')} AS ry FROM a JOIN b USING (ticker)) SELECT {r6('corr(rx, ry)')} AS rho, count(*) AS n FROM j""")
def basis_sensitivity(spark, sf):
    r = cs.records(spark, sf)
    a, b = [sc.score_universe(x).withColumn("score", F.round("score", 12)) for x in (r, r.withColumn("roic_avg", F.col("rev_cagr")))]
    return fx.basis_sensitivity(a, b)[0].select(rnd("rho").alias("rho"), "n")
