"""Screens, scores, diagnostics and peers over companies made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import ranks
from panelspark.plans import diagnose as dg
from panelspark.plans import peers as pr
from panelspark.plans import score as sc
from panelspark.plans import screens as scr
from panelspark.queries import r6, register, rnd
from panelspark.queries import tables as t
from panelspark.queries.core import z_sql
from panelspark.session import cut_lineage

# Two nations stand in for the excluded countries.
OUT = ("NATION_3", "NATION_4")

RAW = """raw AS (SELECT 'S' || s_suppkey || CASE WHEN s_suppkey % 31 = 30 THEN '-WT' ELSE '' END AS symbol,
 CASE WHEN s_suppkey % 29 = 28 THEN 'ETF' ELSE 'EQUITY' END AS quote_type,
 CASE s_suppkey % 7 WHEN 0 THEN 'TOR' WHEN 1 THEN 'NMS' WHEN 2 THEN 'PNK' WHEN 3 THEN 'NGM' ELSE 'NYQ' END AS exchange,
 CASE WHEN s_suppkey % 13 <> 5 THEN CASE WHEN s_suppkey % 23 = 3 THEN s_name || ' Acquisition Corp' ELSE 'Group ' || (s_suppkey % 40) END END AS long_name,
 s_name AS short_name, CASE WHEN s_suppkey % 7 = 0 THEN 'CAD' ELSE 'USD' END AS currency, s_acctbal AS price,
 CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_nationkey * 4000 AS DOUBLE) END AS volume_3m, CAST(20000 AS DOUBLE) AS volume_10d,
 s_acctbal * 900000 AS market_cap, CASE WHEN s_suppkey % 3 <> 0 THEN make_date(2018 + CAST(s_suppkey % 8 AS INT), 3, 1) END AS first_trade,
 CAST(NULL AS VARCHAR) AS board_id FROM supplier)"""


def raw_listings(spark, sf):
    body = RAW[len("raw AS ("):-1].replace("CAST(NULL AS VARCHAR)", "CAST(NULL AS STRING)").replace("FROM supplier", "FROM {supplier}")
    return spark.sql(body, supplier=t.read(spark, sf, "supplier"))


@register("universe_filter", f"""WITH {RAW}, k AS (SELECT *, coalesce(long_name, short_name) AS name, price * coalesce(volume_3m, volume_10d) / CASE WHEN currency = 'CAD' THEN 1.37::DOUBLE ELSE 1.0::DOUBLE END AS dv,
 market_cap / CASE WHEN currency = 'CAD' THEN 1.37::DOUBLE ELSE 1.0::DOUBLE END AS cap, coalesce(board_id, long_name, symbol) AS company_key FROM raw
 WHERE quote_type = 'EQUITY' AND exchange IN ('NMS', 'NYQ', 'NGM', 'NCM', 'TOR') AND NOT regexp_matches(symbol, '[-^]')
 AND NOT regexp_matches(lower(coalesce(long_name, short_name)), 'acquisition corp|acquisition co|spac|blank check')
 AND coalesce(first_trade, DATE '1970-01-01') <= DATE '2026-09-04' - 1095),
 b AS (SELECT *, row_number() OVER (PARTITION BY company_key ORDER BY dv DESC, symbol DESC) AS rn FROM k WHERE dv >= 10000000 AND cap >= 2000000000)
 SELECT symbol AS ticker, name, company_key, exchange, {r6('cap', 0)} AS market_cap_usd, {r6('dv', 0)} AS dollar_volume_usd FROM b WHERE rn = 1""")
def universe_filter(spark, sf):
    u = scr.universe(raw_listings(spark, sf), 1.37, "2026-09-04")
    return u.select("ticker", "name", "company_key", "exchange", rnd("market_cap_usd", 0).alias("market_cap_usd"),
                    rnd("dollar_volume_usd", 0).alias("dollar_volume_usd"))


METRICS = f"""{t.STATEMENTS}, qy AS (SELECT *, CASE WHEN tax_rate IS NULL OR tax_rate <= 0 OR tax_rate > 0.5 THEN 0.21::DOUBLE ELSE tax_rate END AS tx FROM statements WHERE coalesce(revenue, 0) <> 0),
 qz AS (SELECT *, ebit * (1 - tx) / nullif(invested_capital, 0) AS roic, fcf / revenue AS fcfm, gross_profit / revenue AS gm FROM qy),
 qa AS (SELECT ticker, count(*) AS n_years, avg(roic) AS roic_avg, CASE WHEN count(roic) >= 2 THEN arg_max(roic, fy) FILTER (roic IS NOT NULL) - arg_min(roic, fy) FILTER (roic IS NOT NULL) END AS roic_trend,
  arg_max(roic, fy) FILTER (roic IS NOT NULL) AS roic_latest, avg(fcfm) AS fcf_margin_avg, count(*) FILTER (fcf > 0) AS fcf_positive_years, count(fcf) AS fcf_years,
  arg_min(revenue, fy) AS r0, arg_max(revenue, fy) AS r1, max(fy) AS lfy, CASE WHEN count(diluted_shares) > 0 THEN count(diluted_shares) ELSE count(shares_outstanding) END AS nsh,
  CASE WHEN count(diluted_shares) > 0 THEN arg_min(diluted_shares, fy) FILTER (diluted_shares IS NOT NULL) ELSE arg_min(shares_outstanding, fy) END AS s0,
  CASE WHEN count(diluted_shares) > 0 THEN arg_max(diluted_shares, fy) FILTER (diluted_shares IS NOT NULL) ELSE arg_max(shares_outstanding, fy) END AS s1,
  avg(gm) AS gm_avg, CASE WHEN count(gm) >= 2 THEN stddev_pop(gm) END AS gm_std FROM qz GROUP BY 1),
 qb AS (SELECT a.*, coalesce(l.net_debt, coalesce(l.total_debt, 0) - coalesce(l.cash, 0)) AS net_debt, l.ebitda AS ebitda_latest FROM qa a JOIN qy l ON l.ticker = a.ticker AND l.fy = a.lfy),
 metrics AS (SELECT ticker, n_years, roic_avg, roic_trend, roic_latest, fcf_margin_avg, fcf_positive_years, fcf_years,
  CASE WHEN r0 > 0 AND n_years > 1 THEN pow(r1 / r0, 1.0::DOUBLE / (n_years - 1)) - 1 END AS rev_cagr, net_debt, ebitda_latest,
  CASE WHEN net_debt <= 0 THEN 0.0::DOUBLE WHEN ebitda_latest > 0 THEN net_debt / ebitda_latest END AS nd_to_ebitda, net_debt <= 0 AS net_cash,
  CASE WHEN nsh >= 2 AND s0 > 0 THEN s1 / s0 - 1 END AS share_change, gm_avg, gm_std FROM qb)"""
_METRIC_COLS = ["roic_avg", "roic_trend", "roic_latest", "fcf_margin_avg", "rev_cagr", "nd_to_ebitda", "share_change", "gm_avg", "gm_std"]


@register("quality_metrics", f"WITH {METRICS} SELECT ticker, n_years, fcf_positive_years, fcf_years, net_cash, {r6('net_debt', 2)} AS net_debt, "
          + ", ".join(f"{r6(c)} AS {c}" for c in _METRIC_COLS) + " FROM metrics")
def quality_metrics(spark, sf):
    m = scr.quality_metrics(t.statements(spark, sf))
    return m.select("ticker", "n_years", "fcf_positive_years", "fcf_years", "net_cash", rnd("net_debt", 2).alias("net_debt"),
                    *[rnd(c).alias(c) for c in _METRIC_COLS])


def pn_sql(v: str, src: str) -> str:
    """W2 over the whole list as a derived table ``(ticker, pct)``."""
    return (f"(SELECT ticker, 100.0 * (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pct "
            f"FROM (SELECT ticker, {v} AS v FROM {src}) WHERE v IS NOT NULL)")


REASON = f"""CASE WHEN s.ticker IS NULL THEN 'no fundamentals in cache' WHEN coalesce(n_years, 0) < 3 THEN 'only ' || coalesce(n_years, 0) || ' years of statements'
  WHEN regexp_matches(lower(industry), 'bank|insurance|capital markets|mortgage|credit services|asset management|financial data|financial conglomerates')
   THEN 'bank/insurer/lender: ROIC, EBITDA and FCF screens do not apply'
  WHEN country IN {OUT} THEN 'country ' || country END"""
SCREEN = f"""{t.COMPANIES}, {METRICS}, qj AS (SELECT c.*, m.* EXCLUDE (ticker), {REASON} AS exclude_reason FROM companies c
  LEFT JOIN metrics m USING (ticker) LEFT JOIN (SELECT DISTINCT ticker FROM statements) s USING (ticker)),
 q0 AS (SELECT * FROM qj WHERE exclude_reason IS NULL),
 q1 AS (SELECT q.*, CASE WHEN roic_avg < 0 THEN 0 ELSE a.pct + sign(coalesce(roic_trend, 0)) * 5 END AS p1,
  CASE WHEN fcf_margin_avg < 0 THEN 0 ELSE CASE WHEN fcf_positive_years < fcf_years - 1 THEN b.pct * 0.2::DOUBLE ELSE b.pct END END AS p2, c.pct AS p3,
  CASE WHEN net_cash THEN 100 WHEN nd_to_ebitda < 1 THEN 85 WHEN nd_to_ebitda < 2 THEN 65 WHEN nd_to_ebitda < 3 THEN 45 WHEN nd_to_ebitda >= 3 THEN 10 ELSE 30 END AS p4,
  CASE WHEN share_change < -0.05 THEN 100 WHEN share_change < 0 THEN 80 WHEN share_change < 0.03 THEN 55 WHEN share_change < 0.10 THEN 25 WHEN share_change >= 0.10 THEN 0 ELSE 40 END AS p5,
  coalesce(d.pct, 50) AS p6 FROM q0 q LEFT JOIN {pn_sql('roic_avg', 'q0')} a USING (ticker) LEFT JOIN {pn_sql('fcf_margin_avg', 'q0')} b USING (ticker)
  LEFT JOIN {pn_sql('rev_cagr', 'q0')} c USING (ticker) LEFT JOIN {pn_sql('-gm_std', 'q0')} d USING (ticker)),
 q2 AS (SELECT * REPLACE (CASE WHEN p1 IS NOT NULL THEN least(greatest(p1, 0), 100) END AS p1) FROM q1),
 q3 AS (SELECT *, round_even((coalesce(p1, 0) * 25 + coalesce(p2, 0) * 20 + coalesce(p3, 0) * 15 + p4 * 15.0::DOUBLE + p5 * 10.0::DOUBLE + p6 * 15) / 100, 1) AS quality_score FROM q2),
 scored AS (SELECT *, row_number() OVER (ORDER BY quality_score DESC, ticker) AS rank FROM q3)"""


def screened(spark, sf):
    return scr.screened(t.statements(spark, sf), t.companies(spark, sf), OUT)


def screen(spark, sf):
    return scr.quality_screen(screened(spark, sf))


@register("quality_screen", f"WITH {SCREEN} SELECT ticker, rank, quality_score, round_even(p1, 1) AS score_roic, round_even(p2, 1) AS score_fcf, round_even(p3, 1) AS score_growth, round_even(p4::DOUBLE, 1) AS score_balance, round_even(p5::DOUBLE, 1) AS score_shares, round_even(p6, 1) AS score_gm_stability FROM scored")
def quality_screen(spark, sf):
    return screen(spark, sf).select("ticker", "rank", "quality_score", *[f"score_{k}" for k in scr.QUALITY_WEIGHTS])


@register("quality_top_list", f"WITH {SCREEN} SELECT ticker, rank, quality_score FROM scored WHERE rank <= 150")
def quality_top(spark, sf):
    return screen(spark, sf).where("rank <= 150").select("ticker", "rank", "quality_score")


@register("in_top_list", f"WITH {SCREEN} SELECT ticker, quality_score, rank <= 150 AS in_top_150 FROM scored")
def in_top_list(spark, sf):
    s = cut_lineage(screen(spark, sf))
    return scr.flag_top(s.select("ticker", "quality_score"), s.where("rank <= 150"))


@register("liquid_universe", f"""WITH {RAW}, l AS (SELECT upper(trim(lower(symbol) || ' ')) AS ticker, long_name AS name, price * volume_3m AS dv FROM raw)
 SELECT ticker, coalesce(arg_max(name, dv), ticker) AS name FROM l WHERE dv >= 10000000 AND ticker <> '' GROUP BY ticker""")
def liquid_universe(spark, sf):
    raw = raw_listings(spark, sf).select(F.concat(F.lower("symbol"), F.lit(" ")).alias("ticker"), F.col("long_name").alias("name"), (F.col("price") * F.col("volume_3m")).alias("dollar_volume_usd"))
    return scr.liquid_universe(raw)


@register("quality_excluded", f"WITH {SCREEN} SELECT ticker, exclude_reason FROM qj WHERE exclude_reason IS NOT NULL")
def quality_excluded(spark, sf):
    return scr.excluded(screened(spark, sf)).select("ticker", "exclude_reason")


@register("exclusion_reason_counts", f"WITH {SCREEN} SELECT split_part(exclude_reason, ':', 1) AS reason, count(*) AS n FROM qj WHERE exclude_reason IS NOT NULL GROUP BY 1")
def exclusion_counts(spark, sf):
    return scr.excluded(screened(spark, sf)).groupBy(F.split_part("exclude_reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def info(px, marks, companies):
    e = marks.select("ticker", "eps_fy1_now", "ev_ebitda")
    p = px.groupBy("ticker").agg(F.max_by("close", "session").alias("_last"), F.max("session").alias("_end"))
    hi = px.select("ticker", "session", "high").join(p.select("ticker", "_end").hint("shuffle_hash"), "ticker").where(F.col("session") > F.date_sub("_end", 365)).groupBy("ticker").agg(F.max("high").alias("high_52w"))
    return p.join(e.hint("merge"), "ticker").join(hi.hint("merge"), "ticker").join(companies.select("ticker", "currency", "suppkey").hint("merge"), "ticker").select(
        "ticker", F.when(F.col("suppkey") % 12 != 0, F.try_divide("_last", "eps_fy1_now")).alias("forward_pe"), "ev_ebitda", "high_52w",
        F.lit("USD").alias("fin_currency"), F.col("currency").alias("px_currency"))


PRICED = f"""{SCREEN}, {t.DAILY}, {t.ESTIMATES}, px AS (SELECT ticker, arg_max(close, session) AS last, max(close) AS ath, max(session) AS en FROM daily GROUP BY 1),
 hi AS (SELECT ticker, max(high) AS high_52w FROM daily JOIN px USING (ticker) WHERE session > en - 365 GROUP BY 1),
 fye AS (SELECT y.*, d.close AS px FROM qy y ASOF LEFT JOIN daily d ON y.ticker = d.ticker AND y.period_end >= d.session),
 mult AS (SELECT ticker, median(pe) AS mpe, median(ev) AS mev, count(pe) AS npe FROM (SELECT ticker, CASE WHEN diluted_eps > 0 THEN px / diluted_eps END AS pe,
   CASE WHEN ebitda > 0 AND coalesce(nullif(diluted_shares, 0), shares_outstanding) <> 0 THEN (px * coalesce(nullif(diluted_shares, 0), shares_outstanding) + coalesce(net_debt, coalesce(total_debt, 0) - coalesce(cash, 0))) / ebitda END AS ev FROM fye) GROUP BY 1),
 pr0 AS (SELECT s.*, e.* EXCLUDE (ticker), CASE WHEN suppkey % 12 <> 0 THEN last / nullif(eps_fy1_now, 0) END AS forward_pe, last, ath, high_52w,
   CASE WHEN currency = 'USD' THEN mpe END AS median_pe_hist, CASE WHEN currency = 'USD' THEN mev END AS median_ev_ebitda_hist, coalesce(CASE WHEN currency = 'USD' THEN npe END, 0) AS n_hist_years
   FROM scored s LEFT JOIN px USING (ticker) LEFT JOIN hi USING (ticker) LEFT JOIN mult USING (ticker) LEFT JOIN estimates e USING (ticker)),
 pr1 AS (SELECT *, CASE WHEN forward_pe <> 0 AND median_pe_hist > 0 THEN forward_pe / median_pe_hist - 1 END AS pe_vs_median,
   CASE WHEN ev_ebitda <> 0 AND median_ev_ebitda_hist > 0 THEN ev_ebitda / median_ev_ebitda_hist - 1 END AS ev_vs_median,
   last / nullif(high_52w, 0) - 1 AS dd_52w, last / nullif(ath, 0) - 1 AS dd_ath, eps_fy1_now / nullif(eps_fy1_30d, 0) - 1 AS eps_fy1_chg_30d,
   eps_fy1_now / nullif(eps_fy1_90d, 0) - 1 AS eps_fy1_chg_90d, eps_fy0_now / nullif(eps_fy0_30d, 0) - 1 AS eps_fy0_chg_30d FROM pr0),
 priced AS (SELECT *, coalesce(pe_vs_median <= 0, false) OR coalesce(ev_vs_median <= 0, false) AS bucket_compounder,
   coalesce(sector IN {scr.CYCLICAL_SECTORS}, false) AND regexp_matches(lower(coalesce(industry, '')), '{"|".join(scr.CYCLICAL_INDUSTRY_WORDS)}') AND coalesce(dd_ath <= -0.35, false)
   AND (coalesce(eps_fy1_chg_30d, 0) >= -0.005 OR coalesce(eps_fy0_chg_30d, 0) >= -0.005) AS bucket_cyclical_turn FROM pr1)"""


def records(spark, sf):
    """Scored companies with prices, estimates and multiples: one flat row per name."""
    # each is asked several times below: the bars by four aggregates, the statements by three, the estimates twice
    years, bars = cut_lineage(t.statements(spark, sf)), cut_lineage(t.daily(spark, sf).select("ticker", "session", "close", "high"))
    marks = cut_lineage(t.estimates(spark, sf))
    top = scr.quality_screen(scr.screened(years, t.companies(spark, sf), OUT))
    return scr.price_screen(top, bars, years, marks.drop("ev_ebitda"), info(bars, marks, t.companies(spark, sf)))


_PRICE_COLS = ["median_pe_hist", "median_ev_ebitda_hist", "pe_vs_median", "ev_vs_median", "dd_52w", "dd_ath", "eps_fy1_chg_30d", "eps_fy1_chg_90d"]


@register("price_screen", f"WITH {PRICED} SELECT ticker, n_hist_years, bucket_compounder, bucket_cyclical_turn, " + ", ".join(f"{r6(c)} AS {c}" for c in _PRICE_COLS) + " FROM priced")
def price_screen(spark, sf):
    return records(spark, sf).select("ticker", "n_hist_years", "bucket_compounder", "bucket_cyclical_turn", *[rnd(c).alias(c) for c in _PRICE_COLS])


@register("estimate_drift", f"WITH {PRICED} SELECT ticker, {r6('(1 + eps_fy1_chg_90d) / nullif(1 + eps_fy1_chg_30d, 0) - 1')} AS earlier_60d, CASE WHEN eps_fy1_chg_90d <> 0 AND eps_fy1_chg_30d > -1 THEN CASE WHEN eps_fy1_chg_90d > 0 THEN (1 + eps_fy1_chg_30d) * (1 + eps_fy1_chg_30d) * (1 + eps_fy1_chg_30d) > 1 + eps_fy1_chg_90d ELSE (1 + eps_fy1_chg_30d) * (1 + eps_fy1_chg_30d) * (1 + eps_fy1_chg_30d) < 1 + eps_fy1_chg_90d END END AS accelerating FROM priced")
def estimate_drift(spark, sf):
    rest, faster = scr.estimate_drift("eps_fy1_chg_30d", "eps_fy1_chg_90d")
    return records(spark, sf).select("ticker", rnd(rest).alias("earlier_60d"), faster.alias("accelerating"))


# -- score -----------------------------------------------------------------------------------------

_RAWS = {
    "roic": "roic_avg", "roic_trend": "roic_trend",
    "fcf": "CASE WHEN fcf_years <> 0 AND fcf_years - fcf_positive_years > 1 THEN CASE WHEN fcf_margin_avg > 0 THEN fcf_margin_avg * 0.4::DOUBLE ELSE fcf_margin_avg / 0.4::DOUBLE END ELSE fcf_margin_avg END",
    "growth": "rev_cagr", "margin_stability": "gm_std", "balance": "CASE WHEN net_cash THEN -1 ELSE nd_to_ebitda END",
    "value_ev": "CASE WHEN n_hist_years >= 3 THEN ev_vs_median END", "value_pe": "CASE WHEN n_hist_years >= 3 THEN pe_vs_median END",
    "revisions_90d": "eps_fy1_chg_90d", "revisions_30d": "eps_fy1_chg_30d",
    "revision_breadth": "CASE WHEN rev_up IS NOT NULL OR rev_down IS NOT NULL THEN (coalesce(rev_up, 0) - coalesce(rev_down, 0)) / nullif(coalesce(rev_up, 0) + coalesce(rev_down, 0), 0) END",
    "share_count": "share_change", "short_interest": "short_pct_float", "momentum_52w": "dd_52w", "reversal_ath": "-dd_ath"}


def score_sql(variant: str) -> str:
    """``z(ticker, key, pos, weight, z)`` and ``scores`` as CTEs after ``priced``."""
    comps = sc.components(variant)
    long = " UNION ALL ".join(
        f"SELECT ticker, coalesce(sector, '?') AS sec, '{c.key}' AS key, {i} AS pos, {c.weight}::DOUBLE AS weight, {1 if c.higher_is_better else -1}::DOUBLE AS sgn, "
        f"{str(c.sector_neutral).lower()} AS neutral, CAST({_RAWS[c.key]} AS DOUBLE) AS v FROM priced" for i, c in enumerate(comps))
    return f"""lng AS ({long}), scn AS (SELECT sec, count(*) AS c FROM (SELECT coalesce(sector, '?') AS sec FROM priced) GROUP BY 1),
 zsrc AS (SELECT ticker, key, sec AS scope, v FROM lng UNION ALL SELECT ticker, key, '*' AS scope, v FROM lng), {z_sql('zsrc', 'key, scope')},
 z AS (SELECT l.ticker, l.key, l.pos, l.weight, l.sgn * zt.z AS z FROM lng l JOIN scn USING (sec)
   JOIN zt ON zt.ticker = l.ticker AND zt.key = l.key AND zt.scope = CASE WHEN neutral AND c >= 5 THEN l.sec ELSE '*' END),
 s0 AS (SELECT ticker, sum(coalesce(weight * z, 0)) AS score, sum(CASE WHEN z IS NOT NULL THEN weight ELSE 0 END) / sum(weight) AS coverage,
   coalesce(string_agg(CASE WHEN z IS NULL THEN key END, ',' ORDER BY pos), '') AS missing FROM z GROUP BY 1),
 s1 AS (SELECT *, round(score, 12) AS rs FROM s0),
 scores AS (SELECT *, {t.pctl_sql('rs', '')} AS percentile FROM s1)"""


def _score_query(variant):
    sql = f"""WITH {PRICED}, {score_sql(variant)} SELECT ticker, {r6('score')} AS score, {r6('coverage')} AS coverage, {r6('percentile')} AS percentile,
 round_even(percentile * 100, 1) AS display, missing, coverage < 0.60 - 1e-9 AS thin FROM scores"""

    @register(f"score_{variant}", sql)
    def run(spark, sf):
        s = sc.score_universe(records(spark, sf), variant)
        return s.select("ticker", rnd("score").alias("score"), rnd("coverage").alias("coverage"), rnd("percentile").alias("percentile"),
                        "display", F.array_join("missing", ",").alias("missing"), (F.col("coverage") < 0.60 - 1e-9).alias("thin"))


for _v in ("quality_value", "with_momentum", "with_reversal"):
    _score_query(_v)


@register("score_contributions_top", f"""WITH {PRICED}, {score_sql('quality_value')}, c AS (SELECT ticker, key, coalesce(weight * z, 0) AS c, row_number() OVER (PARTITION BY ticker ORDER BY abs(round(coalesce(weight * z, 0), 9)) DESC, key) AS rank FROM z)
 SELECT ticker, key, {r6('c')} AS contribution, rank FROM c WHERE rank <= 4""")
def score_contributions_top(spark, sf):
    z = sc.component_z(records(spark, sf), sc.components())
    c = z.withColumn("c", F.coalesce(F.col("weight") * F.col("z"), F.lit(0.0)))
    top = ranks.top_n(c, ["ticker"], [F.desc(F.abs(F.round("c", 9))), F.asc("key")], 4)
    return top.select("ticker", "key", rnd("c").alias("contribution"), F.col("rank").cast("long").alias("rank"))


# -- diagnostics -------------------------------------------------------------------------------------

@register("component_correlations", f"""WITH {PRICED}, {score_sql('quality_value')}, p AS (SELECT a.key AS a, b.key AS b, a.weight + b.weight AS w, round(a.z, 12) AS x, round(b.z, 12) AS y FROM z a JOIN z b ON a.ticker = b.ticker AND a.pos < b.pos WHERE a.z IS NOT NULL AND b.z IS NOT NULL),
 k AS (SELECT a, b, w, {t.pctl_sql('x', 'a, b')} AS rx, {t.pctl_sql('y', 'a, b')} AS ry FROM p)
 SELECT a, b, {r6('any_value(w)')} AS combined_weight, count(*) AS n, CASE WHEN count(*) >= 3 AND min(rx) <> max(rx) AND min(ry) <> max(ry) THEN {r6('corr(rx, ry)')} END AS rho FROM k GROUP BY a, b""")
def component_correlations(spark, sf):
    z = sc.component_z(records(spark, sf), sc.components()).withColumn("z", F.round("z", 12))
    p = dg.pair_correlations(z)
    return p.select("a", "b", rnd("combined_weight").alias("combined_weight"), "n", rnd("rho").alias("rho"))


@register("effective_signal_count")
def effective_signal_count(spark, sf):
    comps = sc.components()
    z = sc.component_z(records(spark, sf), comps)
    n = z.select("ticker").distinct().count()
    eff = dg.effective_signals(dg.pair_correlations(z), [c.key for c in comps], n)
    return spark.createDataFrame([(n, eff)], "n_names long, effective_signals double")


@register("variance_share", f"""WITH {PRICED}, {score_sql('quality_value')}, c AS (SELECT z.key, z.weight, coalesce(weight * z.z, 0) AS c, s0.score FROM z JOIN s0 USING (ticker))
 SELECT key, {r6('covar_samp(c, score) / var_samp(score)')} AS share, {r6('any_value(weight) / sum(any_value(weight)) OVER ()')} AS nominal_weight FROM c GROUP BY key""")
def variance_share(spark, sf):
    v = dg.variance_share(sc.component_z(records(spark, sf), sc.components()))
    return v.select("key", rnd("share").alias("share"), rnd("nominal_weight").alias("nominal_weight"))


@register("coverage_distribution", f"""WITH {PRICED}, {score_sql('quality_value')}, o AS (SELECT round(coverage, 9) AS coverage, row_number() OVER (ORDER BY coverage) - 1 AS i, count(*) OVER () AS n FROM s0)
 SELECT {r6('min(coverage)')} AS min, {r6('max(CASE WHEN i = floor(0.10 * (n - 1)) THEN coverage END)')} AS p10, {r6('max(CASE WHEN i = n // 2 THEN coverage END)')} AS median, {r6('avg(coverage)')} AS mean, {r6('max(coverage)')} AS max, count(*) FILTER (coverage < 0.6) AS n_thin FROM o""")
def coverage_distribution(spark, sf):
    s = sc.score_universe(records(spark, sf)).withColumn("coverage", F.round("coverage", 9))
    d = dg.coverage_distribution(s)
    return d.select(*[rnd(c).alias(c) for c in ("min", "p10", "median", "mean", "max")], "n_thin")


@register("rank_movement", f"""WITH {PRICED}, {score_sql('quality_value')}, o AS (SELECT ticker, row_number() OVER (ORDER BY coalesce(quality_score, 0) DESC, ticker) AS old_rank, row_number() OVER (ORDER BY rs DESC, ticker) AS new_rank FROM s1 JOIN priced USING (ticker))
 SELECT ticker, old_rank, new_rank, old_rank - new_rank AS moved FROM o ORDER BY abs(old_rank - new_rank) DESC, ticker LIMIT 12""")
def rank_movement(spark, sf):
    r = records(spark, sf)
    s = sc.score_universe(r).select("ticker", F.round("score", 12).alias("score")).join(r.select("ticker", "quality_score"), "ticker")
    return dg.rank_movement(s, "quality_score", "score")


@register("variant_agreement", f"""WITH {PRICED}, {score_sql('quality_value')}, a AS (SELECT ticker, rs AS x FROM s1), b AS (SELECT ticker, round(sum(coalesce(w * z, 0)), 12) AS y FROM (
 SELECT ticker, weight AS w, z FROM z UNION ALL SELECT ticker, 0.10::DOUBLE, z FROM (SELECT ticker, z FROM m_z)) GROUP BY 1), j AS (SELECT {t.pctl_sql('x', '')} AS rx, {t.pctl_sql('y', '')} AS ry FROM a JOIN b USING (ticker))
 SELECT 'quality_value' AS a, 'with_momentum' AS b, {r6('corr(rx, ry)')} AS rho, count(*) AS n FROM j""".replace(", a AS (SELECT ticker, rs AS x", f""", m_src AS (SELECT ticker, 1 AS one, dd_52w AS v FROM priced), {z_sql('m_src', 'one', 'm_z')}, a AS (SELECT ticker, rs AS x"""))
def variant_agreement(spark, sf):
    r = records(spark, sf)
    rounded = {v: sc.score_universe(r, v).withColumn("score", F.round("score", 12)) for v in ("quality_value", "with_momentum")}
    a = dg.variant_agreement(rounded)
    return a.select("a", "b", rnd("rho").alias("rho"), "n")


@register("variant_top_overlap", f"""WITH {PRICED}, {score_sql('with_reversal')}, a AS (SELECT ticker FROM s1 ORDER BY rs DESC, ticker LIMIT 10), b AS (SELECT ticker FROM priced ORDER BY quality_score DESC, ticker LIMIT 10)
 SELECT count(*) AS shared FROM a JOIN b USING (ticker)""")
def variant_top_overlap(spark, sf):
    r = records(spark, sf)
    a = sc.score_universe(r, "with_reversal").select("ticker", F.round("score", 12).alias("score"))
    return dg.top_overlap(a, r.select("ticker", F.col("quality_score").alias("score")), 10)


# -- peers ---------------------------------------------------------------------------------------------

_PI = [("forward P/E", "CASE WHEN forward_pe > 0 THEN forward_pe END", "price"), ("EV/EBITDA", "CASE WHEN ev_ebitda > 0 THEN ev_ebitda END", "price"),
       ("return on invested capital", "roic_avg", "quality"), ("free cash flow margin", "fcf_margin_avg", "quality"), ("revenue growth", "rev_cagr", "quality"),
       ("gross margin stability", "-gm_std", "quality")]
PEERS = f"""pin AS (SELECT *, count(*) OVER (PARTITION BY industry) AS ni, CASE WHEN sector IS NOT NULL THEN count(*) OVER (PARTITION BY sector) ELSE 0 END AS ns, count(*) OVER () AS na FROM priced),
 own AS (SELECT ticker, CASE WHEN ni >= 6 THEN 'industry' WHEN ns >= 6 THEN 'sector' ELSE 'whole list' END AS basis, CASE WHEN ni >= 6 THEN ni WHEN ns >= 6 THEN ns ELSE na END AS n_peers,
   CASE WHEN ni >= 6 THEN 'i:' || industry WHEN ns >= 6 THEN 's:' || sector ELSE '*' END AS scope FROM pin),
 mem AS (SELECT ticker, 'i:' || industry AS scope FROM priced UNION ALL SELECT ticker, 's:' || sector FROM priced WHERE sector IS NOT NULL UNION ALL SELECT ticker, '*' FROM priced),
 pv AS ({" UNION ALL ".join(f"SELECT ticker, '{lab}' AS input, '{side}' AS side, CAST({e} AS DOUBLE) AS v FROM priced" for lab, e, side in _PI)}),
 pk AS (SELECT ticker, scope, input, side, {t.pctl_sql('v', 'scope, input')} AS pct FROM pv JOIN mem USING (ticker) WHERE v IS NOT NULL),
 pg AS (SELECT o.ticker, o.basis, o.n_peers, median(pct) FILTER (side = 'price') AS price_rank, median(pct) FILTER (side = 'quality') AS quality_rank FROM own o LEFT JOIN pk ON pk.ticker = o.ticker AND pk.scope = o.scope GROUP BY 1, 2, 3)"""


@register("peer_valuation", f"""WITH {PRICED}, {PEERS} SELECT ticker, basis, n_peers, {r6('price_rank')} AS price_rank, {r6('quality_rank')} AS quality_rank, {r6('quality_rank - price_rank')} AS gap,
 CASE WHEN price_rank IS NULL OR quality_rank IS NULL THEN 'not comparable' WHEN price_rank <= 0.35 AND quality_rank >= 0.65 THEN 'cheap against peers of better quality'
 WHEN price_rank >= 0.65 AND quality_rank <= 0.35 THEN 'expensive against peers of worse quality' WHEN quality_rank - price_rank >= 0.35 THEN 'priced below where its quality sits'
 WHEN quality_rank - price_rank <= -0.35 THEN 'priced above where its quality sits' WHEN price_rank <= 0.35 AND quality_rank <= 0.35 THEN 'cheap, and the quality suggests why'
 WHEN price_rank >= 0.65 AND quality_rank >= 0.65 THEN 'expensive, and the quality supports it' ELSE 'in the middle' END AS verdict FROM pg""")
def peer_valuation(spark, sf):
    p = pr.peer_valuation(records(spark, sf))
    return p.select("ticker", "basis", "n_peers", *[rnd(c).alias(c) for c in ("price_rank", "quality_rank", "gap")], "verdict")


@register("peer_extremes", f"""WITH {PRICED}, {PEERS}, u AS (SELECT DISTINCT scope FROM own), m AS (SELECT scope, ticker, forward_pe FROM mem JOIN u USING (scope) JOIN priced USING (ticker) WHERE forward_pe > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY forward_pe, ticker) AS a, row_number() OVER (PARTITION BY scope ORDER BY forward_pe DESC, ticker DESC) AS b FROM m)
 SELECT scope, 'cheapest' AS side, CAST(a AS INT) AS rank, ticker, {r6('forward_pe')} AS forward_pe FROM r WHERE a <= 4 UNION ALL SELECT scope, 'dearest', CAST(b AS INT), ticker, {r6('forward_pe')} FROM r WHERE b <= 4""")
def peer_extremes(spark, sf):
    return pr.extreme_peers(records(spark, sf)).withColumn("forward_pe", rnd("forward_pe"))
