"""Rule replay over the weekly panel: features, signals, events, trades, control, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.plans import events as ev
from panelspark.queries import r6, register, rnd
from panelspark.queries import tables as t
from panelspark.queries.core import block_sql, dense_sql, roll_sql
from panelspark.session import cut_lineage

CFG = ev.FeatureConfig(short=(4, 3), mid=(10, 6), long=(40, 24), high=(52, 30), prior_high=(51, 20), market=(40, 24), rs=(13, 26),
                       min_history=30, min_dollar_volume=60_000.0)
ARMS = [ev.Arm("pullback_b40_h5", "pullback", 5, {"band": 0.4, "max_dd": -0.9}), ev.Arm("breakout_s8_h5", "breakout_price_only", 5, {"stop_pct": 0.08}),
        ev.Arm("breakout_s50_h5_rs63+x1", "breakout_price_only", 5, {"stop_pct": 0.5, "filters": ["rs63", "x1"]}),
        ev.Arm("pead_proxy_g20_h8_mkt200", "pead_proxy", 8, {"gap": 0.2, "vol_mult": 1.2, "filters": ["mkt200"]})]
WINDOW = ("1996-01-01", "2000-12-31")


def features(spark, sf):
    p = cut_lineage(t.weekly(spark, sf))
    return ev.compute_features(p, t.benchmark(p), t.membership(spark, sf), cfg=CFG)


def fired(spark, sf):
    """The panel with the firings of every arm, written once: of the features only what an event study reads."""
    return cut_lineage(ev.with_firings(features(spark, sf), ARMS).select("ticker", "s_idx", "session", "close", "bench", "fired"))


FEAT = f"""{t.WEEKLY}, {dense_sql('weekly')}, {t.bench_sql('weekly')}, {t.MEMBERSHIP},
 bx AS (SELECT c.s_idx, b.bench, b.bench / lag(b.bench, 13) OVER o - 1 AS b0, b.bench / lag(b.bench, 26) OVER o - 1 AS b1,
  b.bench > CASE WHEN count(b.bench) OVER (ORDER BY c.s_idx ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) >= 24 THEN avg(b.bench) OVER (ORDER BY c.s_idx ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) END AS market_up
  FROM cal c LEFT JOIN bench b USING (session) WINDOW o AS (ORDER BY c.s_idx)),
 f0 AS (SELECT d.*, bench, market_up, b0, b1, close * volume AS dv FROM dense d JOIN bx USING (s_idx)),
 f1 AS (SELECT *, close / lag(close, 1) OVER w - 1 AS ret1, {roll_sql('avg', 'close', 4, 3)} AS ma_short, {roll_sql('avg', 'close', 10, 6)} AS ma_mid, {roll_sql('avg', 'close', 40, 24)} AS ma_long,
  {roll_sql('max', 'close', 51, 20, 1)} AS prior_high, {roll_sql('max', 'close', 52, 30)} AS high, {roll_sql('min', 'close', 4, 3)} AS low_short, {roll_sql('avg', 'volume', 4, 3, 1)} AS vol_mean,
  {roll_sql('avg', 'dv', 4, 3, 1)} AS dvm, count(close) OVER (PARTITION BY ticker ORDER BY s_idx) AS n_history, close / lag(close, 13) OVER w - 1 - b0 AS rs_a, close / lag(close, 26) OVER w - 1 - b1 AS rs_b,
  lag(close, 1) OVER w AS c_1, lag(close, 2) OVER w AS c_2, {roll_sql('min', 'close', 1, 1)} AS low_0, {roll_sql('min', 'close', 2, 2)} AS low_1, {roll_sql('min', 'close', 3, 3)} AS low_2 FROM f0 WINDOW w AS (PARTITION BY ticker ORDER BY s_idx)),
 feat AS (SELECT f.* EXCLUDE (dv, b0, b1), coalesce(close IS NOT NULL AND n_history >= 30 AND dvm >= 60000 AND EXISTS (SELECT 1 FROM membership m WHERE m.ticker = f.ticker AND m.start_date <= f.session AND (m.end_date IS NULL OR f.session <= m.end_date)), false) AS eligible FROM f1 f)"""
_FC = ["ret1", "ma_short", "ma_mid", "ma_long", "prior_high", "high", "low_short", "vol_mean", "rs_a", "rs_b"]


@register("panel_features", f"WITH {FEAT} SELECT ticker, session, n_history, market_up, eligible, " + ", ".join(f"{r6(c, 4)} AS {c}" for c in _FC) + " FROM feat")
def panel_features(spark, sf):
    return features(spark, sf).select("ticker", "session", "n_history", "market_up", "eligible", *[rnd(c, 4).alias(c) for c in _FC])


SIG = f"""{FEAT}, g AS (SELECT *, coalesce(ret1 >= 0.2 AND volume >= 1.2 * vol_mean, false) AS rel FROM feat),
 g2 AS (SELECT *, coalesce(lag(rel, 1) OVER w, false) AS rel1, coalesce(lag(rel, 2) OVER w, false) AS rel2 FROM g WINDOW w AS (PARTITION BY ticker ORDER BY s_idx)),
 sig AS (SELECT 'pullback_b40_h5' AS arm, 5 AS horizon, ticker, s_idx, session, close, low_short AS stop FROM feat WHERE eligible AND ma_mid > ma_long AND close > ma_long AND abs(close / ma_short - 1) <= 0.4 AND close / high - 1 >= -0.9 AND low_short < close
  UNION ALL SELECT 'breakout_s8_h5', 5, ticker, s_idx, session, close, close * (1.0::DOUBLE - 0.08::DOUBLE) FROM feat WHERE eligible AND close > prior_high
  UNION ALL SELECT 'breakout_s50_h5_rs63+x1', 5, ticker, s_idx, session, close, close * 0.5::DOUBLE FROM feat WHERE eligible AND close > prior_high AND rs_a > 0 AND close >= prior_high * 1.01::DOUBLE
  UNION ALL SELECT 'pead_proxy_g20_h8_mkt200', 8, ticker, s_idx, session, close, CASE WHEN rel THEN low_0 WHEN rel1 THEN low_1 WHEN rel2 THEN low_2 END FROM g2
   WHERE eligible AND market_up AND CASE WHEN rel THEN low_0 < close WHEN rel1 THEN close >= c_1 AND low_1 < close WHEN rel2 THEN close >= c_2 AND low_2 < close ELSE false END)"""


@register("rule_signals", f"WITH {SIG} SELECT arm, ticker, session, {r6('stop', 4)} AS stop FROM sig")
def rule_signals(spark, sf):
    return ev.signals(features(spark, sf), ARMS).select("arm", "ticker", "session", rnd("stop", 4).alias("stop"))


EVT = f"""{SIG}, mx AS (SELECT max(s_idx) AS last FROM cal), pre AS (SELECT sig.*, CASE WHEN NOT session BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}' THEN 'outside_window' WHEN s_idx + 1 > last THEN 'no_next_session'
  WHEN s_idx + horizon > last THEN 'truncated_at_panel_end' WHEN stop IS NULL OR stop <= 0 OR stop >= close THEN 'bad_stop' ELSE 'event' END AS pre FROM sig, mx),
 val AS (SELECT * FROM pre WHERE pre = 'event'),
 evr AS (SELECT arm, ticker, min(s_idx) AS s_idx FROM val GROUP BY 1, 2 UNION ALL SELECT e.arm, e.ticker, min(v.s_idx) FROM evr e JOIN val v ON v.arm = e.arm AND v.ticker = e.ticker AND v.s_idx >= e.s_idx + v.horizon GROUP BY e.arm, e.ticker, e.s_idx),
 st AS (SELECT p.arm, p.horizon, p.ticker, p.s_idx, p.session, p.close, p.stop, CASE WHEN e.s_idx IS NOT NULL THEN 'event' WHEN pre = 'outside_window' THEN pre
  WHEN EXISTS (SELECT 1 FROM evr q WHERE q.arm = p.arm AND q.ticker = p.ticker AND q.s_idx < p.s_idx AND p.s_idx < q.s_idx + p.horizon) THEN 'within_previous_horizon' ELSE pre END AS status
  FROM pre p LEFT JOIN evr e ON e.arm = p.arm AND e.ticker = p.ticker AND e.s_idx = p.s_idx)"""


@register("refractory_events", f"WITH RECURSIVE {EVT} SELECT arm, ticker, session, status FROM st")
def refractory_events(spark, sf):
    f = fired(spark, sf)
    s = ev.classify_signals(ev.signals_of(f), f.agg(F.max("s_idx")).scalar(), *WINDOW)
    return s.select("arm", "ticker", "session", "status")


@register("signal_skip_counts", f"WITH RECURSIVE {EVT} SELECT arm, status, count(*) AS n FROM st GROUP BY 1, 2")
def signal_skip_counts(spark, sf):
    f = fired(spark, sf)
    return ev.skip_counts(ev.classify_signals(ev.signals_of(f), f.agg(F.max("s_idx")).scalar(), *WINDOW))




def walk_sql(source: str, x: str) -> str:
    """The walk of ``source(arm, rep, horizon, ticker, s_idx, stop)`` as CTEs ending in ``{x}trd``."""
    return f"""{x}e0 AS (SELECT *, row_number() OVER (ORDER BY arm, rep, ticker, s_idx) AS id FROM {source}),
 {x}pth AS (SELECT e.id, e.arm, e.rep, e.horizon, e.ticker, e.s_idx AS i, e.stop, k, f.close, f.session, f.bench FROM (SELECT *, unnest(range(0, horizon + 1)) AS k FROM {x}e0) e LEFT JOIN feat f ON f.ticker = e.ticker AND f.s_idx = e.s_idx + k),
 {x}p1 AS (SELECT *, max(close) FILTER (k = 1) OVER (PARTITION BY id) AS entry FROM {x}pth),
 {x}p2 AS (SELECT *, CASE WHEN max(CASE WHEN k >= 1 AND close >= entry + (entry - stop) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) = 1 THEN greatest(stop, entry) ELSE stop END AS sk FROM {x}p1),
 {x}p3 AS (SELECT *, min(k) FILTER (k >= 1 AND close < sk) OVER (PARTITION BY id) AS kh, min(k) FILTER (k >= 1 AND close IS NULL) OVER (PARTITION BY id) AS kg FROM {x}p2),
 {x}p4 AS (SELECT *, coalesce(kg < coalesce(kh, 1000000), false) AS gone FROM {x}p3),
 {x}p5 AS (SELECT *, CASE WHEN gone THEN kg - 1 WHEN kh IS NOT NULL THEN least(kh + 1, horizon) ELSE horizon END AS kx FROM {x}p4),
 {x}t0 AS (SELECT id, arm, rep, horizon, ticker, stop, any_value(entry) AS entry, bool_or(gone) AS gone, any_value(kh) AS kh, any_value(kx) AS kx, max(k) FILTER (k >= 1 AND k <= kx AND close IS NOT NULL) AS ke,
  arg_max(close, k) FILTER (k >= 1 AND k <= kx AND close IS NOT NULL) AS ex, arg_max(session, k) FILTER (k >= 1 AND k <= kx AND close IS NOT NULL) AS exit_date, arg_max(bench, k) FILTER (k >= 1 AND k <= kx AND close IS NOT NULL) AS b1,
  max(bench) FILTER (k = 1) AS b0, max(session) FILTER (k = 1) AS fill_date, max(session) FILTER (k = 0) AS signal_date FROM {x}p5 GROUP BY 1, 2, 3, 4, 5, 6),
 {x}trd AS (SELECT arm, rep, horizon, ticker, signal_date, fill_date, exit_date, CASE WHEN gone OR ke < kx THEN 'panel_end' WHEN kh IS NOT NULL THEN 'stop' ELSE 'horizon' END AS exit_reason, entry, stop AS stop_initial, ex AS exit, ke - 1 AS held,
  ex / entry - 1 AS ret_gross, (ex * (1.0::DOUBLE - 0.001::DOUBLE)) / (entry * (1.0::DOUBLE + 0.001::DOUBLE)) - 1 AS ret_net, b1 / b0 - 1 AS bw FROM {x}t0 WHERE entry IS NOT NULL AND ex IS NOT NULL AND entry > 0)"""


TRD = f"""{EVT}, own AS (SELECT *, -1 AS rep FROM st WHERE status = 'event'), {walk_sql('own', '')},
 trades AS (SELECT *, ret_net - bw AS excess FROM trd)"""


def study(spark, sf):
    f = fired(spark, sf)
    return ev.event_study(f, ev.signals_of(f), max(a.horizon for a in ARMS), *WINDOW)[1]


@register("event_trades", f"WITH RECURSIVE {TRD} SELECT arm, ticker, signal_date, fill_date, exit_date, exit_reason, CAST(held AS INT) AS sessions_held, {r6('ret_gross')} AS ret_gross, {r6('ret_net')} AS ret_net, {r6('bw')} AS bench_same_window, {r6('excess')} AS excess FROM trades")
def event_trades(spark, sf):
    return study(spark, sf).select("arm", "ticker", "signal_date", "fill_date", "exit_date", "exit_reason", "sessions_held",
                                   *[rnd(c).alias(c) for c in ("ret_gross", "ret_net", "bench_same_window", "excess")])


@register("arm_statistics", f"""WITH RECURSIVE {TRD} SELECT arm, count(*) AS n_trades, {r6('count(*) FILTER (ret_net > 0) / count(*)')} AS hit_rate, {r6('avg(ret_net)')} AS mean_net, {r6('median(ret_net)')} AS median_net, {r6('avg(excess)')} AS mean_excess,
 CASE WHEN sum(ret_net) FILTER (ret_net < 0) < 0 THEN {r6('coalesce(sum(ret_net) FILTER (ret_net > 0), 0) / -sum(ret_net) FILTER (ret_net < 0)')} END AS profit_factor, count(*) FILTER (exit_reason = 'stop') AS n_stop, count(*) FILTER (exit_reason = 'horizon') AS n_horizon, count(*) FILTER (exit_reason = 'panel_end') AS n_panel_end FROM trades GROUP BY 1""")
def arm_statistics(spark, sf):
    s = ev.arm_statistics(cut_lineage(study(spark, sf)))
    return s.select("arm", "n_trades", *[rnd(c).alias(c) for c in ("hit_rate", "mean_net", "median_net", "mean_excess", "profit_factor")], "n_stop", "n_horizon", "n_panel_end")


@register("arm_by_year", f"WITH RECURSIVE {TRD} SELECT arm, CAST(year(fill_date) AS INT) AS year, count(*) AS n, {r6('avg(excess)')} AS mean_excess, {r6('count(*) FILTER (ret_net > 0) / count(*)')} AS hit_rate FROM trades GROUP BY ROLLUP (arm, CAST(year(fill_date) AS INT))")
def arm_by_year(spark, sf):
    return ev.by_year(study(spark, sf)).select("arm", "year", "n", rnd("mean_excess").alias("mean_excess"), rnd("hit_rate").alias("hit_rate"))


@register("worst_trades", f"WITH RECURSIVE {TRD}, r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY ret_net, ticker, fill_date) AS rn FROM trades) SELECT arm, CAST(rn AS INT) AS rank, ticker, fill_date, {r6('ret_net')} AS ret_net, exit_reason FROM r WHERE rn <= 5")
def worst_trades(spark, sf):
    from panelspark.operators.ranks import top_n
    w = top_n(study(spark, sf), ["arm"], [F.asc("ret_net"), F.asc("ticker"), F.asc("fill_date")], 5)
    return w.select("arm", "rank", "ticker", "fill_date", rnd("ret_net").alias("ret_net"), "exit_reason")


MB = "mb AS (SELECT arm, horizon, strftime(fill_date, '%Y-%m') AS month, avg(excess) AS mean_excess, count(*) AS n FROM trades WHERE excess IS NOT NULL GROUP BY 1, 2, 3)"


@register("month_buckets", f"WITH RECURSIVE {TRD}, {MB} SELECT arm, month, {r6('mean_excess')} AS mean_excess, n FROM mb")
def month_buckets(spark, sf):
    return ev.month_buckets(study(spark, sf)).select("arm", "month", rnd("mean_excess").alias("mean_excess"), "n")


@register("bucket_statistics", f"""WITH RECURSIVE {TRD}, {MB}, {block_sql('mb', 'arm', 'month', 'mean_excess', '(CAST(ceil(horizon / 21.0) AS INT) + 1)')}
 SELECT mb.arm, count(*) AS n_buckets, {r6('avg(mean_excess) / (stddev_samp(mean_excess) / sqrt(count(*)))', 4)} AS excess_t, {r6('any_value(ci_low)')} AS ci_low, {r6('any_value(ci_high)')} AS ci_high, {r6('count(*) / 2')} AS n_effective FROM mb JOIN ci ON ci.arm = mb.arm GROUP BY 1""")
def bucket_statistics(spark, sf):
    b = ev.bucket_statistics(cut_lineage(ev.month_buckets(study(spark, sf))))
    return b.select("arm", "n_buckets", rnd("excess_t", 4).alias("excess_t"), *[rnd(c).alias(c) for c in ("ci_low", "ci_high", "n_effective")])


@register("paired_difference", f"""WITH RECURSIVE {TRD}, {MB}, d AS (SELECT 'pair' AS pr, x.month, x.mean_excess - y.mean_excess AS diff FROM mb x JOIN mb y ON x.month = y.month WHERE x.arm = 'pullback_b40_h5' AND y.arm = 'breakout_s8_h5'), {block_sql('d', 'pr', 'month', 'diff', '2')}
 SELECT 'pullback_b40_h5' AS a, 'breakout_s8_h5' AS b, count(*) AS n_months, {r6('avg(diff)')} AS diff_mean, {r6('avg(diff) / (stddev_samp(diff) / sqrt(count(*)))', 4)} AS t, {r6('any_value(ci_low)')} AS ci_low, {r6('any_value(ci_high)')} AS ci_high FROM d, ci""")
def paired_difference(spark, sf):
    p = ev.paired_differences(cut_lineage(ev.month_buckets(study(spark, sf))), [("pullback_b40_h5", "breakout_s8_h5")])
    return p.select("a", "b", "n_months", rnd("diff_mean").alias("diff_mean"), rnd("t", 4).alias("t"), rnd("ci_low").alias("ci_low"), rnd("ci_high").alias("ci_high"))


def pair_sql(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {TRD}, {MB}, d AS (SELECT 'pair' AS pr, x.month, x.mean_excess - y.mean_excess AS diff FROM mb x JOIN mb y ON x.month = y.month WHERE x.arm = '{a}' AND y.arm = '{b}'), {block_sql('d', 'pr', 'month', 'diff', '2')}
 SELECT '{a}' AS a, '{b}' AS b, count(*) AS n_months, {r6('avg(diff)')} AS diff_mean, {r6('avg(diff) / (stddev_samp(diff) / sqrt(count(*)))', 4)} AS t, {r6('any_value(ci_low)')} AS ci_low, {r6('any_value(ci_high)')} AS ci_high FROM d, ci"""


@register("pairwise_differences", " UNION ALL ".join(f"SELECT * FROM ({pair_sql(a, b)})" for a, b in ev.equal_pairs(ARMS)))
def pairwise_differences(spark, sf):
    p = ev.pairwise_table(cut_lineage(ev.month_buckets(study(spark, sf))), ARMS)
    return p.select("a", "b", "n_months", rnd("diff_mean").alias("diff_mean"), rnd("t", 4).alias("t"), rnd("ci_low").alias("ci_low"), rnd("ci_high").alias("ci_high"))


@register("benchmark_hold", f"""WITH {t.WEEKLY}, {t.bench_sql('weekly')}, w AS (SELECT min(session) AS f, max(session) AS l, arg_min(bench, session) AS b0, arg_max(bench, session) AS b1 FROM bench WHERE bench IS NOT NULL AND session BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}')
 SELECT 'spy_hold' AS arm, f AS fill_date, l AS exit_date, {r6('b1 / b0 - 1')} AS ret_gross, {r6('(b1 * (1.0::DOUBLE - 0.001::DOUBLE)) / (b0 * (1.0::DOUBLE + 0.001::DOUBLE)) - 1')} AS ret_net FROM w""")
def benchmark_hold(spark, sf):
    h = ev.benchmark_hold(features(spark, sf), *WINDOW)
    return h.withColumns({c: rnd(c) for c in ("ret_gross", "ret_net")})


TURNS = ", ".join(f"k{i + 1} AS (SELECT * EXCLUDE (l, r), r AS l, (l + {ev.mix_sql('r', 'key', i)}) % root AS r FROM k{i})" for i in range(4))
CONTROL = f"""cells AS (SELECT ticker, s_idx, close, row_number() OVER (ORDER BY s_idx, ticker) - 1 AS ordinal FROM feat WHERE eligible AND session BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'),
 rsk AS (SELECT arm, median(1.0::DOUBLE - stop_initial / entry) AS med FROM trades WHERE entry > 0 GROUP BY 1),
 likes AS (SELECT o.arm, o.horizon, count(*) AS n FROM own o GROUP BY 1, 2),
 drawn AS (SELECT l.arm, l.horizon, n, coalesce(nullif(med, 0), 0.05::DOUBLE) AS risk, row_number() OVER (ORDER BY l.arm) AS arm_no, (SELECT count(*) FROM cells, mx WHERE s_idx + l.horizon <= last) AS cells FROM likes l LEFT JOIN rsk ON rsk.arm = l.arm),
 ix AS (SELECT d.*, rep, unnest(range(0, n + root * root - cells)) AS i FROM (SELECT *, CAST(ceil(sqrt(cells)) AS BIGINT) AS root FROM drawn) d, (SELECT unnest(range(0, {ev.CONTROL_REPLICATES})) AS rep)),
 k0 AS (SELECT *, arm_no * 1009 + rep AS key, i // root AS l, i % root AS r FROM ix), {TURNS},
 tk AS (SELECT *, row_number() OVER (PARTITION BY arm, rep ORDER BY i) AS rn FROM (SELECT *, l * root + r AS ordinal FROM k4) WHERE ordinal < cells),
 other AS (SELECT k.arm, k.rep, k.horizon, c.ticker, c.s_idx, c.close * (1.0::DOUBLE - k.risk) AS stop FROM tk k JOIN cells c ON c.ordinal = k.ordinal WHERE k.rn <= k.n AND c.close > 0),
 {walk_sql('other', 'c')}, cm AS (SELECT arm, rep, avg(ret_net - bw) AS m FROM ctrd GROUP BY 1, 2 HAVING avg(ret_net - bw) IS NOT NULL)"""


@register("rule_comparison_with_control", f"""WITH RECURSIVE {TRD}, {MB}, {block_sql('mb', 'arm', 'month', 'mean_excess', '(CAST(ceil(horizon / 21.0) AS INT) + 1)')}, {CONTROL},
 s AS (SELECT arm, count(*) AS n_trades, avg(excess) AS mean_excess FROM trades GROUP BY 1), n AS (SELECT arm, count(*) AS n_signals, count(*) FILTER (status = 'event') AS n_events FROM st GROUP BY 1),
 bk AS (SELECT arm, avg(mean_excess) / (stddev_samp(mean_excess) / sqrt(count(*))) AS t, count(*) / 2 AS n_eff FROM mb GROUP BY 1),
 nul AS (SELECT cm.arm, count(*) AS n_replicates, quantile_cont(m, 0.05) AS p05, quantile_cont(m, 0.5) AS p50, quantile_cont(m, 0.95) AS p95, avg((m <= mean_excess)::INT) AS pct FROM cm JOIN s ON s.arm = cm.arm GROUP BY 1),
 z AS (SELECT n.*, s.n_trades, s.mean_excess, ci_low, ci_high, p05, p50, p95, pct, n_replicates, CASE WHEN mean_excess IS NULL OR ci_low IS NULL OR (ci_low <= 0 AND ci_high >= 0) THEN 'no evidence' WHEN ci_high < 0 THEN 'wrong way' WHEN n_eff < 12 THEN 'weak' WHEN n_eff < 20 THEN 'suggestive'
  WHEN abs(t) < 1.96 + 0.5 * ln(4) THEN 'suggestive' ELSE 'supported' END AS verdict FROM n LEFT JOIN s ON s.arm = n.arm LEFT JOIN bk ON bk.arm = n.arm LEFT JOIN ci ON ci.arm = n.arm LEFT JOIN nul ON nul.arm = n.arm)
 SELECT arm, n_signals, n_events, n_trades, {", ".join(f"{r6(c)} AS {c}" for c in ("mean_excess", "ci_low", "ci_high", "p05", "p50", "p95"))}, {r6('pct')} AS percentile_of_arm, n_replicates, verdict,
  coalesce(verdict IN ('suggestive', 'supported') AND ci_low > 0 AND mean_excess > p95, false) AS survives, CASE WHEN abs(mean_excess) > 0.05 THEN 'mean excess over 5%, check for look-ahead' END AS flag FROM z""")
def rule_comparison(spark, sf):
    r = ev.run_ab(features(spark, sf), ARMS, "train", WINDOW)
    return r.select("arm", "n_signals", "n_events", "n_trades", *[rnd(c).alias(c) for c in ("mean_excess", "ci_low", "ci_high", "p05", "p50", "p95", "percentile_of_arm")], "n_replicates", "verdict", "survives", "flag")


@register("hypothesis_count", "WITH log AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN o_custkey % 9 = 0 THEN 'random' ELSE 'pullback' END AS kind, 'pullback_b' || (o_custkey % 50) || '_h5' AS arm FROM orders) SELECT count(DISTINCT arm) AS n FROM (SELECT arm FROM log WHERE split = 'train' AND kind NOT IN ('random', 'spy_hold') UNION ALL SELECT 'breakout_s8_h5')")
def hypothesis_count(spark, sf):
    o = t.read(spark, sf, "orders")
    log = o.select(F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train").alias("split"), F.when(F.col("o_custkey") % 9 == 0, "random").otherwise("pullback").alias("kind"),
                   F.concat(F.lit("pullback_b"), F.col("o_custkey") % 50, F.lit("_h5")).alias("arm"))
    return ev.hypothesis_count(log, ["breakout_s8_h5"])
