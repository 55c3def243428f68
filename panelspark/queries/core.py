"""Statistics, ranks, panel windows, as-of and interval joins over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import growth, safe_div
from panelspark.operators import asof, intervals, panel, ranks, resample
from panelspark.queries import r6, register, rnd
from panelspark.queries import tables as t
from panelspark.session import cut_lineage


# -- ranks and statistics ---------------------------------------------------------------

@register("rank_ic_by_date", f"""WITH {t.REBALANCES}, v AS (SELECT date, score, fwd_ret FROM rebalances
  WHERE score IS NOT NULL AND fwd_ret IS NOT NULL),
 k AS (SELECT date, {t.pctl_sql('score', 'date')} AS rx, {t.pctl_sql('fwd_ret', 'date')} AS ry FROM v)
 SELECT date, CASE WHEN count(*) >= 20 AND min(rx) <> max(rx) AND min(ry) <> max(ry) THEN {r6('corr(rx, ry)')} END AS ic,
 count(*) AS n FROM k GROUP BY date""")
def rank_ic_by_date(spark, sf):
    s = ranks.spearman(t.rebalances(spark, sf), ["date"], "score", "fwd_ret", min_n=20)
    return s.select("date", rnd("rho").alias("ic"), "n")


@register("rank_percentile", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity,
 {r6(t.pctl_sql('l_quantity', 'l_returnflag'))} AS pctl FROM lineitem""")
def rank_percentile(spark, sf):
    li = t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return ranks.rank_percentile(li, ["l_returnflag"], "l_quantity", "pctl").withColumn("pctl", rnd("pctl"))


@register("rank_percentile_descending_with_nulls", f"""WITH v AS (SELECT p_partkey, p_type, nullif(p_size, 7) AS v FROM part),
 k AS (SELECT p_partkey, {t.pctl_sql('v', 'p_type', asc=False)} AS pctl FROM v WHERE v IS NOT NULL)
 SELECT v.p_partkey, v.p_type, v, {r6('pctl')} AS pctl FROM v LEFT JOIN k USING (p_partkey)""")
def rank_percentile_desc(spark, sf):
    p = t.read(spark, sf, "part").select("p_partkey", "p_type", F.expr("nullif(p_size, 7)").alias("v"))
    return ranks.rank_percentile(p, ["p_type"], "v", "pctl", ascending=False).withColumn("pctl", rnd("pctl"))


@register("percent_rank_100", f"""WITH v AS (SELECT p_partkey, p_brand, nullif(p_size, 3) AS v FROM part),
 k AS (SELECT p_partkey, 100.0 * (rank() OVER (PARTITION BY p_brand ORDER BY v) + (count(*) OVER (PARTITION BY p_brand, v) - 1) / CAST(2.0 AS DOUBLE))
   / count(*) OVER (PARTITION BY p_brand) AS pct FROM v WHERE v IS NOT NULL)
 SELECT v.p_partkey, {r6('pct')} AS pct FROM v LEFT JOIN k USING (p_partkey)""")
def percent_rank_100(spark, sf):
    p = t.read(spark, sf, "part").select("p_partkey", "p_brand", F.expr("nullif(p_size, 3)").alias("v"))
    return ranks.percent_of_n(p, ["p_brand"], "v", "pct").select("p_partkey", rnd("pct").alias("pct"))


_AVGPX = t.fix(f"{t.CENTS} / (CAST(100 AS DOUBLE) * count(*))")
_PARTVAL = f"""pv AS (SELECT l_partkey AS id, p_brand AS sector, p_type AS grp,
  CASE WHEN l_partkey % 29 <> 0 THEN {_AVGPX} END AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def _partval(spark, sf):
    li, p = t.read(spark, sf, "lineitem"), t.read(spark, sf, "part")
    g = li.groupBy("l_partkey").agg(F.expr(_AVGPX).alias("v"))
    return g.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("id"), F.col("p_brand").alias("sector"), F.col("p_type").alias("grp"),
        F.when(F.col("l_partkey") % 29 != 0, F.col("v")).alias("v"))


@register("winsorize", f"""WITH {_PARTVAL}, e AS (SELECT grp, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM pv GROUP BY 1)
 SELECT id, CASE WHEN v IS NOT NULL THEN {r6('least(greatest(v, lo), hi)')} END AS w FROM pv JOIN e USING (grp)""")
def winsorize(spark, sf):
    return ranks.winsorize(_partval(spark, sf), ["grp"], "v", "w").select("id", rnd("w").alias("w"))


def z_sql(src: str, keys: str, out: str = "zt", v: str = "v") -> str:
    """W4 as SQL CTEs: ``out(keys, id, z)`` over ``src(keys, id, v)``."""
    return f"""{out}_e AS (SELECT {keys}, quantile_cont({v}, 0.01) AS lo, quantile_cont({v}, 0.99) AS hi FROM {src} GROUP BY {keys}),
 {out}_w AS (SELECT s.*, CASE WHEN {v} IS NOT NULL THEN least(greatest({v}, lo), hi) END AS w FROM {src} s JOIN {out}_e USING ({keys})),
 {out}_c AS (SELECT {keys}, median(w) AS med, avg(w) AS mu, stddev_samp(w) AS sd, count(w) AS n, min(w) AS mn, max(w) AS mx FROM {out}_w GROUP BY {keys}),
 {out}_d AS (SELECT {keys}, median(abs(w - med)) * 1.4826 AS mad FROM {out}_w JOIN {out}_c USING ({keys}) GROUP BY {keys}),
 {out} AS (SELECT w.*, CASE WHEN w IS NULL THEN NULL WHEN n > 1 AND mad <> 0 THEN least(greatest((w - med) / mad, -4.0), 4.0)
   WHEN n > 1 AND mn < mx THEN least(greatest((w - mu) / sd, -4.0), 4.0) ELSE 0.0 END AS z
   FROM {out}_w w JOIN {out}_c USING ({keys}) JOIN {out}_d USING ({keys}))"""


@register("robust_z", f"WITH {_PARTVAL}, {z_sql('pv', 'grp')} SELECT id, {r6('z')} AS z FROM zt")
def robust_z(spark, sf):
    return ranks.robust_z(_partval(spark, sf), ["grp"], "v", "z").select("id", rnd("z").alias("z"))


@register("robust_z_zero_mad", f"""WITH pv AS (SELECT p_partkey AS id, p_brand AS grp, CASE WHEN p_size < 35 THEN 10.0::DOUBLE ELSE p_size::DOUBLE END AS v FROM part),
 {z_sql('pv', 'grp')} SELECT id, {r6('z')} AS z FROM zt""")
def robust_z_zero_mad(spark, sf):
    p = t.read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"),
        F.when(F.col("p_size") < 35, F.lit(10.0)).otherwise(F.col("p_size").cast("double")).alias("v"))
    return ranks.robust_z(p, ["grp"], "v", "z").select("id", rnd("z").alias("z"))


@register("sector_neutral_z", f"""WITH {_PARTVAL}, sn AS (SELECT id, grp, coalesce(CASE WHEN sector LIKE '%1' THEN sector || (id % 40) ELSE sector END, '?') AS sec, v FROM pv),
 sz AS (SELECT grp, sec, count(*) AS c FROM sn GROUP BY 1, 2),
 g AS (SELECT id, grp, sec AS scope, v FROM sn UNION ALL SELECT id, grp, '*' AS scope, v FROM sn),
 {z_sql('g', 'grp, scope')}
 SELECT sn.id, {r6('z')} AS z FROM sn JOIN sz USING (grp, sec)
 JOIN zt ON zt.id = sn.id AND zt.grp = sn.grp AND zt.scope = CASE WHEN c >= 5 THEN sn.sec ELSE '*' END""")
def sector_neutral_z(spark, sf):
    p = _partval(spark, sf).withColumn(
        "sec", F.when(F.col("sector").endswith("1"), F.concat("sector", (F.col("id") % 40).cast("string"))).otherwise(F.col("sector")))
    return ranks.sector_neutral_z(p, ["grp"], "sec", "v", "z").select("id", rnd("z").alias("z"))


@register("basic_stats", f"""WITH v AS (SELECT l_returnflag AS g, round(l_extendedprice * (1 - l_discount), 4) AS v FROM lineitem),
 m AS (SELECT g, median(v) AS med FROM v GROUP BY 1)
 SELECT g, count(*) AS n, {r6('avg(v)', 3)} AS mean, {r6('stddev_samp(v)', 3)} AS sd, {r6('stddev_pop(v)', 3)} AS sd_pop,
 {r6('any_value(med)', 4)} AS median, {r6('quantile_cont(v, 0.1)', 4)} AS p10, {r6('median(abs(v - med)) * 1.4826', 3)} AS mad,
 {r6('avg(v) / (stddev_samp(v) / sqrt(count(*)))', 3)} AS t FROM v JOIN m USING (g) GROUP BY g""")
def basic_stats(spark, sf):
    from panelspark.operators.describe import describe
    v = t.read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("v"))
    d = describe(v, ["g"], "v", {"p10": 0.1})
    return d.select("g", "n", *[rnd(c, dd).alias(c) for c, dd in
                                [("mean", 3), ("sd", 3), ("sd_pop", 3), ("median", 4), ("p10", 4), ("mad", 3), ("t", 3)]])


@register("spearman_by_group", f"""WITH k AS (SELECT l_linestatus AS g, {t.pctl_sql('l_quantity', 'l_linestatus')} AS rx,
 {t.pctl_sql('l_discount', 'l_linestatus')} AS ry FROM lineitem)
 SELECT g, {r6('corr(rx, ry)')} AS rho, count(*) AS n FROM k GROUP BY g""")
def spearman_by_group(spark, sf):
    li = t.read(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "g")
    return ranks.spearman(li, ["g"], "l_quantity", "l_discount").select("g", rnd("rho").alias("rho"), "n")


_AVGM = t.fix("sum(CAST(round((l_discount - l_tax) * 100) AS BIGINT)) / (CAST(100 AS DOUBLE) * count(*))", 6)
_MONTHLY = f"""ser AS (SELECT l_returnflag AS g, strftime(l_shipdate, '%Y-%m') AS m, {_AVGM} AS v
 FROM lineitem GROUP BY 1, 2)"""


def _monthly(spark, sf):
    return t.read(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("g"), F.date_format("l_shipdate", "yyyy-MM").alias("m")).agg(
        F.expr(_AVGM).alias("v"))


@register("bootstrap_ci", f"""WITH {_MONTHLY}, p AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM ser),
 q AS (SELECT p.g, rep, {resample.draw_sql('rep', 'p.i', resample.SEED, 'n')} AS i FROM p, range(2000) r(rep)),
 d AS (SELECT q.g, rep, avg(v) AS s FROM q JOIN p ON p.g = q.g AND p.i = q.i GROUP BY 1, 2),
 o AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY s, rep) - 1 AS rn FROM d)
 SELECT g, {r6('max(CASE WHEN rn = 49 THEN s END)')} AS ci_low, {r6('max(CASE WHEN rn = 1949 THEN s END)')} AS ci_high FROM o GROUP BY g""")
def bootstrap_ci(spark, sf):
    r = resample.bootstrap_ci(_monthly(spark, sf), ["g"], "m", "v")
    return r.select("g", rnd("ci_low").alias("ci_low"), rnd("ci_high").alias("ci_high"))


def _weighted_sql(stat: str) -> str:
    """Replicates by weights, rows repeated that often, percentiles of what each replicate holds."""
    return f"""WITH {_MONTHLY}, p AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY m) - 1 AS i FROM ser),
 w AS (SELECT g, v, rep, {resample.multiplicity_sql('rep', 'i', resample.SEED)} AS w FROM p, range(500) r(rep)),
 d AS (SELECT g, rep, {stat} AS s FROM (SELECT g, rep, v, unnest(range(w)) FROM w) GROUP BY 1, 2),
 o AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY s, rep) - 1 AS rn, count(*) OVER (PARTITION BY g) AS b FROM d)
 SELECT g, {r6('max(CASE WHEN rn = floor((1 - 0.95::DOUBLE) / 2 * (b - 1)) THEN s END)')} AS ci_low, {r6('max(CASE WHEN rn = floor((1 - (1 - 0.95::DOUBLE) / 2) * (b - 1)) THEN s END)')} AS ci_high FROM o GROUP BY g"""


def _weighted(spark, sf, statistic):
    p = _monthly(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("m")) - 1)
    r = resample.weighted_bootstrap_ci(p, ["g"], "i", "v", statistic, reps=500)
    return r.select("g", rnd("ci_low").alias("ci_low"), rnd("ci_high").alias("ci_high"))


@register("rank_percentile_close_values", """WITH v AS (SELECT l_returnflag AS g, l_orderkey, l_linenumber, 1::DOUBLE + floor(l_extendedprice * 100) / 1e13::DOUBLE AS x FROM lineitem),
 r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY x) AS lo, count(*) OVER (PARTITION BY g, x) AS ties, count(*) OVER (PARTITION BY g) AS n FROM v)
 SELECT l_orderkey, l_linenumber, """ + r6("(lo - 1 + (ties - 1) / 2.0::DOUBLE) / (n - 1)") + """ AS pct FROM r""")
def rank_percentile_close_values(spark, sf):
    x = F.lit(1.0) + F.floor(F.col("l_extendedprice") * 100) / F.lit(1e13)
    v = t.read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_orderkey", "l_linenumber", x.alias("x"))
    r = ranks.rank_percentile(v, ["g"], "x", "pct", crowd=1000)                # all values of a group lie in one bucket
    return r.select("l_orderkey", "l_linenumber", rnd("pct").alias("pct"))


@register("weighted_bootstrap_mean", _weighted_sql("avg(v)"))
def weighted_bootstrap_mean(spark, sf):
    return _weighted(spark, sf, "mean")


@register("weighted_bootstrap_median", _weighted_sql("quantile_cont(v, 0.5)"))
def weighted_bootstrap_median(spark, sf):
    return _weighted(spark, sf, 0.5)


@register("weighted_bootstrap_upper_decile", _weighted_sql("quantile_cont(v, 0.9)"))
def weighted_bootstrap_upper_decile(spark, sf):
    return _weighted(spark, sf, 0.9)


def block_sql(src: str, key: str, order: str, v: str, block: str, reps: int = 3000, seed: int = resample.SEED, out: str = "ci") -> str:
    """A14 as SQL CTEs: ``out(key, ci_low, ci_high)``."""
    a, b = int(0.025 * (reps - 1)), int((1 - 0.025) * (reps - 1))
    if (1 - 0.95) / 2 * (reps - 1) != 0.025 * (reps - 1):
        a, b = int((1 - 0.95) / 2 * (reps - 1)), int((1 - (1 - 0.95) / 2) * (reps - 1))
    return f"""{out}_p AS (SELECT {key}, {v} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i,
   count(*) OVER (PARTITION BY {key}) AS n, {block} AS blk FROM {src} WHERE {v} IS NOT NULL),
 {out}_s AS (SELECT {key}, max(n) AS n, greatest(1, least(max(blk), max(n)))::BIGINT AS blk FROM {out}_p GROUP BY {key} HAVING max(n) >= 3),
 {out}_r AS (SELECT s.*, rep FROM {out}_s s, range({reps}) r(rep)),
 {out}_j AS (SELECT r.*, unnest(range(CAST(ceil(n / blk) AS BIGINT))) AS j FROM {out}_r r),
 {out}_k AS (SELECT *, {resample.draw_sql('rep', 'j', seed, '(n - blk + 1)')} AS st FROM {out}_j),
 {out}_x AS (SELECT *, unnest(range(blk)) AS off FROM {out}_k),
 {out}_y AS (SELECT {key}, rep, st + off AS i FROM {out}_x WHERE j * blk + off < n),
 {out}_d AS (SELECT y.{key}, rep, avg(v) AS s FROM {out}_y y JOIN {out}_p p ON p.{key} = y.{key} AND p.i = y.i GROUP BY 1, 2),
 {out}_o AS (SELECT {key}, s, row_number() OVER (PARTITION BY {key} ORDER BY s, rep) - 1 AS rn FROM {out}_d),
 {out} AS (SELECT {key}, max(CASE WHEN rn = {a} THEN s END) AS ci_low, max(CASE WHEN rn = {b} THEN s END) AS ci_high FROM {out}_o GROUP BY {key})"""


@register("block_bootstrap_ci", f"""WITH {_MONTHLY}, {block_sql('ser', 'g', 'm', 'v', '4')}
 SELECT g, {r6('ci_low')} AS ci_low, {r6('ci_high')} AS ci_high FROM ci""")
def block_bootstrap_ci(spark, sf):
    r = resample.block_bootstrap_ci(_monthly(spark, sf), ["g"], "m", "v", 4)
    return r.select("g", rnd("ci_low").alias("ci_low"), rnd("ci_high").alias("ci_high"))


# -- panel windows ---------------------------------------------------------------------------

CAL = "cal AS (SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS INT) AS s_idx FROM (SELECT DISTINCT session FROM {p}))"


def dense_sql(p: str) -> str:
    """``dense(ticker, session, s_idx, close, volume)``: every calendar row within each life."""
    return f"""{CAL.format(p=p)}, obs AS (SELECT p.*, s_idx FROM {p} p JOIN cal USING (session)),
 life AS (SELECT ticker, min(s_idx) AS first_idx, max(s_idx) AS last_idx, min(session) AS first_obs, max(session) AS last_obs,
   arg_max(close, s_idx) AS last_close, count(*) AS n_obs FROM obs GROUP BY 1),
 dense AS (SELECT l.ticker, c.session, c.s_idx, o.close, o.volume FROM life l JOIN cal c ON c.s_idx BETWEEN l.first_idx AND l.last_idx
   LEFT JOIN obs o ON o.ticker = l.ticker AND o.s_idx = c.s_idx)"""


@register("densify_fill_within_life", f"""WITH {t.DAILY}, {dense_sql('daily')}
 SELECT ticker, session, s_idx, {r6('close')} AS close,
 {r6('last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY s_idx)')} AS filled FROM dense""")
def densify_fill(spark, sf):
    p = t.daily(spark, sf)
    cal = panel.calendar(p)
    d = panel.fill_within_life(panel.densify(panel.indexed(p, cal), cal))
    return d.select("ticker", "session", "s_idx", rnd("close").alias("close"), rnd("filled").alias("filled"))


@register("first_last_observation", f"""WITH {t.DAILY}, {dense_sql('daily')}
 SELECT ticker, first_obs, last_obs, last_close, n_obs FROM life""")
def first_last(spark, sf):
    p = t.daily(spark, sf)
    return panel.lives(panel.indexed(p, panel.calendar(p))).select("ticker", "first_obs", "last_obs", "last_close", "n_obs")


def roll_sql(fn: str, x: str, n: int, m: int, skip: int = 0) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY s_idx ROWS BETWEEN {n - 1 + skip} PRECEDING AND " + (f"{skip} PRECEDING)" if skip else "CURRENT ROW)")
    return f"(CASE WHEN count({x}) {w} >= {m} THEN {fn}({x}) {w} END)"


@register("rolling_windows", f"""WITH {t.WEEKLY}, {dense_sql('weekly')}
 SELECT ticker, session, {r6(roll_sql('avg', 'close', 8, 5), 4)} AS ma8, {r6(roll_sql('min', 'close', 8, 5))} AS low8,
 {r6(roll_sql('max', 'close', 52, 30))} AS high52, {r6(roll_sql('avg', 'volume', 4, 3, 1), 4)} AS vol_prior4,
 {r6(roll_sql('max', 'close', 51, 20, 1))} AS prior_high51 FROM dense""")
def rolling_windows(spark, sf):
    p = t.weekly(spark, sf)
    cal = panel.calendar(p)
    d = panel.densify(panel.indexed(p, cal), cal)
    return d.select("ticker", "session", rnd(panel.rolling(F.avg, "close", 8, 5), 4).alias("ma8"),
                    rnd(panel.rolling(F.min, "close", 8, 5)).alias("low8"), rnd(panel.rolling(F.max, "close", 52, 30)).alias("high52"),
                    rnd(panel.rolling(F.avg, "volume", 4, 3, 1), 4).alias("vol_prior4"),
                    rnd(panel.rolling(F.max, "close", 51, 20, 1)).alias("prior_high51"))


@register("relative_strength", f"""WITH {t.WEEKLY}, {dense_sql('weekly')}, {t.bench_sql('weekly')},
 b AS (SELECT session, bench / lag(bench, 13) OVER (ORDER BY session) - 1 AS br FROM bench),
 d AS (SELECT ticker, session, close / lag(close, 1) OVER w - 1 AS ret1, close / lag(close, 13) OVER w - 1 AS r13 FROM dense WINDOW w AS (PARTITION BY ticker ORDER BY s_idx))
 SELECT ticker, d.session, {r6('ret1')} AS ret1, {r6('r13 - br')} AS rs13 FROM d JOIN b USING (session)""")
def relative_strength(spark, sf):
    p = t.weekly(spark, sf)
    cal = panel.calendar(p)
    d = panel.densify(panel.indexed(p, cal), cal)
    w = Window.partitionBy(F.lit(0)).orderBy("session")           # one row per session
    b = t.benchmark(p).select("session", growth("bench", F.lag("bench", 13).over(w)).alias("br"))
    d = d.select("ticker", "session", panel.lag_return("close", 1).alias("ret1"), panel.lag_return("close", 13).alias("r13"))
    return d.join(F.broadcast(b), "session").select("ticker", "session", rnd("ret1").alias("ret1"), rnd(F.col("r13") - F.col("br")).alias("rs13"))


def probes(spark, sf):
    o = t.read(spark, sf, "orders")
    n = t.read(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    k = F.col("o_orderkey") % (n + 3)
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("S"), k).alias("ticker"),
                    F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 900 - 300).cast("int")).alias("date"))


PROBES = """probes AS (SELECT o_orderkey AS id, 'S' || (o_orderkey % ((SELECT count(*) FROM supplier) + 3)) AS ticker,
 CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 - 300 AS INT) AS date FROM orders)"""


def gappy(spark, sf):
    """Daily bars; suppliers divisible by 6 stop early and those by 8 start late, so every status occurs."""
    k = F.substring("ticker", 2, 10).cast("long")
    c = F.when((k % 5 == 1) & (F.dayofmonth("session") == 9), F.lit(0.0)).otherwise(F.col("close"))
    return t.daily(spark, sf).where(
        ~((k % 6 == 0) & (F.col("session") > F.lit("1999-06-30").cast("date")))
        & ~((k % 8 == 0) & (F.col("session") < F.lit("1997-01-01").cast("date")))).withColumn("close", c)


GAPPY = f"""{t.DAILY}, gappy AS (SELECT ticker, session, high, low, volume,
 CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 5 = 1 AND day(session) = 9 THEN 0.0::DOUBLE ELSE close END AS close FROM daily
 WHERE NOT (CAST(substr(ticker, 2) AS BIGINT) % 6 = 0 AND session > DATE '1999-06-30')
 AND NOT (CAST(substr(ticker, 2) AS BIGINT) % 8 = 0 AND session < DATE '1997-01-01'))"""


def fwd_ctes(policy: str, base: str, horizon: int = 63) -> str:
    """Forward returns of ``probes(id, ticker, date)`` over the panel ``base`` as CTEs ending in ``s``."""
    return f"""{dense_sql(base)},
 e AS (SELECT max(s_idx) AS en, min(session) AS p0 FROM cal),
 b AS (SELECT p.id, p.ticker, p.date, o.s_idx AS bi, o.close AS bpx, o.session AS bd, o.s_idx + {horizon} AS tg
   FROM probes p ASOF LEFT JOIN obs o ON p.ticker = o.ticker AND p.date >= o.session),
 f AS (SELECT b.*, o.close AS fill FROM b ASOF LEFT JOIN obs o ON b.ticker = o.ticker AND b.tg >= o.s_idx),
 j AS (SELECT f.*, l.last_idx, l.last_close, en, p0, l.last_idx < en AS dead, l.last_idx < en AND l.last_idx < tg AS stop
   FROM f LEFT JOIN life l ON l.ticker = f.ticker, e),
 s AS (SELECT *, CASE WHEN last_idx IS NULL THEN 'no_column' WHEN bi IS NULL AND p0 < date THEN 'not_listed_yet'
   WHEN bi IS NULL THEN 'unknown_before_window' WHEN dead AND bi = last_idx AND bd < date THEN 'already_delisted'
   {"WHEN stop THEN 'delisted'" if policy == 'none' else ''} WHEN NOT stop AND tg > en THEN 'short_panel'
   WHEN bpx <= 0 THEN 'bad_base_price' WHEN stop THEN 'truncated' ELSE 'ok' END AS status FROM j)"""


def fwd_sql(policy: str) -> str:
    return f"""WITH {GAPPY}, {PROBES}, {fwd_ctes(policy, 'gappy')}
 SELECT id, ticker, date, bd AS base_date, bpx AS base_px, CASE status WHEN 'ok' THEN {r6('fill / bpx - 1')} WHEN 'truncated' THEN {r6('last_close / bpx - 1')} END AS fwd_ret,
 status, status IN ('already_delisted', 'delisted', 'truncated') OR (status = 'bad_base_price' AND coalesce(stop, false)) AS stopped_trading FROM s"""


@register("forward_return_truncate", fwd_sql("truncate"))
def forward_return_truncate(spark, sf):
    f = panel.forward_returns(probes(spark, sf), cut_lineage(gappy(spark, sf)), 63, "truncate")
    return f.withColumn("fwd_ret", rnd("fwd_ret"))


@register("forward_return_none", fwd_sql("none"))
def forward_return_none(spark, sf):
    f = panel.forward_returns(probes(spark, sf), cut_lineage(gappy(spark, sf)), 63, "none")
    return f.withColumn("fwd_ret", rnd("fwd_ret"))


@register("coverage_on_date", f"""WITH {GAPPY}, req AS (SELECT DISTINCT 'S' || (s_suppkey + 3) AS ticker FROM supplier),
 l AS (SELECT ticker, min(session) AS first_obs, max(session) AS last_obs FROM gappy GROUP BY 1), e AS (SELECT min(session) AS p0, max(session) AS p1 FROM gappy),
 s AS (SELECT CASE WHEN first_obs IS NULL THEN 'no_data' WHEN first_obs > DATE '1996-06-03' AND p0 < DATE '1996-06-03' THEN 'not_listed_yet'
 WHEN first_obs > DATE '1996-06-03' THEN 'unknown_before_window' WHEN last_obs < DATE '1996-06-03' AND last_obs < p1 THEN 'stopped_trading' ELSE 'available' END AS status
 FROM req LEFT JOIN l USING (ticker), e)
 SELECT status, count(*) AS n, {r6('count(*) / sum(count(*)) OVER ()')} AS share FROM s GROUP BY 1""")
def coverage_on_date(spark, sf):
    req = t.read(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey") + 3).alias("ticker"))
    c = panel.coverage_on(req, gappy(spark, sf), "1996-06-03").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))          # five statuses at most
    return c.select("status", "n", rnd(F.col("n") / total).alias("share"))


@register("year_over_year", f"""WITH {t.STATEMENTS} SELECT ticker, fy, {r6('revenue / nullif(lag(revenue) OVER (PARTITION BY ticker ORDER BY fy), 0) - 1')} AS yoy FROM statements""")
def year_over_year(spark, sf):
    w = Window.partitionBy("ticker").orderBy("fy")                 # one row per fiscal year
    return t.statements(spark, sf).select("ticker", "fy", rnd(growth("revenue", F.lag("revenue").over(w))).alias("yoy"))


@register("running_drawdown", f"""WITH {t.WEEKLY}, d AS (SELECT ticker, session, close / max(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS dd FROM weekly)
 SELECT ticker, session, {r6('dd')} AS dd FROM d""")
def running_drawdown(spark, sf):
    return t.weekly(spark, sf).select("ticker", "session", rnd(panel.running_drawdown("close", "session", "ticker")).alias("dd"))


@register("equity_curve_stats", f"""WITH {t.WEEKLY}, d AS (SELECT ticker, session, close, close / max(close) OVER (PARTITION BY ticker ORDER BY session) - 1 AS dd FROM weekly)
 SELECT ticker, strftime(session, '%Y-%m') AS month, arg_max(close, session) AS month_value, {r6('min(min(dd)) OVER (PARTITION BY ticker)')} AS max_drawdown FROM d GROUP BY 1, 2""")
def equity_curve_stats(spark, sf):
    from panelspark.operators.describe import curve_stats
    c = curve_stats(t.weekly(spark, sf), "ticker", "session", "close")
    return c.select("ticker", "month", "month_value", rnd("max_drawdown").alias("max_drawdown"))


@register("trim_partial_tail", f"""WITH {t.DAILY}, x AS (SELECT * FROM daily WHERE session <= DATE '2001-06-30' OR CAST(substr(ticker, 2) AS BIGINT) % 3 = 0),
 per AS (SELECT session, count(*) AS c FROM x GROUP BY 1), cut AS (SELECT max(session) AS c FROM per WHERE c >= 0.2 * (SELECT count(DISTINCT ticker) FROM x))
 SELECT ticker, session, close FROM x WHERE session <= (SELECT c FROM cut)""")
def trim_partial_tail(spark, sf):
    k = F.substring("ticker", 2, 10).cast("long")
    x = t.daily(spark, sf).where((F.col("session") <= F.lit("2001-06-30").cast("date")) | (k % 3 == 0))
    return panel.trim_partial_tail(x, 0.2).select("ticker", "session", "close")


@register("drop_open_session", f"""WITH {t.WEEKLY} SELECT ticker, session, close FROM weekly WHERE session <> (SELECT max(session) FROM weekly)""")
def drop_open_session(spark, sf):
    p = t.weekly(spark, sf)
    last = p.agg(F.max("session")).scalar()
    # the pull stamp of the last session, taken at 15:00 UTC
    stamped = p.withColumn("pulled_at", F.to_timestamp(F.concat_ws(" ", last.cast("string"), F.lit("15:00:00"))))
    return panel.drop_open_session(stamped, F.col("pulled_at")).select("ticker", "session", "close")


@register("panel_age_weekdays", f"""WITH {t.WEEKLY}, l AS (SELECT ticker, max(session) AS last FROM weekly GROUP BY 1)
 SELECT ticker, last, CAST(len(list_filter(range(1, 400), lambda d: last + CAST(d AS INT) <= DATE '2002-01-15' AND dayofweek(last + CAST(d AS INT)) NOT IN (0, 6))) AS INT) AS age FROM l""")
def panel_age(spark, sf):
    from panelspark.functions.dates import weekdays_between
    p = t.weekly(spark, sf).groupBy("ticker").agg(F.max("session").alias("last"))
    return p.withColumn("age", weekdays_between("last", F.lit("2002-01-15").cast("date")))


@register("date_window_slice", f"WITH {t.DAILY} SELECT ticker, session, close FROM daily WHERE session BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
def date_window_slice(spark, sf):
    return t.daily(spark, sf).where(F.col("session").between("1998-01-01", "1998-12-31")).select("ticker", "session", "close")


@register("panel_merge", f"""WITH {t.DAILY}, o AS (SELECT ticker, session, close, volume FROM daily WHERE session < DATE '1999-01-01'),
 n AS (SELECT ticker, session, CASE WHEN day(session) <> 5 THEN close * 2 END AS close, volume FROM daily WHERE session >= DATE '1998-06-01')
 SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.session, o.session) AS session, coalesce(n.close, o.close) AS close, coalesce(n.volume, o.volume) AS volume
 FROM n FULL JOIN o ON n.ticker = o.ticker AND n.session = o.session""")
def panel_merge(spark, sf):
    d = t.daily(spark, sf)
    old = d.where("session < '1999-01-01'")
    new = d.where("session >= '1998-06-01'").withColumn("close", F.when(F.dayofmonth("session") != 5, F.col("close") * 2))
    return panel.merge_panels(old, new, ["close", "volume"])


# -- as-of and interval joins --------------------------------------------------------------------

@register("asof_price", f"""WITH {GAPPY}, {PROBES} SELECT p.id, p.ticker, p.date, g.session AS on_date, g.close AS price
 FROM probes p ASOF LEFT JOIN gappy g ON p.ticker = g.ticker AND p.date >= g.session""")
def asof_price(spark, sf):
    g = gappy(spark, sf).withColumns({"on_date": F.col("session"), "price": F.col("close")})
    return asof.asof_backward(probes(spark, sf), g, ["ticker"], "date", "session", ["on_date", "price"])


_PCT = "max(close) / 400"
_SNAPS = f"""snaps AS (SELECT date_trunc('quarter', session)::DATE AS snap, ticker, {_PCT} AS pct FROM daily GROUP BY 1, 2)"""


@register("asof_snapshot_score", f"""WITH {t.DAILY}, {_SNAPS}, {PROBES}, dts AS (SELECT DISTINCT snap FROM snaps),
 a AS (SELECT p.*, d.snap FROM probes p ASOF LEFT JOIN dts d ON p.date >= d.snap)
 SELECT a.id, a.ticker, a.date, a.snap AS snapshot, {r6('s.pct')} AS pct FROM a LEFT JOIN snaps s ON s.snap = a.snap AND s.ticker = a.ticker""")
def asof_snapshot_score(spark, sf):
    from panelspark.plans.grading import score_at_call
    snaps = t.daily(spark, sf).groupBy(F.to_date(F.date_trunc("quarter", "session")).alias("snapshot"), "ticker").agg(
        F.expr(_PCT).alias("pct"))
    r = score_at_call(probes(spark, sf), snaps, "date", "pct")
    return r.select("id", "ticker", "date", "snapshot", rnd("pct").alias("pct"))


@register("asof_forward_factor", f"""WITH {t.WEEKLY}, fac AS (SELECT ticker, (date_trunc('year', session) + INTERVAL 5 MONTH)::DATE AS factor_date,
   0.5::DOUBLE + max(close) / 100000 AS pf FROM weekly GROUP BY 1, 2),
 l AS (SELECT ticker, arg_max(pf, factor_date) AS lpf FROM fac GROUP BY 1)
 SELECT w.ticker, w.session, {r6('w.close * coalesce(f.pf, l.lpf)', 4)} AS adj FROM weekly w ASOF LEFT JOIN fac f ON w.ticker = f.ticker AND w.session <= f.factor_date
 LEFT JOIN l ON l.ticker = w.ticker""")
def asof_forward_factor(spark, sf):
    w = t.weekly(spark, sf)
    fac = w.groupBy("ticker", F.to_date(F.date_trunc("year", "session") + F.expr("interval 5 month")).alias("factor_date")).agg(
        (F.lit(0.5) + F.max("close") / 100000).alias("pf"))
    return asof.factor_on(w, fac, ["pf"]).select("ticker", "session", rnd(F.col("close") * F.col("pf"), 4).alias("adj"))


@register("event_to_next_session", f"""WITH {t.DAILY}, {PROBES}, o AS (SELECT ticker, session, close, lag(close) OVER (PARTITION BY ticker ORDER BY session) AS prior FROM daily)
 SELECT p.id, p.ticker, p.date, o.session AS release, o.close, o.prior FROM probes p ASOF LEFT JOIN o ON p.ticker = o.ticker AND p.date <= o.session""")
def event_to_next_session(spark, sf):
    w = Window.partitionBy("ticker").orderBy("session")            # one row per session
    o = t.daily(spark, sf).withColumns({"prior": F.lag("close").over(w), "release": F.col("session")})
    return asof.asof_forward(probes(spark, sf), o, ["ticker"], "date", "session", ["release", "close", "prior"])


@register("ledger_balance_asof", """WITH led AS (SELECT o_custkey AS acct, CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS balance FROM orders GROUP BY 1, 2),
 days AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS session FROM orders), a AS (SELECT c_custkey AS acct, session FROM customer, days)
 SELECT a.acct, a.session, coalesce(l.balance, 100000.0::DOUBLE) AS cash FROM a ASOF LEFT JOIN led l ON a.acct = l.acct AND a.session >= l.d""")
def ledger_balance_asof(spark, sf):
    o = t.read(spark, sf, "orders")
    led = o.groupBy(F.col("o_custkey").alias("acct"), F.to_date("o_orderdate").alias("d")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("balance"))
    lo, hi = (F.trunc(f("o_orderdate"), "month") for f in (F.min, F.max))
    span = o.agg(F.sequence(lo, hi, F.expr("interval 1 month"))).scalar()
    a = t.read(spark, sf, "customer").select(F.col("c_custkey").alias("acct"), F.explode(span).alias("session"))
    j = asof.asof_backward(a, led, ["acct"], "session", "d", ["balance"])
    return j.select("acct", "session", F.coalesce("balance", F.lit(100000.0)).alias("cash"))


@register("asof_known_fact", f"""WITH {t.FACTS}, f AS (SELECT * FROM facts WHERE filed <= DATE '1999-06-30')
 SELECT cik, tag, arg_max(value, struct_pack(a := ddate, b := filed, c := adsh, d := value)) AS value, max(ddate) AS ddate,
 arg_max(adsh, struct_pack(a := ddate, b := filed, c := adsh, d := value)) AS adsh FROM f GROUP BY 1, 2""")
def asof_known_fact(spark, sf):
    k = asof.known_on(t.facts(spark, sf), ["cik", "tag"], F.lit("1999-06-30").cast("date"), ["ddate", "filed", "adsh", "value"])
    return k.select("cik", "tag", "value", "ddate", "adsh")


ASKED = "CASE o_orderkey % 5 WHEN 0 THEN 'Revenues' WHEN 1 THEN 'SalesRevenueNet' WHEN 2 THEN 'OperatingIncomeLoss' WHEN 3 THEN 'NetIncomeLoss' ELSE 'Assets' END"


@register("asof_known_fact_many", f"""WITH {t.FACTS}, asks AS (SELECT o_orderkey AS id, o_custkey AS cik, {ASKED} AS tag, CAST(o_orderdate AS DATE) AS as_of FROM orders),
 j AS (SELECT id, a.cik, as_of, f.value, f.ddate, f.filed, f.adsh FROM asks a LEFT JOIN facts f ON f.cik = a.cik AND f.tag = a.tag AND f.filed <= a.as_of)
 SELECT id, cik, as_of, arg_max(value, struct_pack(a := ddate, b := filed, c := adsh, d := value)) AS value FROM j GROUP BY 1, 2, 3""")
def asof_known_fact_many(spark, sf):
    asks = t.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cik"), F.expr(ASKED).alias("tag"), F.to_date("o_orderdate").alias("as_of"))
    return asof.known_on_many(t.facts(spark, sf), asks, ["cik", "tag"], "as_of", ["ddate", "filed", "adsh", "value"], ["value"]).drop("tag")


@register("membership_interval", f"""WITH {t.DAILY}, {t.MEMBERSHIP} SELECT ticker, session, close FROM daily d WHERE EXISTS (SELECT 1 FROM membership m
 WHERE m.ticker = d.ticker AND m.start_date <= d.session AND (m.end_date IS NULL OR d.session <= m.end_date))""")
def membership_interval(spark, sf):
    d = t.daily(spark, sf).select("ticker", "session", "close")
    return intervals.inside_any(d, t.membership(spark, sf), "ticker", "session")


@register("membership_spans_joined", f"""WITH {t.DAILY}, {t.MEMBERSHIP} SELECT d.ticker, session, start_date, end_date FROM daily d JOIN (SELECT DISTINCT ticker, start_date, end_date FROM membership) m
 ON m.ticker = d.ticker AND m.start_date <= d.session AND d.session <= m.end_date""")
def membership_spans_joined(spark, sf):
    m = intervals.merge_spans(t.membership(spark, sf), "ticker")
    return intervals.interval_join(t.daily(spark, sf).select("ticker", "session"), m, "ticker", "session", "start_date", "end_date")


@register("listing_alive_on_sessions", """WITH l AS (SELECT 'S' || l_suppkey AS ticker, CAST(min(l_shipdate) AS DATE) AS ipo, CASE WHEN l_suppkey % 3 <> 0 THEN CAST(max(l_shipdate) AS DATE) END AS gone FROM lineitem WHERE l_linenumber = 3 GROUP BY l_suppkey)
 SELECT DISTINCT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS session FROM lineitem JOIN l ON l.ticker = 'S' || l_suppkey WHERE CAST(l_shipdate AS DATE) >= ipo AND (gone IS NULL OR gone > CAST(l_shipdate AS DATE))""")
def listing_alive_on_sessions(spark, sf):
    li = t.read(spark, sf, "lineitem").withColumn("ticker", F.concat(F.lit("S"), "l_suppkey"))
    listed = li.where("l_linenumber = 3").groupBy("ticker", "l_suppkey").agg(F.to_date(F.min("l_shipdate")).alias("ipo_date"), F.to_date(F.max("l_shipdate")).alias("_g"))
    listed = listed.withColumn("delist_date", F.when(F.col("l_suppkey") % 3 != 0, F.col("_g"))).select("ticker", "ipo_date", "delist_date")
    return intervals.alive_on_dates(li.select("ticker", F.to_date("l_shipdate").alias("session")).distinct(), listed, "session")


@register("year_to_date_self_join", f"""WITH {t.FACTS}, a AS (SELECT * FROM facts WHERE qtrs = 4), b AS (SELECT * FROM facts WHERE qtrs = 3),
 j AS (SELECT a.cik, a.tag, a.ddate AS a_ddate, a.value AS a_value, a.filed AS a_filed, a.adsh AS a_adsh, b.ddate AS b_ddate, b.value AS b_value, b.filed AS b_filed, b.adsh AS b_adsh
  FROM a JOIN b ON a.cik = b.cik AND a.tag = b.tag AND date_diff('day', b.ddate, a.ddate) BETWEEN 75 AND 100 AND b.filed <= a.filed)
 SELECT cik, tag, a_ddate, a_value, a_adsh, {r6('a_value - arg_max(b_value, struct_pack(a := b_filed, b := b_adsh, c := b_ddate, d := b_value))', 2)} AS q4, count(*) > 0 AS found FROM j GROUP BY ALL""".replace(", count(*) > 0 AS found FROM j GROUP BY ALL", " FROM j GROUP BY cik, tag, a_ddate, a_value, a_filed, a_adsh"))
def year_to_date_self_join(spark, sf):
    j = intervals.range_self_join(t.facts(spark, sf), ["cik", "tag"], 4, 3, 75, 100)
    return j.select("cik", "tag", "a_ddate", "a_value", "a_adsh", rnd(F.col("a_value") - F.col("b_value"), 2).alias("q4"))


@register("benchmark_same_window", f"""WITH {t.WEEKLY}, {t.bench_sql('weekly')}, o AS (SELECT ticker, session, close, lead(session, 4) OVER w AS s2, lead(close, 4) OVER w AS c2 FROM weekly WINDOW w AS (PARTITION BY ticker ORDER BY session))
 SELECT ticker, o.session, {r6('c2 / close - 1')} AS ret, {r6('b2.bench / b1.bench - 1')} AS bench_ret, {r6('(c2 / close - 1) - (b2.bench / b1.bench - 1)')} AS excess
 FROM o JOIN bench b1 ON b1.session = o.session LEFT JOIN bench b2 ON b2.session = o.s2""")
def benchmark_same_window(spark, sf):
    p = t.weekly(spark, sf)
    b = t.benchmark(p)
    w = Window.partitionBy("ticker").orderBy("session")            # one row per session
    o = p.select("ticker", "session", "close", F.lead("session", 4).over(w).alias("s2"), F.lead("close", 4).over(w).alias("c2"))
    b1 = F.broadcast(b.select("session", F.col("bench").alias("b1")))       # one row per session
    b2 = F.broadcast(b.select(F.col("session").alias("s2"), F.col("bench").alias("b2")))
    j = o.join(b1, "session").join(b2, "s2", "left")
    ret, br = growth("c2", "close"), growth("b2", "b1")
    return j.select("ticker", "session", rnd(ret).alias("ret"), rnd(br).alias("bench_ret"), rnd(ret - br).alias("excess"))
