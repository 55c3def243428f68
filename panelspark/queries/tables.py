"""How the given tables stand in for panels, statements, facts, calls and text.

Each recipe exists twice: as a DataFrame and as SQL text (a chain of CTEs), so a
registered query and its SQL check start from the same rows. Amounts are rounded at
the source, which makes both engines start from equal numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Industry and sector labels given to the synthetic companies.
INDUSTRIES = ("Semiconductors", "Regional Banks", "Software", "Steel", "Insurance Brokers",
              "Farm Machinery", "Biotechnology", "Specialty Chemicals")
SECTORS = ("Technology", "Industrials", "Healthcare", "Energy", "Basic Materials")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fix(expr: str, digits: int = 4) -> str:
    """Rounding text that both engines evaluate alike to the last bit."""
    m = 10 ** digits
    return f"floor(({expr}) * {m} + 0.5) / {m}"


# exact sums: amounts have whole cents, quantities are whole
CENTS = "sum(CAST(round(l_extendedprice * 100) AS BIGINT))"
CLOSE = fix(f"{CENTS} / (100 * sum(l_quantity))")


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _pick_sql(values, idx):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({idx} AS INT) + 1]"


# -- price panels --------------------------------------------------------------------

def daily(spark, sf) -> DataFrame:
    """One bar per supplier and ship date; halts occur naturally."""
    li = read(spark, sf, "lineitem")
    return li.groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), F.to_date("l_shipdate").alias("session")).agg(
        F.expr(CLOSE).alias("close"),
        F.expr(fix("max(l_extendedprice / l_quantity)")).alias("high"), F.expr(fix("min(l_extendedprice / l_quantity)")).alias("low"),
        F.sum("l_quantity").alias("volume"))


DAILY = f"""daily AS (SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS session,
  {CLOSE} AS close, {fix('max(l_extendedprice / l_quantity)')} AS high,
  {fix('min(l_extendedprice / l_quantity)')} AS low, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def weekly(spark, sf) -> DataFrame:
    """One bar per supplier and week: a fuller panel for rolling windows and rule replays."""
    li = read(spark, sf, "lineitem")
    return li.groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("session")).agg(
        F.expr(CLOSE).alias("close"),
        F.sum("l_quantity").alias("volume"))


WEEKLY = f"""weekly AS (SELECT 'S' || l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS session,
  {CLOSE} AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""


def benchmark(panel: DataFrame) -> DataFrame:
    """The per-session average of a panel, as a series of its own."""
    return panel.groupBy("session").agg(F.expr(BENCH).alias("bench"))


# closes have four decimals, so this sum is exact too
BENCH = fix("sum(CAST(round(close * 10000) AS BIGINT)) / (CAST(10000 AS DOUBLE) * count(close))")


def bench_sql(panel: str) -> str:
    return f"bench AS (SELECT session, {BENCH} AS bench FROM {panel} GROUP BY 1)"


# -- companies and statements -----------------------------------------------------------

def companies(spark, sf) -> DataFrame:
    s = read(spark, sf, "supplier").join(
        F.broadcast(read(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("S"), k).alias("ticker"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 11 != 10, _pick(SECTORS, F.col("n_regionkey"))).alias("sector"),
        _pick(INDUSTRIES, F.col("s_nationkey") % 8).alias("industry"),
        F.col("n_name").alias("country"),
        F.when(k % 7 == 0, "CAD").otherwise("USD").alias("currency"),
        F.col("s_acctbal").alias("acctbal"), k.alias("suppkey"))


COMPANIES = f"""companies AS (SELECT 'S' || s_suppkey AS ticker, s_name AS name,
  CASE WHEN s_nationkey % 11 <> 10 THEN {_pick_sql(SECTORS, 'n_regionkey')} END AS sector,
  {_pick_sql(INDUSTRIES, 's_nationkey % 8')} AS industry, n_name AS country,
  CASE WHEN s_suppkey % 7 = 0 THEN 'CAD' ELSE 'USD' END AS currency, s_acctbal AS acctbal, s_suppkey AS suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

def _money(factor: str) -> str:
    """A sum of amount times factor, exact: both are whole hundredths, so whole ten-thousandths are summed."""
    return fix(f"sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(({factor}) * 100) AS BIGINT)) / CAST(10000 AS DOUBLE)", 2)


# (column, expression): the text is valid in both dialects
_STATEMENT = [
    ("revenue", "CASE WHEN (l_suppkey + fy) % 37 <> 0 THEN " + _money("1") + " END"),
    ("gross_profit", "CASE WHEN (l_suppkey * 3 + fy) % 19 <> 0 THEN " + _money("1 - l_discount * 6") + " END"),
    ("ebit", _money("l_discount * 4 - l_tax")),
    ("ebitda", "CASE WHEN (l_suppkey + fy) % 23 <> 0 THEN " + _money("l_discount * 5 - l_tax") + " END"),
    ("fcf", _money("l_discount - l_tax")),
    ("tax_rate", "CASE WHEN (l_suppkey + fy) % 5 <> 0 THEN " + fix("6 * sum(CAST(round(l_tax * 100) AS BIGINT)) / (CAST(100 AS DOUBLE) * count(*))") + " END"),
    ("invested_capital", "round(sum(l_quantity) * 900, 2)"),
    ("diluted_shares", "CASE WHEN l_suppkey % 13 <> 0 THEN sum(l_quantity) END"),
    ("shares_outstanding", "sum(l_quantity) * 1.02"),
    ("net_debt", "CASE WHEN (l_suppkey + fy) % 4 <> 0 THEN " + _money("l_tax * 3 - l_discount") + " END"),
    ("total_debt", "CASE WHEN (l_suppkey + fy) % 9 <> 0 THEN " + _money("l_tax * 3") + " END"),
    ("cash", _money("l_discount")),
    ("diluted_eps", fix("sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((l_discount * 3 - l_tax) * 100) AS BIGINT)) / (CAST(10000 AS DOUBLE) * sum(l_quantity))")),
]


def statements(spark, sf) -> DataFrame:
    """One row per supplier and year, with holes."""
    li = read(spark, sf, "lineitem").withColumn("fy", F.year("l_shipdate"))
    return li.groupBy("l_suppkey", "fy").agg(*[F.expr(e).alias(c) for c, e in _STATEMENT]).select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), "fy",
        F.make_date(F.col("fy"), F.lit(12), F.lit(31)).alias("period_end"), *[c for c, _ in _STATEMENT])


STATEMENTS = ("statements AS (SELECT 'S' || l_suppkey AS ticker, fy, make_date(fy, 12, 31) AS period_end, "
              + ", ".join(f"{e} AS {c}" for c, e in _STATEMENT)
              + " FROM (SELECT *, CAST(year(l_shipdate) AS INT) AS fy FROM lineitem) GROUP BY l_suppkey, fy)")


# -- estimates and quotes ------------------------------------------------------------------

def _lines(a: int, b: int) -> str:
    pick = f"CASE WHEN l_linenumber IN ({a}, {b}) THEN"
    return fix(f"sum({pick} CAST(round(l_extendedprice * 100) AS BIGINT) END) / (10000 * sum({pick} l_quantity END))")


_ESTIMATE = [
    ("eps_fy1_now", _lines(1, 2)), ("eps_fy1_30d", _lines(3, 4)), ("eps_fy1_90d", _lines(5, 6)),
    ("eps_fy0_now", _lines(2, 3)), ("eps_fy0_30d", _lines(4, 5)),
    ("rev_up", "CASE WHEN l_suppkey % 10 <> 0 THEN CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS DOUBLE) END"),
    ("rev_down", "CASE WHEN l_suppkey % 6 <> 0 THEN CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS DOUBLE) END"),
    ("ev_ebitda", "CASE WHEN l_suppkey % 9 <> 0 THEN " + fix("sum(l_quantity) / count(*) / 3") + " END"),
    ("short_pct_float", fix("count(CASE WHEN l_linestatus = 'O' THEN 1 END) / CAST(count(*) AS DOUBLE)")),
]


def estimates(spark, sf) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(*[F.expr(e).alias(c) for c, e in _ESTIMATE]).select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), *[c for c, _ in _ESTIMATE])


ESTIMATES = ("estimates AS (SELECT 'S' || l_suppkey AS ticker, " + ", ".join(f"{e} AS {c}" for c, e in _ESTIMATE)
             + " FROM lineitem GROUP BY l_suppkey)")


# -- bitemporal facts -----------------------------------------------------------------------

# Tags the facts carry, by line flag and status.
def facts(spark, sf) -> DataFrame:
    """One fact per line item: customer is the filer, order the filing, ship year the period."""
    li = read(spark, sf, "lineitem").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(
        F.col("o_custkey").alias("cik"), F.expr(_TAG).alias("tag"),
        F.expr(_DDATE).alias("ddate"), F.expr(_QTRS).alias("qtrs"),
        F.round("l_extendedprice", 2).alias("value"), F.col("o_orderkey").alias("adsh"),
        F.to_date("o_orderdate").alias("filed"), F.col("l_linenumber").alias("line"))


_TAG = ("CASE WHEN l_linenumber % 7 IN (0, 1) THEN 'Revenues' WHEN l_linenumber % 7 = 2 THEN 'SalesRevenueNet' "
        "WHEN l_linenumber % 7 IN (3, 4) THEN 'OperatingIncomeLoss' WHEN l_linenumber % 7 = 5 THEN 'NetIncomeLoss' "
        "ELSE 'Assets' END")
_DDATE = ("CASE WHEN l_linenumber % 2 = 0 THEN make_date(CAST(year(o_orderdate) AS INT) - 1, 9, 30) "
          "ELSE make_date(CAST(year(o_orderdate) AS INT) - 1, 12, 31) END")
_QTRS = "CASE WHEN l_linenumber % 7 = 6 THEN 0 WHEN l_linenumber % 2 = 0 THEN 3 ELSE 4 END"
FACTS = f"""facts AS (SELECT o_custkey AS cik, {_TAG} AS tag, {_DDATE} AS ddate, {_QTRS} AS qtrs,
  round(l_extendedprice, 2) AS value, o_orderkey AS adsh, CAST(o_orderdate AS DATE) AS filed, l_linenumber AS line
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# -- membership, listings, calls ----------------------------------------------------------------

def membership(spark, sf) -> DataFrame:
    """From the first to the dearest line of each supplier-and-year; every fifth supplier's last span is open."""
    m = read(spark, sf, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("fy")).agg(
        F.to_date(F.min("l_shipdate")).alias("start_date"), F.to_date(F.max_by("l_shipdate", F.struct("l_extendedprice", "l_shipdate"))).alias("end_date"))
    return m.select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), "start_date",
                    F.when(~((F.col("l_suppkey") % 5 == 0) & (F.col("fy") >= 2000)), F.col("end_date")).alias("end_date"))


MEMBERSHIP = """membership AS (SELECT 'S' || l_suppkey AS ticker, CAST(min(l_shipdate) AS DATE) AS start_date,
  CASE WHEN NOT (l_suppkey % 5 = 0 AND year(l_shipdate) >= 2000) THEN CAST(arg_max(l_shipdate, struct_pack(a := l_extendedprice, b := l_shipdate)) AS DATE) END AS end_date
  FROM lineitem GROUP BY l_suppkey, year(l_shipdate))"""


def listings(spark, sf) -> DataFrame:
    """First order date per customer is the listing; gone where the last order is early. Names repeat."""
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("_a"), F.to_date(F.max("o_orderdate")).alias("_b"), F.count(F.lit(1)).alias("n"))
    k = F.col("o_custkey")
    return o.select(
        F.concat(F.lit("C"), F.floor(k / 3)).alias("symbol"), k.alias("row_id"),
        F.when(k % 11 != 0, _pick(("NYSE", "NASDAQ", "NYSE ARCA", "BATS"), k % 4)).alias("exchange"),
        F.when(k % 6 == 0, "ETF").otherwise("Stock").alias("asset_type"),
        F.when(k % 17 != 0, F.col("_a")).alias("ipo_date"),
        F.when(F.col("_b") < F.lit("2000-01-01").cast("date"), F.col("_b")).alias("delist_date"))


LISTINGS = f"""listings AS (SELECT 'C' || CAST(floor(o_custkey / 3.0) AS BIGINT) AS symbol, o_custkey AS row_id,
  CASE WHEN o_custkey % 11 <> 0 THEN {_pick_sql(("NYSE", "NASDAQ", "NYSE ARCA", "BATS"), 'o_custkey % 4')} END AS exchange,
  CASE WHEN o_custkey % 6 = 0 THEN 'ETF' ELSE 'Stock' END AS asset_type,
  CASE WHEN o_custkey % 17 <> 0 THEN CAST(min(o_orderdate) AS DATE) END AS ipo_date,
  CASE WHEN max(o_orderdate) < TIMESTAMP '2000-01-01' THEN CAST(max(o_orderdate) AS DATE) END AS delist_date
  FROM orders GROUP BY o_custkey)"""

_ACTION = ("CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_custkey % 3 = 0 THEN 'Buy in October' WHEN o_custkey % 3 = 1 THEN 'buy' "
           "ELSE 'Buy on a pullback' END WHEN 'O' THEN 'Pass for now' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'Watch' "
           "ELSE 'no action' END END")


def calls(spark, sf) -> DataFrame:
    """Every order is a dated call on one supplier, with a price, a falsifier, a stop and maybe a horizon."""
    n = read(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    o = read(spark, sf, "orders").withColumn("_k", F.col("o_orderkey") % n)
    px = F.round(1000 + F.col("o_totalprice") % 1000, 2)
    cents = F.col("o_orderkey") % 400
    return o.select(
        F.concat(F.lit("S"), F.col("_k")).alias("ticker"), F.to_date("o_orderdate").alias("date"),
        F.col("o_orderkey").alias("pos"), F.expr(_ACTION).alias("action"),
        F.when(F.col("o_orderkey") % 9 != 0, px).alias("price_at_call"),
        F.when(F.col("o_orderkey") % 4 != 1, F.concat(F.lit("a close under $"), F.format_string("1,%03d.50", cents.cast("int"))))
        .otherwise(F.lit("revenue under $3.6 billion")).alias("wrong_if"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(1000.0) + F.col("o_orderkey") % 50).alias("stop"),
        F.when(F.col("o_orderkey") % 3 == 0, F.expr("CAST(CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 15 ELSE 20 END AS INT)")).alias("horizon_days"))


CALLS = f"""calls AS (SELECT 'S' || (o_orderkey % (SELECT count(*) FROM supplier)) AS ticker, CAST(o_orderdate AS DATE) AS date,
  o_orderkey AS pos, {_ACTION} AS action,
  CASE WHEN o_orderkey % 9 <> 0 THEN round(1000 + o_totalprice % 1000, 2) END AS price_at_call,
  CASE WHEN o_orderkey % 4 <> 1 THEN 'a close under $1,' || lpad(CAST(o_orderkey % 400 AS VARCHAR), 3, '0') || '.50'
    ELSE 'revenue under $3.6 billion' END AS wrong_if,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(1000.0 AS DOUBLE) + o_orderkey % 50 END AS stop,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 15 ELSE 20 END AS INT) END AS horizon_days
  FROM orders)"""


# -- rebalances -----------------------------------------------------------------------------------

SCORE = fix("sum(CAST(round(l_discount * 100) AS BIGINT)) / (CAST(100 AS DOUBLE) * count(*))", 3)


def rebalances(spark, sf) -> DataFrame:
    """Per week and supplier: the week's mean discount as score, the next week's price move as return."""
    from pyspark.sql import Window
    li = read(spark, sf, "lineitem")
    p = li.groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), F.col("l_suppkey").alias("k"),
                   F.to_date(F.date_trunc("month", "l_shipdate")).alias("date")).agg(
        F.expr(CLOSE).alias("close"),
        F.expr(SCORE).alias("score"))
    nxt = F.lead("close").over(Window.partitionBy("ticker").orderBy("date"))
    j = p.withColumn("fwd_ret", F.when((F.col("k") + F.month("date")) % 17 != 0, nxt / F.col("close") - 1))
    c = companies(spark, sf).select("ticker", "sector")
    return j.join(c, "ticker").select(
        "date", "ticker", "score", "fwd_ret", "sector",
        F.expr("CASE k % 4 WHEN 0 THEN array('compounder') WHEN 1 THEN array('cyclical_turn') "
               "WHEN 2 THEN array('compounder', 'cyclical_turn') ELSE array() END").cast("array<string>").alias("buckets"))


REBALANCES = f"""{COMPANIES}, rb0 AS (SELECT 'S' || l_suppkey AS ticker, l_suppkey AS k,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS date, {CLOSE} AS close,
  {SCORE} AS score FROM lineitem GROUP BY 1, 2, 3),
rebalances AS (SELECT date, r.ticker, score,
  CASE WHEN (k + month(date)) % 17 <> 0 THEN lead(close) OVER (PARTITION BY r.ticker ORDER BY date) / close - 1 END AS fwd_ret,
  sector, CASE k % 4 WHEN 0 THEN ['compounder'] WHEN 1 THEN ['cyclical_turn'] WHEN 2 THEN ['compounder', 'cyclical_turn']
  ELSE CAST([] AS VARCHAR[]) END AS buckets FROM rb0 r JOIN companies c ON c.ticker = r.ticker)"""


def pctl_sql(v: str, part: str, asc: bool = True) -> str:
    """W1 as SQL over a source whose rows all have a non-null ``v``."""
    p = f"PARTITION BY {part}" if part else ""
    d = "" if asc else " DESC"
    return (f"(CASE WHEN count(*) OVER ({p}) > 1 THEN (rank() OVER ({p} ORDER BY {v}{d}) - 1 + "
            f"(count(*) OVER ({p + ',' if p else 'PARTITION BY'} {v}) - 1) / CAST(2.0 AS DOUBLE)) / (count(*) OVER ({p}) - 1) ELSE 0.5 END)")
