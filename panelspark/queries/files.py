"""Source scans, sinks, payloads, text and streams: rows of the given tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import text as tx
from panelspark.plans import facts as fx
from panelspark.plans import figures as fg
from panelspark.plans import watch as wa
from panelspark.queries import r6, register, rnd
from panelspark.queries import tables as t
from panelspark.session import cut_lineage, scratch_path
from panelspark.sources import payloads as pl
from panelspark.sources import sinks
from panelspark.sources import tables as st
from panelspark.sources import texts
from panelspark.streaming import alerts as sm


def as_text(df):
    return df.select([F.col(c).cast("string").alias(c) for c in df.columns])


def put(spark, df, kind, **opt):
    path = scratch_path(spark, kind)
    w = df.write
    for k, v in opt.items():
        w = w.option(k, v)
    {"csv": w.csv, "json": w.json, "text": w.text}[kind](path)
    return path


# -- delimited files --------------------------------------------------------------------------------

@register("scan_screen_csv", "SELECT upper('s' || s_suppkey) AS ticker, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS score, CAST(s_nationkey AS INT) AS years, s_suppkey % 2 = 0 AS net_cash FROM supplier")
def scan_screen_csv(spark, sf):
    s = t.read(spark, sf, "supplier")
    d = s.select(F.concat(F.lit("s"), "s_suppkey").alias("ticker"), F.when(F.col("s_suppkey") % 5 == 0, "NaN").otherwise(F.col("s_acctbal").cast("string")).alias("score"),
                 F.concat(F.col("s_nationkey"), F.lit(".0")).alias("years"), F.when(F.col("s_suppkey") % 2 == 0, "True").otherwise("False").alias("net_cash"), F.lit("x").alias("other"))
    return st.screen_rows(spark, put(spark, d, "csv", header=True), {"score": "double", "years": "int", "net_cash": "boolean"})


@register("scan_long_bars_csv", f"WITH {t.DAILY} SELECT ticker, session, CASE WHEN day(session) <> 3 THEN close END AS close, volume FROM daily")
def scan_long_bars(spark, sf):
    d = t.daily(spark, sf)
    close = F.when(F.dayofmonth("session") == 3, "").otherwise(F.col("close").cast("string"))
    d = d.select(F.col("session").cast("string").alias("date"), F.lit("").alias("open"), F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"), close.alias("close"),
                 F.col("volume").cast("string").alias("volume"), F.lower("ticker").alias("Name"))
    return st.ohlcv_rows(spark, put(spark, d, "csv", header=True)).select("ticker", "session", "close", "volume")


@register("scan_scaled_bars", f"WITH {t.WEEKLY} SELECT session, {r6('CAST(floor(max(close) * 100 + 0.5) AS BIGINT) / 100.0::DOUBLE', 2)} AS close FROM weekly GROUP BY 1")
def scan_scaled_bars(spark, sf):
    w = t.weekly(spark, sf).groupBy("session").agg((F.floor(F.max("close") * 100 + 0.5) * 100).cast("string").alias("c"))
    d = w.select(F.concat(F.date_format("session", "yyyyMMdd"), F.lit(" 00:00")).alias("s"), F.col("c").alias("o"), F.col("c").alias("h"), F.col("c").alias("l"), "c", F.lit("10").alias("v"))
    return st.scaled_bars(spark, put(spark, d, "csv"), "ALL").select("session", rnd("close", 2).alias("close"))


@register("scan_factor_rows", f"WITH {t.WEEKLY} SELECT session AS factor_date, CAST(count(*) AS DOUBLE) AS price_factor FROM weekly GROUP BY 1")
def scan_factor_rows(spark, sf):
    w = t.weekly(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    d = w.select(F.date_format("session", "yyyyMMdd").alias("d"), F.col("n").cast("string").alias("p"), F.lit("1").alias("s"), F.lit("0").alias("r"))
    head = spark.range(1).select(F.lit("date").alias("d"), F.lit("x").alias("p"), F.lit("x").alias("s"), F.lit("x").alias("r"))
    return st.factor_rows(spark, put(spark, d.unionByName(head), "csv"), "ALL").select("factor_date", "price_factor")


@register("scan_adjusted_prices", f"WITH {t.WEEKLY} SELECT session, {r6('max(close) / 2', 4)} AS close FROM weekly GROUP BY 1")
def scan_adjusted_prices(spark, sf):
    """One name in the layout that carries an adjusted close beside the plain one."""
    w = t.weekly(spark, sf).groupBy("session").agg(F.max("close").alias("c"))
    d = w.select(F.col("session").alias("Date"), *[F.col("c").alias(x) for x in ("Open", "High", "Low", "Close")], (F.col("c") / 2).alias("Adj Close"), F.lit(1.0).alias("Volume"))
    return st.adjusted_price_rows(spark, put(spark, d, "csv", header=True), "ALL").select("session", rnd("close", 4).alias("close"))


@register("scan_membership", f"WITH {t.MEMBERSHIP} SELECT ticker || '-A' AS ticker, start_date, end_date FROM membership")
def scan_membership(spark, sf):
    m = t.membership(spark, sf).withColumn("ticker", F.lower(F.concat("ticker", F.lit(".a"))))
    return st.membership_rows(spark, put(spark, as_text(m), "csv", header=True, nullValue=""))


@register("scan_listings", f"WITH {t.LISTINGS} SELECT symbol, exchange, asset_type, ipo_date, delist_date FROM listings")
def scan_listings(spark, sf):
    l = t.listings(spark, sf)
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    d = l.select("symbol", F.lit("n").alias("name"), n("exchange").alias("exchange"), F.col("asset_type").alias("assetType"), n("ipo_date").alias("ipoDate"), n("delist_date").alias("delistingDate"), F.lit("Active").alias("status"))
    return st.listing_rows(spark, put(spark, d, "csv", header=True)).select("symbol", "exchange", "asset_type", "ipo_date", "delist_date")


@register("scan_wide_quotes", "SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS session, max(l_quantity) AS close FROM lineitem GROUP BY 1, 2")
def scan_wide_quotes(spark, sf):
    li = t.read(spark, sf, "lineitem").withColumns({"k": F.concat("l_returnflag", "l_linestatus"), "date": F.to_date("l_shipdate").cast("string")})
    wide = li.groupBy("date").pivot("k", ["AF", "AO", "NF", "NO", "RF", "RO"]).agg(F.max("l_quantity"))
    return st.wide_quotes(spark, put(spark, wide, "csv", header=True)).where("close is not null")


@register("normalise_prices", f"WITH {t.DAILY}, x AS (SELECT ticker, session, CASE WHEN day(session) <= 10 THEN close / 2 ELSE close END AS close FROM daily), r AS (SELECT DISTINCT 'S' || (s_suppkey + 4) AS ticker FROM supplier) SELECT r.ticker, x.session, x.close FROM r LEFT JOIN x ON x.ticker = r.ticker")
def normalise_prices(spark, sf):
    d = t.daily(spark, sf).withColumns({"adj_close": F.when(F.dayofmonth("session") <= 10, F.col("close") / 2), "_at": F.lit(1)})
    early = d.withColumns({"close": F.lit(-1.0), "adj_close": F.lit(-1.0), "_at": F.lit(0)})
    req = t.read(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey") + 4).alias("ticker"))
    return st.normalised_prices(d.unionByName(early), req)


@register("scan_filing_set", "SELECT CAST(o_custkey AS BIGINT) AS cik, l_returnflag AS tag, count(*) AS n, max(l_extendedprice) AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 5 GROUP BY 1, 2")
def scan_filing_set(spark, sf):
    root = scratch_path(spark, "filings")
    o, li = t.read(spark, sf, "orders"), t.read(spark, sf, "lineitem")
    d8 = lambda c: F.date_format(c, "yyyyMMdd")
    sub = o.select(F.col("o_orderkey").alias("adsh"), F.col("o_custkey").alias("cik"), F.lit('He said "x').alias("name"), F.lit("10-K").alias("form"), d8("o_orderdate").alias("period"), F.year("o_orderdate").alias("fy"), F.lit("FY").alias("fp"), d8("o_orderdate").alias("filed"))
    num = li.select(F.col("l_orderkey").alias("adsh"), F.col("l_returnflag").alias("tag"), F.lit("us-gaap/2023").alias("version"), F.lit("").alias("coreg"), d8("l_shipdate").alias("ddate"), F.lit("4").alias("qtrs"), F.lit("USD").alias("uom"),
                    F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice").cast("string")).otherwise("").alias("value"))
    for name, df in (("sub", sub), ("num", num)):
        for k, quarter in enumerate(("2023q3", "2023q4")):
            as_text(df.where(F.col("adsh").cast("long") % 2 == k)).write.option("header", True).option("sep", "\t").option("quote", "").option("emptyValue", "").csv(f"{root}/{quarter}/{name}.txt")
    sub, num = st.filing_set(spark, root)
    f = fx.clean_facts(num, sub)
    return f.groupBy("cik", "tag").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


# -- json payloads -------------------------------------------------------------------------------------

@register("scan_statement_json", f"WITH {t.STATEMENTS} SELECT ticker, period_end, revenue, coalesce(diluted_shares, shares_outstanding) AS shares FROM statements")
def scan_statement_json(spark, sf):
    s = t.statements(spark, sf)
    line = F.map_from_arrays(F.array(*[F.lit(x) for x in ("Total Revenue", "Diluted Shares", "Ordinary Shares")]), F.array("revenue", "diluted_shares", "shares_outstanding"))
    j = s.groupBy("ticker").agg(F.map_from_entries(F.collect_list(F.struct(F.col("period_end").cast("string"), line))).alias("years"))
    d = j.select("ticker", F.lit("2026-09-04").alias("pulled"), F.struct(F.lit("n").alias("longName"), F.lit("USD").alias("currency")).alias("info"), "years")
    r = pl.statements(spark, put(spark, d, "json"))
    return r.select("ticker", "period_end", pl.first_line("lines", "Total Revenue").alias("revenue"), pl.first_line("lines", "Diluted Shares", "Ordinary Shares").alias("shares"))


@register("scan_company_facts", "SELECT CAST(o_custkey AS BIGINT) AS cik, l_returnflag AS tag, count(*) AS n, max(l_extendedprice) AS top, count(*) FILTER (l_linenumber % 2 = 0) AS canonical FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 6 GROUP BY 1, 2")
def scan_company_facts(spark, sf):
    j = t.read(spark, sf, "lineitem").join(t.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = lambda c: F.date_format(c, "yyyy-MM-dd")
    fact = F.struct(d("o_orderdate").alias("start"), d("l_shipdate").alias("end"), F.when(F.col("l_linenumber") != 6, F.col("l_extendedprice")).alias("val"), F.col("l_orderkey").cast("string").alias("accn"),
                    F.lit("10-K").alias("form"), d("o_orderdate").alias("filed"), F.when(F.col("l_linenumber") % 2 == 0, "CY").alias("frame"))
    units = j.groupBy("o_custkey", "l_returnflag").agg(F.collect_list(fact).alias("f")).select("o_custkey", "l_returnflag", F.struct(F.create_map(F.lit("USD"), "f").alias("units")).alias("u"))
    tags = units.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "u"))).alias("tags"))
    doc = tags.select(F.col("o_custkey").alias("cik"), F.create_map(F.lit("us-gaap"), "tags").alias("facts"))
    r = pl.company_facts(spark, put(spark, doc, "json"))
    return r.groupBy("cik", "tag").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.count("frame").alias("canonical"))


@register("fact_period_kinds", """SELECT CASE WHEN l_linenumber = 7 THEN 'instant' WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 330 AND 400 THEN 'year' WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 60 AND 120 THEN 'quarter' ELSE 'other' END AS kind, count(*) AS n
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def fact_period_kinds(spark, sf):
    j = t.read(spark, sf, "lineitem").join(t.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.when(F.col("l_linenumber") != 7, F.to_date("o_orderdate"))
    return j.groupBy(fx.duration_kind(start, F.to_date("l_shipdate")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("scan_filing_index", """WITH f AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accession, CASE o_orderkey % 3 WHEN 0 THEN '8-K' WHEN 1 THEN '10-K/A' ELSE 'S-1' END AS form, CAST(o_orderdate AS DATE) AS filed FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed DESC, accession DESC) AS rn FROM f WHERE form <> 'S-1') SELECT cik, accession, form, filed, form = '8-K' AS earnings FROM r WHERE rn <= 4""")
def scan_filing_index(spark, sf):
    o = t.read(spark, sf, "orders").select("o_custkey", F.struct(F.col("o_orderkey").cast("string").alias("a"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN '8-K' WHEN 1 THEN '10-K/A' ELSE 'S-1' END").alias("f"),
                                                                 F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '2.02, 9.01' ELSE '' END").alias("i")).alias("r"))
    g = o.groupBy("o_custkey").agg(F.collect_list("r").alias("l"))
    col = lambda k: F.transform("l", lambda x: x[k])
    doc = g.select(F.col("o_custkey").cast("string").alias("cik"), F.struct(F.struct(col("a").alias("accessionNumber"), col("f").alias("form"), col("d").alias("filingDate"), col("i").alias("items")).alias("recent")).alias("filings"))
    r = pl.recent_filings(pl.filing_index(spark, put(spark, doc, "json")), ("8-K", "10-K"), 4)
    return r.select("cik", "accession", "form", "filed", wa.is_earnings(F.col("form"), F.col("items")).alias("earnings"))


# filings of a customer by date: the newest four are recent, older ones stand on pages of three; every fifth customer's first page is not there
PAGED = """f AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS filed, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) - 1 AS i FROM orders),
 p AS (SELECT *, CASE WHEN i < 4 THEN 'recent' ELSE 'CIK' || o_custkey || '-' || ((i - 4) // 3) || '.json' END AS page, i >= 4 AND (i - 4) // 3 = 0 AND o_custkey % 5 = 0 AS gone FROM f)"""


def paged(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("filed"), F.desc("o_orderkey"))
    o = t.read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("filed")).withColumn("i", F.row_number().over(w) - 1)
    o = o.withColumn("n", F.when(F.col("i") >= 4, F.floor((F.col("i") - 4) / 3)).otherwise(-1)).withColumn("page", F.when(F.col("i") < 4, "recent").otherwise(F.concat(F.lit("CIK"), "o_custkey", F.lit("-"), "n", F.lit(".json"))))
    day = F.date_format("filed", "yyyy-MM-dd")
    one = F.struct(F.col("o_orderkey").cast("string").alias("a"), day.alias("d"), F.concat(day, F.lit("T12:30:00.000Z")).alias("t"))
    g = cut_lineage(o.groupBy("o_custkey", "page", "n").agg(F.collect_list(one).alias("l"), F.min(day).alias("lo"), F.max(day).alias("hi"), F.count(F.lit(1)).alias("c")))
    col = lambda k: F.transform("l", lambda x: x[k])
    arrays = [col("a").alias("accessionNumber"), F.transform("l", lambda x: F.lit("8-K")).alias("form"), col("d").alias("filingDate"), col("t").alias("acceptanceDateTime")]
    files = F.collect_list(F.when(F.col("page") != "recent", F.struct(F.col("page").alias("name"), F.col("c").alias("filingCount"), F.col("lo").alias("filingFrom"), F.col("hi").alias("filingTo"))))
    main = g.withColumn("r", F.when(F.col("page") == "recent", F.struct(*arrays))).groupBy("o_custkey").agg(F.first("r", ignorenulls=True).alias("recent"), files.alias("files"))
    main = main.select(F.col("o_custkey").cast("string").alias("cik"), F.struct("recent", "files").alias("filings"))
    there = g.where("page <> 'recent' AND NOT (n = 0 AND o_custkey % 5 = 0)").select(*arrays, F.col("page").alias("document"))
    return pl.filing_pages(spark, put(spark, main, "json"), put(spark, there, "json"), F.col("document"))


@register("filing_pages_audit", f"WITH {PAGED} SELECT cik, page, count(*) AS said_n, CASE WHEN NOT any_value(gone) THEN count(*) END AS read_n, CASE WHEN any_value(gone) THEN 'missing' ELSE 'ok' END AS status FROM p WHERE page <> 'recent' GROUP BY 1, 2")
def filing_pages_audit(spark, sf):
    return paged(spark, sf)[1]


@register("filing_pages_rows", f"WITH {PAGED} SELECT cik, CAST(o_orderkey AS VARCHAR) AS accession, page, filed, CAST(filed AS TIMESTAMP) + INTERVAL 12 HOUR + INTERVAL 30 MINUTE AS accepted FROM p WHERE NOT gone")
def filing_pages_rows(spark, sf):
    return paged(spark, sf)[0].select("cik", "accession", "page", "filed", "accepted")


@register("latest_two_earnings_filings", "WITH r AS (SELECT o_custkey AS cik, o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filed, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS rn FROM orders) SELECT cik, accession, filed, CASE rn WHEN 1 THEN 'current' ELSE 'prior' END AS side FROM r WHERE rn <= 2")
def latest_two(spark, sf):
    o = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("filed"))
    return fg.latest_two(o).select("cik", "accession", "filed", "side")


@register("scan_ticker_map", "SELECT 'S' || s_suppkey AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name AS title FROM supplier")
def scan_ticker_map(spark, sf):
    s = t.read(spark, sf, "supplier")
    one = F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("s"), "s_suppkey").alias("ticker"), F.col("s_name").alias("title"))
    docs = s.groupBy((F.col("s_suppkey") % 4).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), one)))).alias("value"))
    return pl.ticker_map(spark, put(spark, docs.select("value").repartition(4), "text"))


@register("exhibit_choice", "WITH d AS (SELECT o_custkey AS cik, o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'EX-99.1' WHEN 1 THEN 'EX-99.2' WHEN 2 THEN 'EX-10' ELSE '' END AS ty, CASE o_orderkey % 3 WHEN 0 THEN 'q3_ex991.htm' ELSE 'main.htm' END AS nm FROM orders), p AS (SELECT *, CASE WHEN ty = 'EX-99.1' THEN 1 WHEN ty = 'EX-99.2' THEN 2 WHEN starts_with(ty, 'EX-99') THEN 3 WHEN nm = 'q3_ex991.htm' THEN 4 END AS pr FROM d) SELECT cik, arg_min(id, pr * 1000000000::BIGINT + id) AS id, CAST(min(pr) AS INT) AS priority FROM p WHERE pr IS NOT NULL GROUP BY 1")
def exhibit_choice(spark, sf):
    d = t.read(spark, sf, "orders").select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("id"), F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'EX-99.1' WHEN 1 THEN 'EX-99.2' WHEN 2 THEN 'EX-10' ELSE '' END").alias("ty"),
                                           F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'q3_ex991.htm' ELSE 'main.htm' END").alias("nm"))
    d = d.withColumn("p", wa.exhibit_priority(F.col("ty"), F.col("nm"))).where("p is not null")
    return d.groupBy("cik").agg(F.min_by("id", F.struct("p", "id")).alias("id"), F.min("p").alias("priority"))


@register("quote_payloads", f"""WITH q AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS c, CASE WHEN event_id % 14 = 0 THEN 0 ELSE value + 1 END AS pc, value + 2 AS h, CASE WHEN event_id % 5 = 0 THEN -1 ELSE value / 2 END AS l FROM events)
 SELECT id, CASE WHEN c > 0 THEN c END AS current, CASE WHEN pc > 0 THEN pc END AS previous_close, CASE WHEN c > 0 OR pc > 0 THEN CASE WHEN h > 0 THEN h END END AS high, CASE WHEN c > 0 AND l > 0 AND h > l THEN {r6('(c - l) / (h - l)')} END AS range_position FROM q""")
def quote_payloads(spark, sf):
    e = t.read(spark, sf, "events")
    body = F.to_json(F.struct(F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value")).alias("c"), F.when(F.col("event_id") % 14 == 0, 0.0).otherwise(F.col("value") + 1).alias("pc"), (F.col("value") + 2).alias("h"),
                              F.when(F.col("event_id") % 5 == 0, -1.0).otherwise(F.col("value") / 2).alias("l"), F.lit(1700000000).alias("t")))
    return pl.quotes(e.select(F.col("event_id").alias("id"), body.alias("body"))).select("id", "current", "previous_close", "high", rnd("range_position").alias("range_position"))


@register("metric_payloads", "SELECT user_id AS id, max(CASE WHEN event_id % 3 <> 0 THEN value END) AS pe, count(*) FILTER (event_id % 4 <> 0) AS n_points, arg_max(value, event_id) FILTER (event_id % 4 <> 0) AS newest FROM events GROUP BY 1")
def metric_payloads(spark, sf):
    e = t.read(spark, sf, "events")
    pt = F.struct(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("period"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))
    g = e.groupBy("user_id").agg(F.max(F.when(F.col("event_id") % 3 != 0, F.col("value"))).alias("m"), F.collect_list(pt).alias("p"))
    body = F.to_json(F.struct(F.create_map(F.lit("peTTM"), F.col("m").cast("string"), F.lit("other"), F.lit("n/a")).alias("metric"), F.create_map(F.lit("annual"), F.create_map(F.lit("eps"), "p")).alias("series")))
    s = g.select(F.col("user_id").alias("id"), body.alias("body"))
    pts = pl.metric_series(F.col("body"), "eps")
    return s.select("id", pl.metric(F.col("body"), "peNormal", "peTTM").alias("pe"), F.size(pts).cast("long").alias("n_points"), F.get(pts, F.lit(0))["v"].alias("newest"))


@register("insider_payloads", "SELECT user_id AS id, CASE WHEN event_type = 'purchase' THEN 'buy' WHEN event_type = 'click' THEN 'sale' END AS side, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS shares FROM events GROUP BY 1, 2")
def insider_payloads(spark, sf):
    e = t.read(spark, sf, "events")
    row = F.struct(F.col("event_id").alias("share"), F.expr("CASE event_type WHEN 'purchase' THEN 'p' WHEN 'click' THEN 'S' ELSE 'M' END").alias("transactionCode"))
    doc = e.groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(row).alias("data"))).alias("body")).withColumnRenamed("user_id", "id")
    r = pl.explode_rows(doc, "body", pl.INSIDER, "data")
    return r.groupBy("id", pl.insider_side(F.col("transactionCode")).alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("shares"))


@register("event_props_json", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props_json(spark, sf):
    e = t.read(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@register("feed_items", "SELECT 'A & ' || event_type || ' ' || event_id AS title, CASE WHEN event_id % 2 = 0 THEN 'g' || event_id ELSE 'http://x/' || event_id END AS guid, CAST(date_trunc('second', ts) AS TIMESTAMP) AS published FROM events")
def feed_items(spark, sf):
    e = t.read(spark, sf, "events")
    d = e.select(F.concat(F.lit("A &  "), "event_type", F.lit(" "), "event_id").alias("title"), F.concat(F.lit("http://x/"), "event_id").alias("link"),
                 F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("g"), "event_id")).otherwise("").alias("guid"),
                 F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss Z")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("pubDate"))
    path = scratch_path(spark, "rss")
    d.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return pl.feed_items(spark, path).select("title", "guid", "published")


# -- text --------------------------------------------------------------------------------------------------

# entity table of the SQL side; the ampersand, which some pages leave unclosed, is decoded last, so that no decoded sign is taken for another entity
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&#8217;": "\u2019", "&mdash;": "\u2014", "&rsquo;": "\u2019", "&hellip;": "\u2026",
            "&eacute;": "\u00e9", "&#x41;": "A", "&copy;": "\u00a9", "&euro;": "\u20ac", "&frac12;": "\u00bd", "&middot;": "\u00b7"}
_DROPS = "html"
for _t in ("head", "script", "style", "ix:header"):
    _DROPS = f"regexp_replace({_DROPS}, '<{_t}\\b.*?</{_t}\\s*>', ' ', 'gis')"
_TXT = f"regexp_replace(regexp_replace({_DROPS}, '</?(p|div|br|tr|table|h[1-6]|li|ul|ol|section)\\b[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g')"
for _n, _ch in ENTITIES.items():
    _TXT = f"replace({_TXT}, '{_n}', '{_ch.replace(chr(39), chr(39) * 2)}')"
_TXT = f"regexp_replace(regexp_replace({_TXT}, '&amp;?', '&', 'g'), '[ \\t\\x{{00A0}}]+', ' ', 'g')"
_TXT = f"array_to_string(list_transform(string_split(replace({_TXT}, chr(13), ''), chr(10)), lambda s: trim(s, ' ')), chr(10))"
_TXT = f"regexp_replace(regexp_replace({_TXT}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@register("html_to_text", f"SELECT page_id, {_TXT} AS text FROM pages")
def html_to_text(spark, sf):
    return t.read(spark, sf, "pages").select("page_id", tx.html_to_text("html").alias("text"))


SPECIAL = [n for n in [*ENTITIES, "&amp;"] if n not in ("&nbsp;", "&#39;", "&apos;")]
_MORE = " ".join(f"WHEN page_id % {len(SPECIAL)} = {i} THEN '<p>it{n}s x{n}{n} y</p>'" for i, n in enumerate(SPECIAL))


@register("html_to_text_full", f"SELECT page_id, {_TXT} AS text FROM (SELECT page_id, html || CASE {_MORE} END AS html FROM pages)")
def html_to_text_full(spark, sf):
    """Every page with one of the further entities, named, decimal and hexadecimal, at its end."""
    p = t.read(spark, sf, "pages").select("page_id", F.concat("html", F.expr(f"CASE {_MORE} END")).alias("html"))
    return p.select("page_id", tx.html_to_text("html").alias("text"))


@register("call_log_rows", """SELECT CAST(o_orderdate AS DATE) AS date, 'S' || o_custkey AS ticker, o_orderkey || ' call' AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price_at_call, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'a close under $' || o_custkey END AS wrong_if, CAST(o_orderkey % 5 + 1 AS INT) AS conviction FROM orders
 UNION ALL SELECT CAST(o_orderdate AS DATE), 'T' || o_custkey, o_orderkey || ' call', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 10.5 END, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'a close under $' || o_custkey END, CAST(o_orderkey % 5 + 1 AS INT) FROM orders WHERE o_orderkey % 2 = 0""")
def call_log_rows(spark, sf):
    o = t.read(spark, sf, "orders")
    px = F.expr("CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN '1.5' WHEN o_orderkey % 3 = 0 THEN 'n/a' WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || ' / 10.5' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END")
    entry = F.concat(F.lit("\n## "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" S"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" T"), "o_custkey")).otherwise(""), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise("  "), "o_orderkey", F.lit(" call\nPrice at call: "), px,
                     F.lit("\nThesis: words\nWrong if: "), F.when(F.col("o_orderkey") % 4 == 0, "N/A.").otherwise(F.concat(F.lit("a close under $"), "o_custkey")), F.lit("\nConviction: "), F.col("o_orderkey") % 5 + 1, F.lit("\n"))
    r = texts.call_log(spark, put(spark, o.select(entry.alias("value")), "text"))
    return r.select("date", "ticker", "title", "price_at_call", "wrong_if", "conviction")


@register("note_rows", f"WITH {t.STATEMENTS}, {t.COMPANIES} SELECT s.ticker, 'FY' || fy AS fiscal_year, {r6('coalesce(diluted_shares, shares_outstanding)', 3)} AS shares, suppkey % 97 + 1 AS rank FROM statements s JOIN companies c USING (ticker)")
def note_rows(spark, sf):
    s = t.statements(spark, sf).select("ticker", "fy", F.coalesce("diluted_shares", "shares_outstanding").alias("sh"))
    line = F.concat(F.lit("| FY"), "fy", F.lit(" | 1.0 | 50% | 20% | 0.5 | "), F.format_string("%.6f", "sh"), F.lit(" | -0.3 |"))
    g = s.groupBy("ticker").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("rows")).withColumn("k", F.substring("ticker", 2, 10).cast("long") % 97 + 1)
    doc = g.select(F.concat(F.lit("# "), "ticker", F.lit("  Company\n\nQuality rank "), "k", F.lit(" of 150, score 80.\n\n## Financials\n| Fiscal year end | a | b | c | d | e | f |\n|---|---|---|---|---|---|---|\n"), "rows", F.lit("\n\n## Sources\n- [Filing](http://x/y), read 2026-09-04\n")).alias("value"), F.col("ticker").alias("stem"))
    n = texts.parse_notes(doc)
    f = texts.note_financials(texts.note_sections(n))
    return f.where("error is null").join(n.select("ticker", F.col("quality_rank").cast("long").alias("rank")), "ticker").select("ticker", "fiscal_year", rnd("diluted_shares_m", 3).alias("shares"), "rank")


def releases(spark, sf, which: int | None = None):
    """A short release per customer from its orders; the older and the newer half of them give the two sides."""
    o = t.read(spark, sf, "orders")
    o = o if which is None else o.where(F.col("o_orderkey") % 2 == which)
    # a few bytes of an order become a text that takes long to read: short rows are spread before
    o = o.select("o_orderkey", "o_custkey", "o_totalprice").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    m = F.format_string("%.1f", F.col("o_totalprice") / 100000)
    w = F.format_string("%.1f", F.col("o_totalprice") / 100000 + 1)
    text = F.concat(F.lit("Acme Inc. reported results. For the third quarter of fiscal 2026 we expect revenue of between $"), m, F.lit(" and $"), w, F.lit(" million, up from $9.9 million. "),
                    F.when(F.col("o_custkey") % 3 == 0, "Gross margin is expected to be approximately 45.5% plus or minus 50 bps. ").otherwise("We anticipate full year diluted earnings per share of about $2.05. "),
                    F.lit("These forward-looking statements involve guidance on revenue of $1 billion. Sales were strong."))
    return o.select(F.col("o_custkey").alias("cik"), F.col("o_orderkey").alias("doc"), text.alias("text"))


@register("release_figures", """WITH o AS (SELECT o_orderkey AS doc, o_custkey AS cik, printf('%.1f', o_totalprice / 100000) AS m, printf('%.1f', o_totalprice / 100000 + 1) AS w FROM orders)
 SELECT doc, 'revenue' AS metric, 'Q3 FY2026' AS period, round(CAST(m AS DOUBLE) * 1000000, 0) AS low, round(CAST(w AS DOUBLE) * 1000000, 0) AS high, 'USD' AS unit, 'range' AS kind FROM o
 UNION ALL SELECT doc, 'gross_margin', 'unspecified', 45.0, 46.0, 'percent', 'range' FROM o WHERE cik % 3 = 0 UNION ALL SELECT doc, 'eps', 'full year', 2.05, 2.05, 'USD', 'point' FROM o WHERE cik % 3 <> 0""")
def release_figures(spark, sf):
    f = fg.extract_figures(releases(spark, sf), ["doc"])
    return f.select("doc", "metric", "period", "low", "high", "unit", "kind")


@register("document_figures", "SELECT doc_id, 'revenue' AS metric, 'FY2026' AS period, CAST(n_chars AS DOUBLE) * 1000000 AS low, CAST(n_chars AS DOUBLE) * 1000000 AS high, 'USD' AS unit, 'point' AS kind FROM documents")
def document_figures(spark, sf):
    """Whole documents with one forward-looking sentence at the very end."""
    d = t.read(spark, sf, "documents")
    d = d.withColumn("text", F.concat("text", F.lit(" The outlook: revenue of about $"), F.col("n_chars").cast("string"), F.lit(" million in fiscal 2026.")))
    return fg.extract_figures(d, ["doc_id"]).select("doc_id", "metric", "period", "low", "high", "unit", "kind")


def _items(spark, sf, which):
    o = t.read(spark, sf, "orders")
    o = o if which is None else o.where(F.col("o_orderkey") % 2 == which)
    per = F.expr("CASE o_custkey % 4 WHEN 0 THEN 'Q3 FY2026' WHEN 1 THEN 'FY2026' WHEN 2 THEN 'full year' ELSE 'September quarter' END")
    return o.groupBy(F.col("o_custkey").alias("cik"), F.expr("o_orderpriority").alias("metric"), per.alias("period")).agg(
        F.floor(F.min("o_totalprice") / 40000).cast("double").alias("low"), F.floor(F.max("o_totalprice") / 40000).cast("double").alias("high")).withColumns({
            "unit": F.expr("CASE WHEN metric = '5-LOW' THEN 'percent' ELSE 'USD' END"), "kind": F.lit("range")})


def _side(w):
    return f"""(SELECT o_custkey AS cik, o_orderpriority AS metric, CASE o_custkey % 4 WHEN 0 THEN 'Q3 FY2026' WHEN 1 THEN 'FY2026' WHEN 2 THEN 'full year' ELSE 'September quarter' END AS period, floor(min(o_totalprice) / 40000) AS low, floor(max(o_totalprice) / 40000) AS high,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'percent' ELSE 'USD' END AS unit FROM orders WHERE o_orderkey % 2 = {w} GROUP BY 1, 2, 3)"""


@register("release_diff", f"""WITH j AS (SELECT coalesce(c.cik, p.cik) AS cik, coalesce(c.metric, p.metric) AS metric, coalesce(c.period, p.period) AS period, c.cik IS NOT NULL AS hc, p.cik IS NOT NULL AS hp, (c.low + c.high) / 2 AS cm, (p.low + p.high) / 2 AS pm, c.high - c.low AS cw, p.high - p.low AS pw, c.unit FROM {_side(0)} c FULL JOIN {_side(1)} p ON c.cik = p.cik AND c.metric = p.metric AND c.period = p.period),
 k AS (SELECT *, CASE WHEN unit = 'percent' THEN 0.05::DOUBLE ELSE 0.0005::DOUBLE * greatest(abs(pm), 1e-9) END AS tol FROM j)
 SELECT cik, metric, period, CASE WHEN NOT hp THEN 'introduced' WHEN NOT hc AND (starts_with(period, 'Q') OR ends_with(period, ' quarter')) THEN 'lapsed' WHEN NOT hc THEN 'not repeated' WHEN abs(cm - pm) <= tol AND abs(cw - pw) <= tol THEN 'reiterated' WHEN abs(cm - pm) <= tol AND cw < pw THEN 'narrowed' WHEN abs(cm - pm) <= tol THEN 'widened' WHEN cm > pm THEN 'raised' ELSE 'lowered' END AS change FROM k""")
def release_diff(spark, sf):
    return fg.diff_items(_items(spark, sf, 0), _items(spark, sf, 1), ["cik"]).select("cik", "metric", "period", "change")


# -- sinks ---------------------------------------------------------------------------------------------------

@register("snapshot_archive", f"WITH {t.DAILY} SELECT date_trunc('year', session)::DATE AS snapshot_date, ticker, max(close) AS score FROM daily GROUP BY 1, 2")
def snapshot_archive(spark, sf):
    root = scratch_path(spark, "archive")
    d = cut_lineage(t.daily(spark, sf).groupBy(F.to_date(F.date_trunc("year", "session")).alias("day"), "ticker").agg(F.max("close").alias("score")))
    for y in sorted(str(r[0]) for r in d.select("day").distinct().collect()):         # an archive run each, one per year of the panel
        one = d.where(F.col("day") == y).select("ticker", "score")
        sinks.archive_snapshot(one, root, y)
        sinks.archive_snapshot(one.withColumn("score", F.lit(-1.0)), root, y)        # already there: nothing happens
    return sinks.read_archive(spark, root).select(F.col("snapshot_date").cast("date").alias("snapshot_date"), "ticker", "score")


@register("snapshot_archive_variants", f"""WITH {t.DAILY}, d AS (SELECT date_trunc('year', session)::DATE AS day, ticker, max(close) AS hi, min(close) AS lo FROM daily GROUP BY 1, 2),
 s AS (SELECT day, ticker, 'high' AS variant, hi AS score FROM d UNION ALL SELECT day, ticker, 'low', lo FROM d WHERE CAST(substr(ticker, 2) AS BIGINT) % 3 <> 0)
 SELECT day AS snapshot_date, variant, count(*) AS n, count(DISTINCT ticker) AS n_tickers, CAST(sum(CAST(round(score * 10000) AS BIGINT)) AS BIGINT) AS total, (SELECT count(*) FROM s z WHERE z.day = s.day) AS manifest_rows, true AS intact FROM s GROUP BY 1, 2""")
def snapshot_archive_variants(spark, sf):
    root = scratch_path(spark, "variants")
    d = t.daily(spark, sf).groupBy(F.to_date(F.date_trunc("year", "session")).alias("day"), "ticker").agg(F.max("close").alias("high"), F.min("close").alias("low"))
    d = cut_lineage(d.unpivot(["day", "ticker"], ["high", "low"], "variant", "score").where("variant = 'high' OR CAST(substr(ticker, 2) AS BIGINT) % 3 <> 0"))
    days = sorted(str(r[0]) for r in d.select("day").distinct().collect())         # an archive run each, one per year of the panel
    for y in days:
        one = d.where(F.col("day") == y).select("variant", "ticker", "score")
        sinks.stage_snapshot({"scores": one.withColumn("score", F.lit(-1.0))}, root, y)          # broken off before its commit: nobody sees it
        sinks.archive_snapshot(one, root, y)
    rows, tickers = sinks.read_archive(spark, root), sinks.read_archive(spark, root, "tickers")
    kept = sinks.manifest(spark, root).select(F.col("day").cast("date").alias("snapshot_date"), F.inline("tables")).where("name = 'scores'").select("snapshot_date", F.col("n_rows").alias("manifest_rows"), "content_sha")
    # the manifest's hash is that of the rows a reader gets
    now = rows.select("snapshot_date", F.xxhash64("variant", "ticker", "score").cast("decimal(38,0)").alias("_h")).groupBy("snapshot_date").agg(sinks.row_sha().alias("now"))
    g = rows.groupBy("snapshot_date", "variant").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("score") * 10000).cast("long")).alias("total"))
    g = g.join(tickers.groupBy("snapshot_date", "variant").agg(F.count(F.lit(1)).alias("n_tickers")), ["snapshot_date", "variant"]).join(kept.join(now, "snapshot_date"), "snapshot_date")
    return g.select("snapshot_date", "variant", "n", "n_tickers", "total", "manifest_rows", (F.col("content_sha") == F.col("now")).alias("intact"))


@register("panel_write_read", f"WITH {t.DAILY} SELECT ticker, session, close FROM daily")
def panel_write_read(spark, sf):
    path = scratch_path(spark, "panel")
    sinks.write_panel(t.daily(spark, sf), path)
    return spark.read.parquet(path).select("ticker", "session", "close")


@register("quotes_latest", f"WITH {t.DAILY} SELECT ticker, arg_max(close, session) AS close, max(session) AS date FROM daily GROUP BY 1")
def quotes_latest(spark, sf):
    root = scratch_path(spark, "quotes")
    sinks.write_quotes(t.daily(spark, sf), root)
    return spark.read.parquet(f"{root}/latest").select("ticker", "close", "date")


@register("screen_sink", "SELECT s_name AS name, s_acctbal AS score, DATE '2026-09-05' AS pulled FROM supplier UNION ALL SELECT s_name, s_acctbal, DATE '2026-09-04' FROM supplier")
def screen_sink(spark, sf):
    root = scratch_path(spark, "screen")
    d = t.read(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"))
    sinks.write_screen(d, root, "2026-09-04")
    sinks.write_screen(d, root, "2026-09-05")
    return spark.read.parquet(f"{root}/history").select("name", "score", F.col("pulled").cast("date").alias("pulled"))


@register("result_log", "SELECT p_brand AS arm, count(*) AS n, 'train' AS split FROM part WHERE p_size < 25 GROUP BY 1")
def result_log(spark, sf):
    root = scratch_path(spark, "log")
    p = t.read(spark, sf, "part")
    for split, cond in (("train", "p_size < 25"), ("test", "p_size >= 25")):
        sinks.append_results(p.where(cond).groupBy(F.col("p_brand").alias("arm")).agg(F.count(F.lit(1)).alias("n")).withColumn("split", F.lit(split)), root, "2026-09-04T00:00:00Z")
    return sinks.read_results(spark, root, "arm string, n bigint, split string", "train")


@register("provenance_gate", """WITH i AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 3 = 0 THEN true WHEN o_custkey % 3 = 1 AND o_orderkey % 2 = 0 THEN NULL WHEN o_custkey % 3 = 2 AND o_orderkey % 2 = 0 THEN false ELSE true END AS live, o_totalprice AS v FROM orders),
 g AS (SELECT k, count(*) FILTER (live IS NULL) AS u, count(*) FILTER (NOT live) AS d, max(v) AS v FROM i GROUP BY 1) SELECT k, u = 0 AND d = 0 AS is_real, CASE WHEN u = 0 AND d = 0 THEN 'real' WHEN d > 0 THEN 'not real' ELSE 'unknown' END AS status, CASE WHEN u = 0 AND d = 0 THEN v END AS v FROM g""")
def provenance_gate(spark, sf):
    o = t.read(spark, sf, "orders")
    live = F.expr("CASE WHEN o_custkey % 3 = 0 THEN true WHEN o_custkey % 3 = 1 AND o_orderkey % 2 = 0 THEN NULL WHEN o_custkey % 3 = 2 AND o_orderkey % 2 = 0 THEN false ELSE true END")
    return st.provenance_gate(o.select(F.col("o_custkey").alias("k"), live.alias("live"), F.col("o_totalprice").alias("v")), "k", "v")


# -- intraday and streams -----------------------------------------------------------------------------------------

def bars(spark, sf):
    e = t.read(spark, sf, "events")
    return e.select(F.concat(F.lit("U"), "user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"), (F.col("value") + 1).alias("high"), (F.col("value") - 1).alias("low"), F.col("value").alias("open"), F.col("event_id").alias("arrival"))


# early January to the end of the month: New York is five hours behind
LOCAL = "CAST(ts - INTERVAL 5 HOUR AS DATE)"


@register("intraday_last_print", f"""WITH b AS (SELECT 'U' || user_id AS ticker, ts, {LOCAL} AS session, value AS close FROM events WHERE ts < TIMESTAMP '2024-01-20 15:00:00'), l AS (SELECT ticker, max(session) AS s FROM b GROUP BY 1)
 SELECT b.ticker, l.s AS session, arg_max(close, ts) FILTER (session = l.s) AS price, max(close) FILTER (session = l.s) + 1 AS session_high, min(close) FILTER (session = l.s) - 1 AS session_low, count(*) FILTER (session = l.s) AS bars, arg_max(close, ts) FILTER (session < l.s) AS prior_close FROM b JOIN l ON l.ticker = b.ticker GROUP BY 1, 2""")
def intraday_last_print(spark, sf):
    p = sm.last_prints(sm.intraday_bars(bars(spark, sf)), "2024-01-20 15:00:00")
    return p.select("ticker", "session", "price", "session_high", "session_low", "bars", "prior_close")


def await_all(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def run_stream(df, path, spark, mode="append"):
    await_all(df.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).outputMode(mode).start())
    return spark.read.schema(df.schema).parquet(path)


SPAN = "60 days"       # longer than the events, whose files each cover all of them: no print is late beyond recall
FILES = 4              # of a batch, each written by a task of its own; more where a file would hold over a million rows


def events_of(spark, sf):
    return t.read(spark, sf, "events").select(F.concat(F.lit("U"), "user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("kind"), F.col("value").alias("close"))


def in_batches(spark, e, batch):
    """Rows as a stream of four batches in the order of ``batch`` (0 to 3); each has the same number of files."""
    path = scratch_path(spark, "events")
    files = max(FILES, -(-e.count() // 4_000_000))
    for k in range(4):
        e.where(batch == k).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)


def event_stream(spark, sf):
    """Events as a stream: neighbouring events, copies and late prints come in different batches."""
    return in_batches(spark, events_of(spark, sf), 3 - F.pmod("event_id", F.lit(4)))


# a quarter of the month's days a batch; one event in twenty comes two batches late, one a batch
ARRIVAL = "least(3, least(3, (day(ts) - 1) div 8) + CASE event_id % 20 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)"
ARRIVAL_SQL = ARRIVAL.replace(" div ", " // ")


def event_stream_in_time(spark, sf):
    """Events as a stream that moves on in time, with prints that come a batch or two late."""
    return in_batches(spark, events_of(spark, sf), F.expr(ARRIVAL))


def run_batches(df, sink, spark, mode="append"):
    await_all(df.writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).outputMode(mode).start())


# a row is turned away if its window had ended an hour before the last print of the batch before the last
LATE_SQL = f"""e AS (SELECT 'U' || user_id AS ticker, CAST(ts AS TIMESTAMP) AS ts, event_id, event_type AS kind, value AS close, {ARRIVAL_SQL} AS a FROM events),
 m AS (SELECT a, max(max(ts)) OVER (ORDER BY a) AS upto FROM e GROUP BY a),
 l AS (SELECT e.*, time_bucket(INTERVAL 15 MINUTE, ts) AS w, coalesce(time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE <= m.upto - INTERVAL 1 HOUR, false) AS late FROM e LEFT JOIN m ON m.a = e.a - 2)"""


@register("stream_bars_closed", f"""WITH {LATE_SQL} SELECT ticker, w AS ts, arg_min(close, ts) AS open, max(close) AS high, min(close) AS low, arg_max(close, ts) AS close, count(*) AS n
 FROM l WHERE NOT late AND w + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR GROUP BY 1, 2""")
def stream_bars_closed(spark, sf):
    return run_stream(sm.quarter_hour_bars(event_stream_in_time(spark, sf), delay="1 hour"), scratch_path(spark, "closed"), spark)


@register("stream_late_rows", f"WITH {LATE_SQL} SELECT ticker, ts, event_id, kind, close FROM l WHERE late")
def stream_late_rows(spark, sf):
    s, root = event_stream_in_time(spark, sf), scratch_path(spark, "late")
    run_batches(s, sm.late_sink(root), spark)
    return sm.late_rows(spark, root, s.schema)


@register("stream_alert_per_day", f"""WITH {LATE_SQL} SELECT DISTINCT ticker, kind, CAST(ts AS DATE) AS day FROM l LEFT JOIN m ON m.a = l.a - 2 WHERE m.upto IS NULL OR ts > m.upto - INTERVAL 2 DAY""")
def stream_alert_per_day(spark, sf):
    return run_stream(sm.alert_once(event_stream_in_time(spark, sf)), scratch_path(spark, "perday"), spark).select("ticker", "kind", "day")


@register("stream_recent_ids", """WITH RECURSIVE a AS (SELECT 'N' || (user_id % 2) AS ticker, CAST(event_id % 1501 AS VARCHAR) AS id, 3 - event_id % 4 AS b, min(ts) AS ts FROM events GROUP BY ALL),
 s AS (SELECT ticker, b, list(id ORDER BY ts, id) AS ids FROM a GROUP BY 1, 2),
 r AS (SELECT ticker, -1::BIGINT AS b, []::VARCHAR[] AS mem, []::VARCHAR[] AS new FROM (SELECT DISTINCT ticker FROM s)
  UNION ALL SELECT ticker, b, list_concat(mem, new)[-500:], new FROM (
   SELECT r.ticker, r.b + 1 AS b, r.mem, list_filter(coalesce(s.ids, []), lambda x: NOT list_contains(r.mem, x)) AS new FROM r LEFT JOIN s ON s.ticker = r.ticker AND s.b = r.b + 1 WHERE r.b < 3))
 SELECT ticker, id, count(*) AS n FROM (SELECT ticker, unnest(new) AS id FROM r) GROUP BY 1, 2""")
def stream_recent_ids(spark, sf):
    s = event_stream(spark, sf).select(F.concat(F.lit("N"), F.substring("ticker", 2, 20).cast("long") % 2).alias("ticker"), (F.col("event_id") % 1501).cast("string").alias("id"), "ts")
    with sm.list_state(spark):
        out = run_stream(sm.report_recent(s), scratch_path(spark, "recent"), spark)
    return out.groupBy("ticker", "id").agg(F.count(F.lit(1)).alias("n"))


@register("stream_report_once", "SELECT ticker, count(*) AS n FROM (SELECT DISTINCT 'U' || user_id AS ticker, event_id // 3 AS id FROM events) GROUP BY 1")
def stream_report_once(spark, sf):
    s = event_stream(spark, sf).withColumn("id", F.floor(F.col("event_id") / 3))
    out = run_stream(sm.report_once(s, ["ticker", "id"], delay=SPAN), scratch_path(spark, "once"), spark)
    return out.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@register("stream_alert_once", "SELECT DISTINCT 'U' || user_id AS ticker, event_type AS kind, CAST(ts AS DATE) AS day FROM events")
def stream_alert_once(spark, sf):
    out = run_stream(sm.alert_once(event_stream(spark, sf), delay=SPAN), scratch_path(spark, "alerts"), spark)
    return out.select("ticker", "kind", "day")


@register("stream_quarter_hour_bars", """SELECT 'U' || user_id AS ticker, time_bucket(INTERVAL 15 MINUTE, CAST(ts AS TIMESTAMP)) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_quarter_hour_bars(spark, sf):
    root = scratch_path(spark, "bars")
    run_batches(sm.quarter_hour_bars(event_stream(spark, sf), delay=SPAN), sm.bar_sink(root), spark, "update")
    return sm.bars(spark, root)


@register("stream_threshold_alerts", f"SELECT event_id, CASE WHEN value < 10 + user_id % 20 THEN 'trigger_intraday' ELSE 'near_trigger' END AS kind, {r6('value / (10.0::DOUBLE + user_id % 20) - 1')} AS value FROM events WHERE value / (10.0::DOUBLE + user_id % 20) - 1 <= 0.05")
def stream_threshold_alerts(spark, sf):
    rules = t.read(spark, sf, "events").select("user_id").distinct().select(F.concat(F.lit("U"), "user_id").alias("ticker"), (F.lit(10.0) + F.col("user_id") % 20).alias("level"))
    s = event_stream(spark, sf).select("ticker", "ts", "event_id", "close")
    return run_stream(sm.threshold_alerts(s, rules), scratch_path(spark, "levels"), spark).select("event_id", "kind", rnd("value").alias("value"))


@register("stream_late_print_merge", f"SELECT 'U' || user_id AS ticker, {LOCAL} AS session, arg_max(value, ts) AS close FROM events WHERE {LOCAL} < DATE '2024-01-25' GROUP BY 1, 2")
def stream_late_print_merge(spark, sf):
    root = scratch_path(spark, "merge")
    s = sm.closed_sessions(event_stream(spark, sf), "2024-01-25 18:00:00").where("session < '2024-01-25'")
    run_batches(s, sm.merge_sink(root), spark)
    return sm.merged(spark, root).select("ticker", "session", "close")


MORE_RETURNS = "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_returnflag = 'R') > count(*) FILTER (l_returnflag = 'A')"


@register("set_union_and_missing", f"SELECT 'S' || s_suppkey AS ticker, 'missing' AS side FROM supplier WHERE s_suppkey NOT IN ({MORE_RETURNS}) UNION ALL SELECT 'S' || l_suppkey, 'present' FROM ({MORE_RETURNS})")
def set_union_and_missing(spark, sf):
    n = t.read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_returnflag") == "A").alias("a"))
    have = n.where("r > a").select(F.concat(F.lit("S"), "l_suppkey").alias("ticker"))
    asked = t.read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
    return asked.join(have, "ticker", "left_anti").withColumn("side", F.lit("missing")).unionByName(have.withColumn("side", F.lit("present")))


@register("quote_universe_union", "SELECT DISTINCT ticker FROM (SELECT 'S' || s_suppkey AS ticker FROM supplier UNION ALL SELECT 'S' || (l_suppkey * 2) FROM lineitem UNION ALL SELECT 'C' || o_custkey FROM orders)")
def quote_universe_union(spark, sf):
    a = t.read(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"))
    b = t.read(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey") * 2).alias("ticker"))
    c = t.read(spark, sf, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("ticker"))
    return a.unionByName(b).unionByName(c).distinct()


@register("content_hash_and_key", "SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS sha, concat_ws('|', c_name, c_mktsegment, c_custkey) AS key FROM customer")
def content_hash_and_key(spark, sf):
    c = t.read(spark, sf, "customer")
    return c.select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("sha"), F.concat_ws("|", "c_name", "c_mktsegment", F.col("c_custkey").cast("string")).alias("key"))
