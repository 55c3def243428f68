"""Nested JSON and XML payloads to rows, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.dates import feed_timestamp
from panelspark.functions.numeric import finite
from panelspark.functions.text import decode_entities

# Payload schemas.
QUOTE = "c double, d double, dp double, h double, l double, o double, pc double, t bigint"
PROFILE = ("ticker string, name string, country string, currency string, exchange string, ipo string, marketCapitalization double, shareOutstanding double, "
           "industry string, finnhubIndustry string, weburl string")
METRICS = "symbol string, metric map<string, string>, series map<string, map<string, array<struct<period: string, v: double>>>>"
EARNINGS = "array<struct<symbol: string, period: string, year: int, quarter: int, actual: double, estimate: double, surprise: double, surprisePercent: double>>"
CALENDAR = ("earningsCalendar array<struct<symbol: string, date: string, hour: string, quarter: int, year: int, epsEstimate: double, epsActual: double, revenueEstimate: double, "
            "revenueActual: double>>")
NEWS = "array<struct<id: bigint, datetime: bigint, headline: string, source: string, url: string, related: string>>"
RECOMMENDATION = "array<struct<symbol: string, period: string, strongBuy: bigint, buy: bigint, hold: bigint, sell: bigint, strongSell: bigint>>"
INSIDER = "data array<struct<name: string, share: bigint, change: bigint, filingDate: string, transactionDate: string, transactionCode: string, transactionPrice: double>>"
STATEMENTS = ("ticker string, pulled string, info struct<longName: string, sector: string, industry: string, country: string, marketCap: double, financialCurrency: string, "
              "currency: string>, years map<string, map<string, double>>")
FACT = "struct<start: string, end: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string, frame: string>"
COMPANY_FACTS = f"cik bigint, entityName string, facts map<string, map<string, struct<label: string, units: map<string, array<{FACT}>>>>>"
_PAGE = ("accessionNumber: array<string>, form: array<string>, filingDate: array<string>, acceptanceDateTime: array<string>, reportDate: array<string>, "
         "primaryDocument: array<string>, items: array<string>")
SUBMISSIONS = f"cik string, filings struct<recent: struct<{_PAGE}>, files: array<struct<name: string, filingCount: bigint, filingFrom: string, filingTo: string>>>"
TICKER_MAP = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"


def quotes(df: DataFrame, body: str = "body") -> DataFrame:
    """A zero or negative price is missing, field by field; a quote without any price has nothing."""
    q = df.withColumn("_q", F.from_json(body, QUOTE))
    price = lambda f: F.when(finite(F.col(f"_q.{f}")) > 0, F.col(f"_q.{f}"))
    keep = [c for c in df.columns if c != body]
    q = q.select(*keep, "_q", price("c").alias("current"), price("pc").alias("previous_close"), price("h").alias("_h"), price("l").alias("_l"), price("o").alias("_o"))
    some = F.col("current").isNotNull() | F.col("previous_close").isNotNull()
    has = lambda c: F.when(some, c)
    out = q.select(*keep, "current", "previous_close", has(F.col("_q.d")).alias("change"), has(F.col("_q.dp")).alias("percent_change"), has(F.col("_h")).alias("high"), has(F.col("_l")).alias("low"),
                   has(F.col("_o")).alias("open"), has(F.timestamp_seconds("_q.t")).alias("as_of"))
    return out.withColumn("range_position", F.when(F.col("high") > F.col("low"), (F.col("current") - F.col("low")) / (F.col("high") - F.col("low"))))


def profiles(df: DataFrame, body: str = "body") -> DataFrame:
    """The profile of a name; money and shares come in millions, and a profile without a name was not found."""
    p = df.withColumn("_p", F.from_json(body, PROFILE)).select(*[c for c in df.columns if c != body], "_p.*")
    p = p.withColumns({"name": _said("name"), "market_cap": F.col("marketCapitalization") * 1e6, "shares_outstanding": F.col("shareOutstanding") * 1e6, "found": _said("name").isNotNull()})
    return p.withColumn("industry", F.coalesce(F.nullif(F.trim("industry"), F.lit("")), F.nullif(F.trim("finnhubIndustry"), F.lit(""))))


def metric(body: Column, *names: str) -> Column:
    """The first of several spellings of a sparse metric that has a number."""
    m = F.from_json(body, METRICS)["metric"]
    return F.coalesce(*[finite(F.try_element_at(m, F.lit(n)).try_cast("double")) for n in names])


def metric_series(body: Column, name: str, freq: str = "annual") -> Column:
    """Points of a nested series, newest first, points without a value or period dropped."""
    pts = F.try_element_at(F.try_element_at(F.from_json(body, METRICS)["series"], F.lit(freq)), F.lit(name))
    ok = F.filter(pts, lambda p: p["period"].isNotNull() & p["v"].isNotNull())
    return F.sort_array(ok, asc=False)


def explode_rows(df: DataFrame, body: str, schema: str, field: str | None = None) -> DataFrame:
    """Rows of an array payload (earnings, calendar, news, recommendation, insider)."""
    parsed = F.from_json(body, schema)
    return df.select(*[c for c in df.columns if c != body], F.inline(parsed[field] if field else parsed))


def _said(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def earnings(df: DataFrame, body: str = "body") -> DataFrame:
    """Reported quarters; ``beat`` is null when a side of the comparison is missing, ``label`` falls back to the period."""
    r = explode_rows(df, body, EARNINGS)
    label = F.when((F.col("year") != 0) & (F.col("quarter") != 0), F.concat("year", F.lit("Q"), "quarter"))
    return r.withColumns({"symbol": _said("symbol"), "beat": F.col("actual") > F.col("estimate"), "label": F.coalesce(label, _said("period"), F.lit("?"))})


def earnings_calendar(df: DataFrame, body: str = "body") -> DataFrame:
    """Dates ahead, with the session in words and whether a consensus stands against the date."""
    r = explode_rows(df, body, CALENDAR, "earningsCalendar")
    hour = F.lower(F.coalesce("hour", F.lit("")))
    session = F.when(hour == "bmo", "before market open").when(hour == "amc", "after market close").when(hour == "dmh", "during market hours")
    return r.withColumns({"symbol": _said("symbol"), "date": F.to_date(_said("date")), "session": session, "has_consensus": _said("date").isNotNull() & F.col("epsEstimate").isNotNull()})


def company_news(df: DataFrame, body: str = "body") -> DataFrame:
    """News items, their own id as ``news_id``; a stamp of zero is no stamp, and an item without a headline says nothing."""
    item = lambda x: F.struct(x["id"].alias("news_id"), x["datetime"].alias("_at"), x["headline"].alias("headline"), x["source"].alias("source"), x["url"].alias("url"), x["related"].alias("related"))
    r = df.select(*[c for c in df.columns if c != body], F.inline(F.transform(F.from_json(body, NEWS), item)))
    r = r.withColumns({"headline": _said("headline"), "published": F.timestamp_seconds(F.when(F.col("_at") != 0, F.col("_at")))}).drop("_at")
    return r.withColumn("day", F.to_date("published")).where("headline IS NOT NULL")


def recommendations(df: DataFrame, body: str = "body") -> DataFrame:
    """Analyst counts per month, in the columns that ``recommendation_totals`` reads."""
    r = explode_rows(df, body, RECOMMENDATION)
    return r.withColumnsRenamed({"strongBuy": "strong_buy", "strongSell": "strong_sell"}).withColumn("period", F.to_date("period"))


def insider_side(code: Column) -> Column:
    """Open-market purchase or sale."""
    c = F.upper(F.trim(code))
    return F.when(c == "P", "buy").when(c == "S", "sale")


def statements(spark: SparkSession, path: str) -> DataFrame:
    """One row per ticker and fiscal year end, every line in a map."""
    d = spark.read.schema(STATEMENTS).json(path)
    return d.select("ticker", "info", F.explode(F.map_entries("years")).alias("_e")).select("ticker", "info.*", F.to_date("_e.key").alias("period_end"), F.col("_e.value").alias("lines"))


def first_line(lines: str, *labels: str) -> Column:
    """The first label that carries a number."""
    return F.coalesce(*[finite(F.try_element_at(lines, F.lit(x))) for x in labels])


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy, tag, unit and value rows; rows without a value or filing date are skipped."""
    d = spark.read.schema(COMPANY_FACTS).json(path)
    a = d.select("cik", F.explode("facts").alias("taxonomy", "_t")).select("cik", "taxonomy", F.explode("_t").alias("tag", "_u")).select("cik", "taxonomy", "tag", F.explode("_u.units").alias("unit", "_f"))
    r = a.select("cik", "taxonomy", "tag", "unit", F.inline("_f")).where("val is not null and filed is not null")
    return r.select("cik", "taxonomy", "tag", "unit", F.to_date("start").alias("start"), F.to_date("end").alias("end"), F.col("val").alias("value"), F.col("accn").alias("adsh"), "form", F.to_date("filed").alias("filed"), "frame")


def _filing_rows(d: DataFrame, at: str, *keep: Column) -> DataFrame:
    """Rows of the parallel arrays below ``at``, with the ``keep`` columns."""
    ids = F.col(f"{at}.accessionNumber")
    # an absent array is an array of nulls
    z = F.arrays_zip(*[F.coalesce(F.col(f"{at}.{c}"), F.transform(ids, lambda x: F.lit(None).cast("string"))).alias(c)
                       for c in ("accessionNumber", "form", "filingDate", "acceptanceDateTime", "reportDate", "primaryDocument", "items")])
    r = d.select(*keep, F.inline(z))
    cols = [c for c in r.columns if c not in ("accessionNumber", "form", "filingDate", "acceptanceDateTime", "reportDate", "primaryDocument", "items")]
    return r.select(*cols, F.col("accessionNumber").alias("accession"), "form", F.to_date("filingDate").alias("filed"), F.try_to_timestamp("acceptanceDateTime").alias("accepted"), "reportDate", "primaryDocument",
                    F.filter(F.transform(F.split("items", ","), lambda x: F.trim(x)), lambda x: x != "").alias("items"))


def padded_id(c: str) -> Column:
    return F.lpad(F.regexp_replace(c, r"\D", ""), 10, "0")


def filing_index(spark: SparkSession, path: str) -> DataFrame:
    """The recent filings of each company, parallel arrays to rows."""
    return _filing_rows(spark.read.schema(SUBMISSIONS).json(path), "filings.recent", padded_id("cik").alias("cik"))


def filing_pages(spark: SparkSession, main: str, pages: str, page_name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """S15 with older filings: ``(rows, pages)``.

    The main file of a company names its older pages, with the number of filings and the dates of each. Rows are those of the
    recent part and of the pages found, with the ``page`` they come from: the file's name, unless ``page_name`` says otherwise
    (a page may name itself in a field ``document``). ``pages`` has a row per page named or found:
    ``cik, page, said_n, read_n, status``: ok, missing (named, not found), unnamed (found, not named), count (another number of
    filings) or dates (filings outside the stated range), so a hole in the history is a row and not a silence.
    """
    d = spark.read.schema(SUBMISSIONS).json(main)
    recent = _filing_rows(d, "filings.recent", padded_id("cik").alias("cik"), F.lit("recent").alias("page"))
    named = d.select(padded_id("cik").alias("cik"), F.inline("filings.files")).select("cik", F.col("name").alias("page"), F.col("filingCount").alias("said_n"), F.to_date("filingFrom").alias("said_from"), F.to_date("filingTo").alias("said_to"))
    files = spark.read.schema(_PAGE.replace(":", "") + ", document string").json(pages)
    files = files.select((F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1) if page_name is None else page_name).alias("page"), F.struct(*files.columns[:7]).alias("filings"))
    found = _filing_rows(files, "filings", F.col("page"))
    stats = files.select("page").distinct().join(found.groupBy("page").agg(F.count(F.lit(1)).alias("read_n"), F.min("filed").alias("read_from"), F.max("filed").alias("read_to")), "page", "left")
    told = named.join(stats.withColumn("_f", F.lit(True)), "page", "full").withColumn("read_n", F.when(F.col("_f"), F.coalesce("read_n", F.lit(0))))
    status = (F.when(F.col("_f").isNull(), "missing").when(F.col("cik").isNull(), "unnamed").when(~F.col("said_n").eqNullSafe(F.col("read_n")), "count")
              .when((F.col("read_from") < F.col("said_from")) | (F.col("read_to") > F.col("said_to")), "dates").otherwise("ok"))
    older = named.select("cik", "page").join(found, "page")
    return recent.unionByName(older), told.select("cik", "page", "said_n", "read_n", status.alias("status"))


def recent_filings(index: DataFrame, forms, limit: int) -> DataFrame:
    """A form matches itself or its base before the slash; newest first, ``limit`` per company."""
    from panelspark.operators.ranks import top_n
    up = F.upper("form")
    hit = index.where(up.isin(*forms) | F.split_part(up, F.lit("/"), F.lit(1)).isin(*forms))
    return top_n(hit, ["cik"], [F.desc("filed"), F.desc("accession")], limit)


def ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """Ticker, padded id, title."""
    d = spark.read.option("wholetext", True).text(path)
    r = d.select(F.explode(F.map_values(F.from_json("value", TICKER_MAP))).alias("_r"))
    return r.select(F.upper("_r.ticker").alias("ticker"), F.lpad(F.col("_r.cik_str").cast("string"), 10, "0").alias("cik"), "_r.title")


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Feed items; the id falls back to the link, then the title; items without a title are dropped."""
    d = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, pubDate string").load(path)
    title = F.regexp_replace(decode_entities(F.trim("title")), r"\s+", " ")
    nz = lambda c: F.nullif(F.trim(c), F.lit(""))
    return d.select(title.alias("title"), nz("link").alias("link"), F.coalesce(nz("guid"), nz("link"), title).alias("guid"), feed_timestamp("pubDate").alias("published")).where("title <> ''")
