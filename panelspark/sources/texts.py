"""Call logs and research notes: markdown text to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.sources.tables import row_order

# Placeholder words and the sections every note must have.
ABSENT = ("n/a", "na", "none", "-", "--", "tbd", "?")
TICKER = r"^[A-Z][A-Z0-9]*(?:[.\-][A-Z0-9]+)*$"
NUMBER = r"(-?[\d,]+(?:\.\d+)?)"


def first_number(c: Column) -> Column:
    """The first number in a text; commas are dropped."""
    return F.replace(F.regexp_extract(c, NUMBER, 1), F.lit(","), F.lit("")).try_cast("double")


def field(body: Column, name: str) -> Column:
    """A ``Name: value`` line; a placeholder word counts as not filled in."""
    v = F.trim(F.regexp_extract(body, rf"(?m)^{name}:\s*(.*)$", 1))
    return F.when((v != "") & ~F.regexp_replace(F.lower(v), r"^[. ]+|[. ]+$", "").isin(*ABSENT), v)


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per ticker of every dated entry.

    Entries are cut by the reader's line separator, so a long log is read by many tasks.
    """
    raw = spark.read.option("lineSep", "\n## ").text(path).select("value", row_order().alias("pos"))
    return parse_calls(raw, "value")


def parse_calls(entries: DataFrame, text: str) -> DataFrame:
    e = F.regexp_replace(F.col(text), r"^## ", "")
    head, body = F.split_part(e, F.lit("\n"), F.lit(1)), F.regexp_replace(e, r"^[^\n]*\n?", "")
    d = entries.withColumns({"_date": F.regexp_extract(head, r"^(\d{4}-\d{2}-\d{2}) ", 1), "_rest": F.regexp_replace(head, r"^\d{4}-\d{2}-\d{2} ", ""), "_body": body}).where("_date <> ''")
    # two spaces decide the split; without them, leading ticker-shaped words are the tickers
    rest = F.col("_rest")
    words = F.split(F.trim(rest), r"\s+")
    stop = F.array_position(F.transform(words, lambda w: w.rlike(TICKER)), F.lit(False)).cast("int")
    n = F.when(stop == 0, F.size(words)).otherwise(stop - 1)
    wide = rest.contains("  ")
    tick = F.when(wide, F.filter(F.split(F.trim(F.regexp_extract(rest, r"(?s)^(.*?)  ", 1)), r"\s+"), lambda t: t != "")).otherwise(F.slice(words, F.lit(1), F.greatest(n, F.lit(0))))
    title = F.when(wide, F.trim(F.regexp_replace(rest, r"(?s)^.*?  ", ""))).otherwise(F.array_join(F.slice(words, F.greatest(n, F.lit(0)) + 1, F.size(words)), " "))
    d = d.withColumns({"_t": tick, "title": title})
    b = F.col("_body")
    keep = [c for c in entries.columns if c != text]
    d = d.select(*keep, F.to_date("_date").alias("date"), "title", F.posexplode("_t").alias("_i", "_tk"), F.size("_t").alias("_n"),
                 field(b, "Price at call").alias("_px"), field(b, "Stop").alias("_st"), field(b, "Thesis").alias("thesis"), field(b, "Wrong if").alias("wrong_if"),
                 field(b, "Target size").alias("target_size"), field(b, "Conviction").alias("_cv"), field(b, "Bucket").alias("bucket"), field(b, "Horizon").alias("_hz"))

    def mine(c: str) -> Column:
        parts = F.split(c, "/")
        return F.when(F.col("_n") == 1, first_number(F.col(c))).when(F.size(parts) == F.col("_n"), first_number(F.get(parts, F.col("_i"))))

    cv, hz = first_number(F.col("_cv")), F.regexp_extract("_hz", r"(?i)(\d+)\s*(?:trading\s+days?|sessions?|d\b)", 1).try_cast("int")
    return d.select(*keep, "date", F.upper("_tk").alias("ticker"), "title", mine("_px").alias("price_at_call"), "thesis", "wrong_if", "target_size",
                    F.when(cv.between(1, 5), cv.cast("int")).alias("conviction"), "bucket", F.when(hz > 0, hz).alias("horizon_days"), mine("_st").alias("stop"))


# -- notes ------------------------------------------------------------------------------------

def notes(spark: SparkSession, path: str) -> DataFrame:
    """One row per note file: key, company, headline line, its figures and the file stem."""
    raw = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1).alias("stem"), "value")
    return parse_notes(raw)


def parse_notes(raw: DataFrame) -> DataFrame:
    first = F.trim(F.regexp_extract("value", r"^# ([^\n]*)", 1))
    line = F.trim(F.regexp_extract("value", r"^[^\n]*\n(?:\s*\n)*([^#\n][^\n]*)", 1))
    n = raw.select("stem", "value", F.upper(F.regexp_extract(first, r"^(\S+)", 1)).alias("ticker"), F.trim(F.regexp_replace(first, r"^\S+", "")).alias("company"), line.alias("stats_line"))
    return n.withColumns(headline(F.col("stats_line")))


def headline(s: Column) -> dict[str, Column]:
    """Figures quoted in a note's headline."""
    def num(p):
        return F.regexp_replace(F.replace(F.regexp_extract(s, p, 1), F.lit(","), F.lit("")), r"\.$", "").try_cast("double")
    return {"quality_rank": num(r"[Qq]uality rank (\d+) of \d+"), "quality_score": num(r"score (\d+(?:\.\d+)?)"), "price": num(r"Price ([\d,]+(?:\.\d+)?)"),
            "forward_pe": num(r"Forward P/E ([\d.]+)"), "median_pe": num(r"median ([\d.]+)"), "ev_ebitda": num(r"EV/EBITDA ([\d.]+)"), "dd_52w_pct": num(r"([-+]?[\d.]+)% from 52 week high"),
            "next_earnings": F.try_to_date(F.nullif(F.regexp_extract(s, r"Next earnings (\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")}


def note_sections(n: DataFrame) -> DataFrame:
    """``ticker, section, body``; a repeated heading keeps its last text."""
    p = n.select("ticker", F.posexplode(F.split("value", r"(?:^|\n)## ")).alias("_i", "_p")).where("_i > 0")
    p = p.select("ticker", "_i", F.trim(F.split_part("_p", F.lit("\n"), F.lit(1))).alias("section"), F.regexp_replace(F.regexp_replace("_p", r"^[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"))
    return p.groupBy("ticker", "section").agg(F.max_by("body", "_i").alias("body"))


def note_financials(sections: DataFrame) -> DataFrame:
    """Seven-cell rows of the financial table; a row of another width is flagged, not re-read."""
    rows = sections.where("section = 'Financials'").select("ticker", F.posexplode(F.split("body", "\n")).alias("_i", "_l")).where(F.trim("_l").rlike(r"^\|.+\|$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("_l"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    r = rows.select("ticker", "_i", cells.alias("c")).where(~F.array_join("c", "").rlike(r"^[-: ]*$") & ~F.lower(F.get("c", F.lit(0))).rlike("^(fiscal|period)") & F.get("c", F.lit(0)).rlike(r"\d{4}"))

    def num(i):
        return F.regexp_replace(F.get("c", F.lit(i)), r"[,%$]", "").try_cast("double")

    names = ("revenue_bn", "gross_margin", "operating_margin", "fcf_bn", "diluted_shares_m", "net_debt_bn")
    ok = F.size("c") == 7
    return r.select("ticker", "_i", F.regexp_extract(F.get("c", F.lit(0)), r"(FY\d{4}|\d{4})", 1).alias("fiscal_year"), F.when(~ok, F.concat(F.size("c").cast("string"), F.lit(" cells, expected 7"))).alias("error"),
                    *[F.when(ok, num(i + 1) / (100.0 if x.endswith("margin") else 1.0)).alias(x) for i, x in enumerate(names)])


def note_sources(sections: DataFrame) -> DataFrame:
    """Source lines: a link with its read date, or a plain title with its pull date."""
    r = sections.where("section = 'Sources'").select("ticker", F.posexplode(F.split("body", "\n")).alias("_i", "_l")).where(F.trim("_l").startswith("-"))
    link, plain = r"^\s*-\s*\[([^\]]+)\]\(([^)]+)\)(?:,\s*read (\d{4}-\d{2}-\d{2}))?", r"^\s*-\s*([^\[].*?)(?:,\s*pulled (\d{4}-\d{2}-\d{2}))?\s*$"
    g = lambda p, i: F.nullif(F.trim(F.regexp_extract("_l", p, i)), F.lit(""))
    return r.select("ticker", "_i", F.coalesce(g(link, 1), g(plain, 1)).alias("title"), g(link, 2).alias("url"), F.coalesce(g(link, 3), g(plain, 2)).alias("read_date")).where("title is not null")


def note_errors(n: DataFrame, sections: DataFrame, required: tuple[str, ...], min_years: int = 3) -> DataFrame:
    """Lenient loading: one row per note and fault; a note without a row is sound."""
    have = sections.where("body <> ''").groupBy("ticker").agg(F.collect_set("section").alias("_s"))
    fin = note_financials(sections).groupBy("ticker").agg(F.count(F.lit(1)).alias("_f"), F.max("error").alias("_e"))
    src = note_sources(sections).groupBy("ticker").agg(F.count(F.lit(1)).alias("_c"))
    dup = n.withColumn("_d", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    j = dup.join(have, "ticker", "left").join(fin, "ticker", "left").join(src, "ticker", "left")
    missing = F.array_except(F.array(*[F.lit(x) for x in required]), F.coalesce("_s", F.array().cast("array<string>")))
    faults = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("missing sections: "), F.array_join(missing, ", "))), F.when(F.upper("stem") != F.col("ticker"), "key differs from the file name"),
        F.when(F.col("_d") > 1, "key is not unique"), F.col("_e"), F.when(F.coalesce("_f", F.lit(0)) < min_years, "too few fiscal years"), F.when(F.col("_c").isNull(), "no sources")))
    return j.select("stem", "ticker", F.explode(faults).alias("fault"))
