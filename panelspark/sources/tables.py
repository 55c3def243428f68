"""File scans with fixed schemas. Nothing is inferred; a changed header raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.dates import compact_date
from panelspark.functions.numeric import finite

# Spellings of "missing", and the listing file's header.
NULL_WORDS = ("", "null", "none", "nan", "n/a")
TRUE_WORDS = ("True", "true", "1", "TRUE")
LISTING_COLUMNS = ("symbol", "name", "exchange", "assetType", "ipoDate", "delistingDate", "status")


def require_columns(df: DataFrame, needed) -> DataFrame:
    """Raise before any action when a column is absent."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def blank_to_null(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.lower(F.trim(c)).isin(*NULL_WORDS), F.trim(c))


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns to their types; what does not parse is null, whole numbers go through double."""
    out = {}
    for c, ty in types.items():
        v = blank_to_null(c)
        if ty == "double":
            out[c] = finite(v.try_cast("double"))
        elif ty in ("int", "bigint"):
            out[c] = v.try_cast("double").try_cast(ty)
        elif ty == "boolean":
            out[c] = F.coalesce(F.trim(c).isin(*TRUE_WORDS), F.lit(False))
        elif ty == "date":
            out[c] = F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd")
        elif ty == "compact_date":
            out[c] = compact_date(v)
        else:
            out[c] = v
    return df.withColumns(out)


def row_order() -> Column:
    """The place of a row in its input: file, block of the file, row of the block. Comparable, whatever tasks read what."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_delimited(spark: SparkSession, path: str, types: dict[str, str], sep: str = ",", quoted: bool = True, ordered: bool = False) -> DataFrame:
    """A headed file by column name: other columns are dropped, short rows are padded with null.

    ``ordered`` adds ``_at``, the place of the row in the input.
    """
    r = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("inferSchema", False)
    if not quoted:
        r = r.option("quote", "")
    df = require_columns(r.csv(path), types)
    if ordered:
        return typed(df.select(*types, row_order().alias("_at")), types)
    return typed(df.select(*types), types)


def screen_rows(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """Typed screen rows, upper-cased key, the last row of a ticker wins."""
    df = read_delimited(spark, path, {"ticker": "string", **types}, ordered=True).withColumn("ticker", F.upper("ticker"))
    cols = [c for c in df.columns if c not in ("ticker", "_at")]
    return df.where(F.col("ticker").isNotNull()).groupBy("ticker").agg(F.max_by(F.struct(*cols), "_at").alias("_r")).select("ticker", "_r.*")


def ohlcv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Long bars; a repeated (name, date) keeps the first present value per field."""
    fields = ["open", "high", "low", "close", "volume"]
    df = read_delimited(spark, path, {"date": "date", **{f: "double" for f in fields}, "Name": "string"}, ordered=True)
    df = df.select(F.upper("Name").alias("ticker"), F.col("date").alias("session"), *fields, "_at").where("ticker is not null and session is not null")
    return df.groupBy("ticker", "session").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("_at"))).alias(f) for f in fields])


def scaled_bars(spark: SparkSession, path: str, ticker: str | Column) -> DataFrame:
    """Headerless ``yyyyMMdd HH:mm,o,h,l,c,v`` in ten-thousandths; the last repeat wins."""
    raw = spark.read.schema("stamp string, open double, high double, low double, close double, volume double").csv(path)
    t = F.lit(ticker) if isinstance(ticker, str) else ticker
    df = raw.select("*", row_order().alias("_at")).withColumns({"ticker": t, "session": compact_date(F.substring("stamp", 1, 8))})
    df = df.where("session is not null").groupBy("ticker", "session").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "_at").alias("_r"))
    return df.select("ticker", "session", *[(F.col(f"_r.{c}") / 10000.0).alias(c) for c in ("open", "high", "low", "close")], "_r.volume")


def factor_rows(spark: SparkSession, path: str, ticker: str | Column) -> DataFrame:
    """``yyyyMMdd,price_factor,split_factor,ref``; other lines are skipped, an empty file raises."""
    raw = spark.read.schema("d string, price_factor double, split_factor double, ref double").csv(path)
    t = F.lit(ticker) if isinstance(ticker, str) else ticker
    df = raw.where(F.col("d").rlike("^[0-9]{8}$")).select(t.alias("ticker"), compact_date("d").alias("factor_date"), "price_factor", "split_factor", "ref")
    if df.isEmpty():
        raise ValueError(f"no factor rows in {path}")
    return df


def adjusted_price_rows(spark: SparkSession, path: str, ticker: str | Column) -> DataFrame:
    """The ``Date, Open, High, Low, Close, Adj Close, Volume`` layout of one name; the adjusted close counts, the last repeat wins."""
    types = {"Date": "date", "Close": "double", "Adj Close": "double", "Volume": "double"}
    df = read_delimited(spark, path, types, ordered=True).where(F.col("Date").isNotNull())
    t = F.lit(ticker) if isinstance(ticker, str) else ticker
    return normalised_prices(df.select(t.alias("ticker"), F.col("Date").alias("session"), F.col("Close").alias("close"), F.col("Adj Close").alias("adj_close"), "_at"))


def normalised_prices(df: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """The adjusted close where the layout has one; the last repeat wins; requested names keep a row."""
    at = "_at" if "_at" in df.columns else None
    close = F.coalesce("adj_close", "close") if "adj_close" in df.columns else F.col("close")
    df = df.withColumn("_o", F.col(at) if at else F.monotonically_increasing_id())
    p = df.groupBy("ticker", "session").agg(F.max_by(close, "_o").alias("close"))
    return p if requested is None else requested.select("ticker").distinct().join(p, "ticker", "left")


def membership_rows(spark: SparkSession, path: str) -> DataFrame:
    """Upper-cased dashed tickers; a blank end is open."""
    df = read_delimited(spark, path, {"ticker": "string", "start_date": "date", "end_date": "date"})
    return df.select(F.replace(F.upper("ticker"), F.lit("."), F.lit("-")).alias("ticker"), "start_date", "end_date").where("ticker is not null and start_date is not null")


def listing_rows(spark: SparkSession, path: str) -> DataFrame:
    """The exact header or an error; a JSON error body is not a listing."""
    lines = spark.read.text(path).select("value", row_order().alias("at"))
    first = lines.groupBy("at.file").agg(F.trim(F.ltrim(F.min_by("value", "at"), F.lit("\ufeff"))).alias("first"))
    wanted = F.array(*[F.lit(c) for c in LISTING_COLUMNS])
    bad = first.where(~(F.transform(F.split("first", ","), F.trim) == wanted)).orderBy("file").limit(1).collect()
    if bad:
        what = "not a listing" if bad[0]["first"].startswith("{") else "unexpected listing header"
        raise ValueError(f"{what} in {bad[0]['file']}: {bad[0]['first'][:200]!r}")
    df = read_delimited(spark, path, {"symbol": "string", "name": "string", "exchange": "string", "assetType": "string", "ipoDate": "date", "delistingDate": "date", "status": "string"})
    return df.select(F.upper("symbol").alias("symbol"), "name", F.upper("exchange").alias("exchange"), F.col("assetType").alias("asset_type"),
                     F.col("ipoDate").alias("ipo_date"), F.col("delistingDate").alias("delist_date"), "status").where("symbol is not null")


def wide_quotes(spark: SparkSession, path: str) -> DataFrame:
    """A date by ticker grid to long rows."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    require_columns(df, ["date"])
    names = [c for c in df.columns if c != "date"]
    long = df.unpivot(["date"], names, "ticker", "close")
    return long.select("ticker", F.to_date("date").alias("session"), finite(F.col("close").try_cast("double")).alias("close"))


def filing_set(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``*/sub.txt`` and ``*/num.txt``, tab separated without quoting, all quarters in one scan each."""
    sub = read_delimited(spark, f"{root}/*/sub.txt", {"adsh": "string", "cik": "bigint", "name": "string", "form": "string", "period": "compact_date", "fy": "int", "fp": "string", "filed": "compact_date"}, "\t", False)
    num = read_delimited(spark, f"{root}/*/num.txt", {"adsh": "string", "tag": "string", "version": "string", "coreg": "string", "ddate": "compact_date", "qtrs": "int", "uom": "string", "value": "double"}, "\t", False)
    # "us-gaap/2023" names a taxonomy and a year; a filer's own tags carry its accession
    num = num.withColumn("taxonomy", F.split_part("version", F.lit("/"), F.lit(1))).withColumn("dimh", F.lit("0x00000000"))
    return sub, num


def provenance_gate(inputs: DataFrame, key: str, stat: str) -> DataFrame:
    """The figure of a key only where every input is live; unknown counts as not shown to be live."""
    g = inputs.groupBy(key).agg(F.bool_and("live").alias("_all"), F.count_if(F.col("live").isNull()).alias("_unknown"), F.count_if(~F.col("live")).alias("_dead"), F.max(stat).alias(stat))
    real = (F.col("_unknown") == 0) & F.col("_all")
    status = F.when(real, "real").when(F.col("_dead") > 0, "not real").otherwise("unknown")
    return g.select(key, real.alias("is_real"), status.alias("status"), F.when(real, F.col(stat)).alias(stat))
