"""How many of a past universe are gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.dates import years_back
from panelspark.functions.numeric import annualised
from panelspark.operators.intervals import alive_on
from panelspark.operators.ranks import top_n

# The population and the horizons looked at.
EXCHANGES = ("NYSE", "NASDAQ")
HORIZON_YEARS = (1, 3, 5, 10)


def _eligible(listings: DataFrame, today: Column, horizons, min_years: float, exchanges) -> DataFrame:
    l = listings.where((F.col("asset_type") == "Stock") & F.upper("exchange").isin(*exchanges))
    # each listing meets each of the few as-of dates
    l = l.select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("years_ago")).withColumn("as_of", years_back(today, F.col("years_ago")))
    age = F.datediff("as_of", "ipo_date") / 365.25
    return l.withColumns({
        "eligible": F.coalesce(alive_on(l, F.col("as_of")) & (age >= min_years), F.lit(False)), "unknown_ipo": F.col("ipo_date").isNull()}).withColumn(
        "gone", F.col("eligible") & F.coalesce(F.col("delist_date") <= today, F.lit(False)))


def attrition(listings: DataFrame, today: str, horizons=HORIZON_YEARS, min_years: float = 3.0, exchanges=EXCHANGES) -> DataFrame:
    """Per as-of date, how many eligible names there were and how many are gone."""
    day = F.lit(today).cast("date")
    e = _eligible(listings, day, horizons, min_years, exchanges)
    g = e.groupBy("years_ago", "as_of").agg(F.count_if("eligible").alias("eligible"), F.count_if("gone").alias("gone"), F.count_if("unknown_ipo").alias("unknown_ipo"))
    g = g.withColumn("rate", F.try_divide("gone", "eligible"))
    return g.withColumn("annualised", annualised("rate", F.datediff(day, F.col("as_of")) / 365.25))


def attrition_by(listings: DataFrame, today: str, by: str, horizons=HORIZON_YEARS, min_years: float = 3.0, exchanges=EXCHANGES) -> DataFrame:
    """A23 split by ``exchange`` or by delisting ``year``."""
    e = _eligible(listings, F.lit(today).cast("date"), horizons, min_years, exchanges)
    if by == "year":
        return e.where("gone").groupBy("years_ago", F.year("delist_date").alias("year")).agg(F.count(F.lit(1)).alias("gone"))
    return e.groupBy("years_ago", by).agg(F.count_if("eligible").alias("eligible"), F.count_if("gone").alias("gone"))


def departed_examples(listings: DataFrame, today: str, n: int = 12, **kw) -> DataFrame:
    """The earliest departures per as-of date."""
    e = _eligible(listings, F.lit(today).cast("date"), kw.get("horizons", HORIZON_YEARS), kw.get("min_years", 3.0), kw.get("exchanges", EXCHANGES)).where("gone")
    return top_n(e, ["years_ago"], [F.asc("delist_date"), F.asc("symbol"), F.asc("row_id")], n).select("years_ago", "rank", "symbol", "delist_date")


def reused_symbols(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("asset_type") == "Stock").groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cross_check(names: DataFrame, listings: DataFrame, today: str) -> DataFrame:
    """Each universe name against the listings by its key or its dashed key: covered, alive, or a delisted hit."""
    day = F.lit(today).cast("date")
    per = listings.groupBy("symbol").agg(F.bool_or(alive_on(listings, day)).alias("alive"), F.max("delist_date").alias("last_delisting"))
    n = names.select("ticker", F.posexplode(F.array(F.upper("ticker"), F.replace(F.upper("ticker"), F.lit("."), F.lit("-")))).alias("_p", "symbol"))
    hit = n.join(per, "symbol").groupBy("ticker").agg(F.min_by(F.struct("alive", "last_delisting"), "_p").alias("_h"))
    j = names.select("ticker").join(hit, "ticker", "left")
    return j.select("ticker", F.when(F.col("_h").isNull(), "not covered").when(F.col("_h.alive"), "listed").otherwise("delisted").alias("status"),
                    F.when(~F.col("_h.alive"), F.col("_h.last_delisting")).alias("last_delisting"))
