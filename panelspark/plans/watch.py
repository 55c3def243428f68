"""The watch list: price reads, filings, alerts by written rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import growth
from panelspark.functions.text import call_kind, price_trigger
from panelspark.operators.panel import own_reads
from panelspark.operators.ranks import place
from panelspark.plans.grading import latest_calls

# Thresholds and forms watched.
DROP_WEEK, MOVE_DAY, NEAR_TRIGGER, STALE_DAYS = -0.15, 0.05, 0.05, 5
FORMS_WATCHED = ("8-K", "10-Q", "10-K", "4", "SC 13D", "SC 13G", "DEF 14A", "10-Q/A", "10-K/A")


def names_to_watch(calls: DataFrame, held: DataFrame) -> DataFrame:
    """The latest call per name, plus held names without one; ``held`` is ``ticker, held_trigger``."""
    c = latest_calls(calls).select("ticker", "date", "action", "price_at_call", "wrong_if", call_kind("action").alias("kind"), price_trigger("wrong_if").alias("_t"))
    j = c.join(held.withColumn("_h", F.lit(True)), "ticker", "full")
    return j.select("ticker", "date", "action", F.coalesce("kind", F.lit("held")).alias("kind"), "price_at_call", "wrong_if",
                    F.coalesce("_t", "held_trigger").alias("trigger"), F.coalesce("_h", F.lit(False)).alias("held"))


def price_reads(names: DataFrame, prices: DataFrame, as_of: str) -> DataFrame:
    """W14 over each name's own observations; a name without prices keeps its row."""
    r = own_reads(prices, as_of)
    j = names.join(r, "ticker", "left")
    level = F.when(F.col("trigger") != 0, F.col("trigger"))
    return j.select(
        *names.columns, F.col("back_0").alias("last_close"), "last_date", F.col("back_1").alias("prev_close"),
        growth("back_0", "back_1").alias("chg_1d"), growth("back_0", "back_5").alias("chg_5d"), growth("back_0", "price_at_call").alias("since_call"),
        (F.try_divide("back_0", level) - 1.0).alias("to_trigger"), (F.col("back_0") < level).alias("breached"), "low",
        F.coalesce("sessions", F.lit(0)).cast("long").alias("sessions"), F.datediff(F.lit(as_of).cast("date"), "last_date").alias("stale_days"))


def filings_since(names: DataFrame, ids: DataFrame, filings: DataFrame, since: str, forms=FORMS_WATCHED) -> DataFrame:
    """Watched forms filed after a date; a name without an id keeps a row with a note."""
    f = filings.where(F.col("form").isin(*forms) & (F.col("filed") > F.lit(since).cast("date")))
    j = names.select("ticker").join(ids, "ticker", "left").join(f, "cik", "left")
    note = F.when(F.col("cik").isNull(), "no id, filings not scanned")
    return j.where(F.col("cik").isNull() | F.col("accession").isNotNull()).withColumn("note", note)


def is_earnings(form: Column, items: Column) -> Column:
    """An 8-K carrying item 2.02."""
    return form.startswith("8-K") & F.exists(items, lambda i: i.startswith("2.02"))


def exhibit_priority(doc_type: Column, name: Column) -> Column:
    """How likely a document is the press release; the type first, the file name second."""
    n = F.lower(name)
    return (F.when(doc_type == "EX-99.1", 1).when(doc_type == "EX-99.2", 2).when(doc_type.startswith("EX-99"), 3)
            .when(n.rlike(r"ex-?_?99[-_.]?1"), 4).when(n.rlike(r"ex-?_?99"), 5))


def price_alerts(reads: DataFrame) -> DataFrame:
    """Rules on a price read, one row per rule that fires."""
    lvl = F.coalesce(F.col("trigger") != 0, F.lit(False)) & F.col("last_close").isNotNull()
    breached = F.coalesce(F.col("breached"), F.lit(False))

    def alert(cond: Column, kind: str, severity: int, value: str) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col(value).alias("value"), F.col("last_date").alias("as_of")))

    fired = F.array_compact(F.array(
        alert(lvl & breached, "trigger", 3, "to_trigger"), alert(lvl & ~breached & (F.col("to_trigger") <= NEAR_TRIGGER), "near_trigger", 2, "to_trigger"),
        alert(F.col("chg_5d") <= DROP_WEEK, "drop_week", 3, "chg_5d"), alert(F.abs("chg_1d") >= MOVE_DAY, "move_day", 2, "chg_1d")))
    return reads.select("ticker", "held", F.explode(fired).alias("_a")).select("ticker", "held", "_a.*")


def filing_alerts(filings: DataFrame) -> DataFrame:
    """Rules on filings: earnings release, report, stake, other 8-K, and one row for a name's insider filings."""
    form = F.col("form")
    kind = F.when(is_earnings(form, F.col("items")), "earnings_8k").when(form.startswith("10-Q") | form.startswith("10-K"), "filing") \
        .when(form.startswith("SC 13"), "stake").when(form.startswith("8-K"), "filing")
    sev = F.when(is_earnings(form, F.col("items")), 3).when(form.startswith("8-K"), 1).otherwise(2)
    each = filings.withColumns({"kind": kind, "severity": sev}).where("kind is not null").select(
        "ticker", "kind", "severity", F.lit(None).cast("double").alias("value"), F.col("filed").alias("as_of"))
    four = filings.where(form == "4").groupBy("ticker").agg(F.count(F.lit(1)).cast("double").alias("value"), F.max("filed").alias("as_of")).select(
        "ticker", F.lit("filing").alias("kind"), F.lit(1).alias("severity"), "value", "as_of")
    return each.unionByName(four)


def alert_key() -> Column:
    """The same event: name, kind and day."""
    return F.concat_ws("|", "ticker", "kind", F.date_format("as_of", "yyyy-MM-dd"))


def unsent(alerts: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts whose key has not gone out."""
    return alerts.withColumn("alert_key", alert_key()).join(sent.select("alert_key"), "alert_key", "left_anti")


def scan_counts(names: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts, rule alerts and highest severity per name; quiet names count 0."""
    a = alerts.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_alerts"), F.count_if(F.col("severity") >= 3).alias("n_rule_alerts"), F.max("severity").alias("max_severity"))
    return names.select("ticker", "held").join(a, "ticker", "left").fillna(0, ["n_alerts", "n_rule_alerts", "max_severity"])


def ordered(alerts: DataFrame) -> DataFrame:
    """Alerts with their ``place``: severity first, then name and kind, newest first among equals."""
    coarse = [(F.col("severity"), True), (F.substring("ticker", 1, 3), False)]
    return place(alerts, [], coarse, [F.asc("ticker"), F.asc("kind"), F.desc("as_of")], "place")
