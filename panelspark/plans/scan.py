"""The watch scan in one call: every source gives rows or says why not, and none can fail the scan or be silently absent."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelspark.plans import watch as wa
from panelspark.session import cut_lineage

STATUS = "source string, status string, n_rows bigint, newest string, reason string"
# what a source has to give; one that gives nothing stands in as an empty table of this form
PRICES = "ticker string, session date, close double"
FILINGS = "cik string, form string, filed date, accession string, items array<string>"
HEADLINES = "ticker string, guid string, title string, published timestamp"
REASON = 200            # letters kept of a reason


@dataclass
class Report:
    names: DataFrame            # one row per name: price read, alerts, rule alerts, highest severity, headlines
    alerts: DataFrame           # with ``place``: severity first, then name and kind
    headlines: DataFrame
    sources: DataFrame          # one row per source: ok, empty or failed, rows, newest date, reason


def read_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], newest: dict[str, str]) -> tuple[dict[str, DataFrame | None], DataFrame]:
    """``(tables, status)``: each source written once, its rows counted and its newest date observed by the job that writes it.

    A source that cannot be planned or breaks off while it is read gives None and a row that says so; the others go on.
    """
    tables, told = {}, []
    for name, build in sources.items():
        seen = Observation(name)
        try:
            df = build()
            last = F.max(F.col(newest[name]).cast("string")) if name in newest else F.lit(None).cast("string")
            tables[name] = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n"), last.alias("newest")))
            told.append((name, "ok" if seen.get["n"] else "empty", seen.get["n"], seen.get["newest"], None))
        except Exception as e:  # noqa: BLE001    whatever a source does wrong is its own row
            tables[name] = None
            told.append((name, "failed", 0, None, f"{type(e).__name__}: {e}"[:REASON]))
    return tables, spark.createDataFrame(told, STATUS)


def watch_scan(spark: SparkSession, names: DataFrame, sources: dict[str, Callable[[], DataFrame]], as_of: str, since: str, ids: DataFrame | None = None, sent: DataFrame | None = None) -> Report:
    """``names`` as of ``names_to_watch``; ``sources`` may give prices, filings and headlines; ``ids``: ``ticker, cik``; ``sent``: the alert keys already out.

    A source that is not given at all has a row too (absent), so a report always says what it rests on.
    """
    forms = {"prices": PRICES, "filings": FILINGS, "headlines": HEADLINES}
    read, status = read_sources(spark, sources, {"prices": "session", "filings": "filed", "headlines": "published"})
    absent = [(n, "absent", 0, None, "not asked") for n in forms if n not in sources]
    status = status.unionByName(spark.createDataFrame(absent, STATUS))
    got = {n: read.get(n) if read.get(n) is not None else spark.createDataFrame([], f) for n, f in forms.items()}
    reads = cut_lineage(wa.price_reads(names, got["prices"], as_of))
    ids = ids if ids is not None else spark.createDataFrame([], "ticker string, cik string")
    filed = wa.filings_since(names, ids, got["filings"], since)
    alerts = wa.price_alerts(reads).select("ticker", "kind", "severity", "value", "as_of").unionByName(wa.filing_alerts(filed.where("accession IS NOT NULL")))
    if sent is not None:
        alerts = wa.unsent(alerts, sent).drop("alert_key")
    alerts = cut_lineage(alerts.join(names.select("ticker", "held"), "ticker"))
    heads = got["headlines"].join(names.select("ticker"), "ticker", "left_semi").where(F.col("published") > F.lit(since).cast("timestamp"))
    counts = wa.scan_counts(names, alerts).join(heads.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_headlines")), "ticker", "left").fillna(0, ["n_headlines"])
    noted = filed.where("note IS NOT NULL").select("ticker", "note")
    rows = reads.join(counts.drop("held"), "ticker").join(noted, "ticker", "left")
    return Report(rows, wa.ordered(alerts), heads, status)
