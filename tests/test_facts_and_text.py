"""Filed facts, release figures, text readers and file scans on tiny inputs with hand answers."""

import datetime as dt
import html
import json
import re

import pytest
from pyspark.sql import functions as F

from panelspark.functions import text as tx
from panelspark.functions.dates import compact_date, feed_timestamp, weekdays_between, years_back
from panelspark.plans import facts as fx
from panelspark.plans import figures as fg
from panelspark.plans import listings as ls
from panelspark.plans import reports as rp
from panelspark.plans import watch as wa
from panelspark.sources import payloads, sinks, texts
from panelspark.sources import tables as st

D = dt.date
COLS = "cik long, taxonomy string, tag string, ddate date, qtrs int, value double, filed date, adsh string"


def facts(spark, rows):
    return spark.createDataFrame([(1, "us-gaap", *r) for r in rows], COLS)


def test_a_restatement_is_seen_only_after_it_was_filed(spark):
    f = facts(spark, [("Revenues", D(2022, 12, 31), 4, 1_000_000.0, D(2023, 2, 1), "a"), ("Revenues", D(2022, 12, 31), 4, 950_000.0, D(2024, 2, 1), "b")])
    value = lambda on: fx.annual_series(f, on).collect()[0]["value"]
    assert value("2023-06-30") == 1_000_000.0 and value("2024-06-30") == 950_000.0
    assert fx.annual_series(f).collect()[0]["value"] == 1_000_000.0
    assert fx.annual_series(f, "2022-12-31").count() == 0


def test_fourth_quarter_is_the_year_less_nine_months_and_carries_the_annual_stamp(spark):
    f = facts(spark, [("Revenues", D(2022, 12, 31), 4, 400.0, D(2023, 2, 1), "k"), ("Revenues", D(2022, 9, 30), 3, 310.0, D(2022, 11, 1), "q"), ("Revenues", D(2022, 9, 30), 3, 305.0, D(2023, 3, 1), "late"),
                      ("Revenues", D(2021, 12, 31), 4, 300.0, D(2022, 2, 1), "k0"), ("Revenues", D(2022, 9, 30), 1, 100.0, D(2022, 11, 1), "q")])
    got = {r["ddate"]: (r["value"], r["filed"], r["derived"]) for r in fx.quarterly_series(f).collect()}
    assert got == {D(2022, 9, 30): (100.0, D(2022, 11, 1), False), D(2022, 12, 31): (90.0, D(2023, 2, 1), True)}


def test_tag_preference_is_per_filer_over_all_its_facts(spark):
    f = facts(spark, [("Revenues", D(2020, 12, 31), 4, 1.0, D(2021, 2, 1), "a"), ("SalesRevenueNet", D(2021, 12, 31), 4, 2.0, D(2022, 2, 1), "b"), ("Assets", D(2020, 12, 31), 0, 9.0, D(2021, 2, 1), "a")])
    m = {(r["metric"], r["tag"]) for r in fx.metric_facts(f).select("metric", "tag").collect()}
    assert m == {("revenue", "Revenues"), ("assets", "Assets")}
    y = fx.fiscal_years(f, "2023-01-01").collect()
    assert [(r["fy"], r["revenue"], r["assets"], r["first_filed"]) for r in y] == [(2020, 1.0, 9.0, D(2021, 2, 1))]


def test_growth_runs_over_elapsed_years_and_net_cash_has_no_leverage(spark):
    rows = []
    for fy, rev, debt, cash in ((2018, 100.0, 10.0, 50.0), (2021, 133.1, 10.0, 50.0)):
        end = D(fy, 12, 31)
        rows += [("Revenues", end, 4, rev, D(fy + 1, 2, 1), "x"), ("LongTermDebt", end, 0, debt, D(fy + 1, 2, 1), "x"), ("CashAndCashEquivalentsAtCarryingValue", end, 0, cash, D(fy + 1, 2, 1), "x")]
    a = fx.reported_aggregates(fx.fiscal_years(facts(spark, rows), "2023-01-01")).collect()[0]
    assert a["rev_cagr"] == pytest.approx(0.10) and a["net_cash"] is True and a["nd_to_ebitda"] is None and a["net_debt"] == -40.0


# -- figures -----------------------------------------------------------------------------------------

TEXT = ("Acme Inc. reported a record quarter. For the third quarter of fiscal 2026, we expect revenue of $4.1 billion to $4.3 billion, up from its prior outlook of $3.9 billion, and gross margin of approximately 45.5%. "
        "Outlook: full year diluted earnings per share between $2.05 and $2.15. Capex guidance is $500 million plus or minus $50 million for FY2027. "
        "We anticipate operating margin improvement. Sales rose 10%. Forward-looking statements about revenue of $9 billion are guidance subject to risks and uncertainties.")


def items(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "d int, text string")
    return {(r["metric"], r["period"]): (r["low"], r["high"], r["unit"], r["kind"]) for r in fg.extract_figures(df, ["d"], **kw).collect()}


def test_figures_of_a_release(spark):
    got = items(spark, TEXT)
    assert got == {
        ("revenue", "Q3 FY2026"): (4.1e9, 4.3e9, "USD", "range"), ("gross_margin", "Q3 FY2026"): (45.5, 45.5, "percent", "point"),
        ("eps", "full year"): (2.05, 2.15, "USD", "range"), ("capex", "FY2027"): (4.5e8, 5.5e8, "USD", "range"),
        ("operating_margin", "unspecified"): (None, None, "", "qualitative")}


@pytest.mark.parametrize("clause, want", [
    ("We expect revenue in fiscal 2027 of about $12.5 million.", ("revenue", "FY2027", 12.5e6, 12.5e6, "USD")), ("We expect a tax rate of 21 to 23 in Q4 26.", ("tax_rate", "Q4 FY2026", 21.0, 23.0, "")),
    ("We target EPS of 1,234.5 by 2030.", ("eps", "unspecified", 1234.5, 1234.5, "")), ("We expect the September quarter to bring net sales near €3 billion.", ("revenue", "September quarter", 3e9, 3e9, "USD"))])
def test_single_clauses(spark, clause, want):
    (k, v), = items(spark, clause).items()
    assert (*k, *v[:3]) == want


def test_every_diff_class(spark):
    mk = lambda rows: spark.createDataFrame([("c", *r) for r in rows], "t string, metric string, period string, low double, high double, unit string, kind string")
    pri = [("a", "FY1", 10.0, 12.0, "USD", "range"), ("b", "FY1", 10.0, 12.0, "USD", "range"), ("c", "FY1", 10.0, 12.0, "USD", "range"), ("d", "FY1", 10.0, 12.0, "USD", "range"), ("e", "FY1", 10.0, 12.0, "USD", "range"),
           ("f", "FY1", 10.0, 12.0, "USD", "range"), ("g", "Q1 FY1", 1.0, 1.0, "USD", "point"), ("h", "FY1", 1.0, 1.0, "USD", "point"), ("j", "FY1", 45.0, 45.0, "percent", "point")]
    cur = [("a", "FY1", 11.0, 13.0, "USD", "range"), ("b", "FY1", 9.0, 11.0, "USD", "range"), ("c", "FY1", 10.5, 11.5, "USD", "range"), ("d", "FY1", 9.0, 13.0, "USD", "range"), ("e", "FY1", 10.0, 12.0, "USD", "range"),
           ("f", "FY1", 10.0, 12.0, "percent", "range"), ("i", "FY2", 1.0, 1.0, "USD", "point"), ("j", "FY1", 45.04, 45.04, "percent", "point")]
    got = {r["metric"]: r["change"] for r in fg.diff_items(mk(cur), mk(pri), ["t"]).collect()}
    assert got == {"a": "raised", "b": "lowered", "c": "narrowed", "d": "widened", "e": "reiterated", "f": "not comparable", "g": "lapsed", "h": "not repeated", "i": "introduced", "j": "reiterated"}


# -- text ----------------------------------------------------------------------------------------------

def test_markup_becomes_text_like_the_plain_form(spark):
    raw = "<head><title>x</title></head><p>A&nbsp;&amp; B&eacute;</p><script>var a='</p>';</script><div>  one\t two </div><br><br><br><br><li>z &lt;tag&gt;</li>"
    s = re.sub(r"(?is)<(script|style|head|ix:header)\b.*?</\1\s*>", " ", raw)
    s = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)</?(p|div|br|tr|table|h[1-6]|li|ul|ol|section)\b[^>]*>", "\n", s))
    s = re.sub("[ \t\xa0]+", " ", html.unescape(s).replace("\xa0", " "))
    want = re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in s.splitlines())).strip()
    df = spark.createDataFrame([(raw,)], "h string")
    assert df.select(tx.html_to_text("h")).collect()[0][0] == want


def test_call_log_headings_and_aligned_prices(spark, tmp_path):
    log = ("# Log\n\n```\n## YYYY-MM-DD TICKER  Title\nPrice at call: 1\n```\n\n## 2026-09-04 AAA BBB DPM.TO  Recommendation: Buy now\nPrice at call: 610.68 / 1,145.59 / 9\nThesis: words.\nWrong if: a close under $130, or worse.\nConviction: 4\nHorizon: 10 trading days\nStop: 1 / 2\n"
           "\n## 2026-09-05 NVR RECAP: late\nPrice at call: n/a\nWrong if: N/A.\nConviction: 9\nHorizon: 3 weeks\n")
    (tmp_path / "log.md").write_text(log)
    rows = {r["ticker"]: r for r in texts.call_log(spark, str(tmp_path / "log.md")).collect()}
    assert set(rows) == {"AAA", "BBB", "DPM.TO", "NVR"}
    assert [rows[t]["price_at_call"] for t in ("AAA", "BBB", "DPM.TO", "NVR")] == [610.68, 1145.59, 9.0, None]
    assert rows["BBB"]["stop"] is None and rows["BBB"]["horizon_days"] == 10 and rows["NVR"]["horizon_days"] is None
    assert rows["NVR"]["title"] == "RECAP: late" and rows["NVR"]["wrong_if"] is None and rows["NVR"]["conviction"] is None and rows["AAA"]["title"] == "Recommendation: Buy now"


def test_note_faults_are_reported_and_not_raised(spark):
    good = "# AAA  A Co\n\nQuality rank 4 of 150, score 89.\n\n## Financials\n| FY | a | b | c | d | e | f |\n|--|--|--|--|--|--|--|\n" + "".join(f"| FY{y} | 1 | 50% | 20% | 1 | 2 | -3 |\n" for y in (2021, 2022, 2023)) + "\n## Sources\n- [T](http://x/y), read 2026-01-02\n- Plain, pulled 2026-01-03\n"
    bad = "# BBB  B Co\n\nx\n\n## Financials\n| FY2021 | 1 | 2 |\n"
    n = texts.parse_notes(spark.createDataFrame([("AAA", good), ("WRONG", bad)], "stem string, value string"))
    s = texts.note_sections(n)
    f = {r["fiscal_year"]: r["gross_margin"] for r in texts.note_financials(s).where("ticker = 'AAA'").collect()}
    assert f == {"FY2021": 0.5, "FY2022": 0.5, "FY2023": 0.5}
    src = {(r["title"], r["url"], r["read_date"]) for r in texts.note_sources(s).collect()}
    assert src == {("T", "http://x/y", "2026-01-02"), ("Plain", None, "2026-01-03")}
    faults = {(r["ticker"], r["fault"]) for r in texts.note_errors(n, s, ("Financials", "Sources")).collect()}
    assert {t for t, _ in faults} == {"BBB"} and len(faults) == 5


def test_wording_of_calls(spark):
    rows = [("Buy now", "buy"), ("Buy in October", "buy_later"), ("Buy on a pullback to $10", "buy_on_pullback"), ("Watchlist", "watch"), ("Pass", "pass"), (None, "other")]
    df = spark.createDataFrame(rows, "a string, want string")
    assert df.where(tx.call_kind("a") != F.col("want")).count() == 0
    trig = spark.createDataFrame([("or a close under $1,130.50", 1130.5), ("closing below 12", 12.0), ("under $3.6 billion", None), ("close under $0", None)], "a string, want double")
    assert trig.where(~tx.price_trigger("a").eqNullSafe(F.col("want"))).count() == 0


def test_dates(spark):
    r = spark.range(1).select(compact_date(F.lit("20241231")).alias("a"), compact_date(F.lit("20241331")).alias("b"), years_back(F.lit("2024-02-29").cast("date"), 1).alias("c"), weekdays_between(F.lit("2026-09-04").cast("date"), F.lit("2026-09-08").cast("date")).alias("d"),
                              feed_timestamp(F.lit("Fri, 04 Sep 2026 10:00:00 GMT")).alias("e"), feed_timestamp(F.lit("2026-09-04")).alias("f"), feed_timestamp(F.lit("soon")).alias("g")).collect()[0]
    assert (r["a"], r["b"], r["c"], r["d"], r["g"]) == (D(2024, 12, 31), None, D(2023, 2, 28), 2, None) and r["e"].hour == 10 and r["f"].day == 4


# -- files -------------------------------------------------------------------------------------------------

def test_changed_headers_and_error_bodies_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,name\nA,b\n")
    (tmp_path / "b.csv").write_text('{"Note": "limit"}\n')
    for f in ("a.csv", "b.csv"):
        with pytest.raises(ValueError):
            st.listing_rows(spark, str(tmp_path / f))
    with pytest.raises(ValueError):
        st.screen_rows(spark, str(tmp_path / "a.csv"), {"score": "double"})


def test_filing_set_reads_unquoted_tabs(spark, tmp_path):
    q = tmp_path / "2023q3"
    q.mkdir()
    (q / "sub.txt").write_text("adsh\tcik\tname\tform\tperiod\tfy\tfp\tfiled\textra\nA1\t5\tSaid \"x\t10-K\t20230630\t2023\tFY\t20230801\tz\n")
    (q / "num.txt").write_text("adsh\ttag\tversion\tcoreg\tddate\tqtrs\tuom\tvalue\tfootnote\nA1\tRevenues\tus-gaap/2023\t\t20230630\t4\tUSD\t10\t\nA1\tRevenues\tus-gaap/2023\tSub\t20230630\t4\tUSD\t11\t\nA1\tRevenues\tus-gaap/2023\t\t20230630\t4\tUSD\t\t\nA1\tRevenues\tus-gaap/2023\t\t20231330\t4\tUSD\t3\t\n")
    sub, num = st.filing_set(spark, str(tmp_path))
    got = fx.clean_facts(num, sub).collect()
    assert [(r["cik"], r["value"], r["taxonomy"], r["filed"]) for r in got] == [(5, 10.0, "us-gaap", D(2023, 8, 1))]
    assert sub.collect()[0]["name"] == 'Said "x'


def test_quotes_without_a_price_are_empty(spark):
    df = spark.createDataFrame([("a", json.dumps({"c": 0, "pc": 0, "d": 0, "h": 5})), ("b", json.dumps({"c": 4, "pc": -1, "d": 0.0, "h": 5, "l": 3}))], "s string, body string")
    got = {r["s"]: r for r in payloads.quotes(df).collect()}
    assert got["a"]["high"] is None and got["a"]["change"] is None
    assert got["b"]["previous_close"] is None and got["b"]["change"] == 0.0 and got["b"]["range_position"] == 0.5


def test_archiving_again_changes_nothing_unless_forced(spark, tmp_path):
    root = str(tmp_path / "arch")
    df = spark.createDataFrame([("A", 1.0)], "ticker string, score double")
    assert sinks.archive_snapshot(df, root, "2026-09-04") and not sinks.archive_snapshot(df.withColumn("score", F.lit(2.0)), root, "2026-09-04")
    assert sinks.read_archive(spark, root).collect()[0]["score"] == 1.0
    assert sinks.archive_snapshot(df.withColumn("score", F.lit(2.0)), root, "2026-09-04", force=True)
    assert sinks.read_archive(spark, root).collect()[0]["score"] == 2.0
    with pytest.raises(ValueError):
        rp.snapshot_panel(sinks.read_archive(spark, root).withColumnRenamed("snapshot_date", "snapshot"))


def test_attrition_counts_only_names_listed_long_enough(spark):
    rows = [("A", 1, "NYSE", "Stock", D(2000, 1, 1), None), ("B", 2, "NYSE", "Stock", D(2000, 1, 1), D(2020, 1, 1)), ("C", 3, "NYSE", "Stock", D(2017, 1, 1), D(2020, 1, 1)), ("D", 4, "NYSE", "ETF", D(2000, 1, 1), D(2020, 1, 1)),
            ("E", 5, "BATS", "Stock", D(2000, 1, 1), D(2020, 1, 1)), ("F", 6, "NASDAQ", "Stock", None, D(2020, 1, 1)), ("G", 7, "NASDAQ", "Stock", D(2000, 1, 1), D(2010, 1, 1))]
    l = spark.createDataFrame(rows, "symbol string, row_id long, exchange string, asset_type string, ipo_date date, delist_date date")
    r = ls.attrition(l, "2021-06-30", horizons=(3,)).collect()[0]
    assert r["eligible"] == 2 and r["gone"] == 1 and r["annualised"] == pytest.approx(1 - 0.5 ** (1 / (1096 / 365.25)), abs=1e-6)


def test_price_alert_rules(spark):
    d0 = D(2026, 9, 4)
    rows = [("under", True, 100.0, 99.0, 99.0 / 100 - 1, True, 0.0, 0.0), ("near", False, 100.0, 104.0, 0.04, False, 0.0, 0.0), ("quiet", False, None, 50.0, None, None, 0.01, -0.1), ("drop", False, None, 50.0, None, None, 0.06, -0.2)]
    df = spark.createDataFrame([(*r, d0) for r in rows], "ticker string, held boolean, trigger double, last_close double, to_trigger double, breached boolean, chg_1d double, chg_5d double, last_date date")
    got = {(r["ticker"], r["kind"], r["severity"]) for r in wa.price_alerts(df).collect()}
    assert got == {("under", "trigger", 3), ("near", "near_trigger", 2), ("drop", "drop_week", 3), ("drop", "move_day", 2)}
