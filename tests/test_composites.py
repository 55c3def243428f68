"""Diagnosis of a score, standing calls and vendor payloads on small inputs."""

import datetime as dt
import json
import math

import pytest

from panelspark.plans import diagnose as dg
from panelspark.plans import reports as rp
from panelspark.plans import score as sc
from panelspark.sources import payloads as pl


@pytest.mark.parametrize("rho", [0.0, 0.6, 0.99])
def test_effective_signals_by_entropy(spark, rho):
    pairs = spark.createDataFrame([("a", "b", rho), ("a", "c", None)], "a string, b string, rho double")
    lam = [1 + rho, 1 - rho, 1.0]
    want = math.exp(-sum(x / 3 * math.log(x / 3) for x in lam if x > 0))
    assert dg.effective_signals(pairs, ["a", "b", "c"], 20) == pytest.approx(want)
    assert dg.effective_signals(pairs, ["a", "b", "c"], 19) is None
    assert dg.participation(pairs, 3).first()[0] == pytest.approx(9 / sum(x * x for x in lam))


def company(i, **over):
    row = {"ticker": f"N{i:02d}", "sector": "x", "roic_avg": i * 0.01, "roic_trend": (i * 7 % 11) * 0.1, "fcf_years": 5, "fcf_positive_years": 5, "fcf_margin_avg": (i * 5 % 13) * 0.01, "rev_cagr": i * 0.02,
           "gm_std": (i * 3 % 17) * 0.01, "net_cash": False, "nd_to_ebitda": (i * 11 % 19) * 0.1, "n_hist_years": 5, "ev_vs_median": (i * 13 % 23) * 0.01, "pe_vs_median": (i * 2 % 29) * 0.01,
           "eps_fy1_chg_90d": (i * 9 % 7) * 0.01, "eps_fy1_chg_30d": (i * 4 % 9) * 0.01, "rev_up": 1.0 * (i % 4), "rev_down": 1.0, "share_change": (i * 6 % 5) * 0.01, "short_pct_float": (i * 8 % 3) * 0.01,
           "dd_52w": -(i % 10) * 0.05, "dd_ath": -(i % 8) * 0.05, "quality_score": float(i)}
    return {**row, **over}


def records(spark, n, **over):
    rows = [company(i, **over) for i in range(1, n + 1)]
    types = {bool: "boolean", int: "int", float: "double", str: "string"}
    ddl = ", ".join(f"{k} {types[type(company(1)[k])]}" for k in rows[0])
    return spark.createDataFrame([tuple(r.values()) for r in rows], ddl)


def test_diagnosis_notes(spark):
    d = dg.diagnose(records(spark, 24))
    notes = {r["note"]: r for r in d.notes.collect()}
    assert "few_names" not in notes and notes["worst_pair"]["subject"] == "roic,growth" and notes["worst_pair"]["value"] == pytest.approx(1.0)
    assert 1 <= notes["redundant_pairs"]["value"] and 1 < d.effective < 13 and 1 < notes["participation"]["value"] < 13
    assert sum(r["share"] for r in d.variance.collect()) == pytest.approx(1.0) and d.thin.count() == 0 and d.moves.count() == 12


def test_diagnosis_of_few_and_thin_names(spark):
    d = dg.diagnose(records(spark, 6, rev_up=None, rev_down=None, ev_vs_median=None, pe_vs_median=None, eps_fy1_chg_90d=None, eps_fy1_chg_30d=None))
    notes = {r["note"]: r["value"] for r in d.notes.collect()}
    assert d.effective is None and notes["few_names"] == 6 and "participation" not in notes and "few_signals" not in notes
    assert notes["thin_names"] == 6 == d.thin.count()


def test_variants_share_one_pass(spark):
    r = records(spark, 12)
    by, _ = sc.variant_scores(r)
    for v, s in by.items():
        own = {x["ticker"]: round(x["score"], 9) for x in sc.score_universe(r, v).collect()}
        assert {x["ticker"]: round(x["score"], 9) for x in s.collect()} == own


def test_standing_calls(spark):
    calls = [("A", 1, "Buy now", "a close under $90", 1.0), ("B", 2, "Buy now", None, 3.0), ("C", 3, "Buy on a pullback to $100 to $120", None, None), ("D", 4, "Buy on a pullback to $100 to $120", None, None),
             ("E", 5, "Pass", "a close under $90", None), ("F", 6, "Buy now", "a close under $90", 9.0), ("G", 7, "Buy in October", None, None), ("H", 8, "Buy in October", None, None), ("I", 9, None, None, None), ("B", 10, "buy", None, 3.0)]
    reads = [("A", 95.0, None), ("B", 50.0, False), ("C", 110.0, False), ("D", 130.0, False), ("E", 1.0, True), ("F", 80.0, None), ("G", 5.0, False)]
    out = rp.standing_calls(spark.createDataFrame(calls, "ticker string, pos long, action string, wrong_if string, conviction double"), spark.createDataFrame(reads, "ticker string, last_close double, breached boolean"),
                            spark.createDataFrame([("B",), ("B",), ("H",)], "ticker string"), "2024-03-01")
    got = {(r["list"], r["place"]): (r["ticker"], r["pos"], r["why"]) for r in out.collect()}
    assert got == {("buy now", 1): ("B", 2, "wording"), ("buy now", 2): ("B", 10, "wording"), ("buy now", 3): ("A", 1, "wording"), ("buy now", 4): ("C", 3, "inside its zone"),
                   ("waiting", 1): ("D", 4, "above its zone"), ("waiting", 2): ("G", 7, "wording"), ("out", 1): ("F", 6, "wrong-if level broken")}


def test_vendor_payloads(spark):
    def body(x):
        return spark.createDataFrame([(1, json.dumps(x))], "id long, body string")
    bad = spark.createDataFrame([(2, None), (3, "[]"), (4, ""), (5, "not json"), (6, '{"a": ['), (7, '[{"year": 1}, 3]')], "id long, body string")
    for read in (pl.earnings, pl.company_news, pl.earnings_calendar, pl.recommendations):
        assert read(bad).count() == 0
    assert [r["found"] for r in pl.profiles(bad).collect()] == [False] * 6
    e = pl.earnings(body([{"year": 2024, "quarter": 2, "actual": 0.0, "estimate": -1.0}, {"year": 0, "quarter": 1, "period": "p", "actual": 1.0}, {}])).collect()
    assert [(r["label"], r["beat"]) for r in e] == [("2024Q2", True), ("p", None), ("?", None)]
    c = pl.earnings_calendar(body({"earningsCalendar": [{"date": "2024-05-01", "hour": "AMC", "epsEstimate": 0.0}, {"date": "", "epsEstimate": 1.0}]})).collect()
    assert [(r["date"], r["session"], r["has_consensus"]) for r in c] == [(dt.date(2024, 5, 1), "after market close", True), (None, None, False)]
    n = pl.company_news(body([{"headline": " x ", "datetime": 0, "id": 1}, {"headline": " ", "datetime": 5}])).collect()
    assert [(r["headline"], r["published"]) for r in n] == [("x", None)]
    p = pl.profiles(body({"marketCapitalization": 2.5})).first()
    assert p["market_cap"] == 2.5e6 and not p["found"]
    r = rp.recommendation_totals(pl.recommendations(body([{"period": "2024-01-01", "strongBuy": 1, "buy": 2, "hold": None, "sell": 0, "strongSell": 0}]))).first()
    assert r["total"] is None and r["bullish_share"] is None
