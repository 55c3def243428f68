"""As-reported fundamentals from filed facts, as known on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import cagr, safe_div
from panelspark.operators.intervals import range_self_join
from panelspark.operators.ranks import spearman

# The tags that can carry a line, in order of preference.
GAAP_TAGS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax",
                "Revenues", "SalesRevenueNet", "SalesRevenueGoodsNet"),
    "cost_of_revenue": ("CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfServices"),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncomeLoss",),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"),
    "diluted_shares": ("WeightedAverageNumberOfDilutedSharesOutstanding",),
    "basic_shares": ("WeightedAverageNumberOfSharesOutstandingBasic",),
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
    "equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue",),
    "short_term_investments": ("ShortTermInvestments", "MarketableSecuritiesCurrent"),
    "long_term_debt": ("LongTermDebtNoncurrent", "LongTermDebt"),
    "short_term_debt": ("LongTermDebtCurrent", "ShortTermBorrowings", "DebtCurrent"),
    "commercial_paper": ("CommercialPaper",),
    "depreciation_amortization": ("DepreciationDepletionAndAmortization", "DepreciationAndAmortization", "DepreciationAmortizationAndAccretionNet"),
    "interest_expense": ("InterestExpense", "InterestExpenseDebt"),
    "income_tax": ("IncomeTaxExpenseBenefit",),
    "pretax_income": ("IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest",),
    "rd": ("ResearchAndDevelopmentExpense",),
    "sbc": ("ShareBasedCompensation",),
    "dividends_paid": ("PaymentsOfDividendsCommonStock", "PaymentsOfDividends"),
    "buybacks": ("PaymentsForRepurchaseOfCommonStock",),
}
IFRS_TAGS = {
    "revenue": ("Revenue", "RevenueFromContractsWithCustomers"),
    "cost_of_revenue": ("CostOfSales",),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("ProfitLossFromOperatingActivities",),
    "net_income": ("ProfitLoss",),
    "operating_cash_flow": ("CashFlowsFromUsedInOperatingActivities",),
    "capex": ("PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities",),
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
    "equity": ("Equity",),
    "cash": ("CashAndCashEquivalents",),
    "diluted_shares": ("WeightedAverageNumberOfDilutedSharesOutstanding",),
}
INSTANTS = ("assets", "liabilities", "equity", "cash", "short_term_investments", "long_term_debt", "short_term_debt", "commercial_paper")
YEAR_LINES = ("revenue", "cost_of_revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow", "capex",
              "diluted_shares", "basic_shares", "equity", "cash", "short_term_investments", "long_term_debt", "short_term_debt",
              "commercial_paper", "income_tax", "pretax_income", "depreciation_amortization", "assets")
TOLERANCE = {"roic_avg": 0.02, "roic_trend": 0.02, "roic_latest": 0.02, "fcf_margin_avg": 0.02, "rev_cagr": 0.01,
             "share_change": 0.01, "gm_avg": 0.02, "gm_std": 0.01, "nd_to_ebitda": 0.25}
FIELD_GROUPS = (("roic_avg", ("roic_avg", "roic_trend", "roic_latest")),
                ("fcf_margin_avg", ("fcf_margin_avg", "fcf_positive_years", "fcf_years")),
                ("rev_cagr", ("rev_cagr",)),
                ("nd_to_ebitda", ("net_debt", "ebitda_latest", "nd_to_ebitda", "net_cash")),
                ("share_change", ("share_change",)),
                ("gm_avg", ("gm_avg", "gm_std")))


def clean_facts(num: DataFrame, sub: DataFrame, forms: tuple[str, ...] | None = None) -> DataFrame:
    """P5 + J4: usable facts with the filing that carried them.

    Co-registrant and dimensioned rows are dropped, and rows missing a value, date,
    length or filing date. Both sides meet by accession; AQE broadcasts the filings
    when they are small.
    """
    n = num.where((F.coalesce("coreg", F.lit("")) == "") & F.coalesce("dimh", F.lit("")).isin("", "0x00000000")
                  & F.col("value").isNotNull() & F.col("ddate").isNotNull() & F.col("qtrs").isNotNull())
    s = sub.where(F.col("filed").isNotNull())
    if forms:
        s = s.where(F.col("form").isin(*forms))
    return n.drop("coreg", "dimh").join(s.select("adsh", "cik", "filed", "form"), "adsh")


def merge_submissions(sub: DataFrame, quarter: str = "quarter") -> DataFrame:
    """One row per accession, the later quarter's row wins."""
    rest = [c for c in sub.columns if c not in ("adsh", quarter)]
    return sub.groupBy("adsh").agg(F.max_by(F.struct(*rest), F.col(quarter)).alias("_s")).select("adsh", "_s.*")


def resolve_ids(names: DataFrame, ids: DataFrame) -> DataFrame:
    """The first spelling of a ticker that the id list knows; unmatched names keep a null id."""
    t = F.upper("ticker")
    cand = F.array(t, F.replace(t, F.lit("."), F.lit("-")), F.replace(t, F.lit("-"), F.lit(".")), F.split_part(t, F.lit("."), F.lit(1)))
    c = names.select("ticker", F.posexplode(cand).alias("_p", "_t"))
    hit = c.join(ids.select(F.col("ticker").alias("_t"), "cik"), "_t").groupBy("ticker").agg(F.min_by("cik", "_p").alias("cik"))
    return names.join(hit, "ticker", "left")


def tag_preference(spark) -> DataFrame:
    """``metric, taxonomy, tag, prio``: the fixed lists as a table of some forty rows."""
    rows = [(m, tax, tag, i + (0 if tax == "us-gaap" else 100))
            for tax, lists in (("us-gaap", GAAP_TAGS), ("ifrs-full", IFRS_TAGS)) for m, tags in lists.items() for i, tag in enumerate(tags)]
    return spark.createDataFrame(rows, "metric string, taxonomy string, tag string, prio int")


def metric_facts(facts: DataFrame) -> DataFrame:
    """Facts of the one tag each filer uses for a line, chosen over all its facts (us-gaap first)."""
    tagged = facts.join(F.broadcast(tag_preference(facts.sparkSession)), ["taxonomy", "tag"])   # some forty fixed rows
    best = tagged.groupBy("cik", "metric").agg(F.min("prio").alias("prio"))
    return tagged.join(best, ["cik", "metric", "prio"]).drop("prio")


def first_reported(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest filed value per key."""
    return facts.groupBy(*keys).agg(F.min_by(F.struct("value", "filed", "adsh"), F.struct("filed", "adsh", "value")).alias("_f")).select(*keys, "_f.*")


def annual_series(facts: DataFrame, on: str | None = None) -> DataFrame:
    """One value per (filer, tag, year end): first reported, or as known on a date."""
    keys = ["cik", "tag", "ddate"]
    y = facts.where(F.col("qtrs") == 4)
    if on is None:
        return first_reported(y, keys)
    y = y.where(F.col("filed") <= F.to_date(F.lit(on)))
    return y.groupBy(*keys).agg(F.max_by(F.struct("value", "filed", "adsh"), F.struct("filed", "adsh", "value")).alias("_f")).select(*keys, "_f.*")


def derived_fourth_quarters(facts: DataFrame) -> DataFrame:
    """Annual minus nine months, stamped with the annual filing; years with a real quarter are left alone."""
    j = range_self_join(facts, ["cik", "tag"], 4, 3, 75, 100)
    real = facts.where(F.col("qtrs") == 1).select("cik", "tag", F.col("ddate").alias("a_ddate")).distinct()
    j = j.join(real, ["cik", "tag", "a_ddate"], "left_anti")
    return j.select("cik", "tag", F.col("a_ddate").alias("ddate"), F.lit(1).alias("qtrs"), (F.col("a_value") - F.col("b_value")).alias("value"),
                    F.col("a_filed").alias("filed"), F.col("a_adsh").alias("adsh"), F.lit(True).alias("derived"))


def quarterly_series(facts: DataFrame, on: str | None = None) -> DataFrame:
    """Quarters with the derived fourth one: first reported, or as known on a date."""
    cols = ["cik", "tag", "ddate", "qtrs", "value", "filed", "adsh"]
    q = facts.where(F.col("qtrs") == 1).select(*cols, F.lit(False).alias("derived")).unionByName(derived_fourth_quarters(facts))
    keys = ["cik", "tag", "ddate"]
    rec, order = F.struct("value", "filed", "adsh", "derived"), F.struct("filed", "adsh", "value")
    if on is None:
        return q.groupBy(*keys).agg(F.min_by(rec, order).alias("_f")).select(*keys, "_f.*")
    q = q.where(F.col("filed") <= F.to_date(F.lit(on)))
    return q.groupBy(*keys).agg(F.max_by(rec, order).alias("_f")).select(*keys, "_f.*")


def fiscal_years(facts: DataFrame, on: str, window: int = 10) -> DataFrame:
    """A3: one row per filer and fiscal year known on the date, every line as known then."""
    day = F.to_date(F.lit(on))
    m = metric_facts(facts)
    rev = m.where((F.col("metric") == "revenue") & (F.col("qtrs") == 4))
    ends = rev.where(F.col("filed") <= day).groupBy("cik", F.year("ddate").alias("fy")).agg(F.max("ddate").alias("ddate"))
    recent = Window.partitionBy("cik").orderBy(F.desc("fy"))           # one row per fiscal year
    ends = ends.withColumn("_rn", F.row_number().over(recent)).where(F.col("_rn") <= window).drop("_rn")
    wanted = F.when(F.col("metric").isin(*INSTANTS), 0).otherwise(4)
    known = m.where((F.col("filed") <= day) & (F.col("qtrs") == wanted) & F.col("metric").isin(*YEAR_LINES))
    known = known.join(ends, ["cik", "ddate"])
    pick = known.groupBy("cik", "fy", "ddate", "metric").agg(
        F.max_by(F.struct("value", "filed", "adsh"), F.struct("filed", "adsh", "value")).alias("_f"))
    wide = pick.groupBy("cik", "fy", "ddate").agg(
        F.max("_f.filed").alias("filed"), F.count_distinct("_f.adsh").alias("n_filings"),
        *[F.max(F.when(F.col("metric") == x, F.col("_f.value"))).alias(x) for x in YEAR_LINES])
    first = rev.groupBy("cik", "ddate").agg(F.min("filed").alias("first_filed"))
    w = wide.where(F.col("revenue").isNotNull()).join(first, ["cik", "ddate"], "left")
    return with_ratios(w.withColumn("diluted_shares", F.coalesce("diluted_shares", "basic_shares")).withColumnRenamed("ddate", "end_date"))


def with_ratios(y: DataFrame) -> DataFrame:
    """Derived lines of a fiscal year."""
    gp = F.coalesce(F.col("gross_profit"), F.col("revenue") - F.col("cost_of_revenue"))
    fcf = F.col("operating_cash_flow") - F.abs(F.coalesce("capex", F.lit(0.0)))
    t = safe_div("income_tax", "pretax_income")
    tax = F.when(t.isNull() | (t <= 0) | (t > 0.5), 0.21).otherwise(t)
    parts = [F.col(c) for c in ("long_term_debt", "short_term_debt", "commercial_paper")]
    debt = F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
    y = y.withColumns({"gross_profit": gp, "fcf": fcf, "tax": tax, "total_debt": debt})
    ic = F.col("equity") + F.coalesce("total_debt", F.lit(0.0))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return y.withColumns({
        "gross_margin": safe_div("gross_profit", "revenue"), "fcf_margin": safe_div("fcf", "revenue"),
        "roic": F.when(ic > 0, F.col("operating_income") * (1 - F.col("tax")) / ic),
        "ebitda": F.col("operating_income") + F.col("depreciation_amortization"),
        "net_debt": F.when(F.col("total_debt").isNotNull() | F.col("cash").isNotNull(), z("total_debt") - z("cash") - z("short_term_investments"))})


def reported_aggregates(years: DataFrame) -> DataFrame:
    """A2: the screen's aggregates over as-reported years; growth over elapsed years."""
    on = lambda c: F.when(F.col(c).isNotNull(), F.col("fy"))
    sh = F.when(F.col("diluted_shares") != 0, F.col("diluted_shares"))
    y = years.withColumn("_sh", sh)
    g = y.groupBy("cik").agg(
        F.count(F.lit(1)).alias("n_years"), F.avg("roic").alias("roic_avg"), F.max_by("roic", on("roic")).alias("roic_latest"),
        F.when(F.count("roic") >= 2, F.max_by("roic", on("roic")) - F.min_by("roic", on("roic"))).alias("roic_trend"),
        F.avg("fcf_margin").alias("fcf_margin_avg"),
        F.when(F.count("fcf") > 0, F.count_if(F.col("fcf") > 0)).alias("fcf_positive_years"), F.when(F.count("fcf") > 0, F.count("fcf")).alias("fcf_years"),
        F.min_by("revenue", "fy").alias("_r0"), F.max_by("revenue", "fy").alias("_r1"), (F.max("fy") - F.min("fy")).alias("_span"),
        F.max_by("net_debt", "fy").alias("net_debt"), F.max_by("ebitda", "fy").alias("ebitda_latest"),
        F.count("_sh").alias("_n"), F.min_by("_sh", on("_sh")).alias("_s0"), F.max_by("_sh", on("_sh")).alias("_s1"),
        F.avg("gross_margin").alias("gm_avg"), F.when(F.count("gross_margin") >= 2, F.stddev_pop("gross_margin")).alias("gm_std"))
    net_cash = F.coalesce(F.col("net_debt") <= 0, F.lit(False))
    return g.select(
        "cik", "n_years", "roic_avg", "roic_trend", "roic_latest", "fcf_margin_avg", "fcf_positive_years", "fcf_years",
        cagr("_r0", "_r1", "_span").alias("rev_cagr"), "net_debt", "ebitda_latest",
        F.when(~net_cash & (F.col("ebitda_latest") > 0), F.col("net_debt") / F.col("ebitda_latest")).alias("nd_to_ebitda"),
        net_cash.alias("net_cash"), F.when((F.col("_n") >= 2) & (F.col("_s0") > 0), F.col("_s1") / F.col("_s0") - 1.0).alias("share_change"),
        "gm_avg", "gm_std")


def reconcile(a: DataFrame, b: DataFrame, key: str, complete: Column, tolerance: dict[str, float] = TOLERANCE) -> DataFrame:
    """Gap per field against its tolerance; a verdict only where the windows are ``complete``."""
    fields = list(tolerance)
    j = a.select(key, "window_a", *fields).join(
        b.select(key, "window_b", *[F.col(f).alias(f"b_{f}") for f in fields]), key)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("a"), F.col(f"b_{f}").cast("double").alias("b"),
                              F.lit(tol).alias("tolerance")) for f, tol in tolerance.items()])
    return (j.withColumn("_ok", complete).select(key, "_ok", F.explode(rows).alias("_r")).select(key, "_ok", "_r.*")
            .withColumn("gap", F.col("b") - F.col("a"))
            .withColumn("agrees", F.when(F.col("_ok"), F.abs("gap") <= F.col("tolerance"))).drop("_ok"))


def rebase(records: DataFrame, reported: DataFrame, key: str, min_years: int = 3) -> DataFrame:
    """Group by group the reported figures where their lead field is present, else the other source."""
    fields = [f for _, g in FIELD_GROUPS for f in g]
    r = reported.select(key, F.col("n_years").alias("_ny"), *[F.col(f).alias(f"_r_{f}") for f in fields])
    j = records.join(r, key, "left")
    enough = F.coalesce(F.col("_ny") >= min_years, F.lit(False))
    cols, flags = {}, []
    for lead, members in FIELD_GROUPS:
        use = F.col(f"_r_{lead}").isNotNull()
        if lead == "nd_to_ebitda":
            use = use | F.coalesce(F.col("_r_net_cash"), F.lit(False))
        use = enough & use
        flags.append(use)
        for f in members:
            cols[f] = F.when(use, F.col(f"_r_{f}")).otherwise(F.col(f))
    n_used = sum((x.cast("int") for x in flags), F.lit(0))
    basis = F.when(~enough, "other").when(n_used == len(flags), "reported").otherwise("mixed")
    by = F.array_join(F.array_compact(F.array(*[F.when(x, lead) for x, (lead, _) in zip(flags, FIELD_GROUPS)])), ",")
    return j.withColumn("basis", basis).withColumn("reported_groups", by).withColumns(cols).drop("_ny", *[f"_r_{f}" for f in fields])


def basis_sensitivity(a: DataFrame, b: DataFrame, key: str = "ticker", points: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Rank correlation of two bases, and the names whose display moved more than ``points``."""
    j = a.select(key, F.col("score").alias("x"), F.col("display").alias("da")).join(
        b.select(key, F.col("score").alias("y"), F.col("display").alias("db")).hint("merge"), key)
    return spearman(j, [], "x", "y"), j.where(F.abs(F.col("db") - F.col("da")) > points).select(key, "da", "db")


def margin_table(years: DataFrame) -> DataFrame:
    """Per-year margins; a missing or zero numerator gives null."""
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return years.where(z("revenue") != 0).select(
        "ticker", "fy", safe_div(nz("gross_profit"), F.col("revenue")).alias("gross_margin"), safe_div(nz("ebit"), F.col("revenue")).alias("operating_margin"),
        "fcf", F.coalesce(nz("diluted_shares"), F.col("shares_outstanding")).alias("shares"),
        F.coalesce(F.col("net_debt"), z("total_debt") - z("cash")).alias("net_debt"))


def duration_kind(start: Column, end: Column) -> Column:
    """Year, quarter, instant or other, by days."""
    d = F.datediff(end, start)
    return F.when(start.isNull(), "instant").when(d.between(330, 400), "year").when(d.between(60, 120), "quarter").otherwise("other")
