"""Universe filter, quality screen and price screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import clip, growth, ladder, safe_div
from panelspark.operators.asof import asof_backward
from panelspark.operators.ranks import position, rank_columns
from panelspark.session import cut_lineage

# Screen rules.
MIN_MARKET_CAP_USD = 2_000_000_000
MIN_DOLLAR_VOLUME_USD = 10_000_000
MIN_YEARS_LISTED = 3
ALLOWED_EXCHANGES = ("NMS", "NYQ", "NGM", "NCM", "TOR")
EXCLUDED_COUNTRIES = ("China", "Hong Kong")
SPAC_WORDS = ("acquisition corp", "acquisition co", "spac", "blank check")
FINANCIAL_INDUSTRY_WORDS = ("bank", "insurance", "capital markets", "mortgage", "credit services", "asset management",
                            "financial data", "financial conglomerates")
QUALITY_WEIGHTS = {"roic": 25, "fcf": 20, "growth": 15, "balance": 15, "shares": 10, "gm_stability": 15}
CYCLICAL_SECTORS = ("Technology", "Industrials", "Basic Materials", "Energy", "Consumer Cyclical")
CYCLICAL_INDUSTRY_WORDS = (
    "semiconductor", "steel", "aluminum", "copper", "chemical", "oil", "gas", "coal", "mining", "industrial", "machinery",
    "farm", "construction", "auto", "truck", "aerospace", "railroad", "shipping", "marine", "airlines", "building",
    "lumber", "paper", "packaging", "electrical equipment", "engineering", "metal", "energy", "drilling", "equipment",
    "agricultural")


def any_word(text: Column, words) -> Column:
    """Substring test against plain words."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(words))


def to_usd(amount: Column | str, currency: Column | str, usdcad: float | Column) -> Column:
    """Canadian amounts are divided by the rate."""
    a = F.col(amount) if isinstance(amount, str) else amount
    c = F.col(currency) if isinstance(currency, str) else currency
    rate = usdcad if isinstance(usdcad, Column) else F.lit(float(usdcad))
    return F.when(c == "CAD", a / rate).otherwise(a)


def universe(raw: DataFrame, usdcad: float, as_of: str, exchanges=ALLOWED_EXCHANGES,
             min_cap: float = MIN_MARKET_CAP_USD, min_dollar_volume: float = MIN_DOLLAR_VOLUME_USD) -> DataFrame:
    """P1 + W19: listed equities above the floors, the most liquid listing per company."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), 365 * MIN_YEARS_LISTED)
    name = F.coalesce("long_name", "short_name")
    kept = raw.where(
        (F.col("quote_type") == "EQUITY") & F.col("exchange").isin(*exchanges)
        & ~F.col("symbol").rlike("[-^]") & ~any_word(name, SPAC_WORDS)
        & (F.coalesce(F.col("first_trade"), F.lit("1970-01-01").cast("date")) <= cutoff))
    kept = kept.withColumns({
        "dollar_volume_usd": to_usd(F.col("price") * F.coalesce("volume_3m", "volume_10d"), "currency", usdcad),
        "market_cap_usd": to_usd("market_cap", "currency", usdcad),
        "company_key": F.coalesce("board_id", "long_name", "symbol")})
    kept = kept.where((F.col("dollar_volume_usd") >= min_dollar_volume) & (F.col("market_cap_usd") >= min_cap))
    best = kept.groupBy("company_key").agg(
        F.max_by(F.struct("symbol", "exchange", "currency", "price", "market_cap_usd", "dollar_volume_usd", "first_trade",
                          name.alias("name")),
                 F.struct("dollar_volume_usd", "symbol")).alias("_s"))
    return best.select(F.col("_s.symbol").alias("ticker"), "company_key", "_s.name", "_s.exchange", "_s.currency", "_s.price",
                       "_s.market_cap_usd", "_s.dollar_volume_usd", "_s.first_trade")


def quality_metrics(statements: DataFrame) -> DataFrame:
    """A1: per company over its fiscal years with revenue. A company has a handful of years."""
    y = statements.where(F.coalesce(F.col("revenue"), F.lit(0.0)) != 0)
    tax = F.when(F.col("tax_rate").isNull() | (F.col("tax_rate") <= 0) | (F.col("tax_rate") > 0.5), 0.21).otherwise(F.col("tax_rate"))
    y = y.withColumns({
        "_roic": safe_div(F.col("ebit") * (1 - tax), "invested_capital"),
        "_fcfm": safe_div("fcf", "revenue"), "_gm": safe_div("gross_profit", "revenue")})

    def first(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("fy")))

    def last(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("fy")))

    def latest(c):
        return F.max_by(F.col(c), F.col("fy"))

    a = y.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_years"),
        F.avg("_roic").alias("roic_avg"),
        F.when(F.count("_roic") >= 2, last("_roic") - first("_roic")).alias("roic_trend"),
        last("_roic").alias("roic_latest"),
        F.avg("_fcfm").alias("fcf_margin_avg"),
        F.count_if(F.col("fcf") > 0).alias("fcf_positive_years"), F.count("fcf").alias("fcf_years"),
        F.min_by("revenue", "fy").alias("_r0"), F.max_by("revenue", "fy").alias("_r1"),
        latest("net_debt").alias("_nd"), latest("total_debt").alias("_td"), latest("cash").alias("_cash"),
        latest("ebitda").alias("ebitda_latest"),
        F.count("diluted_shares").alias("_nsh"),
        *[f(c).alias(f"_{n}_{c}") for c in ("diluted_shares", "shares_outstanding") for n, f in (("f", first), ("l", last))],
        F.count("shares_outstanding").alias("_nso"),
        F.avg("_gm").alias("gm_avg"),
        F.when(F.count("_gm") >= 2, F.stddev_pop("_gm")).alias("gm_std"))
    nd = F.coalesce("_nd", F.coalesce("_td", F.lit(0.0)) - F.coalesce("_cash", F.lit(0.0)))
    use_diluted = F.col("_nsh") > 0
    s0 = F.when(use_diluted, F.col("_f_diluted_shares")).otherwise(F.col("_f_shares_outstanding"))
    s1 = F.when(use_diluted, F.col("_l_diluted_shares")).otherwise(F.col("_l_shares_outstanding"))
    n_sh = F.when(use_diluted, F.col("_nsh")).otherwise(F.col("_nso"))
    steps = F.col("n_years") - 1
    return a.withColumn("net_debt", nd).select(
        "ticker", "n_years", "roic_avg", "roic_trend", "roic_latest", "fcf_margin_avg", "fcf_positive_years", "fcf_years",
        F.when((F.col("_r0") > 0) & (steps > 0), F.pow(F.col("_r1") / F.col("_r0"), F.lit(1.0) / steps) - 1.0).alias("rev_cagr"),
        "net_debt", "ebitda_latest",
        F.when(F.col("net_debt") <= 0, 0.0).when(F.col("ebitda_latest") > 0, F.col("net_debt") / F.col("ebitda_latest")).alias("nd_to_ebitda"),
        (F.col("net_debt") <= 0).alias("net_cash"),
        F.when((n_sh >= 2) & (s0 > 0), s1 / s0 - 1.0).alias("share_change"),
        "gm_avg", "gm_std")


def exclusion_reason(excluded_countries=EXCLUDED_COUNTRIES) -> Column:
    """The first failing rule names the reason; null keeps the row."""
    n = F.coalesce("n_years", F.lit(0))
    return ladder([
        (F.col("has_statements").isNull(), "no fundamentals in cache"),
        (n < 3, F.concat(F.lit("only "), n.cast("string"), F.lit(" years of statements"))),
        (any_word(F.col("industry"), FINANCIAL_INDUSTRY_WORDS), "bank/insurer/lender: ROIC, EBITDA and FCF screens do not apply"),
        (F.col("country").isin(*excluded_countries), F.concat(F.lit("country "), F.col("country"))),
    ])


def balance_points() -> Column:
    d = F.col("nd_to_ebitda")
    return ladder([(F.col("net_cash"), 100.0), (d < 1, 85.0), (d < 2, 65.0), (d < 3, 45.0), (d >= 3, 10.0)], 30.0)


def share_points() -> Column:
    s = F.col("share_change")
    return ladder([(s < -0.05, 100.0), (s < 0, 80.0), (s < 0.03, 55.0), (s < 0.10, 25.0), (s >= 0.10, 0.0)], 40.0)


def quality_points(metrics: DataFrame) -> DataFrame:
    """Six component scores 0..100 and their weighted total; a null component counts 0."""
    m = rank_columns(metrics, ["ticker"], [], {"_p_roic": "roic_avg", "_p_fcf": "fcf_margin_avg", "_p_growth": "rev_cagr",
                                               "_p_gm": -F.col("gm_std")}, scale="n100")
    weak = F.col("fcf_positive_years") < F.col("fcf_years") - 1
    raw = {
        "roic": F.when(F.col("roic_avg") < 0, 0.0).otherwise(
            F.col("_p_roic") + F.signum(F.coalesce("roic_trend", F.lit(0.0))) * 5),
        "fcf": F.when(F.col("fcf_margin_avg") < 0, 0.0).otherwise(F.when(weak, F.col("_p_fcf") * 0.2).otherwise(F.col("_p_fcf"))),
        "growth": F.col("_p_growth"),
        "balance": balance_points(), "shares": share_points(),
        "gm_stability": F.coalesce("_p_gm", F.lit(50.0))}
    pts = {k: clip(v, 0.0, 100.0) for k, v in raw.items()}
    total = sum((F.coalesce(pts[k], F.lit(0.0)) * w for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0)) / sum(QUALITY_WEIGHTS.values())
    return m.withColumns({**{f"score_{k}": F.bround(v, 1) for k, v in pts.items()}, "quality_score": F.bround(total, 1)}).drop(
        "_p_roic", "_p_fcf", "_p_growth", "_p_gm")


def screened(statements: DataFrame, names: DataFrame, excluded_countries=EXCLUDED_COUNTRIES) -> DataFrame:
    """Every name with its metrics and, where a rule drops it, the reason."""
    have = statements.select("ticker").distinct().withColumn("has_statements", F.lit(True))
    j = names.join(quality_metrics(statements).hint("merge"), "ticker", "left").join(have.hint("merge"), "ticker", "left")
    return j.withColumn("exclude_reason", exclusion_reason(excluded_countries)).drop("has_statements")


def liquid_universe(rows: DataFrame, min_dollar_volume: float = MIN_DOLLAR_VOLUME_USD) -> DataFrame:
    """Ticker and name of the rows above the floor; a blank ticker is dropped, a missing name is the ticker, the most traded row of a ticker counts."""
    t = F.upper(F.trim("ticker"))
    kept = rows.where((F.coalesce("dollar_volume_usd", F.lit(0.0)) >= min_dollar_volume) & (F.coalesce(t, F.lit("")) != ""))
    return kept.groupBy(t.alias("ticker")).agg(F.max_by("name", F.struct("dollar_volume_usd", "name")).alias("name")).select("ticker", F.coalesce("name", "ticker").alias("name"))


def flag_top(scored: DataFrame, top: DataFrame) -> DataFrame:
    """Every scored name with whether it is on the top list."""
    return scored.join(top.select("ticker", F.lit(True).alias("in_top_150")).distinct(), "ticker", "left").withColumn("in_top_150", F.coalesce("in_top_150", F.lit(False)))


def excluded(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("exclude_reason").isNotNull())


def quality_screen(rows: DataFrame) -> DataFrame:
    """X1 over ``screened`` rows: component scores, total and rank of every name that stays."""
    # one row per company, read once per ranked column: written once
    kept = cut_lineage(rows.where(F.col("exclude_reason").isNull()).drop("exclude_reason"))
    return position(cut_lineage(quality_points(kept)), "quality_score", "ticker", "rank")


def own_history_multiples(statements: DataFrame, prices: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """A4 + J13: median P/E and EV/EBITDA at each year end; a company has a handful of years."""
    y = statements.where(F.coalesce(F.col("revenue"), F.lit(0.0)) != 0)
    at = asof_backward(y, prices.where(F.col("close").isNotNull()).withColumn("px", F.col("close")),
                       ["ticker"], "period_end", "session", ["px"])
    shares = F.when(F.coalesce(F.col("diluted_shares"), F.lit(0.0)) != 0, F.col("diluted_shares")).otherwise(F.col("shares_outstanding"))
    nd = F.coalesce("net_debt", F.coalesce("total_debt", F.lit(0.0)) - F.coalesce("cash", F.lit(0.0)))
    pe = F.when(F.col("diluted_eps") > 0, F.col("px") / F.col("diluted_eps"))
    ev = F.when((F.col("ebitda") > 0) & (shares != 0), (F.col("px") * shares + nd) / F.col("ebitda"))
    m = at.groupBy("ticker").agg(F.median(pe).alias("median_pe_hist"), F.median(ev).alias("median_ev_ebitda_hist"),
                                 F.count(pe).alias("n_hist_years"))
    return m if skip is None else m.join(skip.select("ticker").hint("merge"), "ticker", "left_anti")


def price_screen(top: DataFrame, prices: DataFrame, statements: DataFrame, estimates: DataFrame, info: DataFrame) -> DataFrame:
    """Multiples against own history, drawdowns, estimate moves, bucket flags.

    ``info`` has ``ticker, forward_pe, ev_ebitda, high_52w, fin_currency, px_currency``.
    """
    mismatch = info.where(F.col("fin_currency").isNotNull() & F.col("px_currency").isNotNull()
                          & (F.col("fin_currency") != F.col("px_currency")))
    mult = own_history_multiples(statements, prices, mismatch)
    px = prices.where(F.col("close").isNotNull()).groupBy("ticker").agg(
        F.max_by("close", "session").alias("last"), F.max("close").alias("ath"))
    # every side has a row per name: met by merges, for as broadcasts the driver would hold each of them unpacked
    j = top
    for side in (info, px, mult, estimates):
        j = j.join(side.hint("merge"), "ticker", "left")
    j = j.withColumns({
        "n_hist_years": F.coalesce("n_hist_years", F.lit(0)),
        "pe_vs_median": F.when((F.col("forward_pe") != 0) & (F.col("median_pe_hist") > 0), growth("forward_pe", "median_pe_hist")),
        "ev_vs_median": F.when((F.col("ev_ebitda") != 0) & (F.col("median_ev_ebitda_hist") > 0), growth("ev_ebitda", "median_ev_ebitda_hist")),
        "dd_52w": growth("last", "high_52w"), "dd_ath": growth("last", "ath"),
        "eps_fy1_chg_30d": growth("eps_fy1_now", "eps_fy1_30d"), "eps_fy1_chg_90d": growth("eps_fy1_now", "eps_fy1_90d"),
        "eps_fy0_chg_30d": growth("eps_fy0_now", "eps_fy0_30d")})
    return cut_lineage(j.withColumns({"bucket_compounder": compounder(), "bucket_cyclical_turn": cyclical_turn()}))


def compounder() -> Column:
    """Cheap against its own median on either multiple."""
    return F.coalesce(F.col("pe_vs_median") <= 0, F.lit(False)) | F.coalesce(F.col("ev_vs_median") <= 0, F.lit(False))


def cyclical_turn() -> Column:
    stable = (F.coalesce("eps_fy1_chg_30d", F.lit(0.0)) >= -0.005) | (F.coalesce("eps_fy0_chg_30d", F.lit(0.0)) >= -0.005)
    return F.coalesce(F.col("sector").isin(*CYCLICAL_SECTORS), F.lit(False)) & any_word(F.col("industry"), CYCLICAL_INDUSTRY_WORDS) \
        & F.coalesce(F.col("dd_ath") <= -0.35, F.lit(False)) & stable


def estimate_drift(c30: str, c90: str) -> tuple[Column, Column]:
    """The earlier 60-day part of a 90-day move, and whether the last 30 days outpaced it."""
    a, b = F.col(c30), F.col(c90)
    rest = safe_div(1 + b, 1 + a) - 1.0
    pace, whole = (1 + a) * (1 + a) * (1 + a), 1 + b
    return rest, F.when((b != 0) & (a > -1), F.when(b > 0, pace > whole).otherwise(pace < whole))
