"""Tables a reader sees: trends, memo, positions, digest, company record, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import cagr, growth, ladder, safe_div
from panelspark.functions.text import buy_zone, price_trigger, standing
from panelspark.operators.asof import asof_backward, asof_forward
from panelspark.operators.panel import own_reads
from panelspark.operators.rangemin import ends, first_below, places, range_minimum, sparse_table
from panelspark.operators.ranks import join_on, place, spearman, top_n, value_bucket
from panelspark.session import cut_lineage

# Portfolio limits and trend bands.
MIN_POSITIONS, MAX_POSITIONS, MAX_POSITION, MAX_SECTOR, MAX_CYCLICAL, CASH_BAND = 8, 12, 0.12, 0.30, 0.30, (0.20, 0.30)
FLAT_BAND, FLAT_POINTS = 0.05, 0.01


# -- trends ------------------------------------------------------------------------------------

def trends(series: DataFrame) -> DataFrame:
    """Summary of each (entity, metric) over its observed periods.

    ``series``: ``entity, metric, period, pos, value, unit, higher_is_better``; a handful of periods each.
    """
    on = F.when(F.col("value").isNotNull(), F.col("pos"))
    year = F.try_to_number(F.regexp_extract("period", r"(\d{4})", 1), F.lit("9999")).cast("int")
    s = series.withColumn("_y", year)
    g = s.groupBy("entity", "metric", "unit", "higher_is_better").agg(
        F.count("value").alias("n_obs"), F.min_by("value", on).alias("first"), F.max_by("value", on).alias("last"),
        F.min_by("_y", on).alias("_y0"), F.max_by("_y", on).alias("_y1"), F.count(F.when(F.col("value").isNotNull(), F.col("_y"))).alias("_ny"))
    years = F.col("_y1") - F.col("_y0")
    periods = F.when(F.col("n_obs") < 2, 0).when(years > 0, years).otherwise(F.col("n_obs") - 1).cast("long")
    first, last, pct = F.col("first"), F.col("last"), F.col("unit") == "percent"
    delta = last - first
    rel = delta / F.abs(first)
    sign = F.when(delta > 0, "up").otherwise("down")
    direction = ladder([
        (first.isNull(), "unknown"), (pct & (F.abs(delta) < FLAT_POINTS), "flat"), (pct, sign),
        ((first == 0) & (delta == 0), "flat"), (first == 0, sign), (F.abs(rel) < FLAT_BAND, "flat")], sign)
    g = g.withColumns({"periods": periods, "has_gap": (F.col("n_obs") >= 2) & (F.col("_ny") == F.col("n_obs")) & (years != F.col("n_obs") - 1), "direction": direction})
    return g.select(
        "entity", "metric", "n_obs", "first", "last", "periods", "has_gap", delta.alias("change"),
        F.when((first > 0) & (last >= 0), last / first - 1.0).alias("change_pct"), F.when(~pct, cagr("first", "last", "periods")).alias("cagr"), "direction",
        F.when(F.col("direction").isin("up", "down"), (F.col("direction") == "up") == F.col("higher_is_better")).alias("reads_well"))


def best_marks(cells: DataFrame) -> DataFrame:
    """The best cells of each metric row in its direction; none under two values or when all tie."""
    lo, hi = F.min("value"), F.max("value")
    g = cells.where(F.col("value").isNotNull()).groupBy("metric", "higher_is_better").agg(F.count(F.lit(1)).alias("_n"), lo.alias("_lo"), hi.alias("_hi"))
    j = cells.join(g.drop("higher_is_better"), "metric", "left")
    want = F.when(F.col("higher_is_better"), F.col("_hi")).otherwise(F.col("_lo"))
    return j.withColumn("best", F.coalesce((F.col("_n") >= 2) & (F.col("_lo") < F.col("_hi")) & (F.col("value") == want), F.lit(False))).drop("_n", "_lo", "_hi")


def recommendation_totals(rows: DataFrame) -> DataFrame:
    """Totals only where all five buckets are present."""
    parts = [F.col(c) for c in ("strong_buy", "buy", "hold", "sell", "strong_sell")]
    total = parts[0] + parts[1] + parts[2] + parts[3] + parts[4]
    return rows.withColumn("total", total).withColumn("bullish_share", safe_div(F.when(F.col("total").isNotNull(), F.col("strong_buy") + F.col("buy")), F.col("total")))


def basis_warning(records: DataFrame, min_names: int = 20) -> DataFrame:
    """How differently the two own-history comparisons read, and their correlation with growth."""
    both = cut_lineage(records.where((F.col("n_hist_years") >= 3) & F.col("pe_vs_median").isNotNull() & F.col("ev_vs_median").isNotNull())
                       .select("pe_vs_median", "ev_vs_median", "rev_cagr"))
    long = both.select("rev_cagr", F.explode(F.array(F.struct(F.lit("pe").alias("basis"), F.col("pe_vs_median").alias("v")),
                                                    F.struct(F.lit("ev").alias("basis"), F.col("ev_vs_median").alias("v")))).alias("_s")).select("rev_cagr", "_s.*")
    from panelspark.operators.describe import describe
    d = describe(long, ["basis"], "v").select("basis", "n", "median")
    neg = long.groupBy("basis").agg(F.avg((F.col("v") < 0).cast("double")).alias("share_negative"))
    rho = spearman(long, ["basis"], "v", "rev_cagr").select("basis", "rho")
    ok = F.col("n") >= min_names
    return d.join(neg, "basis").join(rho, "basis", "left").select("basis", "n", *[F.when(ok, F.col(c)).alias(c) for c in ("share_negative", "median", "rho")])


# -- memo ---------------------------------------------------------------------------------------------

def size_band(total: Column, thin: Column, has_note: Column, cyclical: Column) -> tuple[Column, Column, Column]:
    """P20: a size range from the rules, and the notes that explain it."""
    ceiling = total * MAX_POSITION
    base = total * (1 - CASH_BAND[0]) / 10.0
    f = F.when(thin, 0.6).otherwise(1.0) * F.when(has_note, 1.0).otherwise(0.6) * F.when(cyclical, 0.7).otherwise(1.0)
    lo, hi = F.least(base * f * 0.75, ceiling), F.least(base * f * 1.25, ceiling)
    notes = F.array_compact(F.array(F.when(thin, "thin evidence"), F.when(~has_note, "no note"), F.when(cyclical, "cyclical turn"), F.when(hi >= ceiling, "position limit")))
    ok = total > 0
    return F.when(ok, F.bround(lo, -2)), F.when(ok, F.bround(hi, -2)), F.when(ok, notes)


def stance(action: Column) -> Column:
    a = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    return ladder([(a.startswith("pass"), "passed"), (a.startswith("watch"), "watching"), (a.startswith("buy"), "buy")], "unstated")


def position_lists(scores: DataFrame, notes: DataFrame, held: DataFrame, n: int = 12) -> DataFrame:
    """Candidates, declined and the reading queue by score; held names skipped, declined ones all kept."""
    j = scores.join(held.select("ticker"), "ticker", "left_anti").join(notes.select("ticker", F.col("action").alias("_a"), F.lit(True).alias("_n")), "ticker", "left")
    j = j.withColumns({"stance": F.when(F.col("_n"), stance(F.col("_a"))).otherwise("unread"), "has_note": F.coalesce("_n", F.lit(False))})
    j = j.withColumn("list", F.when(F.col("stance") == "buy", "candidate").when(F.col("has_note"), "declined").otherwise("queue")).drop("_a", "_n")
    order = [F.desc("score"), F.asc("ticker")]
    short = top_n(j.where(F.col("list") != "declined"), ["list"], order, n)
    declined = place(j.where(F.col("list") == "declined"), ["list"], [(value_bucket(F.col("score")), True)], order, "rank")
    return short.unionByName(declined)


def drivers_and_drags(z: DataFrame, n: int = 4, floor: float = 0.01) -> DataFrame:
    """T4: a name's largest contributions above the floor and its worst below minus the floor."""
    c = z.withColumn("c", F.coalesce(F.col("weight") * F.col("z"), F.lit(0.0)))
    up = top_n(c.where(F.col("c") > floor), ["ticker"], [F.desc(F.round("c", 12)), F.asc("key")], n).withColumn("side", F.lit("driver"))
    down = top_n(c.where(F.col("c") < -floor), ["ticker"], [F.asc(F.round("c", 12)), F.asc("key")], n).withColumn("side", F.lit("drag"))
    return up.unionByName(down).select("ticker", "side", "rank", "key", F.col("c").alias("contribution"))


def constraint_checks(holdings: DataFrame, cash: DataFrame, sectors: DataFrame) -> DataFrame:
    """The five rules of each portfolio as rows of (rule, status, value).

    ``holdings``: ``portfolio, ticker, cost_usd, bucket``; ``cash``: ``portfolio, cash_usd``.
    """
    h = holdings.join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("unknown")))
    t = h.groupBy("portfolio").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("dep"), F.max("cost_usd").alias("big"),
                                   F.sum(F.when(F.lower(F.coalesce("bucket", F.lit(""))).startswith("cyc"), F.col("cost_usd")).otherwise(0.0)).alias("cyc"))
    s = h.groupBy("portfolio", "sector").agg(F.sum("cost_usd").alias("v")).groupBy("portfolio").agg(F.max("v").alias("sec"))
    j = cash.join(t, "portfolio", "left").join(s, "portfolio", "left").fillna(0.0, ["dep", "big", "cyc", "sec"]).fillna(0, ["n"])
    total = F.when(F.col("cash_usd") + F.col("dep") != 0, F.col("cash_usd") + F.col("dep")).otherwise(1.0)
    dep = F.when(F.col("dep") != 0, F.col("dep")).otherwise(1.0)

    def row(name: str, ok: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.when(ok, "ok").otherwise("not met").alias("status"), value.cast("double").alias("value"))

    cp, sp, pp, yp = F.col("cash_usd") / total, F.col("sec") / total, F.col("big") / total, F.col("cyc") / dep
    rules = F.array(row("names", F.col("n").between(MIN_POSITIONS, MAX_POSITIONS), F.col("n")), row("cash", cp.between(*CASH_BAND), cp), row("sector", sp <= MAX_SECTOR, sp),
                    row("position", pp <= MAX_POSITION, pp), row("cyclical", yp <= MAX_CYCLICAL, yp))
    return j.select("portfolio", F.explode(rules).alias("_r")).select("portfolio", "_r.*")


# -- positions -----------------------------------------------------------------------------------------

def mark_positions(positions: DataFrame, prices: DataFrame, bench: DataFrame, as_of: str, usdcad: float) -> DataFrame:
    """Value, return, profit, same-window benchmark and the breach flag of each position.

    ``positions``: ``pos, ticker, bought, shares, cost_per_share, currency, stop``.
    """
    day = F.lit(as_of).cast("date")
    from panelspark.plans.grading import low_since
    last = prices.where(F.col("close").isNotNull() & (F.col("session") <= day)).groupBy("ticker").agg(F.max_by("close", "session").alias("last"))
    b1 = bench.where(F.col("session") <= day).agg(F.max_by("bench", "session")).scalar()
    p = low_since(positions.withColumn("date", F.col("bought")), prices, as_of).join(last, "ticker", "left").withColumn("_all", F.lit(1))
    p = asof_backward(p, bench.select(F.lit(1).alias("_all"), "session", F.col("bench").alias("_b0")), ["_all"], "bought", "session", ["_b0"])
    fx = F.when(F.col("currency") == "CAD", 1.0 / usdcad).otherwise(1.0)
    br = F.when(F.col("_b0") > 0, b1 / F.col("_b0") - 1.0)
    return p.select("pos", "ticker", "last", (F.col("last") * F.col("shares") * fx).alias("value_usd"), (F.col("cost_per_share") * F.col("shares") * fx).alias("cost_usd"),
                    growth("last", "cost_per_share").alias("ret"), ((F.col("last") - F.col("cost_per_share")) * F.col("shares") * fx).alias("pnl_usd"),
                    br.alias("bench_ret"), (F.col("low_since_call") < F.col("stop")).alias("stop_breached"))


def position_lows(positions: DataFrame, prices: DataFrame, as_of: str | None = None) -> DataFrame:
    """One row per position: the lowest close since the fill, whether one was under the stop, and the first session it was.

    ``positions``: ``pos, ticker, bought, stop``. No position is paired with its sessions: both answers come from the closes of its name,
    which are written once, in order, in one row.
    """
    p = prices.where(F.col("close").isNotNull())
    if as_of is not None:
        p = p.where(F.col("session") <= F.lit(as_of).cast("date"))
    table, top = sparse_table(p, "ticker", None, "close", also="session")                              # one row per session
    asks = asof_forward(positions.select("pos", "ticker", "bought", "stop"), places(table, "ticker", "idx", "session"), ["ticker"], "bought", "session", ["idx"], unique=True)
    asks = asks.withColumnRenamed("idx", "lo").join(ends(table, "ticker", "hi"), "ticker", "left")
    low = first_below(range_minimum(asks, table, "ticker"), table, top, "ticker", "stop", show="breached_on")
    return low.select("pos", "ticker", "low", F.col("at").isNotNull().alias("breached"), "breached_on")


def running_lows(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """W26 as a series: per position and session since the fill, the lowest close so far and whether it is under the stop. ``position_lows`` answers without the pairs.

    The pairs are neither moved nor sorted: a position carries the least close of the 1, 2, 4 ... sessions from its fill on, a
    session that of the 1, 2, 4 ... up to it, and any stretch is covered by one of each. Rows that repeat a ``pos`` are one
    series and are put in order together.
    """
    real = cut_lineage(prices.where(F.col("close").isNotNull() & F.col("ticker").isNotNull() & F.col("session").isNotNull()).select("ticker", "session", "close"))
    held = positions.where(F.col("ticker").isNotNull() & F.col("bought").isNotNull()).select("pos", "ticker", "bought", "stop")
    again = held.groupBy("pos").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    out = ["pos", "session", "close", "low_so_far", "breached"]
    breached = F.col("low_so_far") < F.col("stop")
    if again.isEmpty():
        return _lows_by_doubling(held, real).withColumn("breached", breached).select(*out)
    again = cut_lineage(again.withColumn("_again", F.lit(True)))
    tagged = cut_lineage(join_on(held, again, ["pos"], "left", long=True))
    once = _lows_by_doubling(tagged.where("_again IS NULL").drop("_again"), real).withColumn("breached", breached).select(*out)
    j = tagged.where("_again").drop("_again").join(real, "ticker").where(F.col("session") >= F.col("bought"))
    w = Window.partitionBy("pos").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)      # rows that repeat a name
    return once.unionByName(j.withColumn("low_so_far", F.min("close").over(w)).withColumn("breached", breached).select(*out))


def _lows_by_doubling(held: DataFrame, real: DataFrame) -> DataFrame:
    """``pos, stop, session, close, low_so_far`` of positions whose ``pos`` are all different."""
    longest = real.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    bars = real.select("ticker", F.col("session").alias("at"), "session", "close", none(held, "pos"), none(held, "stop"), F.lit(1).alias("side"))
    fills = held.select("ticker", F.col("bought").alias("at"), none(real, "session"), none(real, "close"), "pos", "stop", F.lit(0).alias("side"))
    before = Window.partitionBy("ticker").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    # a close's number, and for a position that of the first close from its fill on
    d = bars.unionByName(fills).withColumn("i", F.count("close").over(before) + (1 - F.col("side")))
    one = Window.partitionBy("ticker").orderBy("i")
    d = d.withColumn("low_0", F.min("close").over(one.rangeBetween(0, 0)))
    top = max(int(longest or 1).bit_length() - 1, 0)
    for k in range(top):
        d = d.withColumn(f"low_{k + 1}", F.least(f"low_{k}", F.min(f"low_{k}").over(one.rangeBetween(1 << k, 1 << k))))
    upto = F.array(*[F.min(f"low_{k}").over(one.rangeBetween(1 - (1 << k), 1 - (1 << k))) for k in range(top + 1)])
    p = d.where("side = 0").select("pos", "ticker", "stop", F.col("i").alias("_from"), F.array(*[f"low_{k}" for k in range(top + 1)]).alias("_ahead"))
    s = d.withColumn("_back", upto).where("side = 1").select(F.col("ticker").alias("_t"), "session", "close", "i", "_back")
    j = p.hint("merge").join(s, (F.col("ticker") == F.col("_t")) & (F.col("i") >= F.col("_from")))
    level = F.floor(F.log2((F.col("i") - F.col("_from") + 1) + F.lit(0.5))).cast("int")          # half a step off the powers, so never rounded across one
    return j.select("pos", "stop", "session", "close", F.least(F.get("_ahead", level), F.get("_back", level)).alias("low_so_far"))


def portfolio_series(holdings: DataFrame, prices: DataFrame, cash: DataFrame, bench: DataFrame, usdcad: float, start_cash: float = 100_000.0) -> DataFrame:
    """Holdings at each session's price from the purchase on, cash as of the session, and the indexed benchmark."""
    fx = F.when(F.col("currency") == "CAD", F.lit(1.0 / usdcad)).otherwise(1.0)
    # units held of a name change on few days: positions are summed per day, then run up, and each
    # price row takes the count of its day, so positions are never paired with sessions
    per_day = holdings.groupBy("ticker", "bought").agg(F.sum(F.col("shares") * fx).alias("_u"))
    w = Window.partitionBy("ticker").orderBy("bought").rowsBetween(Window.unboundedPreceding, 0)     # one row per day
    units = per_day.select("ticker", "bought", F.sum("_u").over(w).alias("units"))
    v = asof_backward(prices.where(F.col("close").isNotNull()).select("ticker", "session", "close"), units, ["ticker"], "session", "bought", ["units"])
    v = v.where(F.col("units").isNotNull()).groupBy("session").agg(F.sum(F.col("close") * F.col("units")).alias("holdings_usd"))
    days = bench.select("session", "bench", F.lit(1).alias("_all"))
    d = asof_backward(days, cash.select(F.lit(1).alias("_all"), "session", "balance"), ["_all"], "session", "session", ["balance"])
    base = bench.agg(F.min_by("bench", "session")).scalar()
    j = d.join(v, "session", "left").withColumns({"cash_usd": F.coalesce("balance", F.lit(start_cash)), "holdings_usd": F.coalesce("holdings_usd", F.lit(0.0))})
    return j.select("session", "holdings_usd", "cash_usd", (F.col("holdings_usd") + F.col("cash_usd")).alias("total_usd"), (F.col("bench") / base * start_cash).alias("bench_indexed"))


def scorecard(series: DataFrame) -> DataFrame:
    """Return of the portfolio and of the benchmark from first to last session."""
    r = lambda c: growth(F.max_by(c, "session"), F.min_by(c, "session"))
    return series.agg(r("total_usd").alias("portfolio_return"), r("bench_indexed").alias("bench_return"))


# -- digest ---------------------------------------------------------------------------------------------

def benchmark_summary(prices: DataFrame, as_of: str) -> DataFrame:
    """Last close and its move over 1 and 5 own sessions and since the last close of the prior year."""
    r = own_reads(prices, as_of)
    p = prices.where(F.col("close").isNotNull() & (F.col("session") <= F.lit(as_of).cast("date")))
    y = p.groupBy("ticker", F.year("session").alias("_y")).agg(F.max_by("close", "session").alias("_c"))
    j = r.withColumn("_ly", F.year("last_date")).join(y.withColumnRenamed("ticker", "_t"), (F.col("ticker") == F.col("_t")) & (F.col("_y") < F.col("_ly")), "left")
    g = j.groupBy("ticker", "back_0", "last_date", "back_1", "back_5").agg(F.max_by("_c", "_y").alias("_base"))
    return g.select("ticker", F.col("back_0").alias("last_close"), "last_date", growth("back_0", "back_1").alias("chg_1d"), growth("back_0", "back_5").alias("chg_5d"), growth("back_0", "_base").alias("ytd"))


def day_movers(reads: DataFrame, n: int = 2, floor: float = 0.02) -> DataFrame:
    """The largest moves up and down beyond the floor."""
    r = reads.where(F.col("chg_1d").isNotNull())
    up = r.where(F.col("chg_1d") >= floor).orderBy(F.desc("chg_1d"), "ticker").limit(n).withColumn("side", F.lit("up"))
    down = r.where(F.col("chg_1d") <= -floor).orderBy(F.asc("chg_1d"), "ticker").limit(n).withColumn("side", F.lit("down"))
    return up.unionByName(down).select("side", "ticker", "chg_1d")


def upcoming(events: DataFrame, watched: DataFrame, today: str, days: int = 14) -> DataFrame:
    """Events within the next days, watched names first."""
    d = F.datediff("date", F.lit(today).cast("date"))
    j = events.where(d.between(0, days)).join(watched.select("ticker").distinct().withColumn("_w", F.lit(True)), "ticker", "left")
    return j.withColumn("watched", F.coalesce("_w", F.lit(False))).drop("_w")


def upcoming_digest(events: DataFrame, watched: DataFrame, today: str, days: int = 8) -> DataFrame:
    """P11 as the digest lists it: the next days only, watched names first, then by date and name; ``place`` states the order."""
    soon = upcoming(events, watched, today, days)
    return place(soon, [], [(F.col("watched"), True), (F.col("date"), False)], [F.asc("ticker"), *[F.asc(c) for c in events.columns if c not in ("ticker", "date")]], "place")


def capped_headlines(items: DataFrame, per_name: int, total: int) -> DataFrame:
    """A cap per name, then a cap on the whole report."""
    order = [F.desc("published"), F.asc("guid")]
    k = top_n(items, ["ticker"], order, per_name).drop("rank")
    return top_n(k, [], [F.asc("ticker"), *order], total)


def digest_rows(counts: DataFrame) -> DataFrame:
    """Severity first, then held, then name; ``place`` states the order for a table without one."""
    coarse = [(F.col("max_severity"), True), (F.col("held"), True), (F.substring("ticker", 1, 2), False)]
    return place(counts, [], coarse, [F.asc("ticker")], "place")


def standing_calls(calls: DataFrame, reads: DataFrame, held: DataFrame, today: str) -> DataFrame:
    """What the call log says to buy now, wait for or leave, at the last closes.

    ``calls``: ``ticker, pos, action, wrong_if`` and maybe ``conviction``; ``reads``: ``ticker, last_close, breached``. A call whose
    own wrong-if level is broken is ``out`` whatever it says; a held name does not wait; a call that commits to nothing has no row.
    ``place`` orders the list of what to buy by conviction, names not held first, the others by the log.
    """
    c = calls if "conviction" in calls.columns else calls.withColumn("conviction", F.lit(None).cast("double"))
    j = c.select("ticker", "pos", "action", "wrong_if", F.coalesce(F.col("conviction").cast("double"), F.lit(0.0)).alias("conviction"))
    j = j.join(reads.select("ticker", F.col("last_close").alias("price"), F.col("breached").alias("_b")), "ticker", "left")
    j = j.join(held.select("ticker").distinct().withColumn("held", F.lit(True)), "ticker", "left").fillna(False, ["held"])
    j = j.withColumns({"trigger": price_trigger("wrong_if"), "standing": standing("action", "price", F.lit(today).cast("date"))})
    broken = F.coalesce("_b", F.lit(False)) | F.coalesce(F.col("price") < F.col("trigger"), F.lit(False))
    what = F.when(F.col("standing") == "skip", F.lit(None)).when(broken, "out").when(F.col("standing") == "now", "buy now").when(~F.col("held"), "waiting")
    z0, z1 = buy_zone("action")
    why = ladder([(broken, "wrong-if level broken"), (z0.isNull() | z1.isNull(), "wording"), (F.col("price").isNull(), "no close"),
                  (F.col("price") > z1, "above its zone"), (F.col("price") < z0, "under its zone")], "inside its zone")
    j = j.withColumns({"list": what, "why": why}).where(F.col("list").isNotNull())
    buy = F.col("list") == "buy now"
    j = j.withColumns({"_c": F.when(buy, -F.col("conviction")).otherwise(0.0), "_h": buy & F.col("held")})
    # a list may hold most of the log: it is counted by slices of names, or of the log
    slice_ = F.when(buy, F.substring("ticker", 1, 3)).otherwise(F.lpad((F.col("pos") / 4096).cast("long").cast("string"), 18, "0"))
    done = place(j, ["list"], [(F.col("_c"), False), (F.col("_h"), False), (slice_, False)], [F.when(buy, F.col("ticker")).asc(), F.asc("pos"), F.asc("ticker")], "place")
    return done.select("list", "place", "ticker", "pos", "price", "trigger", "held", "why")


# -- company record and index --------------------------------------------------------------------------

def company_record(records: DataFrame, trend_rows: DataFrame, peers: DataFrame) -> DataFrame:
    """One nested row per name: identity, fundamentals, valuation, trends, gaps."""
    t = trend_rows.groupBy(F.col("entity").alias("ticker")).agg(                          # a few metrics per name
        F.sort_array(F.collect_list(F.struct("metric", "first", "last", "periods", "direction"))).alias("trends"))
    fund = ["roic_avg", "fcf_margin_avg", "rev_cagr", "nd_to_ebitda", "share_change", "gm_avg"]
    val = ["forward_pe", "ev_ebitda", "pe_vs_median", "ev_vs_median", "dd_52w", "dd_ath"]
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fund + val]))
    j = records.join(t, "ticker", "left").join(peers.select("ticker", F.col("verdict").alias("peer_verdict"), F.col("gap").alias("peer_gap")), "ticker", "left")
    buckets = F.array_compact(F.array(F.when(F.col("bucket_compounder"), "compounder"), F.when(F.col("bucket_cyclical_turn"), "cyclical turn")))
    return j.select("ticker", F.struct("name", "sector", "industry").alias("identity"), F.struct(*fund).alias("fundamentals"), F.struct(*val).alias("valuation"),
                    F.struct("peer_verdict", "peer_gap").alias("peers"), buckets.alias("buckets"), net_revisions().alias("net_revisions"), "trends", gaps.alias("gaps"))


def net_revisions() -> Column:
    """Up minus down; null when nobody is counted on either side."""
    return F.when(F.col("rev_up").isNotNull() | F.col("rev_down").isNotNull(), F.coalesce("rev_up", F.lit(0.0)) - F.coalesce("rev_down", F.lit(0.0)))


def search_index(index: DataFrame, text: str, sort: str, descending: bool = False) -> DataFrame:
    """P10: case-insensitive substring over the text facets, sorted with nulls last either way."""
    hay = F.lower(F.concat_ws(" ", "ticker", "name", "sector", "industry"))
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return index.where(hay.contains(text.lower())).orderBy(order, "ticker")


# -- snapshots --------------------------------------------------------------------------------------------

def snapshot_movements(presence: DataFrame) -> DataFrame:
    """First snapshot at which a name entered, and at which it was gone from the one before.

    ``presence``: ``snapshot, ticker``. Snapshots are numbered on a small table of dates.
    """
    dates = presence.select("snapshot").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("snapshot")))
    p = presence.distinct().join(F.broadcast(dates), "snapshot")                            # one row per snapshot
    n = dates.agg(F.max("_i")).scalar()
    w = Window.partitionBy("ticker").orderBy("_i")                                            # one row per snapshot
    p = p.withColumns({"_prev": F.lag("_i").over(w), "_next": F.lead("_i").over(w)})
    ent = F.when((F.col("_i") > 1) & (F.coalesce("_prev", F.lit(-1)) != F.col("_i") - 1), F.col("_i"))
    left = F.when((F.col("_i") < n) & (F.coalesce("_next", F.lit(-1)) != F.col("_i") + 1), F.col("_i") + 1)
    g = p.groupBy("ticker").agg(F.min(ent).alias("_e"), F.min(left).alias("_l"))
    a, b = dates.select(F.col("_i").alias("_e"), F.col("snapshot").alias("entered")), dates.select(F.col("_i").alias("_l"), F.col("snapshot").alias("left_on"))
    return g.join(F.broadcast(a), "_e", "left").join(F.broadcast(b), "_l", "left").select("ticker", "entered", "left_on")


def snapshot_panel(scores: DataFrame) -> DataFrame:
    """The archived scores as rebalances; fewer than two dates are refused before any measurement."""
    if scores.select("snapshot").distinct().limit(2).count() < 2:
        raise ValueError("a panel needs at least two snapshot dates")
    return scores.select(F.col("snapshot").alias("date"), "ticker", "score")


def backtest_from_snapshots(scores: DataFrame, prices: DataFrame, horizon: int, policy: str = "truncate") -> DataFrame:
    """Archived scores joined to forward returns, with the status of each return."""
    from panelspark.operators.panel import forward_returns
    p = snapshot_panel(scores)
    f = forward_returns(p, prices, horizon, policy)
    return f.select("date", "ticker", "score", "fwd_ret", "status")
