"""Replaying trading rules as an event study against a matched random control.

Arms are rows: one pass over the features yields the signals of every arm, and all
arms and all control replicates walk their price paths in one job.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelspark.functions.numeric import all_of, growth, ladder
from panelspark.operators import panel as pn
from panelspark.operators.chains import greedy_chain
from panelspark.operators.describe import describe
from panelspark.operators.intervals import in_spans
from panelspark.operators.resample import PRIME, SEED, block_bootstrap_ci, draw
from panelspark.plans.backtest import excess_verdict
from panelspark.plans.figures import once
from panelspark.session import cut_lineage

# One-way cost, the arm grid, and the two windows of the study.
ONE_WAY_COST = (5.0 + 5.0) / 10_000.0
SPLITS = {"train": ("2013-02-08", "2016-06-30"), "test": ("2016-07-01", "2018-02-07")}
HORIZONS = (5, 10, 20)
PEAD_SESSIONS = 3
CONTROL_REPLICATES = 20


@dataclass(frozen=True)
class FeatureConfig:
    """Window lengths with their minimum observations; the defaults are the daily study's."""
    short: tuple[int, int] = (20, 20)
    mid: tuple[int, int] = (50, 50)
    long: tuple[int, int] = (200, 200)
    high: tuple[int, int] = (252, 200)
    prior_high: tuple[int, int] = (251, 59)
    market: tuple[int, int] = (200, 200)
    rs: tuple[int, int] = (63, 126)
    min_history: int = 200
    min_dollar_volume: float = 10_000_000.0


@dataclass(frozen=True)
class Arm:
    id: str
    kind: str
    horizon: int
    params: dict = field(default_factory=dict)
    preregistered: bool = False


def default_arms() -> list[Arm]:
    """The declared grid; each entry is one hypothesis."""
    grid = [("pullback", "b", band, {"band": band, "max_dd": -0.15}, "pullback") for band in (0.02, 0.03, 0.04)]
    grid += [("breakout", "s", s, {"stop_pct": s}, "breakout_price_only") for s in (0.06, 0.08, 0.10)]
    grid += [("pead_proxy", "g", g, {"gap": g, "vol_mult": 2.0}, "pead_proxy") for g in (0.05, 0.08)]
    return [Arm(f"{n}_{k}{round(v * 100)}_h{h}", kind, h, p) for n, k, v, p, kind in grid for h in HORIZONS] + [Arm("spy_hold", "spy_hold", 0)]


_ARM_ID = re.compile(r"^(pullback|breakout|pead_proxy)_([bsg])(\d+)_h(\d+)(?:_([a-z0-9+]+))?$")


def arm_by_id(arm_id: str) -> Arm:
    """``kind_pNN_hNN[_filter+filter]``; an unknown id or filter raises."""
    m = _ARM_ID.match(arm_id)
    if not m:
        raise ValueError(f"unknown arm {arm_id!r}")
    kind, key, val, h, extra = m.groups()
    value, filters = int(val) / 100.0, [x for x in (extra or "").split("+") if x]
    unknown = [x for x in filters if x not in FILTERS]
    shapes = {("pullback", "b"): ("pullback", {"band": value, "max_dd": -0.15}),
              ("breakout", "s"): ("breakout_price_only", {"stop_pct": value}),
              ("pead_proxy", "g"): ("pead_proxy", {"gap": value, "vol_mult": 2.0})}
    if unknown or (kind, key) not in shapes:
        raise ValueError(f"unknown arm {arm_id!r}")
    k, p = shapes[(kind, key)]
    return Arm(arm_id, k, int(h), {**p, "filters": filters} if filters else p)


def compute_features(prices: DataFrame, bench: DataFrame, membership: DataFrame | None = None, exclude: DataFrame | None = None,
                     cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """One row per ticker and session of its life; all windows share one sort by (ticker, s_idx).

    ``bench`` is ``session, bench``: one row per session.
    """
    cal = pn.calendar(prices)
    one = Window.partitionBy(F.lit(0)).orderBy("s_idx")                     # one row per session
    nm, mm = cfg.market
    mw = one.rowsBetween(-(nm - 1), 0)
    b = cal.join(bench, "session", "left").select(
        "s_idx", "bench", *[growth("bench", F.lag("bench", n).over(one)).alias(f"_b{i}") for i, n in enumerate(cfg.rs)],
        (F.col("bench") > F.when(F.count("bench").over(mw) >= mm, F.avg("bench").over(mw))).alias("market_up"))
    bars = prices.select("ticker", "session", "close", "volume")
    if membership is not None:
        bars = in_spans(bars, membership, "ticker", "session", "_m")       # asked of the bars themselves, which carry the answer along
    d = pn.densify(pn.indexed(bars, cal), cal).join(F.broadcast(b), "s_idx")
    r = pn.rolling
    d = d.withColumn("_dv", F.col("close") * F.col("volume"))
    w = pn.by_ticker()
    d = d.withColumns({
        "ret1": pn.lag_return("close", 1),
        "ma_short": r(F.avg, "close", *cfg.short), "ma_mid": r(F.avg, "close", *cfg.mid), "ma_long": r(F.avg, "close", *cfg.long),
        "prior_high": r(F.max, "close", *cfg.prior_high, skip=1), "high": r(F.max, "close", *cfg.high),
        "low_short": r(F.min, "close", *cfg.short), "vol_mean": r(F.avg, "volume", *cfg.short, skip=1),
        "_dvm": r(F.avg, "_dv", *cfg.short, skip=1),
        "n_history": F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "rs_a": pn.lag_return("close", cfg.rs[0]) - F.col("_b0"), "rs_b": pn.lag_return("close", cfg.rs[1]) - F.col("_b1"),
        **{f"c_{k}": F.lag("close", k).over(w) for k in range(1, PEAD_SESSIONS)},
        **{f"low_{k}": r(F.min, "close", k + 1, k + 1) for k in range(PEAD_SESSIONS)}})
    ok = F.col("close").isNotNull() & (F.col("n_history") >= cfg.min_history) & (F.col("_dvm") >= cfg.min_dollar_volume)
    d = d.withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("_dv", "_dvm", "_b0", "_b1")
    if membership is not None:
        d = d.withColumn("eligible", F.col("eligible") & F.coalesce("_m", F.lit(False))).drop("_m")
    if exclude is not None:
        d = d.join(exclude.select("ticker").distinct().withColumn("_x", F.lit(True)), "ticker", "left")
        d = d.withColumn("eligible", F.col("eligible") & F.col("_x").isNull()).drop("_x")
    return d


# -- rules: kind -> (fires, stop) over the feature columns ------------------------------------------

def _pullback(p):
    c = F.col("close")
    fires = all_of([F.col("ma_mid") > F.col("ma_long"), c > F.col("ma_long"), F.abs(c / F.col("ma_short") - 1.0) <= p.get("band", 0.03),
                    c / F.col("high") - 1.0 >= p.get("max_dd", -0.15), F.col("low_short") < c])
    return fires, F.col("low_short")


def _breakout(p):
    return F.col("close") > F.col("prior_high"), F.col("close") * (1.0 - p.get("stop_pct", 0.08))


def _gap_on_volume(p):
    """The nearest release in the last sessions decides; a hold test that fails does not fall through."""
    w = pn.by_ticker()
    release = F.coalesce((F.col("ret1") >= p.get("gap", 0.05)) & (F.col("volume") >= p.get("vol_mult", 2.0) * F.col("vol_mean")), F.lit(False))
    c = F.col("close")
    fires, stop = None, None
    for k in range(PEAD_SESSIONS):
        rel = release if k == 0 else F.coalesce(F.lag(release, k).over(w), F.lit(False))
        held = (c >= (c if k == 0 else F.col(f"c_{k}"))) & (F.col(f"low_{k}") < c)
        fires = F.when(rel, held) if fires is None else fires.when(rel, held)
        stop = F.when(rel, F.col(f"low_{k}")) if stop is None else stop.when(rel, F.col(f"low_{k}"))
    return fires.otherwise(False), stop


# kinds without a rule of their own: cells drawn at random, and the benchmark held over the window
BASELINES = ("random", "spy_hold")
RULES = {"pullback": _pullback, "breakout_price_only": _breakout, "pead_proxy": _gap_on_volume}
FILTERS = {"mkt200": "the market is above its own long mean", "rs63": "the name outran the market over the first span",
           "rs126": "the name outran the market over the second span", "x1": "at least 1% beyond the level the rule keyed on"}


def entry_filter(name: str, kind: str) -> Column:
    """A named filter; an unknown name raises."""
    c = F.col("close")
    if name == "mkt200":
        return F.col("market_up")
    if name == "rs63":
        return F.col("rs_a") > 0
    if name == "rs126":
        return F.col("rs_b") > 0
    if name == "x1":
        level = {"breakout_price_only": F.col("prior_high"), "pullback": F.col("low_short")}.get(kind)
        return F.lit(True) if level is None else c >= level * 1.01
    raise ValueError(f"unknown filter {name!r}; known: {sorted(FILTERS)}")


def with_firings(features: DataFrame, arms: list[Arm]) -> DataFrame:
    """``features`` with ``fired``: an array of (arm, horizon, stop) of the arms that fire in the row.

    Asked of features that are not yet written, the rules share the sort of the feature windows.
    """
    cols, cells = {}, []
    for n, a in enumerate(arms):
        if a.kind in BASELINES:
            continue
        if a.kind not in RULES:
            raise ValueError(f"unknown arm kind {a.kind!r}")
        fires, stop = RULES[a.kind](a.params)
        conds = [fires, F.col("eligible")] + [entry_filter(x, a.kind) for x in a.params.get("filters") or []]
        cols[f"_f{n}"], cols[f"_s{n}"] = F.coalesce(all_of(conds), F.lit(False)), stop.cast("double")
        cells.append(F.when(F.col(f"_f{n}"), F.struct(F.lit(a.id).alias("arm"), F.lit(a.horizon).alias("horizon"), F.col(f"_s{n}").alias("stop"))))
    return features.withColumns(cols).withColumn("fired", F.array_compact(F.array(*cells))).drop(*cols)


def signals_of(fired: DataFrame) -> DataFrame:
    """``arm, horizon, ticker, s_idx, session, close, stop`` of every entry of ``fired``."""
    return fired.select("ticker", "s_idx", "session", "close", F.explode("fired").alias("_a")).select(
        "_a.arm", "_a.horizon", "ticker", "s_idx", "session", "close", "_a.stop")


def signals(features: DataFrame, arms: list[Arm]) -> DataFrame:
    """X11: ``arm, horizon, ticker, s_idx, session, close, stop`` for every firing of every arm, in one pass."""
    return signals_of(with_firings(features, arms))


def classify_signals(sig: DataFrame, last_idx: Column, start: str | None = None, end: str | None = None) -> DataFrame:
    """Each signal with a ``status``: ``event`` or the reason it was skipped.

    Only an accepted event starts a new refractory span: accepted are the first signal of a name in an arm that
    could be one, and each next one a horizon or more later, marked by pointer doubling.
    """
    inside = F.lit(True)
    if start:
        inside = inside & (F.col("session") >= F.lit(start).cast("date"))
    if end:
        inside = inside & (F.col("session") <= F.lit(end).cast("date"))
    bad = F.col("stop").isNull() | (F.col("stop") <= 0) | (F.col("stop") >= F.col("close"))
    pre = ladder([(~inside, "outside_window"), (F.col("s_idx") + 1 > F.col("_last"), "no_next_session"),
                  (F.col("s_idx") + F.col("horizon") > F.col("_last"), "truncated_at_panel_end"), (bad, "bad_stop")], "event")
    rows = cut_lineage(sig.withColumn("_last", last_idx).withColumn("_pre", pre).drop("_last"))
    keys = ["arm", "horizon", "ticker"]
    taken = greedy_chain(rows.where("_pre = 'event'").withColumn("_span", F.col("horizon")), keys, "s_idx", "_span").withColumnRenamed("pos", "_taken")
    got = rows.join(taken.hint("merge").withColumn("s_idx", F.col("_taken").cast(rows.schema["s_idx"].dataType)), [*keys, "s_idx"], "left")
    before = Window.partitionBy(*keys).orderBy("s_idx").rowsBetween(Window.unboundedPreceding, -1)         # one row per session
    near = F.coalesce(F.col("s_idx") < F.last("_taken", ignorenulls=True).over(before) + F.col("horizon"), F.lit(False))
    status = ladder([(F.col("_pre") == "outside_window", "outside_window"), (near, "within_previous_horizon")], F.col("_pre"))
    return got.select("arm", "horizon", "ticker", "s_idx", "session", "close", "stop", status.alias("status"))


def _event_type(events: DataFrame) -> StructType:
    return events.select(F.struct("arm", "rep", "horizon", "stop").alias("e")).schema["e"].dataType


def walk(events: DataFrame, prices: DataFrame, max_horizon: int, cost: float = ONE_WAY_COST) -> DataFrame:
    """J21 + W22 + J26: the trade of every event.

    ``events``: ``arm, rep, horizon, ticker, s_idx, stop``, a cell as often as it was drawn;
    ``prices``: ``ticker, s_idx, session, close, bench``, every index of a ticker's life. Events are put among the
    rows of their name, and a window gives each its own and the next ``max_horizon`` rows, so short rows are moved
    once and the arrays never; the exit rule is one pass over that short array. Only rows that some event of
    the name can reach are put into arrays.
    """
    at = prices.schema["s_idx"].dataType
    bar = F.struct(F.col("s_idx").alias("i"), "close", "bench", "session")
    rows = prices.select("ticker", "s_idx", bar.alias("bar"), F.lit(None).cast(_event_type(events)).alias("_e"))
    asks = events.where(F.col("ticker").isNotNull() & F.col("s_idx").isNotNull()).select("ticker", F.col("s_idx").cast(at).alias("s_idx"), F.lit(None).cast(rows.schema["bar"].dataType).alias("bar"), F.struct("arm", "rep", "horizon", "stop").alias("_e"))
    ahead = Window.partitionBy("ticker").orderBy("s_idx").rangeBetween(0, max_horizon)
    upto = Window.partitionBy("ticker").orderBy("s_idx").rangeBetween(Window.unboundedPreceding, 0)
    asked = F.max(F.when(F.col("_e").isNotNull(), F.col("s_idx"))).over(upto)
    near = rows.unionByName(asks).withColumn("_asked", asked).where(F.col("s_idx") - F.col("_asked") <= max_horizon).drop("_asked")
    t = near.withColumn("p", F.collect_list("bar").over(ahead)).where(F.col("_e").isNotNull() & (F.expr("get(p, 0).i") == F.col("s_idx")))
    t = t.select("_e.arm", "_e.rep", "_e.horizon", F.col("ticker").alias("_t"), F.col("s_idx").alias("_i"), "_e.stop", "p")
    t = t.withColumn("entry", F.expr("get(p, 1).close"))
    # one pass over the bars: the first that reaches the target, that closes under the stop in force, and that is missing
    first = """aggregate(sequence(1, CAST(horizon AS INT)), CAST(named_struct('u', NULL, 'h', NULL, 'g', NULL) AS STRUCT<u: INT, h: INT, g: INT>), (a, k) -> named_struct(
        'u', coalesce(a.u, CASE WHEN get(p, k).close >= entry + (entry - stop) THEN k END),
        'h', coalesce(a.h, CASE WHEN get(p, k).close < CASE WHEN a.u IS NOT NULL OR get(p, k).close >= entry + (entry - stop) THEN greatest(stop, entry) ELSE stop END THEN k END),
        'g', coalesce(a.g, CASE WHEN get(p, k).close IS NULL THEN k END)))"""
    t = t.select("*", once(_w=F.expr(first))).select("*", F.col("_w.u").alias("ku"), F.col("_w.h").alias("_kh"), F.col("_w.g").alias("_kg"))
    t = t.withColumn("_gone", F.coalesce(F.col("_kg") < F.coalesce("_kh", F.col("_kg") + 1), F.lit(False)))
    t = t.withColumns({"_kx": F.when(F.col("_gone"), F.col("_kg") - 1).when(F.col("_kh").isNotNull(), F.least(F.col("_kh") + 1, F.col("horizon"))).otherwise(F.col("horizon")),
                       "_kd": F.when(F.col("_gone"), F.col("_kg") - 1).otherwise(F.coalesce("_kh", "horizon"))})
    # no bar before the first missing one is missing, so only the bar after a stop may be
    t = t.withColumn("_ke", F.expr("CASE WHEN _gone THEN nullif(_kx, 0) WHEN _kx > _kh AND get(p, _kx).close IS NULL THEN _kh ELSE _kx END"))
    t = t.withColumns({
        "exit": F.expr("get(p, _ke).close"), "exit_date": F.expr("get(p, _ke).session"), "_b1": F.expr("get(p, _ke).bench"), "_b0": F.expr("get(p, 1).bench"),
        "fill_date": F.expr("get(p, 1).session"), "signal_date": F.expr("get(p, 0).session"), "_c0": F.expr("get(p, 0).close"), "_ch": F.expr("get(p, horizon).close"),
        "stop_final": F.expr("CASE WHEN _kd >= ku THEN greatest(stop, entry) ELSE stop END")})
    t = t.where(F.col("entry").isNotNull() & F.col("exit").isNotNull() & (F.col("entry") > 0))
    early = F.col("_gone") | (F.col("_ke") < F.col("_kx"))
    net = (F.col("exit") * (1.0 - cost)) / (F.col("entry") * (1.0 + cost)) - 1.0
    spy = F.when(F.col("_b0") > 0, F.col("_b1") / F.col("_b0") - 1.0)
    return t.select(
        "arm", "rep", "horizon", F.col("_t").alias("ticker"), "signal_date", "fill_date", "exit_date",
        F.when(early, "panel_end").when(F.col("_kh").isNotNull(), "stop").otherwise("horizon").alias("exit_reason"),
        "entry", F.col("stop").alias("stop_initial"), "stop_final", "exit", (F.col("_ke") - 1).alias("sessions_held"),
        (F.col("exit") / F.col("entry") - 1.0).alias("ret_gross"), net.alias("ret_net"),
        F.when(F.col("_c0") > 0, F.col("_ch") / F.col("_c0") - 1.0).alias("ret_from_signal_close"),
        spy.alias("bench_same_window"), (net - spy).alias("excess"))


def event_study(features: DataFrame, sig: DataFrame, max_horizon: int, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(every signal with its status, the trades of the accepted ones)."""
    last = features.agg(F.max("s_idx")).scalar()
    status = classify_signals(sig, last, start, end)
    ev = status.where("status = 'event'").withColumn("rep", F.lit(-1))
    return status, walk(ev, features, max_horizon)


# -- statistics -----------------------------------------------------------------------------------------

def block_for(horizon: Column) -> Column:
    return (F.ceil(horizon / F.lit(21.0)) + 1).cast("int")


def skip_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("arm", "status").agg(F.count(F.lit(1)).alias("n"))


def arm_statistics(trades: DataFrame) -> DataFrame:
    """Per arm."""
    win, loss = F.sum(F.when(F.col("ret_net") > 0, F.col("ret_net")).otherwise(0.0)), -F.sum(F.when(F.col("ret_net") < 0, F.col("ret_net")).otherwise(0.0))
    g = trades.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_trades"), (F.count_if(F.col("ret_net") > 0) / F.count(F.lit(1))).alias("hit_rate"),
        F.avg("ret_net").alias("mean_net"), F.avg("excess").alias("mean_excess"), F.when(loss > 0, win / loss).alias("profit_factor"),
        F.avg("ret_from_signal_close").alias("mean_from_signal"),
        *[F.count_if(F.col("exit_reason") == r).alias(f"n_{r}") for r in ("stop", "horizon", "panel_end")])
    return g.join(describe(trades, ["arm"], "ret_net").select("arm", F.col("median").alias("median_net")), "arm")


def by_year(trades: DataFrame) -> DataFrame:
    """A15 by fill year with the overall row, as one rollup."""
    return trades.withColumn("year", F.year("fill_date")).rollup("arm", "year").agg(
        F.count(F.lit(1)).alias("n"), F.avg("excess").alias("mean_excess"), (F.count_if(F.col("ret_net") > 0) / F.count(F.lit(1))).alias("hit_rate"))


def month_buckets(trades: DataFrame) -> DataFrame:
    """Mean excess per arm and fill month."""
    return trades.where(F.col("excess").isNotNull()).groupBy("arm", "horizon", F.date_format("fill_date", "yyyy-MM").alias("month")).agg(
        F.avg("excess").alias("mean_excess"), F.count(F.lit(1)).alias("n"))


def bucket_statistics(buckets: DataFrame, reps: int = 3000) -> DataFrame:
    """Interval, t and effective n over the bucket means of each arm."""
    b = buckets.withColumn("block", block_for(F.col("horizon")))
    ci = block_bootstrap_ci(b, ["arm"], "month", "mean_excess", F.col("block"), reps=reps)
    s = describe(b, ["arm"], "mean_excess").select("arm", F.col("n").alias("n_buckets"), F.col("t").alias("excess_t"))
    size = b.groupBy("arm").agg(F.max("block").alias("block"))
    return s.join(size, "arm").join(ci, "arm", "left").withColumn("n_effective", F.col("n_buckets") / F.col("block"))


def paired_differences(buckets: DataFrame, pairs: list[tuple[str, str]], reps: int = 3000) -> DataFrame:
    """Month by month difference of two arms, with its interval and t."""
    spec = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    tagged = buckets.select("arm", "month", "mean_excess", "horizon", F.explode(spec).alias("_p")).select("*", "_p.a", "_p.b")
    side = tagged.where(F.col("arm").isin(*{x for p in pairs for x in p}) & ((F.col("arm") == F.col("a")) | (F.col("arm") == F.col("b"))))
    d = side.groupBy("a", "b", "month").agg(
        F.max(F.when(F.col("arm") == F.col("a"), F.col("mean_excess"))).alias("_x"), F.max(F.when(F.col("arm") == F.col("b"), F.col("mean_excess"))).alias("_y"),
        F.max(block_for(F.col("horizon"))).alias("block"))
    d = cut_lineage(d.where(F.col("_x").isNotNull() & F.col("_y").isNotNull()).withColumn("diff", F.col("_x") - F.col("_y")))
    ci = block_bootstrap_ci(d, ["a", "b"], "month", "diff", F.col("block"), reps=reps)
    s = describe(d, ["a", "b"], "diff").select("a", "b", F.col("n").alias("n_months"), F.col("mean").alias("diff_mean"), "t")
    return s.join(ci, ["a", "b"], "left")


def equal_pairs(arms: list[Arm]) -> list[tuple[str, str]]:
    """The pairs a comparison reports: arms of one kind and horizon, in the order of their ids."""
    ruled = sorted((a for a in arms if a.kind not in BASELINES), key=lambda a: (a.kind, a.id))
    return [(a.id, b.id) for i, a in enumerate(ruled) for b in ruled[i + 1:] if (a.kind, a.horizon) == (b.kind, b.horizon)]


def pairwise_table(buckets: DataFrame, arms: list[Arm], reps: int = 3000) -> DataFrame:
    """Month by month differences of every pair at equal horizon."""
    return paired_differences(buckets, equal_pairs(arms), reps)


def benchmark_hold(features: DataFrame, start: str, end: str, cost: float = ONE_WAY_COST) -> DataFrame:
    """The ``spy_hold`` arm: the benchmark bought on the first and sold on the last session of the window, after costs."""
    b = features.where(F.col("bench").isNotNull() & F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    g = b.agg(F.min("session").alias("fill_date"), F.max("session").alias("exit_date"), F.min_by("bench", "session").alias("entry"), F.max_by("bench", "session").alias("exit"))
    net = (F.col("exit") * (1.0 - cost)) / (F.col("entry") * (1.0 + cost)) - 1.0
    return g.select(F.lit("spy_hold").alias("arm"), "fill_date", "exit_date", (F.col("exit") / F.col("entry") - 1.0).alias("ret_gross"), net.alias("ret_net"))


# -- the control -------------------------------------------------------------------------------------------

def mix_sql(right: str, key: str, turn: int | str) -> str:
    """What a round of the permutation adds, as SQL text: whole numbers below 2^63, alike in any engine and any retry."""
    offset = f"(16807 * {turn} + {SEED})" if isinstance(turn, str) else 16807 * turn + SEED
    x = f"(({right} * 69621 + {key} * 48271 + {offset}) % {PRIME})"
    x = f"(({x} * {x} + 12345) % {PRIME})"
    return f"(({x} * {x} + {right}) % {PRIME})"


def numbered_cells(features: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Eligible cells of the window with their ordinal by (session, ticker): counts per session, then a rank inside one.

    The cells that leave room for a horizon are a prefix of this order.
    """
    cells = features.where("eligible")
    if start:
        cells = cells.where(F.col("session") >= start)
    if end:
        cells = cells.where(F.col("session") <= end)
    cells = cells.select("ticker", "s_idx", "close")
    before = Window.orderBy("s_idx").rowsBetween(Window.unboundedPreceding, -1)             # one row per session
    base = cells.groupBy("s_idx").agg(F.count(F.lit(1)).alias("here")).withColumn("base", F.coalesce(F.sum("here").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("s_idx").orderBy("ticker")) - 1
    return cells.withColumn("_r", rank).join(base, "s_idx").select("ticker", "s_idx", "close", "here", (F.col("base") + F.col("_r")).cast("long").alias("ordinal"))


# draws of a replicate that one row is drawn out to, and rounds of the permutation
DRAW_SLICE = 65_536
ROUNDS = 4


def control_events(features: DataFrame, like: DataFrame, replicates: int = CONTROL_REPLICATES, start: str | None = None, end: str | None = None) -> DataFrame:
    """Per arm and replicate, ``n`` eligible cells drawn uniformly, with replacement only where ``n`` exceeds the cells.

    ``like``: ``arm, horizon, n, risk``, one row per arm. Ordinals are drawn by whole-number
    arithmetic and joined to the numbered cells: a pseudo-random permutation of [0, root^2), root^2
    being the next square above the cells. Of its first n + root^2 - cells values n at least are
    cells, so the draw is never short and no cell is multiplied by arms or replicates.
    """
    last = features.agg(F.max("s_idx")).scalar()
    cells = cut_lineage(numbered_cells(features, start, end))
    number = Window.orderBy("arm")                                                           # one row per arm
    arms = like.select("arm", "horizon", F.col("n").cast("long").alias("n"), "risk", F.row_number().over(number).cast("long").alias("arm_no"))
    sizes = cells.groupBy("s_idx").agg(F.count(F.lit(1)).alias("here"))
    room = sizes.select("here", "s_idx", F.explode(arms.select(F.collect_list(F.struct("arm_no", "horizon"))).scalar()).alias("_a")).where(F.col("s_idx") + F.col("_a.horizon") <= last)
    d = arms.join(room.groupBy(F.col("_a.arm_no").alias("_no")).agg(F.sum("here").alias("cells")), F.col("arm_no") == F.col("_no"))
    d = d.withColumn("root", F.ceil(F.sqrt("cells")).cast("long")).select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    d = d.where("n > 0").withColumn("key", F.col("arm_no") * 1009 + F.col("rep"))
    back = f"aggregate(array(3L, 2L, 1L, 0L), named_struct('l', o div root, 'r', o % root), (a, t) -> named_struct('l', pmod(a.r - {mix_sql('a.l', 'key', 't')}, root), 'r', a.l), a -> a.l * root + a.r)"
    # the draws that hit no cell come from the few ordinals behind the last one, turned back; each that stands before
    # the n-th hit lengthens the draw by one, so the draw is generated at its length and never sorted
    d = cut_lineage(d)
    miss = d.where(F.col("n") <= F.col("cells")).where(F.col("root") * F.col("root") > F.col("cells")).withColumn("o", F.explode(F.sequence("cells", F.col("root") * F.col("root") - 1)))
    order = Window.partitionBy("arm", "rep").orderBy("_v")                                    # at most twice the root of the cells
    more = miss.withColumn("_v", F.expr(back)).withColumn("_j", F.row_number().over(order) - 1).groupBy(F.col("arm").alias("_a"), F.col("rep").alias("_p")).agg(F.count_if(F.col("_v") - F.col("_j") < F.col("n")).alias("_more"))
    d = d.join(more, (F.col("arm") == F.col("_a")) & (F.col("rep") == F.col("_p")), "left").withColumn("long", F.col("n") + F.coalesce("_more", F.lit(0))).drop("_a", "_p", "_more")
    # the few rows of arms and replicates are cut into slices and spread before they are drawn out
    tasks = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(long - 1) div {DRAW_SLICE}")))).repartition(tasks, "arm", "rep", "slice")
    d = d.withColumn("i", F.explode(F.sequence(F.col("slice") * DRAW_SLICE, F.least((F.col("slice") + 1) * DRAW_SLICE, F.col("long")) - 1)))
    # a round is evaluated once per row and no filter is pushed below it, which would write out the rounds again
    d = d.select("*", once(_l=F.expr("i div root"), _r=F.expr("i % root")))
    for turn in range(ROUNDS):
        d = d.select(*[c for c in d.columns if c not in ("_l", "_r")], once(_l=F.col("_r"), _r=F.expr(f"(_l + {mix_sql('_r', 'key', turn)}) % root")))
    spot = F.when(F.col("n") <= F.col("cells"), F.expr("_l * root + _r")).otherwise(draw(F.col("key"), F.col("i"), SEED, F.col("cells")))
    taken = d.withColumn("ordinal", spot).where(F.col("ordinal") < F.col("cells"))
    return taken.join(cells.hint("merge").select("ordinal", "ticker", "s_idx", "close"), "ordinal").where(F.col("close") > 0).select(
        "arm", "rep", "horizon", "ticker", "s_idx", (F.col("close") * (1.0 - F.col("risk"))).alias("stop"))


def null_distribution(control_trades: DataFrame, arm_means: DataFrame) -> DataFrame:
    """p05/p50/p95 of the replicate means, and the share of them at or below the arm's mean."""
    m = control_trades.groupBy("arm", "rep").agg(F.avg("excess").alias("m")).where(F.col("m").isNotNull())
    j = m.join(arm_means.select("arm", "mean_excess"), "arm")
    return j.groupBy("arm").agg(                                                # one row per replicate
        F.count(F.lit(1)).alias("n_replicates"), *[F.percentile("m", q).alias(c) for c, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))],
        F.avg((F.col("m") <= F.col("mean_excess")).cast("double")).alias("percentile_of_arm"))


def run_ab(features: DataFrame, arms: list[Arm], split: str, window: tuple[str, str] | None = None, hypotheses: int | None = None,
           replicates: int = CONTROL_REPLICATES, reps: int = 3000) -> DataFrame:
    """X14 + A19: one row per arm: statistics, interval, control percentiles, verdict, decision and flags.

    Give it features that are not yet written: what the study reads of them is written here, once, with the firings.
    """
    start, end = window or SPLITS[split]
    k = hypotheses or len(arms)
    longest = max(a.horizon for a in arms)
    panel = cut_lineage(with_firings(features, arms).select("ticker", "s_idx", "session", "close", "bench", "eligible", "fired"))
    status = cut_lineage(classify_signals(signals_of(panel), panel.agg(F.max("s_idx")).scalar(), start, end))
    trades = cut_lineage(walk(status.where("status = 'event'").withColumn("rep", F.lit(-1)), panel, longest))
    stats = cut_lineage(arm_statistics(trades))
    buckets = cut_lineage(month_buckets(trades))
    b = bucket_statistics(buckets, reps)
    risk = describe(trades.where("entry > 0").withColumn("_r", 1.0 - F.col("stop_initial") / F.col("entry")), ["arm", "horizon"], "_r").select("arm", "median")
    events = status.where("status = 'event'").groupBy("arm", "horizon").agg(F.count(F.lit(1)).alias("n"))
    like = cut_lineage(events.join(risk, "arm", "left").select("arm", "horizon", "n", F.coalesce(F.when(F.col("median") != 0, F.col("median")), F.lit(0.05)).alias("risk")))
    # a cell is walked for each draw: the pass over its few bars costs less than gathering the replicates that drew it
    drawn = control_events(panel, like, replicates, start=start, end=end)
    ctrl = walk(drawn, panel, longest).where(F.col("excess").isNotNull()).select("arm", "rep", "excess")
    null = null_distribution(ctrl, stats)
    n_sig = status.groupBy("arm").agg(F.count(F.lit(1)).alias("n_signals"), F.count_if(F.col("status") == "event").alias("n_events"))
    j = n_sig.join(stats, "arm", "left").join(b, "arm", "left").join(null, "arm", "left")
    verdict = excess_verdict(F.col("mean_excess"), F.col("ci_low"), F.col("ci_high"), F.col("excess_t"), F.col("n_effective"), k)
    j = j.withColumn("verdict", verdict)
    return j.withColumns({
        "survives": survives(), "flag": F.when(F.abs("mean_excess") > 0.05, "mean excess over 5%, check for look-ahead"),
        "split": F.lit(split), "hypotheses": F.lit(k)})


def survives() -> Column:
    """A verdict of suggestive or better, an interval above zero, a mean above the control's p95."""
    return F.coalesce(F.col("verdict").isin("suggestive", "supported") & (F.col("ci_low") > 0) & (F.col("mean_excess") > F.col("p95")), F.lit(False))


def hypothesis_count(log: DataFrame, planned: list[str]) -> DataFrame:
    """Distinct rule arms ever run on the train window, with the ones about to run."""
    ran = log.where((F.col("split") == "train") & ~F.col("kind").isin("random", "spy_hold")).select("arm")
    return ran.select(F.explode(F.concat(F.array("arm"), F.array(*[F.lit(x) for x in planned]))).alias("arm")).agg(F.count_distinct("arm").alias("n")) \
        if planned else ran.agg(F.count_distinct("arm").alias("n"))


def refuse_second_look(log: DataFrame, arms: list[Arm], split: str) -> None:
    """The held-out window runs once, with pre-registered arms only."""
    if split != "test":
        return
    late = [a.id for a in arms if not a.preregistered]
    if late:
        raise ValueError(f"not pre-registered: {late}")
    seen = log.where((F.col("split") == "test") & F.col("arm").isin(*[a.id for a in arms])).limit(1).count()
    if seen:
        raise ValueError("an arm has already been run on the held-out window")
