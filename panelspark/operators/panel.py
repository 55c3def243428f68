"""Price panels in long form: one row per (ticker, session).

``build`` aggregates raw rows to that key first, so every window below that is
partitioned by ticker sees at most one row per calendar session, however many raw
rows a ticker owns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.numeric import ladder, safe_div


def calendar(panel: DataFrame) -> DataFrame:
    """``session, s_idx``: the union of all tickers' sessions, numbered from 0.

    One row per trading day, so the unpartitioned numbering is over a small table.
    """
    days = panel.select("session").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("session")
    return days.select("session", (F.row_number().over(w) - 1).cast("int").alias("s_idx"))


def indexed(panel: DataFrame, cal: DataFrame) -> DataFrame:
    return panel.join(F.broadcast(cal), "session")


def lives(panel: DataFrame) -> DataFrame:
    """First and last real print of each ticker."""
    return panel.where(F.col("close").isNotNull()).groupBy("ticker").agg(
        F.min("s_idx").alias("first_idx"), F.max("s_idx").alias("last_idx"),
        F.min("session").alias("first_obs"), F.max("session").alias("last_obs"),
        F.max_by("close", "s_idx").alias("last_close"), F.count(F.lit(1)).alias("n_obs"))


def densify(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """Every calendar row between a ticker's first and last print, holes as null.

    Rows outside a life carry no information for any window (they are null), so
    they are left out; the rows of a ticker come from its own index range.
    """
    life = lives(panel).select("ticker", "first_idx", "last_idx")
    grid = life.select("ticker", "first_idx", "last_idx",
                       F.explode(F.sequence("first_idx", "last_idx")).alias("s_idx"))
    vals = panel.drop("session")
    return (grid.join(vals, ["ticker", "s_idx"], "left")
            .join(F.broadcast(cal), "s_idx"))


def by_ticker(order: str = "s_idx"):
    return Window.partitionBy("ticker").orderBy(order)


def rolling(fn, x: str, n: int, min_periods: int, skip: int = 0) -> Column:
    """Rolling aggregate of ``n`` rows ending ``skip`` rows back; null below ``min_periods``."""
    w = by_ticker().rowsBetween(-(n - 1) - skip, -skip)
    # the count of a frame is a difference of two running counts, which no frame has to be walked for
    seen = F.count(x).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    back = lambda k: seen if k == 0 else F.count(x).over(by_ticker().rowsBetween(Window.unboundedPreceding, -k))
    return F.when(back(skip) - back(n + skip) >= min_periods, fn(x).over(w))


def lag_return(x: str, n: int) -> Column:
    """Move over ``n`` panel rows."""
    return safe_div(F.col(x), F.lag(x, n).over(by_ticker())) - 1.0


def fill_within_life(dense: DataFrame, out: str = "filled") -> DataFrame:
    """Carry the last print forward, only between first and last print."""
    return dense.withColumn(out, F.last("close", ignorenulls=True).over(by_ticker()))


def running_drawdown(x: str, order: str, *keys: str) -> Column:
    """Value over its running peak, minus 1."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return safe_div(F.col(x), F.max(x).over(w)) - 1.0


def trim_partial_tail(panel: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Drop trailing sessions in which under ``min_share`` of the names printed."""
    n_names = panel.select(F.count_distinct("ticker")).scalar()
    per = panel.where(F.col("close").isNotNull()).groupBy("session").agg(F.count(F.lit(1)).alias("n_here"))
    cut = per.where(F.col("n_here") >= F.lit(min_share) * n_names).agg(F.max("session")).scalar()
    return panel.where(F.col("session") <= cut)


def drop_open_session(panel: DataFrame, pulled_at: str | Column, closes_utc: str = "20:30:00") -> DataFrame:
    """Drop the last session when it is the pull day and the pull came before the close."""
    pulled = pulled_at if isinstance(pulled_at, Column) else F.to_timestamp(F.lit(pulled_at))
    early = F.date_format(pulled, "HH:mm:ss") < F.lit(closes_utc)
    return panel.where(~(early & (F.col("session") == F.to_date(pulled))))


def merge_panels(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """The new value where present, else the old; union of rows."""
    o = old.select("ticker", "session", *[F.col(f).alias(f"_o_{f}") for f in fields])
    return new.select("ticker", "session", *fields).join(o, ["ticker", "session"], "full").select(
        "ticker", "session", *[F.coalesce(f, f"_o_{f}").alias(f) for f in fields])


def coverage_on(requested: DataFrame, panel: DataFrame, on: str, max_gap: int = 7) -> DataFrame:
    """Status of every requested ticker on a date, from its first and last print."""
    day = F.to_date(F.lit(on))
    starts, ends = panel.agg(F.min("session")).scalar(), panel.agg(F.max("session")).scalar()
    life = panel.where(F.col("close").isNotNull()).groupBy("ticker").agg(
        F.min("session").alias("first_obs"), F.max("session").alias("last_obs"))
    j = requested.join(life, "ticker", "left").withColumns({"_p0": starts, "_p1": ends})
    return j.select(
        "ticker", "first_obs", "last_obs",
        ladder([
            (F.col("first_obs").isNull(), "no_data"),
            ((F.col("first_obs") > day) & (F.col("_p0") < day), "not_listed_yet"),
            (F.col("first_obs") > day, "unknown_before_window"),
            ((F.col("last_obs") < day) & (F.col("last_obs") < F.col("_p1")), "stopped_trading"),
        ], "available").alias("status"))


FORWARD_STATUSES = ("ok", "truncated", "delisted", "already_delisted", "not_listed_yet",
                    "unknown_before_window", "no_data", "no_column", "short_panel", "bad_base_price")


def forward_returns(probes: DataFrame, panel: DataFrame, horizon: int | Column, policy: str = "truncate",
                    requested: DataFrame | None = None) -> DataFrame:
    """Return from the last print on or before ``date`` to ``horizon`` panel rows later, with a status.

    ``probes`` has ``ticker, date``; every probe keeps its row. ``requested`` lists the
    tickers the panel was asked for; by default those in the panel.
    """
    if policy not in ("truncate", "none"):
        raise ValueError(f"unknown policy {policy!r}")
    from panelspark.operators.asof import asof_backward

    cal = calendar(panel)
    obs = indexed(panel.select("ticker", "session", "close"), cal)
    real = obs.where(F.col("close").isNotNull())
    life = lives(obs).select("ticker", "last_idx", "last_close")
    asked = (requested if requested is not None else panel.select("ticker")).select("ticker").distinct()

    base = asof_backward(
        probes.withColumn("_h", horizon if isinstance(horizon, Column) else F.lit(horizon)),
        real.select("ticker", "session", F.col("s_idx").alias("base_idx"), F.col("close").alias("base_px"),
                    F.col("session").alias("base_date")),
        by=["ticker"], left_on="date", right_on="session", values=["base_idx", "base_px", "base_date"])
    b = (base.join(life, "ticker", "left")
         .join(asked.withColumn("_known", F.lit(True)), "ticker", "left")
         .withColumns({"_end": cal.agg(F.max("s_idx")).scalar(), "_p0": cal.agg(F.min("session")).scalar()})
         .withColumn("_tg", F.col("base_idx") + F.col("_h")))
    filled = fill_within_life(densify(obs, cal)).select("ticker", F.col("s_idx").alias("_tg"), "filled")
    j = b.join(filled, ["ticker", "_tg"], "left")

    dead = F.col("last_idx") < F.col("_end")
    stop = dead & (F.col("last_idx") < F.col("_tg"))
    status = ladder([
        (F.col("_known").isNull(), "no_column"),
        (F.col("last_idx").isNull(), "no_data"),
        (F.col("base_idx").isNull() & (F.col("_p0") < F.col("date")), "not_listed_yet"),
        (F.col("base_idx").isNull(), "unknown_before_window"),
        (dead & (F.col("base_idx") == F.col("last_idx")) & (F.col("base_date") < F.col("date")), "already_delisted"),
        (stop & F.lit(policy == "none"), "delisted"),
        (~stop & (F.col("_tg") > F.col("_end")), "short_panel"),
        (F.col("base_px") <= 0, "bad_base_price"),
        (stop, "truncated"),
    ], "ok")
    j = j.withColumn("status", status)
    exit_px = F.when(F.col("status") == "truncated", F.col("last_close")).when(F.col("status") == "ok", F.col("filled"))
    return j.select(
        *probes.columns, "base_date", "base_px",
        F.when(F.col("status").isin("ok", "truncated"), exit_px / F.col("base_px") - 1.0).alias("fwd_ret"),
        "status",
        (F.col("status").isin("already_delisted", "delisted", "truncated")
         | ((F.col("status") == "bad_base_price") & F.coalesce(stop, F.lit(False)))).alias("stopped_trading"))


def own_reads(panel: DataFrame, as_of: str, keep: int = 6) -> DataFrame:
    """W14 inputs: per ticker its last ``keep`` own observations as ``back_0 .. back_k``, low and count."""
    obs = panel.where(F.col("close").isNotNull() & (F.col("session") <= F.to_date(F.lit(as_of))))
    numbered = obs.withColumn("_rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session"))))
    return numbered.groupBy("ticker").agg(
        *[F.max(F.when(F.col("_rn") == k + 1, F.col("close"))).alias(f"back_{k}") for k in range(keep)],
        F.max("session").alias("last_date"), F.min("close").alias("low"), F.count(F.lit(1)).alias("sessions"))

