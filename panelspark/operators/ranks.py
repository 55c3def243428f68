"""Order statistics and ranks that never gather a group into one task.

Everything rests on ``value_ranks``: a table of the distinct values of a group
with how many rows lie below each. Ties collapse in the map-side aggregate, and a
group is spread over value buckets (a monotone function of the value), so a group
holding a third of all rows is still sorted by many tasks. There are 65,536 buckets
for every doubling; values closer than that share a task. Where all values of a column lie close
together, ``crowd`` says from how many distinct values on a bucket is cut further, at quantiles of a
KLL sketch of it (two more passes over the distinct values), so that the cells of a group are about even
whatever its values are. Counts per cell are prefix-summed and ranks inside a cell counted, so ranks are
exact either way: the sketch only says where to cut. The window that adds up a group's cells meets one row
per cell in use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from panelspark.functions.numeric import clip, safe_div
from panelspark.session import cut_lineage

PER_OCTAVE = 65_536       # value buckets per doubling
PER_OCTAVE_AT = 2_048     # the same where only the buckets of some percentiles are looked into
TIE_LETTERS = 4           # of a tie column that cut a value's rows
_SHIFT = 100_000_000      # keeps the bucket of any positive double positive
CUTS = 1_024              # cells of such a bucket


def value_bucket(v: Column, per_octave: int = PER_OCTAVE) -> Column:
    """A bucket number that never decreases as ``v`` grows."""
    octave = F.floor(F.log2(F.least(F.abs(v), F.lit(1e308))) * per_octave) + F.lit(_SHIFT)
    return F.when(v > 0, octave).when(v < 0, -octave).otherwise(F.lit(0)).cast("long")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", long: bool = False) -> DataFrame:
    """Equi-join on ``keys`` where null equals null; right keys are dropped.

    ``long``: the right side has a row per value and not per group. It is met by a merge, since the size that
    decides on a broadcast is that of packed files, and the driver would hold every such table unpacked.
    """
    r = (right.hint("merge") if long else right).select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def edges_upto(edges: Column, v: Column) -> Column:
    """How many of at most ``CUTS`` - 1 ascending edges lie at or below ``v``, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((CUTS - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= v, at + step).otherwise(at))


def crowded_edges(distinct: DataFrame, keys: list[str], value: str, crowd: int) -> DataFrame:
    """``keys, _b, _edges``: ascending quantiles of every bucket with more than ``crowd`` distinct values."""
    many = distinct.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_dn")).where(F.col("_dn") > crowd)
    inside = join_on(distinct.select(*keys, "_b", F.col(value).cast("double").alias("_v")), many, keys + ["_b"], "left").where(F.col("_dn").isNotNull())
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    quantiles = F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("_v"), shares)
    return inside.groupBy(*keys, "_b").agg(F.array_sort(F.array_distinct(quantiles)).alias("_edges"))


def value_ranks(df: DataFrame, keys: list[str], value: str, weight: str | None = None, crowd: int | None = None) -> DataFrame:
    """``keys, value, tie_n, n_below, n`` for every distinct non-null value of every group."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    distinct = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(w.cast("long").alias("tie_n"))
        .withColumn("_b", value_bucket(F.col(value).cast("double")))
    )
    if crowd is None:
        distinct = distinct.withColumn("_c", F.lit(0))
    else:
        # a value's cell: how many of its bucket's edges lie at or below it; the values are read three times
        distinct = cut_lineage(distinct)
        edges = crowded_edges(distinct, keys, value, crowd)
        cell = F.when(F.col("_edges").isNotNull(), edges_upto(F.col("_edges"), F.col(value).cast("double"))).otherwise(F.lit(0))
        distinct = join_on(distinct, edges, keys + ["_b"], "left").withColumn("_c", cell).drop("_edges")
    per_cell = distinct.groupBy(*keys, "_b", "_c").agg(F.sum("tie_n").alias("_bn"))
    # rows here are cells of a group, not rows of the group
    by_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = per_cell.select(
        *keys, "_b", "_c",
        F.coalesce(F.sum("_bn").over(by_group.orderBy("_b", "_c").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_bn").over(by_group).alias("n"),
    )
    inside = Window.partitionBy(*keys, "_b", "_c").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        join_on(distinct, offsets, keys + ["_b", "_c"], long=True)
        .withColumn("n_below", F.col("_off") + F.coalesce(F.sum("tie_n").over(inside), F.lit(0)))
        .select(*keys, value, "tie_n", "n_below", "n")
    )


def percentile_from_ranks(value: str, q: float) -> Column:
    """Aggregate: the linear percentile of a group, over its ``value_ranks`` rows."""
    pos = F.lit(float(q)) * (F.col("n") - 1)
    lo_i = F.floor(pos)
    hi_i = F.least(lo_i + 1, F.col("n") - 1)
    v, below, upto = F.col(value), F.col("n_below"), F.col("n_below") + F.col("tie_n")
    at_lo = F.max(F.when((below <= lo_i) & (lo_i < upto), v))
    at_hi = F.max(F.when((below <= hi_i) & (hi_i < upto), v))
    frac = F.max(pos - lo_i)
    return F.when(frac == 0, at_lo).otherwise(at_lo * (1.0 - frac) + at_hi * frac)


def value_ranks_at(df: DataFrame, keys: list[str], value: str, qs: list[float], weight: str | None = None) -> DataFrame:
    """The rows of ``value_ranks`` in the value buckets that hold the percentiles ``qs`` of their group.

    Only counts per bucket are shuffled, of which a group has as many whatever the number of its rows, and then the
    few rows of the buckets asked for; ``df`` is read twice.
    """
    w = (F.sum(weight) if weight else F.count(F.lit(1))).cast("long")
    rows = df.where(F.col(value).isNotNull()).withColumn("_b", value_bucket(F.col(value).cast("double"), PER_OCTAVE_AT))
    by_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    cells = rows.groupBy(*keys, "_b").agg(w.alias("_bn")).select(
        *keys, "_b", "_bn", F.coalesce(F.sum("_bn").over(by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_bn").over(by_group).alias("n"))
    asked = F.lit(False)
    for q in qs:
        at = F.floor(F.lit(float(q)) * (F.col("n") - 1))
        asked = asked | ((F.col("_off") <= at + 1) & (at < F.col("_off") + F.col("_bn")))
    # written, so that its size is known and the rows are not dealt by group to meet it
    few = cut_lineage(cells.where(asked).drop("_bn"))
    # a left join: the rows are never the side that is sent to the driver
    held = join_on(rows, few, keys + ["_b"], "left").where(F.col("n").isNotNull())
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return held.groupBy(*keys, "_b", "_off", "n", value).agg(w.alias("tie_n")).withColumn(
        "n_below", F.col("_off") + F.coalesce(F.sum("tie_n").over(inside), F.lit(0))).select(*keys, value, "tie_n", "n_below", "n")


def percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], crowd: int | None = None) -> DataFrame:
    """One row per group with the named exact percentiles."""
    r = value_ranks(df, keys, value, crowd=crowd)
    return r.groupBy(*keys).agg(*[percentile_from_ranks(value, q).alias(name) for name, q in qs.items()])


def _percentile_rank(ascending: bool) -> Column:
    below = F.col("n_below") if ascending else F.col("n") - F.col("n_below") - F.col("tie_n")
    avg_rank = below + (F.col("tie_n") - 1) / F.lit(2.0)
    return F.when(F.col("n") > 1, avg_rank / (F.col("n") - 1)).otherwise(F.lit(0.5))


def rank_percentile(df: DataFrame, keys: list[str], value: str, out: str, ascending: bool = True, crowd: int | None = None) -> DataFrame:
    """Percentile rank in [0, 1], ties averaged, null kept and not counted, 0.5 alone."""
    r = value_ranks(df, keys, value, crowd=crowd).select(*keys, value, _percentile_rank(ascending).alias(out))
    return join_on(df, r, keys + [value], "left", long=True)


def rank_columns(df: DataFrame, ids: list[str], keys: list[str], columns: dict[str, Column | str],
                 scale: str = "unit") -> DataFrame:
    """Ranks of several columns in one pass; ``ids`` name a row. ``scale``: ``unit`` is W1, ``n100`` is W2.

    The columns are stacked under a tag and ranked together, so the input is read once
    for all of them.
    """
    spec = F.array(*[F.struct(F.lit(out).alias("_col"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("_v"))
                     for out, c in columns.items()])
    long = df.select(*ids, *[k for k in keys if k not in ids], F.explode(spec).alias("_s")).select("*", "_s._col", "_s._v").drop("_s")
    pct = _percentile_rank(True) if scale == "unit" else 100.0 * (
        F.col("n_below") + 1 + (F.col("tie_n") - 1) / F.lit(2.0)) / F.col("n")
    r = value_ranks(long, keys + ["_col"], "_v").select(*keys, "_col", "_v", pct.alias("_pct"))
    got = join_on(long, r, keys + ["_col", "_v"], long=True).groupBy(*ids).agg(
        *[F.max(F.when(F.col("_col") == out, F.col("_pct"))).alias(out) for out in columns])
    return join_on(df, got, ids, "left", long=True)


def percent_of_n(df: DataFrame, keys: list[str], value: str, out: str, crowd: int | None = None) -> DataFrame:
    """Average rank over n, times 100."""
    pct = 100.0 * (F.col("n_below") + 1 + (F.col("tie_n") - 1) / F.lit(2.0)) / F.col("n")
    r = value_ranks(df, keys, value, crowd=crowd).select(*keys, value, pct.alias(out))
    return join_on(df, r, keys + [value], "left", long=True)


def winsorize(df: DataFrame, keys: list[str], value: str, out: str,
              lower: float = 0.01, upper: float = 0.99, crowd: int | None = None) -> DataFrame:
    """Clip at the linear percentiles of the group."""
    edges = percentiles(df, keys, value, {"_lo": lower, "_hi": upper}, crowd)
    if keys:
        j = join_on(df, edges, keys, "left")
    else:
        j = df.withColumns({"_lo": edges.select("_lo").scalar(), "_hi": edges.select("_hi").scalar()})
    return j.withColumn(out, clip(value, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def z_table(df: DataFrame, keys: list[str], value: str, winsor: tuple[float, float] | None = (0.01, 0.99),
            robust: bool = True, limit: float | None = 4.0, crowd: int | None = None) -> DataFrame:
    """``keys, value, z``: the standardised value of each distinct value of each group.

    Median and scaled MAD of the winsorized values; mean and sample deviation where
    that scale is zero or undefined; 0.0 where there is no variation at all.
    """
    # both tables are read several times below, so they are written once
    r = cut_lineage(value_ranks(df, keys, value, crowd=crowd))
    lo_q, hi_q = winsor if winsor else (0.0, 1.0)
    edges = r.groupBy(*keys).agg(
        percentile_from_ranks(value, lo_q).alias("_lo"), percentile_from_ranks(value, hi_q).alias("_hi"))
    # every group of the values is among its statistics, and a left join never sends the values to the driver; what is
    # known of groups is written, so that its size is known and the values are not dealt by group to meet it
    w = join_on(r, cut_lineage(edges), keys, "left").withColumn("_w", clip(value, F.col("_lo"), F.col("_hi")))
    # clipping keeps the order, so the clipped values keep their rank positions
    centre = w.groupBy(*keys).agg(
        percentile_from_ranks("_w", 0.5).alias("_med"),
        (F.sum(F.col("_w") * F.col("tie_n")) / F.sum("tie_n")).alias("_mean"),
        F.min("_w").alias("_min"), F.max("_w").alias("_max"), F.max("n").alias("_n"))
    c = cut_lineage(join_on(w, cut_lineage(centre), keys, "left").withColumn("_dev", F.abs(F.col("_w") - F.col("_med"))))
    spread = c.groupBy(*keys).agg(
        F.when((F.max("_n") > 1) & (F.max("_min") < F.max("_max")),
               F.sqrt(F.sum(F.col("tie_n") * F.pow(F.col("_w") - F.col("_mean"), 2)) / (F.max("_n") - 1)))
        .alias("_sd"))
    if robust:
        dev = value_ranks(c, keys, "_dev", weight="tie_n", crowd=crowd).groupBy(*keys).agg(
            F.when(F.max("n") > 1, percentile_from_ranks("_dev", 0.5) * 1.4826).alias("_mad"))
        spread = join_on(spread, dev, keys)
        use_mad = F.coalesce(F.col("_mad"), F.lit(0.0)) != 0
        mid = F.when(use_mad, F.col("_med")).otherwise(F.col("_mean"))
        scale = F.when(use_mad, F.col("_mad")).otherwise(F.col("_sd"))
    else:
        mid, scale = F.col("_mean"), F.col("_sd")
    raw = F.coalesce(safe_div(F.col("_w") - mid, scale), F.lit(0.0))
    z = clip(raw, -limit, limit) if limit is not None else raw
    return join_on(c, cut_lineage(spread), keys, "left").select(*keys, value, z.alias("z"))


def robust_z(df: DataFrame, keys: list[str], value: str, out: str, **kw) -> DataFrame:
    """W4 on rows; null values keep a null z."""
    return join_on(df, z_table(df, keys, value, **kw).withColumnRenamed("z", out), keys + [value], "left", long=True)


def sector_neutral_z(df: DataFrame, keys: list[str], sector: str, value: str, out: str, min_names: int = 5,
                     neutral: Column | None = None) -> DataFrame:
    """Z inside the sector where it has ``min_names`` rows (null values count), else in the whole group.

    ``neutral`` (boolean) says which rows want the sector form; all of them by default.
    Sector and whole-group statistics come from one pass over rows tagged with a scope.
    """
    sec = F.coalesce(F.col(sector), F.lit("?"))
    sizes = df.groupBy(*keys, sec.alias("_sec")).agg(F.count(F.lit(1)).alias("_sec_n"))
    t = join_on(df.withColumn("_sec", sec), cut_lineage(sizes), keys + ["_sec"], "left")
    wants = F.col("_sec_n") >= min_names
    if neutral is not None:
        wants = wants & neutral
    t = t.withColumn("_scope", F.when(wants, F.concat(F.lit("s:"), F.col("_sec"))).otherwise(F.lit("*")))
    scoped = t.select(
        *keys, value,
        F.explode(F.array_distinct(F.array(F.lit("*"), F.col("_scope")))).alias("_scope"))
    z = z_table(scoped, keys + ["_scope"], value).withColumnRenamed("z", out)
    return join_on(t, z, keys + ["_scope", value], "left", long=True).drop("_sec", "_sec_n", "_scope")


def safe_corr(x: str, y: str) -> Column:
    """Correlation aggregate that gives null, and not an error, where a side has no variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """``keys, rho, n``. Pairs with both present; null below ``min_n`` or without variance."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    rx = value_ranks(pairs, keys, "_x").select(*keys, "_x", _percentile_rank(True).alias("_rx"))
    ry = value_ranks(pairs, keys, "_y").select(*keys, "_y", _percentile_rank(True).alias("_ry"))
    ranked = join_on(join_on(pairs, rx, keys + ["_x"], long=True), ry, keys + ["_y"], long=True)
    # the spread test is on exact ends, not on a rounded variance
    flat = (F.min("_rx") == F.max("_rx")) | (F.min("_ry") == F.max("_ry"))
    return ranked.groupBy(*keys).agg(
        F.when((F.count(F.lit(1)) >= min_n) & ~flat, safe_corr("_rx", "_ry")).alias("rho"),
        F.count(F.lit(1)).alias("n"))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group in a total order.

    The filter on the row number lets Catalyst place a window group limit before the
    shuffle, so each input partition sends at most ``n`` rows of a group.
    """
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return df.withColumn(out, F.row_number().over(w.orderBy(*order))).where(F.col(out) <= n)


def place(df: DataFrame, keys: list[str], coarse: list[tuple[Column, bool]], order: list[Column], out: str) -> DataFrame:
    """1-based place of every row of a group in the order (``coarse``, ``order``), however long the list is.

    ``coarse``: (column, descending) pairs that never contradict ``order``, such as a value bucket or the
    first letters of a name. Rows are counted per coarse cell, and only the rows of a cell are sorted together.
    """
    names = [f"__c{i}" for i in range(len(coarse))]
    d = df.withColumns({n: c for n, (c, _) in zip(names, coarse)})
    by = [F.desc(n) if down else F.asc(n) for n, (_, down) in zip(names, coarse)]
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)      # one row per cell
    cells = d.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    return join_on(d.withColumn("__r", inside), cells, keys + names, long=True).withColumn(out, (F.col("__before") + F.col("__r")).cast("int")).drop("__before", "__r", *names)


def position(df: DataFrame, value: str, tie: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """1-based place of every row in the order (value, tie), without a global sort.

    Rows are counted per value and first letters of the tie column, and only those of a cell are put in order
    against each other, so a value that very many rows share is spread as well. A null value counts as the lowest.
    """
    v = df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")) if descending else F.lit(float("inf"))))
    # letters only say something about the order of text
    letters = [(F.substring(tie, 1, TIE_LETTERS), False)] if isinstance(df.schema[tie].dataType, StringType) else []
    placed = place(v, [], [(F.col("_v"), descending), *letters], [F.asc(tie)], out)
    return placed.withColumn(out, F.col(out).cast("long")).drop("_v")
