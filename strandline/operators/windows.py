"""Window operators over series with one row per key and period.

Such a series is bounded by the calendar (a century of days is 36,525 rows), so one
window partition per key is safe whatever the size of the raw tables below it.
Operators on raw rows use the sliced primitives in ``ordering``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import columns as C
from strandline.operators.ordering import cut, join_on, row_position
from strandline.storage import staged

_AGGS = {"sum": F.sum, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "max": F.max, "min": F.min}


def frame(n: int, center: bool = False) -> tuple[int, int]:
    """Row frame of a rolling window; an even centred one leans one row back."""
    return (-(n // 2), n - 1 - n // 2) if center else (-(n - 1), 0)


def rolling(
    df: DataFrame, keys: Sequence[str], t: str, x: str, n: int, agg: str = "mean", min_periods: int | None = None, center: bool = False, out: str = "roll"
) -> DataFrame:
    """Rolling statistic, null until ``min_periods`` values (default: all n) are in the frame."""
    w = C.by_time(keys, t).rowsBetween(*frame(n, center))
    need = n if min_periods is None else min_periods
    return df.withColumn(out, F.when(F.count(x).over(w) >= need, _AGGS[agg](x).over(w)))


def rolling_corr(df: DataFrame, keys: Sequence[str], t: str, x: str, y: str, n: int, include_current: bool, out: str = "r") -> DataFrame:
    """Correlation over n rows, with or without the current one; 0 where a side is flat."""
    w = C.by_time(keys, t).rowsBetween(*((-(n - 1), 0) if include_current else (-n, -1)))
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    r = F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(F.when(both, F.col(x))).over(w) * F.stddev_pop(F.when(both, F.col(y))).over(w))
    return df.withColumn(out, F.when(F.count(F.when(both, 1)).over(w) == n, F.coalesce(r, F.lit(0.0))))


def realised_vol(df: DataFrame, keys: Sequence[str], t: str, ret: str, n: int = 60, days: int = 252, out: str = "vol") -> DataFrame:
    """Annualised root mean square over a trailing window that grows from the first row."""
    w = C.by_time(keys, t).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.sqrt(F.avg(F.col(ret) * F.col(ret)).over(w) * days))


def forward_change(df: DataFrame, keys: Sequence[str], t: str, x: str, h: int, out: str = "fwd") -> DataFrame:
    return df.withColumn(out, F.lead(x, h).over(C.by_time(keys, t)) - F.col(x))


def forward_sum(df: DataFrame, keys: Sequence[str], t: str, x: str, h: int, out: str = "fwd_sum") -> DataFrame:
    w = C.by_time(keys, t).rowsBetween(1, h)
    return df.withColumn(out, F.when(F.count(x).over(w) == h, F.sum(x).over(w)))


def first_crossings(df: DataFrame, keys: Sequence[str], d: str, x: str, threshold: float, quiet: int) -> DataFrame:
    """Days at or above the threshold more than ``quiet`` days after the last such day."""
    above = df.where(F.col(x) >= threshold)
    gap = F.datediff(d, F.lag(d).over(C.by_time(keys, d)))
    return above.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > quiet)).drop("_gap")


def episodes(df: DataFrame, keys: Sequence[str], t: str, cond: Column) -> DataFrame:
    """Runs of true rows: start, length, and whether the run is closed by a false row.  Rows of unknown condition don't count.

    A run still open at the end of its series keeps its start but has no duration.
    """
    w = C.by_time(keys, t)
    marked = df.withColumn("_c", cond).where("_c IS NOT NULL").withColumn("_i", F.row_number().over(w)).withColumn("_n", F.max(t).over(Window.partitionBy(*keys)))
    breaks = F.sum(F.when(~F.col("_c"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("_run", breaks).where("_c").groupBy(*keys, "_run").agg(
        F.min(t).alias("start"), F.count(F.lit(1)).alias("length"), (F.max(t) < F.max("_n")).alias("closed")
    )
    return runs.drop("_run").withColumn("duration", F.when(F.col("closed"), F.col("length")))


def first_last_when(df: DataFrame, keys: Sequence[str], d: str, conds: dict[str, tuple[str, Column]], gap_of: Column) -> DataFrame:
    """First or last day meeting each condition, and the longest gap between days meeting ``gap_of``."""
    gap = F.when(gap_of, F.datediff(d, F.max(F.when(gap_of, F.col(d))).over(C.by_time(keys, d).rowsBetween(Window.unboundedPreceding, -1))))
    aggs = [(F.min if which == "first" else F.max)(F.when(c, F.col(d))).alias(name) for name, (which, c) in conds.items()]
    return df.withColumn("_gap", gap).groupBy(*keys).agg(*aggs, F.max("_gap").alias("longest_gap"))


def heat_weeks(df: DataFrame, keys: Sequence[str], d: str, x: Column, base: float, days: int = 84, out: str = "dhw") -> DataFrame:
    """Degree heating weeks: exceedances of at least one degree over a trailing day range, / 7."""
    hot = x - base
    w = Window.partitionBy(*keys).orderBy(F.unix_date(d)).rangeBetween(-(days - 1), 0)
    return df.withColumn(out, F.sum(F.when(hot >= 1, hot).otherwise(0.0)).over(w) / 7.0)


def good_streak(df: DataFrame, keys: Sequence[str], t: str, cond: Column, cap: int = 100, out: str = "streak") -> DataFrame:
    """Consecutive true rows so far, reset by a false row, capped."""
    w = C.by_time(keys, t)
    flagged = df.withColumn("_c", F.coalesce(cond, F.lit(False)))
    island = F.sum(F.when(~F.col("_c"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    good = F.sum(F.when(F.col("_c"), 1).otherwise(0)).over(
        Window.partitionBy(*keys, "_island").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    )
    return flagged.withColumn("_island", island).withColumn(out, F.least(good, F.lit(cap))).drop("_c", "_island")


def ffill(df: DataFrame, keys: Sequence[str], t: str, x: str, out: str | None = None) -> DataFrame:
    w = C.by_time(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or x, F.last(x, ignorenulls=True).over(w))


def event_paths(price: DataFrame, events: DataFrame, keys: Sequence[str], d: str, x: str, window: int = 10) -> DataFrame:
    """Cumulative log change around each event from the day before the window.

    Events move to the first trading day on or after them; those too near an edge of the
    series are left out.
    """
    keys = list(keys)
    w = C.by_time(keys, d)
    cal = price.select(*keys, d, F.log(x).alias("_lx"), F.row_number().over(w).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    tagged = cal.select(*keys, d, F.lit(1).alias("_side"), "_i", "_n").unionByName(
        events.select(*keys, d, F.lit(0).alias("_side")), allowMissingColumns=True
    )
    # backwards with a growing frame: a frame to the end of the partition is quadratic
    ahead = Window.partitionBy(*keys).orderBy(F.desc(d), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        tagged.withColumn("_at", F.last("_i", ignorenulls=True).over(ahead)).withColumn("_len", F.last("_n", ignorenulls=True).over(ahead))
        .where("_side = 0").select(*keys, F.col(d).alias("event"), "_at", "_len")
        .where((F.col("_at") - window > 1) & (F.col("_at") + window <= F.col("_len")))
    )
    steps = placed.withColumn("k", F.explode(F.sequence(F.lit(-window - 1), F.lit(window)))).withColumn("_i", F.col("_at") + F.col("k"))
    path = steps.join(cal.select(*keys, "_i", "_lx"), [*keys, "_i"])
    base = path.where(F.col("k") == -window - 1).select(*keys, "event", F.col("_lx").alias("_base"))
    out = path.where(F.col("k") >= -window).join(base, [*keys, "event"])
    return out.select(*keys, "event", "k", (F.col("_lx") - F.col("_base")).alias("cum"))


def sta_lta_pick(traces: DataFrame, keys: Sequence[str], i: str, a: str, short: int, long: int, threshold: float, start: int) -> DataFrame:
    """First sample whose short-over-long energy passes the threshold after a warm-up; -1 if none.

    A trace has a fixed number of samples, so it is one window partition.
    """
    w = C.by_time(keys, i)
    energy = F.col(a) * F.col(a)
    ratio = F.avg(energy).over(w.rowsBetween(-(short - 1), 0)) / F.greatest(F.avg(energy).over(w.rowsBetween(-(long - 1), 0)), F.lit(1e-20))
    ready = (F.col(i) >= start) & (F.col(i) >= long - 1)
    return traces.withColumn("_r", ratio).groupBy(*keys).agg(
        F.coalesce(F.min(F.when(ready & (F.col("_r") > threshold), F.col(i))), F.lit(-1)).alias("pick")
    )


def first_motion(traces: DataFrame, keys: Sequence[str], i: str, a: str, arrival: Column, before: int = 10, start: int = 1, after: int = 3) -> DataFrame:
    """0 if the ground moves up after the arrival, else 1."""
    rel = F.col(i) - arrival
    post = F.avg(F.when(rel.between(start, start + after - 1), F.col(a)))
    pre = F.avg(F.when(rel.between(-before, -1), F.col(a)))
    return traces.groupBy(*keys).agg(F.when(post - pre > 0, 0).otherwise(1).alias("motion"))


def snr_db(traces: DataFrame, keys: Sequence[str], i: str, a: str, arrival: Column, signal: int = 100, far: int = 250, near: int = 50) -> DataFrame:
    """10 log10 of signal variance over noise variance."""
    rel = F.col(i) - arrival
    s = F.var_pop(F.when(rel.between(0, signal - 1), F.col(a)))
    n = F.var_pop(F.when(rel.between(-far, -near - 1), F.col(a)))
    floor = F.lit(1e-20)
    return traces.groupBy(*keys).agg((F.log10(F.greatest(s, floor) / F.greatest(n, floor)) * 10).alias("snr"))


def early_warning(df: DataFrame, keys: Sequence[str], t: str, x: str, trend: int, w: int) -> DataFrame:
    """Variance and lag-1 autocorrelation of the detrended series over the previous w rows."""
    order = C.by_time(keys, t)
    lo, hi = frame(trend, True)
    res = df.withColumn("_x", F.col(x) - F.avg(x).over(order.rowsBetween(lo, hi))).withColumn("_p", F.col("_x") * F.lag("_x").over(order))
    past = order.rowsBetween(-w, -1)
    s, ss = F.sum("_x").over(past), F.sum(F.col("_x") * F.col("_x")).over(past)
    pairs = F.sum("_p").over(order.rowsBetween(-(w - 1), -1))
    first, last = F.lag("_x", w).over(order), F.lag("_x", 1).over(order)
    mean = s / w
    num = pairs - mean * (s * 2 - first - last) + mean * mean * (w - 1)
    full = F.count("_x").over(past) == w
    return (
        res.withColumn("variance", F.when(full, F.greatest(ss / w - mean * mean, F.lit(0.0))))
        .withColumn("ac1", F.when(full, F.try_divide(num, ss - s * mean)))
        .drop("_x", "_p")
    )


def autocorr(df: DataFrame, keys: Sequence[str], t: str, x: str, max_lag: int | None = None, block: int = 1 << 14) -> DataFrame:
    """Autocorrelation at lags 1..K (default floor(sqrt(T))): mean product over full variance.

    Rows are numbered in planned time ranges and cut into blocks of at least ``block`` and K positions.  A block gets the K rows after it
    as well, so a row is copied once at most, and gives one array of K partial sums; a key with all rows is many blocks.
    ``t`` is a number, a date or a timestamp.  A null value keeps its place and takes part in no product; a key without variance has 0
    at every lag.  Lags beyond the last row are left out, so a single row has none.
    """
    keys = list(keys)
    series = staged(df.select(*keys, t, F.col(x).cast("double").alias("_x")), "series")  # the ranges, their sums and the rows read it
    sliced = cut(series, keys, [t], None)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"), F.count("_x").alias("_known"), F.sum("_x").alias("_sum"))
    top = F.floor(F.sqrt("_n")) if max_lag is None else F.lit(max_lag).cast("long")
    ranges = sizes.select(
        *keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"), F.sum("_rows").over(whole).alias("_n"),
        F.try_divide(F.sum("_sum").over(whole), F.sum("_known").over(whole)).alias("_mean"),
    ).withColumn("_top", F.least(top, F.col("_n") - 1))
    place = F.col("_offset") + F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(t)) - 1
    rows = join_on(sliced, ranges, [*keys, "_slice"]).select(*keys, "_n", "_top", place.alias("_i"), (F.col("_x") - F.col("_mean")).alias("_c"))
    size = F.greatest(F.lit(block).cast("long"), F.col("_top"))
    own, first = F.floor(F.col("_i") / size), F.floor(F.greatest(F.col("_i") - F.col("_top"), F.lit(0)) / size)
    dealt = rows.select(*keys, "_n", "_top", "_i", "_c", own.alias("_own"), F.explode(F.sequence(first, own)).alias("_block"))
    dealt = dealt.select(*keys, "_block", "_n", "_top", "_i", "_c", (F.col("_own") == F.col("_block")).alias("_mine"))
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(f, k) for f, k in (("n", T.LongType()), ("s", T.ArrayType(T.DoubleType())), ("m", T.ArrayType(T.LongType()))))])

    def partial(group: pa.Table) -> pa.Table:
        at = np.argsort(group["_i"].to_numpy())
        c = group["_c"].to_numpy()[at].astype(float)
        mine, known = int(np.count_nonzero(group["_mine"].to_numpy())), ~np.isnan(c)
        c, gaps = np.where(known, c, 0.0), not known.all()
        sums, pairs = [], []
        for lag in range(group["_top"][0].as_py() + 1):
            end = max(min(mine, len(c) - lag), 0)
            sums.append(float(c[:end] @ c[lag : lag + end]))
            pairs.append(int(np.count_nonzero(known[:end] & known[lag : lag + end])) if gaps else end)
        one = group.slice(0, 1)
        arrays = [*(one[k] for k in keys), one["_n"], pa.array([sums], pa.list_(pa.float64())), pa.array([pairs], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(arrays, names=schema.names)

    sums = dealt.groupBy(*keys, "_block").applyInArrow(partial, schema)
    by_lag = sums.select(*keys, "n", F.posexplode(F.arrays_zip("s", "m")).alias("lag", "_p"))
    mean = F.try_divide(F.sum("_p.s"), F.sum("_p.m").cast("double"))
    by_lag = by_lag.groupBy(*keys, "lag").agg(F.max("n").alias("n"), mean.alias("_a"))
    by_lag = by_lag.withColumn("_v", F.max(F.when(F.col("lag") == 0, F.col("_a"))).over(whole))  # one row per lag
    rho = F.coalesce(F.try_divide(F.col("_a"), F.when(F.col("_v") > 0, F.col("_v"))), F.lit(0.0))
    return by_lag.where("lag > 0").select(*keys, F.col("lag").cast("long").alias("lag"), "n", rho.alias("rho"))


def effective_n(ac: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Effective observations from autocorrelations averaged over the variables at each lag."""
    mean = ac.groupBy(*by, "lag").agg(F.avg("rho").alias("_m"), F.max("n").alias("n"))
    infl = F.sum(F.col("_m") * F.col("_m")) * 2 + 1
    return mean.groupBy(*by).agg(F.max("n").alias("n"), (F.max("n") / F.greatest(infl, F.lit(1.0))).alias("n_eff"))


def effective_n_pair(ac: DataFrame, var: str) -> DataFrame:
    """Effective observations for every pair of variables, from the products of their autocorrelations."""
    b = ac.select(F.col(var).alias("_b"), "lag", F.col("rho").alias("_rb"))
    both = ac.join(b, "lag").where(F.col(var) < F.col("_b"))
    infl = F.sum(F.col("rho") * F.col("_rb")) * 2 + 1
    return both.groupBy(F.col(var).alias("i"), F.col("_b").alias("j")).agg((F.max("n") / F.greatest(infl, F.lit(1.0))).alias("n_eff"))


def every_kth(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, slice_by: Column | None = None) -> DataFrame:
    """Rows 0, k, 2k, ... of each key."""
    return row_position(df, keys, order, slice_by, "_pos").where((F.col("_pos") - 1) % k == 0).drop("_pos")


def block_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, n: int, slice_by: Column | None = None, out: str = "mean") -> DataFrame:
    """Means of full blocks of n rows; a short last block is dropped."""
    pos = row_position(df, keys, order, slice_by, "_pos").withColumn("block", F.floor((F.col("_pos") - 1) / n))
    return pos.groupBy(*keys, "block").agg(F.avg(x).alias(out), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).drop("_n")


def beta_weights(k: int, w: float) -> list[float]:
    """Beta-lag weights summing to one; larger w leans on recent periods."""
    raw = [(1 - i / (k + 1)) ** (w - 1) for i in range(1, k + 1)]
    return [r / sum(raw) for r in raw]


def beta_lag_sum(df: DataFrame, keys: Sequence[str], t: str, x: str, k: int, w: float, out: str = "midas") -> DataFrame:
    order = C.by_time(keys, t)
    terms = [F.lag(x, i).over(order) * phi for i, phi in enumerate(beta_weights(k, w), start=1)]
    return df.withColumn(out, sum(terms[1:], terms[0]))


def cum_index(df: DataFrame, keys: Sequence[str], t: str, x: str, compound: bool = False, out: str = "index") -> DataFrame:
    w = C.by_time(keys, t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.exp(F.sum(F.log1p(x)).over(w)) if compound else F.sum(x).over(w))


def top_events(df: DataFrame, x: str, n: int, order: Sequence[str]) -> DataFrame:
    """The n largest absolute values, back in date order (a top-k, not a full sort)."""
    return df.where(F.col(x).isNotNull()).orderBy(F.abs(F.col(x)).desc(), *order).limit(n).orderBy(*order)


