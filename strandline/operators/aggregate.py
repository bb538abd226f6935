"""Aggregations: calendar resampling, seasonal scaling, tails, scores, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators.ordering import exact_quantiles, join_on, quantile_columns, tail_mean, value_ranks
from strandline.storage import staged

_PERIODS = {
    "D": (lambda d: d, "INTERVAL 1 DAY"),
    "W-FRI": (lambda d: F.next_day(F.date_sub(d, 1), "FRI"), "INTERVAL 7 DAY"),
    "W-SUN": (lambda d: F.next_day(F.date_sub(d, 1), "SUN"), "INTERVAL 7 DAY"),
    "MS": (lambda d: F.trunc(d, "MM"), "INTERVAL 1 MONTH"),
    "QS": (lambda d: F.trunc(d, "QUARTER"), "INTERVAL 3 MONTH"),
    "YS": (lambda d: F.trunc(d, "YEAR"), "INTERVAL 1 YEAR"),
}
_ENDS = {"ME": "MS", "QE": "QS"}


def period(d: Column, freq: str) -> Column:
    """Label of the calendar bin: week ending day, period start, or period end."""
    if freq == "ME":
        return F.last_day(d)
    if freq == "QE":
        return F.last_day(F.add_months(F.trunc(d, "QUARTER"), 2))
    return _PERIODS[freq][0](d)


def spine(bounds: DataFrame, keys: Sequence[str], lo: str, hi: str, freq: str, out: str) -> DataFrame:
    """All periods between two period labels, per key."""
    step = F.expr(_PERIODS[_ENDS.get(freq, freq)][1])
    if freq in _ENDS:
        start = F.explode(F.sequence(F.trunc(lo, "MM" if freq == "ME" else "QUARTER"), F.trunc(hi, "MM" if freq == "ME" else "QUARTER"), step))
        return bounds.select(*keys, start.alias(out)).withColumn(out, period(F.col(out), freq))
    return bounds.select(*keys, F.explode(F.sequence(F.col(lo), F.col(hi), step)).alias(out))


def resample(df: DataFrame, keys: Sequence[str], t: str, freq: str, aggs: dict[str, Column], zero: Sequence[str] = ()) -> DataFrame:
    """Calendar bins per key with no gaps.

    Raw rows collapse to one per (key, bin) with partial aggregation before anything else.
    An empty bin is null, or 0 for the columns in ``zero`` (totals).
    """
    keys = list(keys)
    binned = df.groupBy(*keys, period(F.col(t), freq).alias(t)).agg(*[a.alias(n) for n, a in aggs.items()])
    bounds = binned.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    out = spine(bounds, keys, "_lo", "_hi", freq, t).join(binned, [*keys, t], "left")
    return out.fillna(0, subset=list(zero)) if zero else out


def last_known(x: str, *order: str) -> Column:
    """Latest non-null value as an aggregate."""
    return F.max_by(F.col(x), F.when(F.col(x).isNotNull(), F.struct(*order)))


def weighted_sum(df: DataFrame, by: Sequence[str], x: str, w: str, min_count: int = 1, out: str = "total") -> DataFrame:
    """Weighted total, null unless at least ``min_count`` values are present."""
    return df.groupBy(*by).agg(F.when(F.count(x) >= min_count, F.sum(F.col(x) * F.col(w))).alias(out))


def complete_sum(df: DataFrame, by: Sequence[str], x: str, out: str = "total") -> DataFrame:
    """Total only where every member is present."""
    return df.groupBy(*by).agg(F.when(F.count(x) == F.count(F.lit(1)), F.sum(x)).alias(out))


def zscore_by(df: DataFrame, group: Sequence[str | Column], x: str, out: str = "z", kind: str = "z") -> DataFrame:
    """Standardise (``z``), demean (``demean``) or scale (``scale``) inside calendar groups.

    The moments are an aggregate joined back, so a large group is never sorted in one task.
    """
    names = [f"_g{i}" for i in range(len(group))]
    keyed = df.select("*", *[(F.col(g) if isinstance(g, str) else g).alias(n) for g, n in zip(group, names)])
    stats = keyed.groupBy(*names).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    centre = F.col(x) - F.col("_m")
    value = {"z": F.try_divide(centre, F.col("_s")), "demean": centre, "scale": F.try_divide(F.col(x), F.col("_s"))}[kind]
    return join_on(keyed, stats, names).withColumn(out, value).drop(*names, "_m", "_s")


def median_anomaly(df: DataFrame, keys: Sequence[str], x: str, out: str = "anomaly") -> DataFrame:
    """Value minus the exact median of its group (for example site, month and hour)."""
    med = quantile_columns(df, keys, x, {"_median": 0.5})
    return join_on(df, med, list(keys)).withColumn(out, F.col(x) - F.col("_median")).drop("_median")


def interpolate(df: DataFrame, keys: Sequence[str], pos: str, x: str, hold_end: bool = True) -> DataFrame:
    """Linear fill between known values of a calendar-bounded series.

    Leading gaps stay null; trailing gaps hold the last value when ``hold_end``.
    """
    w = C.by_time(keys, pos)
    known = F.when(F.col(x).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(x).alias("v")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.desc(pos))
    b = F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    both = df.withColumn("_a", a).withColumn("_b", b)
    slope = F.try_divide(F.col("_b.v") - F.col("_a.v"), (F.col("_b.p") - F.col("_a.p")).cast("double"))
    filled = F.col("_a.v") + slope * (F.col(pos) - F.col("_a.p"))
    tail = F.when(F.col("_b").isNull() & F.lit(hold_end), F.col("_a.v"))
    return both.withColumn(x, F.coalesce(F.col(x), filled, tail)).drop("_a", "_b")


def climatology(df: DataFrame, keys: Sequence[str], d: str, x: str, half: int = 15, days: int = 366) -> DataFrame:
    """Mean by day of year, gaps interpolated, smoothed by a centred mean wrapping the year."""
    keys = list(keys)
    per = df.groupBy(*keys, F.dayofyear(d).alias("doy")).agg(F.avg(x).alias("clim"))
    grid = per.select(*keys).distinct().withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(days))))
    full = interpolate(grid.join(per, [*keys, "doy"], "left"), keys, "doy", "clim")
    wrapped = full.withColumn(
        "_pos",
        F.explode(F.filter(F.array(F.col("doy"), F.col("doy") - days, F.col("doy") + days), lambda p: p.between(1 - half, days + half))),
    )
    w = C.by_time(keys, "_pos").rowsBetween(-half, half)
    smooth = F.when(F.count("clim").over(w) == 2 * half + 1, F.avg("clim").over(w))
    return wrapped.withColumn("clim", smooth).where(F.col("_pos").between(1, days)).select(*keys, "doy", "clim")


def reference_zscore(
    df: DataFrame, keys: Sequence[str], d: str, lead: str, xs: Sequence[str], ref: tuple[int, int], leads: Sequence[int] = (1, 2, 3)
) -> DataFrame:
    """Mean over the leads (all required), then z by calendar month against reference years."""
    keys = list(keys)
    full = df.where(F.col(lead).isin(list(leads))).groupBy(*keys, d).agg(
        *[F.avg(x).alias(x) for x in xs], F.countDistinct(lead).alias("_l")
    ).where(F.col("_l") == len(leads)).drop("_l").withColumn("_m", F.month(d))
    clim = full.where(F.year(d).between(*ref)).groupBy(*keys, "_m").agg(
        *[F.avg(x).alias(f"_mu_{x}") for x in xs], *[F.stddev_samp(x).alias(f"_sd_{x}") for x in xs]
    )
    z = [F.try_divide(F.col(x) - F.col(f"_mu_{x}"), F.col(f"_sd_{x}")).alias(f"{x}_z") for x in xs]
    return full.join(clim, [*keys, "_m"], "left").select(*keys, d, *z)


def trailing_zscore(df: DataFrame, keys: Sequence[str], d: str, x: str, years: int = 15, min_obs: int = 10, out: str = "z") -> DataFrame:
    """z against the same calendar month of the previous years, strictly past."""
    w = Window.partitionBy(*keys, F.month(d)).orderBy(F.year(d)).rangeBetween(-years, -1)
    z = F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w))
    return df.withColumn(out, F.when(F.count(x).over(w) >= min_obs, z))


def group_quantiles(df: DataFrame, by: Sequence[str], x: str, named: dict[str, float]) -> DataFrame:
    return quantile_columns(df, by, x, named)


def cvar_count(df: DataFrame, by: Sequence[str], x: str, q: float = 0.05, out: str = "cvar") -> DataFrame:
    """Mean of the lowest ``ceil(q n)`` rows, at least one."""
    return tail_mean(df, by, x, F.greatest(F.lit(1), F.ceil(F.col("n_all") * q)), out)


def cvar_quantile(df: DataFrame, by: Sequence[str], x: str, q: float = 0.05, out: str = "cvar") -> DataFrame:
    """Mean of the values at or below the exact quantile."""
    cut = quantile_columns(df, by, x, {"_cut": q})
    joined = join_on(df, cut, list(by))
    return joined.where(F.col(x) <= F.col("_cut")).groupBy(*by).agg(F.avg(x).alias(out))


def capture_price(df: DataFrame, by: Sequence[str], gen: str, price: str) -> DataFrame:
    """Generation-weighted price per site and its ratio to the plain mean price."""
    captured = F.try_divide(F.sum(F.col(gen) * F.col(price)), F.sum(gen))
    return df.groupBy(*by).agg(captured.alias("capture"), F.try_divide(captured, F.avg(price)).alias("ratio"))


def top_k_mean(df: DataFrame, by: Sequence[str], x: str, k: int, out: str = "top") -> DataFrame:
    """Mean of the ``k`` largest rows per key.

    For a small ``k`` a window with a limit keeps at most ``k`` rows of a key in each task before the shuffle.
    """
    if k > 1000 or not by:
        return tail_mean(df, by, x, F.lit(k), out, largest=True)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(x)))
    top = df.where(F.col(x).isNotNull()).select(*by, x).withColumn("_k", first).where(F.col("_k") <= k)
    return top.groupBy(*by).agg(F.avg(x).alias(out))


def unpivot_models(df: DataFrame, ids: Sequence[str], models: Sequence[str], obs: str) -> DataFrame:
    """Wide predictions -> one error row per model."""
    return df.unpivot([*ids, obs], list(models), "model", "pred").withColumn("err", F.col("pred") - F.col(obs))


def skill_table(pred: DataFrame, models: Sequence[str], obs: str, band: Column, hot_share: float, far: Column) -> DataFrame:
    """RMSE, bias and n per model: overall, per band, hottest share, far stations.

    One aggregate over the unpivoted errors with grouping sets; the hot and far scores are
    conditional means of the same pass.
    """
    cut = quantile_columns(pred, [], obs, {"_cut": 1 - hot_share})
    long = unpivot_models(
        pred.crossJoin(F.broadcast(cut)).select(band.alias("band"), far.alias("_far"), F.col("_cut"), obs, *models),
        ["band", "_far", "_cut"], models, obs,
    )
    sq = F.col("err") * F.col("err")
    return long.groupingSets([[F.col("model")], [F.col("model"), F.col("band")]], F.col("model"), F.col("band")).agg(
        F.when(F.grouping_id() == 1, "all").otherwise(F.col("band")).alias("group"),
        F.sqrt(F.avg(sq)).alias("rmse"),
        F.avg("err").alias("bias"),
        F.count("err").alias("n"),
        F.sqrt(F.avg(F.when(F.col(obs) >= F.col("_cut"), sq))).alias("rmse_hot"),
        F.sqrt(F.avg(F.when(F.col("_far"), sq))).alias("rmse_far"),
    ).drop("band")


def skill_score(df: DataFrame, by: Sequence[str], err: Column, err_clim: Column, out: str = "skill") -> DataFrame:
    return df.groupBy(*by).agg((F.lit(1.0) - F.try_divide(F.avg(err * err), F.avg(err_clim * err_clim))).alias(out))


def interval_coverage(df: DataFrame, by: Sequence[str], y: str, lo: Column, hi: Column) -> DataFrame:
    inside = F.when((F.col(y) >= lo) & (F.col(y) <= hi), 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.avg(inside).alias("coverage"), F.avg(hi - lo).alias("width"))


def conformal_width(cal: DataFrame, fold: str, y: str, lo: str, hi: str, q: float = 0.9) -> DataFrame:
    """Per fold, the quantile of how far readings fall outside their interval."""
    miss = cal.withColumn("_e", F.greatest(F.col(lo) - F.col(y), F.col(y) - F.col(hi)))
    return quantile_columns(miss, [fold], "_e", {"widen": q})


def binned_stat(df: DataFrame, x: str, y: str, bins: int, slices: int | None = None) -> DataFrame:
    """Mean of x and y in bins of equal count, ties in x split by a stable first-come rank.

    ``df`` must carry a unique ``_tie`` column; bins are right-closed edges of 1..n.
    """
    ranks = value_ranks(df, [], x, slices).select(x, "n_below", "n_all")
    first = df.join(ranks, x)
    w = Window.partitionBy(x).orderBy("_tie")
    rank = F.col("n_below") + F.row_number().over(w)
    b = F.greatest(F.lit(1), F.ceil((rank - 1) * bins / (F.col("n_all") - 1))).cast("int")
    return first.withColumn("bin", b).groupBy("bin").agg(F.avg(x).alias(x), F.avg(y).alias(y), F.count(F.lit(1)).alias("n"))


def _in_quantile_bins(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Add ``bin``, 0 to bins - 1, by quantile edges of x: [lo, hi), the last one closed."""
    edges = {f"_e{i}": i / bins for i in range(1, bins)}
    cut = quantile_columns(df, [], x, edges)
    inside = sum((F.when(F.col(x) >= F.col(e), 1).otherwise(0) for e in edges), F.lit(0))
    return df.crossJoin(F.broadcast(cut)).withColumn("bin", inside).drop(*edges)


def quantile_bins(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Quantile-edge bins [lo, hi), the last one closed; mean of y per bin."""
    return _in_quantile_bins(df, x, bins).groupBy("bin").agg(F.avg(x).alias(x), F.avg(y).alias(y), F.count(F.lit(1)).alias("n"))


def binned_median(df: DataFrame, x: str, y: str, bins: int, slices: int | None = None) -> DataFrame:
    """Quantile-edge bins as in ``quantile_bins``; exact medians of x and y per bin and the rows with an x.

    The medians come from ranks in value slices, so a bin (a large share of the table by design) is never sorted in one
    task.  Rows without x are in no bin; rows without y count, and a bin without any y has a null median.
    """
    binned = staged(_in_quantile_bins(df.where(F.col(x).isNotNull()), x, bins).select("bin", x, y), "binned")
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    for c in (x, y):
        out = join_on(out, quantile_columns(binned, ["bin"], c, {c: 0.5}, slices), ["bin"], "left")
    return out.select("bin", x, y, "n")


def fixed_bins(x: str, edges: Sequence[float]) -> Column:
    """Index of the right-closed bin (lo, hi] holding x."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        out = F.when((F.col(x) > lo) & (F.col(x) <= hi), i).otherwise(out)
    return out


def histogram(df: DataFrame, x: str, edges: Sequence[float]) -> DataFrame:
    """Counts in [lo, hi) bins, the last bin closed on both sides; empty bins give 0."""
    last = len(edges) - 2
    counts = [
        F.count(F.when((F.col(x) >= lo) & ((F.col(x) <= hi) if i == last else (F.col(x) < hi)), 1)).alias(f"b{i}")
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("lo"), F.col(f"b{i}").alias("n")) for i in range(last + 1)])
    return df.agg(*counts).select(F.inline(rows))


def seasonal_factor(df: DataFrame, keys: Sequence[str], d: str, ret: str) -> DataFrame:
    """Volatility by month of year-scaled returns, normalised to mean one, with its error."""
    scaled = zscore_by(df.where(F.col(ret).isNotNull()), [*keys, F.year(d)], ret, "_scaled", "scale")
    month = scaled.groupBy(*keys, F.month(d).alias("month")).agg(F.stddev_samp("_scaled").alias("_sd"), F.count("_scaled").alias("n"))
    f = F.col("_sd") / F.avg("_sd").over(Window.partitionBy(*keys))  # at most twelve rows per key
    return month.withColumn("factor", f).withColumn("se", F.col("factor") / F.sqrt(2 * F.col("n"))).drop("_sd")


def hit_stats(df: DataFrame, by: Sequence[str], hedge: Column, actual: str) -> DataFrame:
    a = F.col(actual)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("decisions"),
        share(hedge).alias("hedged_share"),
        share(hedge == (a > 0)).alias("hit_rate"),
        share(a > 0).alias("base_rate_up"),
        F.avg(F.when(hedge, a).otherwise(0.0)).alias("saving"),
        F.avg(a).alias("always"),
        F.avg(F.when(hedge, a)).alias("when_hedged"),
        F.avg(F.when(~hedge, a)).alias("when_waited"),
    )


def before_after(
    df: DataFrame, keys: Sequence[str], d: str, x: str, pre: tuple[str, str], post: tuple[str, str], event_year: int, base_years: Sequence[int]
) -> DataFrame:
    """Mean after / mean before in the event year, against the same windows of other years.

    Windows are (month-day, month-day); one pass of conditional means per (key, year).
    """
    md = F.date_format(d, "MM-dd")
    in_pre, in_post = md.between(*pre), md.between(*post)
    per = df.where(in_pre | in_post).groupBy(*keys, F.year(d).alias("_y")).agg(
        F.avg(F.when(in_pre, F.col(x))).alias("_a"), F.avg(F.when(in_post, F.col(x))).alias("_b"),
        F.count(F.when(in_pre, F.col(x))).alias("_na"), F.count(F.when(in_post, F.col(x))).alias("_nb"),
    )
    ratio = F.try_divide(F.col("_b"), F.col("_a"))
    event = F.col("_y") == event_year
    return per.groupBy(*keys).agg(
        F.max(F.when(event, F.col("_a"))).alias("pre_mean"), F.max(F.when(event, F.col("_b"))).alias("post_mean"),
        F.max(F.when(event, ratio)).alias("ratio"), F.avg(F.when(F.col("_y").isin(list(base_years)), ratio)).alias("ratio_base"),
        F.max(F.when(event, F.col("_na"))).alias("n_pre"), F.max(F.when(event, F.col("_nb"))).alias("n_post"),
    )


def independence_check(df: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    p = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(
        p(a).alias("p_a"), p(b).alias("p_b"), p(a & b).alias("p_both"), (p(a) * p(b)).alias("p_if_independent"), F.count(F.when(a & b, 1)).alias("n_both")
    )


def coverage_filter(df: DataFrame, entity: Sequence[str], x: str, min_share: float) -> DataFrame:
    """Rows of the entities with enough values present."""
    ok = df.groupBy(*entity).agg((F.count(x) / F.count(F.lit(1))).alias("_share")).where(F.col("_share") >= min_share)
    return df.join(ok.select(*entity), list(entity), "left_semi")


def relative_index(df: DataFrame, entity: str, t: str, x: str, by: Sequence[str] = (), min_entities: int = 3) -> DataFrame:
    """Entity over its own mean, then the mean over entities where enough report."""
    own = df.groupBy(entity).agg(F.avg(x).alias("_own"))
    rel = df.join(own, entity).withColumn("_rel", F.try_divide(F.col(x), F.col("_own")))
    return rel.groupBy(*by, t).agg(F.when(F.count("_rel") >= min_entities, F.avg("_rel")).alias("index"), F.count("_rel").alias("n"))


def exceedance(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Return period ``(n + 1) / rank`` with the largest value at rank one."""
    ranks = value_ranks(df, keys, x)
    above = F.col("n_all") - F.col("n_below") - F.col("n_eq")
    place = F.explode(F.sequence(above + 1, above + F.col("n_eq")))
    return ranks.withColumn("rank", place).select(*keys, x, "rank", ((F.col("n_all") + 1) / F.col("rank")).alias("return_period"))


def shortfall(df: DataFrame, by: Sequence[str], x: str, q: float = 0.05, out: str = "shortfall") -> DataFrame:
    """(mean - quantile) / mean per group."""
    low = exact_quantiles(df, by, x, [q]).withColumnRenamed(x, "_low").drop("q")
    mean = df.groupBy(*by).agg(F.avg(x).alias("mean"))
    joined = join_on(mean, low, list(by))
    return joined.withColumn(out, F.try_divide(F.col("mean") - F.col("_low"), F.col("mean"))).drop("_low")


def worst_month(df: DataFrame, keys: Sequence[str], year: str, month: str, x: str) -> DataFrame:
    """Per key and year, the largest relative shortfall against the month's mean."""
    mean = df.groupBy(*keys, month).agg(F.avg(x).alias("_mean"))
    rel = df.join(mean, [*keys, month]).withColumn("_rel", F.try_divide(F.col("_mean") - F.col(x), F.col("_mean")))
    return rel.groupBy(*keys, year).agg(F.max("_rel").alias("worst"))


def group_summary(df: DataFrame, sets: Sequence[Sequence[str]], x: str, cost: str, q: float = 0.05) -> DataFrame:
    """n, mean, sd, tail mean and mean cost at several groupings, stacked."""
    names = sorted({c for s in sets for c in s})
    out = None
    for s in sets:
        base = df.groupBy(*s).agg(
            F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg(cost).alias("mean_cost")
        )
        part = base.join(cvar_count(df, s, x, q), list(s))
        part = part.select(*[F.col(c) if c in s else F.lit(None).cast("string").alias(c) for c in names], "n", "mean", "sd", "cvar", "mean_cost")
        out = part if out is None else out.unionByName(part)
    return out


def extreme_count(df: DataFrame, keys: Sequence[str], d: str, x: str, lo: float, hi: float, out: str = "extreme_days") -> DataFrame:
    """Days per month outside the thresholds, back on each day."""
    month = F.trunc(d, "MM")
    counts = df.groupBy(*keys, month.alias("_m")).agg(F.count(F.when((F.col(x) < lo) | (F.col(x) > hi), 1)).alias(out))
    return df.withColumn("_m", month).join(counts, [*keys, "_m"]).drop("_m")
