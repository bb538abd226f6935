"""Joins: calendar alignment, as-of, intervals, lookups (nearest neighbours are in ``spatial``)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordering import carry_last, join_on, locate, planned_edges
from strandline.storage import staged


def align(series: dict[str, tuple[DataFrame, str, str]], t: str = "t", how: str = "inner") -> DataFrame:
    """Several series ``name -> (frame, time, value)`` on one calendar.

    A tagged union and one aggregate replace a chain of outer joins: one shuffle for any
    number of series.  ``inner`` keeps complete rows, ``outer`` keeps all.
    """
    names = list(series)
    parts = [
        df.select(F.col(tc).alias(t), F.lit(name).alias("_s"), F.col(x).cast("double").alias("_v"))
        for name, (df, tc, x) in series.items()
    ]
    wide = reduce(DataFrame.unionByName, parts).groupBy(t).agg(
        *[F.max(F.when(F.col("_s") == n, F.col("_v"))).alias(n) for n in names]
    )
    return wide.dropna(subset=names) if how == "inner" else wide


def merge_suffix(a: DataFrame, b: DataFrame, on: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join; columns present on both sides get a suffix."""
    on = list(on)
    shared = [c for c in a.columns if c in b.columns and c not in on]
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, on)


def _asof(left, right, keys, t, cols, slice_by, forward, tie) -> DataFrame:
    tie = list(tie)
    value = F.struct(*[F.col(c) for c in cols])
    known = right.select(*keys, F.col(t), F.lit(0 if forward else 1).alias("_side"), value.alias("_val"), *[c for c in tie if c in right.columns])
    asked = left.select(*keys, F.col(t), F.lit(1 if forward else 0).alias("_side"), F.struct(*left.columns).alias("_row"), *[c for c in tie if c in left.columns])
    both = known.unionByName(asked, allowMissingColumns=True)
    out = carry_last(both, keys, [t, "_side", *tie], F.col("_val").isNotNull(), F.col("_val"), "_hit", slice_by, forward)
    return out.where("_row IS NOT NULL").select("_row.*", *[F.col("_hit")[c].alias(c) for c in cols])


def asof_last(left, right, keys, t, cols, slice_by: Column | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Last right row at or before each left row.

    Union and carry: one sort per time slice, no range join.  Slices are equally full ranges of a key's time,
    planned from a quantile sketch of both sides unless ``slice_by`` is given.
    """
    return _asof(left, right, list(keys), t, list(cols), slice_by, True, tie)


def asof_next(left, right, keys, t, cols, slice_by: Column | None = None, tie: Sequence[str] = (), shared_times: bool = False) -> DataFrame:
    """First right row at or after each left row.

    With ``shared_times`` (days of a calendar, say) each distinct time of a key is looked up once, and its
    rows fetch the answer: what a task sorts doesn't grow with the rows of a day.
    """
    keys, cols = list(keys), list(cols)
    if not shared_times:
        return _asof(left, right, keys, t, cols, slice_by, False, tie)
    times = left.select(*keys, t).distinct()
    found = staged(_asof(times, right, keys, t, cols, slice_by, False, [c for c in tie if c in right.columns]), "times")
    return join_on(left, found, [*keys, t], "left")


ENDPOINTS = 512  # starts and ends that a planned range holds about


def interval_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """All pairs of half-open intervals (numeric or time bounds) that overlap; columns ``a_*``, ``b_*``.

    The time of each key is cut into ranges with about the same number of endpoints.  Every interval is filed once under the
    range where it starts, and under all ranges it touches; a pair meets where the later one starts, so it
    appears once, and intervals that merely pass through a range together aren't compared there.
    """
    keys = list(keys)
    sides = {}
    for side, df in (("a", a), ("b", b)):
        valid = df.where(F.col(start) < F.col(end)).withColumnsRenamed({c: f"{side}_{c}" for c in df.columns if c not in keys})
        sides[side] = staged(valid, f"intervals-{side}")  # read three times
    bounds = [sides[s].select(*keys, F.explode(F.array(f"{s}_{start}", f"{s}_{end}")).alias("_x")) for s in sides]
    points = bounds[0].unionByName(bounds[1])
    edges = planned_edges(points, keys, "_x", rows=ENDPOINTS)

    def place(df: DataFrame, x: str, name: str) -> DataFrame:
        out = locate(df, keys, x, name, edges)
        return out if ranks is None else join_on(out.withColumnRenamed(name, "_range"), ranks, [*keys, "_range"]).withColumnRenamed("_rank", name).drop("_range")

    ranks = None
    if len(edges) > 1:  # number the ranges of a key without gaps
        used = locate(points, keys, "_x", "_range", edges).select(*keys, "_range").distinct()
        ranks = staged(used.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_range"))), "ranges")
    placed = {s: place(place(df, f"{s}_{start}", "_first"), f"{s}_{end}", "_last") for s, df in sides.items()}
    starts = {s: df.withColumnRenamed("_first", "_at").drop("_last") for s, df in placed.items()}
    touched = {s: df.withColumn("_at", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last") for s, df in placed.items()}
    s = {side: F.col(f"{side}_{start}") for side in sides}
    later_a = join_on(starts["a"], touched["b"], [*keys, "_at"]).where((s["b"] <= s["a"]) & (s["a"] < F.col(f"b_{end}")))
    later_b = join_on(starts["b"], touched["a"], [*keys, "_at"]).where((s["a"] < s["b"]) & (s["b"] < F.col(f"a_{end}")))
    return later_a.unionByName(later_b).drop("_at")


def circular_day_pool(df: DataFrame, keys: Sequence[str], doy: str, x: str, half: int = 30, days: int = 365) -> DataFrame:
    """Rows within ``half`` days of each day of the year, wrapping; count, sum and squares.

    Rows collapse to one per day of year first, so the widening by 2*half+1 touches at
    most ``days`` rows per key.
    """
    per_day = df.groupBy(*keys, ((F.col(doy) - 1) % days).alias("_d")).agg(
        F.count(x).alias("_n"), F.sum(x).alias("_s"), F.min(x).alias("_lo"), F.max(x).alias("_hi")
    )
    spread = per_day.withColumn("_o", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    target = ((F.col("_d") + F.col("_o") + days) % days + 1).cast("int").alias(doy)
    return spread.groupBy(*keys, target).agg(
        F.sum("_n").alias("n"), F.sum("_s").alias("total"), F.min("_lo").alias("lowest"), F.max("_hi").alias("highest")
    )


def semi_filter(df: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is present in every other table."""
    return reduce(lambda acc, o: acc.join(o.select(key), key, "left_semi"), others, df)


def cross_params(df: DataFrame, **grids: Sequence) -> DataFrame:
    """Every row with every parameter value; the grids are literals, so nothing is joined."""
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def lookup_weights(df: DataFrame, weights: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    """Attach a weight per key; the optimizer broadcasts the table when it is small."""
    return df.join(weights.select(key, weight), key)


def merge_shared_cells(stations: DataFrame, cell: Sequence[str], sid: str, means: Sequence[str]) -> DataFrame:
    """Stations of one cell become one: first id, mean of the listed columns."""
    return stations.groupBy(*cell).agg(
        F.min(sid).alias(sid), F.count(F.lit(1)).alias("n_merged"), *[F.avg(m).alias(m) for m in means]
    )


def forecast_issue_table(fc: DataFrame, site: str, target: str, lead: str, x: str, n_leads: int = 7) -> DataFrame:
    """Re-key target dates to issue dates; keep issues with every lead, with their highest value."""
    return (
        fc.where(F.col(x).isNotNull())
        .groupBy(site, F.expr(f"date_sub({target}, {lead})").alias("issue"))
        .agg(F.max(x).alias("level"), F.countDistinct(lead).alias("_leads"))
        .where(F.col("_leads") == n_leads)
        .drop("_leads")
    )
