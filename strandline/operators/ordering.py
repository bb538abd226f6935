"""Order-based primitives that survive a hot key.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task.  That is fine
for a series with one row per calendar period (its length is bounded by the calendar)
and wrong for raw rows, where one key may hold a third of the table.  The functions
here split every key into ordered slices (value slices or time slices), work inside a
slice, and carry what crosses a slice border in a table with one row per slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from strandline.storage import staged

FANOUT, WIDE, STRIDE = 64, 256, 16


def default_slices(df: DataFrame) -> int:
    """Slices per key follow the shuffle width the cluster is tuned for."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null matches null, so the rows of a null key stay."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(F.broadcast(right))  # a single row
    other = right.select(*(F.col(c).alias(f"_right_{c}" if c in keys else c) for c in right.columns))
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(other[f"_right_{k}"])
    return left.join(other, cond, how).drop(*(f"_right_{k}" for k in keys))


def slice_values(df: DataFrame, keys: Sequence[str], x: str, name: str, slices: int, edges_apart: bool = False) -> DataFrame:
    """Number value slices of each key in ascending order, at approximate quantiles.

    Beyond 64 slices the cut is repeated inside the slices of the level above, so a row is
    compared with 64 edges per level whatever the total.  With ``edges_apart`` an edge
    value is a slice of its own (odd number), so a heavily tied value shares none.
    """
    keys = list(keys)
    out, path, per_level = df.withColumn(name, F.lit(0).cast("long")), [], 1
    while per_level ** max(len(path), 1) < slices or not path:
        fan = max(4, min(FANOUT, slices)) if not path else FANOUT
        group = [*keys, name] if path else keys
        edges = out.groupBy(*group).agg(F.percentile_approx(x, [i / fan for i in range(1, fan)], 1000).alias("_edges"))
        out = join_on(out, edges, group)
        below = F.size(F.filter("_edges", lambda e: e < F.col(x)))
        if edges_apart:
            upto = F.size(F.filter("_edges", lambda e: e <= F.col(x)))
            step, width = below * 2 + F.when(upto > below, 1).otherwise(0), 2 * fan
        else:
            step, width = below, fan
        out = out.withColumn(name, F.col(name) * width + step).drop("_edges")
        path.append(name)
        per_level = FANOUT
    return out


def planned_edges(df: DataFrame, keys: Sequence[str], x: str, slices: int | None = None, rows: int | None = None) -> list[DataFrame | list]:
    """Edges of about ``slices`` equally full ranges of ``x`` inside each key, or of ranges of about ``rows`` rows.

    They come from quantile sketches: a table of up to 256 edges per key, and one for each further level of 64.  The tables are written to the
    shared folder, so all branches of a plan (and recomputed tasks) cut at the same places.  Without keys the first level is a list of at most 255 values.
    """
    keys, name = list(keys), "_range"
    fan, out, edges = max(4, min(WIDE, slices or WIDE)), df.select(*keys, x), []
    while not edges or WIDE * FANOUT ** (len(edges) - 1) < slices:
        sketch = F.percentile_approx(x, [i / fan for i in range(1, fan)], 1000)
        table = out.groupBy(*keys, *([name] if edges else [])).agg(F.array_distinct(sketch).alias("_edges"), F.count(x).alias("_n"))
        if keys or edges:
            edges.append(staged(table, "edges"))
            most = edges[0].agg(F.max("_n")).first()[0] if rows and len(edges) == 1 else None
        else:
            first = table.first()
            edges.append(first["_edges"] or [])
            most = first["_n"]
        if slices is None:
            slices = math.ceil((most or 0) / rows)
        fan, out = FANOUT, _locate_level(out, keys, x, name, edges[-1], len(edges) > 1)
    return [e if isinstance(e, list) else e.drop("_n") for e in edges]


def _locate_level(df: DataFrame, keys: list[str], x: str, name: str, edges: DataFrame | list, deeper: bool) -> DataFrame:
    if isinstance(edges, list):
        kind = ArrayType(df.schema[x].dataType)
        return df.withColumn(name, _below(F.lit(edges).cast(kind), F.lit(edges[STRIDE - 1 :: STRIDE]).cast(kind), x))
    heads = F.filter("_edges", lambda e, i: i % STRIDE == STRIDE - 1)
    found = join_on(df, edges.withColumn("_heads", heads), [*keys, name] if deeper else keys)
    below = _below(F.col("_edges"), F.col("_heads"), x)
    return found.withColumn(name, F.col(name) * FANOUT + below if deeper else below).drop("_edges", "_heads")


def _below(edges: Column, heads: Column, x: str) -> Column:
    """Number of ascending edges below ``x``: first among every 16th, then among the 16 that follow."""
    count = lambda a: F.coalesce(F.size(F.filter(a, lambda e: e < F.col(x))), F.lit(0))
    skip = count(heads) * STRIDE
    return (skip + count(F.slice(edges, skip + 1, STRIDE))).cast("long")


def locate(df: DataFrame, keys: Sequence[str], x: str, name: str, edges: Sequence[DataFrame]) -> DataFrame:
    """Add the number of the range that holds ``x``; numbers grow with ``x``, and equal values share one.  A null is in the first."""
    for level, table in enumerate(edges):
        table = table.withColumnRenamed("_range", name) if level and name != "_range" else table
        df = _locate_level(df, list(keys), x, name, table, level > 0)
    return df


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None) -> DataFrame:
    """Add ``_slice``: the caller's slices, or ranges of the first ordering column planned so that a hot key is spread evenly."""
    if slice_by is not None:
        return df.withColumn("_slice", slice_by)
    return locate(df, keys, order[0], "_slice", planned_edges(df, keys, order[0], default_slices(df)))


def value_ranks(df: DataFrame, keys: Sequence[str], x: str, slices: int | None = None, sums: bool = False) -> DataFrame:
    """One row per (keys, value): ``n_eq`` copies, ``n_below`` smaller rows, ``n_all`` rows.

    With ``sums`` also ``s_below`` and ``s_all``, the totals of the smaller and of all rows.

    Copies collapse before any ordering, so a value held by a third of the rows is one
    row.  Each key is then cut at approximate quantiles; the edges only decide which
    task orders which value, the counts stay exact.
    """
    keys = list(keys)
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n_eq"))
    sliced = slice_values(counts, keys, x, "_slice", slices or default_slices(df))
    parts = {"n": F.col("n_eq")} | ({"s": F.col(x) * F.col("n_eq")} if sums else {})
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_{p}") for p, c in parts.items()])
    whole = Window.partitionBy(*keys)
    by_key = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_slice",
        *[F.sum(f"_{p}").over(whole).alias(f"{p}_all") for p in parts],
        *[F.coalesce(F.sum(f"_{p}").over(by_key), F.lit(0)).alias(f"_{p}_offset") for p in parts],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    out = join_on(sliced, offsets, [*keys, "_slice"])
    below = [(F.col(f"_{p}_offset") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{p}_below") for p, c in parts.items()]
    return out.select(*keys, x, "n_eq", *[f"{p}_all" for p in parts], *below)


def _ranges(df: DataFrame, keys: list[str], x: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the planned range of ``x``, and one row per range: rows and total inside, below and in the whole key.

    No row is sorted or shuffled here: ranges come from a sketch, and their sums are partial aggregates.
    """
    rows = df.where(F.col(x).isNotNull()).select(*keys, x)
    ranged = locate(rows, keys, x, "_range", planned_edges(rows, keys, x, WIDE))
    per = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(x).alias("_s"))
    whole = Window.partitionBy(*keys)  # at most 256 rows a key
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, per.select("*", F.sum("_n").over(whole).alias("n_all"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_below"))


def _ranked_inside(ranged: DataFrame, wanted: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Distinct values of the wanted ranges with copies ``n_eq`` and smaller rows ``n_below``; other columns of ``wanted`` stay."""
    per = wanted.columns
    values = join_on(ranged, wanted, [*keys, "_range"]).groupBy(*per, x).agg(F.count(F.lit(1)).alias("n_eq"))
    inside = Window.partitionBy(*keys, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    return values.withColumn("n_below", F.col("_below") + F.coalesce(F.sum("n_eq").over(inside), F.lit(0)))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], x: str, qs: Sequence[float], slices: int | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles, one row per (keys, q).

    Ranges of values are counted first; only rows of the few that hold an order statistic next to a quantile are
    brought together and ordered.  ``slices`` is kept for callers and no longer needed.
    """
    keys = list(keys)
    place = lambda q: (F.col("n_all") - 1) * q
    grid = F.array(*[F.lit(float(q)) for q in qs])
    holds = lambda below, n: lambda q: ((below <= F.floor(place(q))) & (F.floor(place(q)) < below + n)) | ((below <= F.ceil(place(q))) & (F.ceil(place(q)) < below + n))
    ranged, per = _ranges(df, keys, x)
    wanted = staged(per.where(F.exists(grid, holds(F.col("_below"), F.col("_n")))).select(*keys, "_range", "n_all", "_below"), "wanted")
    ranks = _ranked_inside(ranged, wanted, keys, x)
    covers = lambda k: (F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n_eq"))
    hit = F.filter(grid, holds(F.col("n_below"), F.col("n_eq")))
    near = ranks.where(F.size(hit) > 0).withColumn("q", F.explode(hit))
    h = place(F.col("q"))
    near = near.select(
        *keys,
        "q",
        (h - F.floor(h)).alias("_frac"),
        F.when(covers(F.floor(h)), F.col(x)).alias("_lo"),
        F.when(covers(F.ceil(h)), F.col(x)).alias("_hi"),
    )
    out = near.groupBy(*keys, "q").agg(
        F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_frac").alias("_frac")
    )
    return out.select(
        *keys, "q", (F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))).alias(x)
    )


def quantile_columns(
    df: DataFrame, keys: Sequence[str], x: str, named: dict[str, float], slices: int | None = None
) -> DataFrame:
    """Exact quantiles as columns, one row per key."""
    keys = list(keys)
    long = exact_quantiles(df, keys, x, list(named.values()), slices)
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == float(q), F.col(x))).alias(name) for name, q in named.items()]
    )


def average_rank(df: DataFrame, keys: Sequence[str], x: str, out: str = "rank", slices: int | None = None) -> DataFrame:
    """Add the 1-based rank of ``x`` inside each key, ties sharing the mean rank; null for a null ``x``."""
    ranks = value_ranks(df, keys, x, slices).select(
        *keys, x, (F.col("n_below") + (F.col("n_eq") + 1) / 2).alias(out), F.col("n_all").alias(f"{out}_n")
    )
    return join_on(df, ranks, [*keys, x], "left")


def tail_mean(
    df: DataFrame, keys: Sequence[str], x: str, size: Column, out: str, largest: bool = False, slices: int | None = None
) -> DataFrame:
    """Mean of the ``size`` smallest (or largest) rows per key; ``size`` may use ``n_all``.

    Ranges that lie inside the tail count by their sums; only the range that the cut goes through is ordered.
    The cut can fall among copies of one value, so each value counts with the number of
    its copies that lie inside the tail.
    """
    keys = list(keys)
    ranged, per = _ranges(df, keys, x)
    per = per.withColumn("_k", F.least(size.cast("long"), F.col("n_all")))

    def used(below: Column, n: Column) -> Column:
        before = F.col("n_all") - below - n if largest else below
        return F.greatest(F.lit(0), F.least(n, F.col("_k") - before))

    per = staged(per.withColumn("_used", used(F.col("_below"), F.col("_n"))).where("_used > 0"), "tails")
    full = per.where("_used = _n").select(*keys, F.col("_s").alias("_t"), "_used")
    ranks = _ranked_inside(ranged, per.where("_used < _n").select(*keys, "_range", "n_all", "_below", "_k"), keys, x)
    part = ranks.withColumn("_used", used(F.col("n_below"), F.col("n_eq"))).where("_used > 0")
    both = full.unionByName(part.select(*keys, (F.col(x) * F.col("_used")).alias("_t"), "_used"))
    return both.groupBy(*keys).agg((F.sum("_t") / F.sum("_used")).alias(out))


def _before(keys: Sequence[str], slice_col: str) -> Window:
    return Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None = None, out: str = "pos") -> DataFrame:
    """1-based row number inside each key, without a whole key in one task.

    Rows are numbered inside a slice and shifted by the rows of the earlier slices.  Slices are planned from
    a quantile sketch; a ``slice_by`` must grow with the ordering (a day, an hour).
    """
    keys = list(keys)
    sliced = cut(df, keys, order, slice_by)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(_before(keys, "_slice")), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        join_on(sliced, offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_offset") + F.row_number().over(inside))
        .drop("_slice", "_offset")
    )


def sliced_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str], slice_by: Column | None = None
) -> DataFrame:
    """Previous row's columns (``new name -> column``) along a key cut into slices.

    The first row of a slice takes the last row of the nearest earlier non-empty slice.
    """
    keys, order = list(keys), list(order)
    sliced = cut(df, keys, order, slice_by)
    payload = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(cols.values())])
    ends = sliced.groupBy(*keys, "_slice").agg(F.max_by(payload, F.struct(*order)).alias("_end"))
    by_key = Window.partitionBy(*keys).orderBy("_slice")
    carried = ends.select(*keys, "_slice", F.lag("_end").over(by_key).alias("_carry"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    prev = F.coalesce(F.lag(payload).over(inside), F.col("_carry"))
    out = join_on(sliced, carried, [*keys, "_slice"]).withColumn("_prev", prev)
    for i, name in enumerate(cols):
        out = out.withColumn(name, F.col(f"_prev.v{i}"))
    return out.drop("_slice", "_carry", "_prev")


def carry_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], mark: Column, value: Column, out: str, slice_by: Column | None = None,
    forward: bool = True,
) -> DataFrame:
    """Latest ``value`` among marked rows up to this row (or the next one, backwards)."""
    keys, order = list(keys), list(order)
    sliced = cut(df, keys, order, slice_by).withColumn("_known", F.when(mark, F.struct(value.alias("v"))))
    pick = F.max_by if forward else F.min_by
    ends = sliced.where("_known IS NOT NULL").groupBy(*keys, "_slice").agg(
        pick(F.col("_known"), F.struct(*order)).alias("_end")
    )
    slices = join_on(sliced.select(*keys, "_slice").distinct(), ends, [*keys, "_slice"], "left")
    if forward:
        outside = F.last("_end", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        )
        inside = F.last("_known", ignorenulls=True).over(
            Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        )
    else:
        # backwards with a growing frame: a frame to the end of the partition is quadratic
        outside = F.last("_end", ignorenulls=True).over(
            Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
        )
        inside = F.last("_known", ignorenulls=True).over(
            Window.partitionBy(*keys, "_slice").orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)
        )
    carried = slices.select(*keys, "_slice", outside.alias("_outside"))
    return (
        join_on(sliced, carried, [*keys, "_slice"])
        .withColumn(out, F.coalesce(inside, F.col("_outside"))["v"])
        .drop("_slice", "_known", "_outside")
    )


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key as an aggregate, so partial results combine before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), ordering).alias("_row"))
    return best.select(*keys, "_row.*")
