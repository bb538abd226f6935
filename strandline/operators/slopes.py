"""Median of pairwise slopes by slope selection, without the pairs.

For a trial slope s the pairs with a smaller slope are those whose order in ``x - s * t`` is opposite to their order in ``t``; they are
counted by halving (``dependence.signed_pair_sums``), so a count costs O(n log n) and no group lies in one task.  Random pairs propose
trials next to the median, exact counts at the trials close a bracket round it, and when a bracket holds at most ``listed`` slopes a row
its pairs are listed: two orders of the rows (at the lower and at the upper end) differ only there, so the rows' rank intervals overlap,
and the total length of these intervals is at most twice the number of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.dependence import signed_pair_sums
from strandline.operators.ordering import join_on, row_position, value_ranks
from strandline.operators.resample import hash_int
from strandline.storage import staged

GRID, BLOCK = 1000, 64
CLOSE = 4e-13  # relative width below which a bracket is one slope: differences of x - s * t are no finer


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def median_slopes(df: DataFrame, by: Sequence[str], t: str, xs: Sequence[str], listed: int = 64) -> DataFrame:
    """Median of the slopes between all rows of a group with different ``t``, per column: ``<x>_slope``, with ``n_years`` rows.

    Rows without a finite ``t`` or x give no slope; a group without a slope gets null; a null key is a group; an empty table gives no row.  Groups of at most
    ``2 * listed + 1`` rows list their slopes in an array (at most ``listed`` a row).  Larger ones are selected by counts, exact up to the rounding of
    ``x - s * t``, for groups of up to 1e8 rows (pair counts are whole doubles).  The points are written to the shared folder; the rounds run while the plan is built.
    """
    by, xs = list(by), list(xs)
    if not by:
        return median_slopes(df.withColumn("_one", F.lit(0)), ["_one"], t, xs, listed).drop("_one")
    cols = [F.col(t).cast("double").alias("_t"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)]]
    points = staged(df.select(*by, *cols, F.monotonically_increasing_id().alias("_id")), "points")
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n_years"))
    most = sizes.agg(F.max("n_years")).first()[0] or 0
    slopes = [f"{x}_slope" for x in xs]
    if most <= 2 * listed + 1:
        return _listed(points, by, len(xs)).toDF(*by, "n_years", *slopes)
    crowded = F.col("n_years") > 2 * listed + 1
    small = _listed(join_on(points, sizes.where(~crowded), by).drop("n_years"), by, len(xs)).toDF(*by, "n_years", *slopes)
    long = join_on(points, sizes.where(crowded), by).select(
        *by, "_t", "_id", F.posexplode(F.array(*[f"_x{i}" for i in range(len(xs))])).alias("_c", "_x")
    ).where(_finite(F.col("_t")) & _finite(F.col("_x")))
    found = _selected(long, [*by, "_c"], listed)
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("_c") == i, F.col("_slope"))).alias(s) for i, s in enumerate(slopes)])
    large = join_on(sizes.where(crowded), wide, by, "left").select(*by, "n_years", *slopes)
    return small.unionByName(large)


def _listed(points: DataFrame, by: list[str], n: int) -> DataFrame:
    """The slopes of small groups as arrays of one row each."""
    fields = ["_t", *[f"_x{i}" for i in range(n)]]
    rows = points.groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias("_r"), F.count(F.lit(1)).alias("n_years"))

    def median(x: str) -> Column:
        # a later row minus each earlier one; rows without a value drop out
        known = F.filter("_r", lambda r: _finite(r["_t"]) & _finite(r[x]))
        s = F.array_sort(F.flatten(F.transform(known, lambda a: F.transform(F.filter(known, lambda b: b["_t"] > a["_t"]), lambda b: (b[x] - a[x]) / (b["_t"] - a["_t"])))))
        mid = lambda k: F.get(s, F.floor(k).cast("int"))
        return (mid((F.size(s) - 1) / 2) + mid(F.size(s) / 2)) / 2

    return rows.select(*by, "n_years", *[median(f"_x{i}").alias(f"_s{i}") for i in range(n)])


def _residual(s: Column) -> Column:
    """Order of the rows under a slope; at the infinite ends it is that of t, forwards and backwards."""
    return F.when(s == -math.inf, F.col("_t")).when(s == math.inf, -F.col("_t")).otherwise(F.col("_x") - s * F.col("_t"))


def _ties(df: DataFrame, keys: list[str], cols: list[str], out: str) -> DataFrame:
    c = df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return c.groupBy(*keys).agg((F.sum(F.col("_n") * (F.col("_n") - 1)) / 2).alias(out), F.sum("_n").alias("_n"))


def _selected(long: DataFrame, keys: list[str], listed: int) -> DataFrame:
    """``(keys, _slope)`` for groups of any size: ``long`` has ``_t``, ``_x`` and a number ``_id`` of the row."""
    start = long.groupBy(*keys).agg(F.min("_t").alias("_t0"))
    moved = join_on(long, start, keys).withColumn("_t", F.col("_t") - F.col("_t0")).drop("_t0")
    points = staged(row_position(moved, keys, ["_id"], out="_pos").drop("_id"), "numbered")
    pairs = F.col("_n") * (F.col("_n") - 1) / 2 - F.col("_same")
    middle = F.array_distinct(F.array(F.floor((F.col("upto") - 1) / 2), F.floor(F.col("upto") / 2)))
    targets = _ties(points, keys, ["_t"], "_same").withColumn("upto", pairs).where("upto > 0").select(
        *keys, F.col("_n").cast("long").alias("_n"), F.explode(middle).alias("_k"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"),
        F.lit(0.0).alias("below"), "upto", F.lit(None).cast("double").alias("answer"),
    )
    targets, rounds = staged(targets, "targets"), 0
    while True:
        still = targets.where(F.col("answer").isNull() & (F.col("upto") - F.col("below") > F.col("_n") * listed))
        if still.isEmpty():
            break
        trials = staged(_trials(points, still, keys, rounds), "trials")
        targets = staged(_narrowed(targets, _counts(points, trials, keys), keys), "targets")
        rounds += 1
    left = targets.where("answer IS NULL")
    known = targets.where("answer IS NOT NULL").select(*keys, F.col("answer").alias("_slope"))
    if not left.isEmpty():
        known = known.unionByName(_listed_between(points, left, keys))
    return known.groupBy(*keys).agg(F.avg("_slope").alias("_slope"))


def _trials(points: DataFrame, still: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Up to six slopes per open bracket, from as many random pairs as there are rows: beside, at and around the sought one."""
    share = (F.col("_k") - F.col("below") + 0.5) / (F.col("upto") - F.col("below"))
    brackets = still.groupBy(*keys, "_n", "lo", "hi").agg(F.avg(share).alias("_f"))
    one = join_on(points, brackets, keys).withColumn("_with", hash_int(F.col("_n"), seed, F.col("_pos")) + 1)
    two = points.select(*keys, F.col("_pos").alias("_with"), F.col("_t").alias("_t2"), F.col("_x").alias("_x2"))
    s = F.try_divide(F.col("_x2") - F.col("_x"), F.col("_t2") - F.col("_t"))
    drawn = join_on(one, two, [*keys, "_with"]).withColumn("_s", s).where("_s > lo AND _s < hi")
    sketch = F.percentile_approx("_s", [i / GRID for i in range(GRID + 1)], 10000)
    seen = drawn.groupBy(*keys, "lo", "hi").agg(sketch.alias("_q"), F.count(F.lit(1)).alias("_m"))
    found = join_on(brackets, seen, [*keys, "lo", "hi"], "left")
    reach = F.greatest(F.lit(1.0), F.sqrt(F.col("_f") * (1 - F.col("_f")) / F.col("_m")) * 3 * GRID)
    at = lambda place: F.get("_q", F.greatest(F.lit(0), F.least(F.lit(GRID), place)).cast("int"))
    found = found.select(
        *keys, "lo", "hi", "_m", at(F.floor(F.col("_f") * GRID - reach)).alias("a"), at(F.round(F.col("_f") * GRID)).alias("b"), at(F.ceil(F.col("_f") * GRID + reach)).alias("c"),
        (F.get("_q", F.lit(GRID)) - F.get("_q", F.lit(0))).alias("_spread"),
    )
    # the outer trials miss the drawn slopes by a little, so that rows tied at a drawn slope aren't tied at the ends of a bracket
    aside = F.greatest((F.col("c") - F.col("a")) * 1e-7, F.abs("b") * 1e-13, F.col("_spread") * 1e-13)
    near = F.greatest(F.abs("b") * 1e-13, F.col("_spread") * 1e-13)
    halves = F.when((F.coalesce(F.col("_m"), F.lit(0)) < 20) & (F.col("lo") > -math.inf) & (F.col("hi") < math.inf), F.col("lo") + (F.col("hi") - F.col("lo")) / 2)
    tried = F.array(F.col("a") - aside, F.col("b") - near, F.col("b"), F.col("b") + near, F.col("c") + aside, halves)
    return found.select(*keys, "lo", "hi", F.explode(tried).alias("_s")).where("_s > lo AND _s < hi").select(*keys, "_s").distinct()


def _counts(points: DataFrame, trials: DataFrame, keys: list[str]) -> DataFrame:
    """Per trial the number of slopes below it (``_under``) and of those not above it (``_upto``)."""
    at = [*keys, "_s"]
    rows = join_on(points, trials, keys).select(*at, "_t", _residual(F.col("_s")).alias("_r"))
    signed = signed_pair_sums(rows, at, "_t", "_r", [("w", "w")])
    ties = [_ties(rows, at, c, name) for c, name in ((["_t"], "_tt"), (["_r"], "_rr"), (["_t", "_r"], "_tr"))]
    both = join_on(signed, ties[0], at)
    for other in ties[1:]:
        both = join_on(both, other.drop("_n"), at)
    equal = F.col("_rr") - F.col("_tr")
    under = (F.col("_n") * (F.col("_n") - 1) / 2 - F.col("_tt") - equal - F.col("p0")) / 2
    return both.select(*at, under.alias("_under"), (under + equal).alias("_upto"))


def _narrowed(targets: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Brackets closed to the trials next to each sought rank; a trial that holds the rank is the answer."""
    per = counts.groupBy(*keys).agg(F.collect_list(F.struct("_s", "_under", "_upto")).alias("_trials"))  # at most six a bracket, two brackets a group
    k = F.col("_k")
    lows = F.filter("_trials", lambda c: (c["_upto"] <= k) & (c["_s"] > F.col("lo")))
    highs = F.filter("_trials", lambda c: (c["_under"] > k) & (c["_s"] < F.col("hi")))
    hits = F.filter("_trials", lambda c: (c["_under"] <= k) & (c["_upto"] > k))
    out = join_on(targets, per, keys, "left").select(
        *keys, "_n", "_k", "lo", "hi", "below", "upto", "answer", F.array_max(lows).alias("_l"), F.array_min(highs).alias("_h"), F.get(hits, F.lit(0))["_s"].alias("_hit")
    )
    out = out.select(
        *keys, "_n", "_k", F.coalesce("_l._s", "lo").alias("lo"), F.coalesce("_h._s", "hi").alias("hi"),
        F.coalesce("_l._upto", "below").alias("below"), F.coalesce("_h._under", "upto").alias("upto"), F.coalesce("answer", "_hit").alias("answer"),
    )
    lo, hi = F.col("lo"), F.col("hi")
    one = (lo > -math.inf) & (hi < math.inf) & (hi - lo <= F.greatest(F.abs(lo), F.abs(hi)) * CLOSE)
    return out.withColumn("answer", F.coalesce("answer", F.when(one, lo + (hi - lo) / 2)))


def _listed_between(points: DataFrame, left: DataFrame, keys: list[str]) -> DataFrame:
    """The sought slopes among those strictly inside their brackets, by an overlap join of rank intervals."""
    at = [*keys, "lo", "hi"]
    rows = join_on(points, left.select(*at).distinct(), keys)
    rows = staged(rows.withColumn("_u", _residual(F.col("lo"))).withColumn("_v", _residual(F.col("hi"))), "ends")
    rows = row_position(rows, at, ["_u", "_v", "_pos"], out="_a")
    rows = row_position(rows, at, ["_v", "_u", "_pos"], out="_b")
    rows = rows.withColumn("_from", F.least("_a", "_b")).withColumn("_first", F.floor(F.col("_from") / BLOCK))
    rows = staged(rows.select(*at, "_t", "_x", "_pos", "_a", "_b", "_from", "_first"), "intervals")
    cover = rows.withColumn("_first", F.explode(F.sequence(F.col("_first"), F.floor(F.greatest("_a", "_b") / BLOCK))))
    other = cover.select(*at, "_first", *[F.col(c).alias(f"{c}2") for c in ("_t", "_x", "_pos", "_a", "_b", "_from")])
    met = join_on(rows, other, [*at, "_first"]).where(
        (F.struct("_from2", "_pos2") < F.struct("_from", "_pos")) & ((F.col("_a") - F.col("_a2")) * (F.col("_b") - F.col("_b2")) < 0)
    )
    slopes = met.select(*at, F.try_divide(F.col("_x2") - F.col("_x"), F.col("_t2") - F.col("_t")).alias("_slope"))
    ranks = value_ranks(staged(slopes, "slopes"), at, "_slope")
    place = F.col("_k") - F.col("below")
    return join_on(ranks, left, at).where((F.col("n_below") <= place) & (place < F.col("n_below") + F.col("n_eq"))).select(*keys, "_slope")
