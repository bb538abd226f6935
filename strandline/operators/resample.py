"""Resampling with hash-seeded draws: the same rows come back on any cluster layout.

A draw is a function of (seed, draw, position), never of a partition or a task.  Series
resampled by position have one row per period; clusters are resampled in ``statistics``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators.ordering import exact_quantiles, join_on


def hash_int(bound: Column, *parts) -> Column:
    """Whole number in 0..bound-1 from a hash of the parts."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), bound)


def hash_uniform(*parts) -> Column:
    return hash_int(F.lit(1 << 30), *parts) / float(1 << 30)


def _numbered(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    w = C.by_time(keys, t)
    return df.withColumn("_src", F.row_number().over(w) - 1).withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _draws(pos: DataFrame, keys: Sequence[str], draws: int) -> DataFrame:
    sizes = pos.groupBy(*keys).agg(F.max("_len").cast("long").alias("_len"))
    return sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def block_resample(df: DataFrame, keys: Sequence[str], t: str, draws: int, block: int, seed: int = 0) -> DataFrame:
    """Rows resampled in contiguous blocks: adds ``draw`` and ``slot`` (place in the draw)."""
    keys = list(keys)
    pos = _numbered(df, keys, t)
    plan = _draws(pos, keys, draws).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_len") - 1) / block))))
    start = hash_int(F.greatest(F.col("_len") - block + 1, F.lit(1)), seed, F.col("draw"), F.col("_b"))
    plan = plan.withColumn("_start", start).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    plan = plan.withColumn("slot", F.col("_b") * block + F.col("_o")).where(F.col("slot") < F.col("_len"))
    return plan.select(*keys, "draw", "slot", (F.col("_start") + F.col("_o")).alias("_src")).join(pos.drop("_len"), [*keys, "_src"]).drop("_src")


def stationary_resample(df: DataFrame, keys: Sequence[str], t: str, draws: int, mean_block: float, seed: int = 0) -> DataFrame:
    """Blocks of geometric length that wrap round the end of the series."""
    keys = list(keys)
    pos = _numbered(df, keys, t)
    plan = _draws(pos, keys, draws).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_len") - 1)))
    fresh = (F.col("slot") == 0) | (hash_uniform(seed, F.col("draw"), F.col("slot"), F.lit("new")) < 1.0 / mean_block)
    start = F.when(fresh, F.struct(F.col("slot").alias("k0"), hash_int(F.col("_len"), seed, F.col("draw"), F.col("slot"), F.lit("at")).alias("s")))
    w = Window.partitionBy(*keys, "draw").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    plan = plan.withColumn("_st", F.last(start, ignorenulls=True).over(w))
    src = F.pmod(F.col("_st.s") + F.col("slot") - F.col("_st.k0"), F.col("_len"))
    return plan.select(*keys, "draw", "slot", src.alias("_src")).join(pos.drop("_len"), [*keys, "_src"]).drop("_src")


def block_ci(
    df: DataFrame, keys: Sequence[str], t: str, x: str, flag: Column, draws: int, mean_block: float = 6, seed: int = 0, statistic=None
) -> DataFrame:
    """5-95% interval of the mean of flagged rows under stationary resampling.

    With a ``statistic`` (``statistics.Sums`` or ``Quantile``) it is that of the flagged rows, in the column ``value``.
    """
    keys = list(keys)
    boot = stationary_resample(df.withColumn("_f", flag), keys, t, draws, mean_block, seed)
    sizes = df.groupBy(*keys).agg(F.avg(F.when(flag, F.col(x))).alias("mean"), F.count(F.when(flag, 1)).alias("n"))
    if statistic is None:
        name, point, boot = "mean", sizes, boot.groupBy(*keys, "draw").agg(F.avg(F.when(F.col("_f"), F.col(x))).alias("mean"))
    else:
        name, boot = "value", statistic.evaluate(boot.where("_f"), [*keys, "draw"])
        point = join_on(sizes.drop("mean"), statistic.evaluate(df.where(flag), keys), keys, "left")
    q = exact_quantiles(boot.where(f"{name} IS NOT NULL"), keys, name, [0.05, 0.95])
    band = q.groupBy(*keys).agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    return point.join(band, keys, "left") if keys else point.crossJoin(F.broadcast(band))


def permutation_p(df: DataFrame, t: str, x: str, flag: Column, draws: int, block: int = 12, seed: int = 0, statistic=None) -> DataFrame:
    """Share of block-shuffled series whose flagged mean (or ``statistic`` of ``x``) reaches the observed one.

    Flags stay in place and values move in blocks, so their own rhythm survives.
    """
    base = df.withColumn("_f", flag)
    moved = block_resample(base, [], t, draws, block, seed).select("draw", "slot", F.col(x).alias("_moved"))
    flags = _numbered(base, [], t).where("_f").select(F.col("_src").cast("long").alias("slot"))
    met = moved.join(flags, "slot")
    if statistic is None:
        null = met.groupBy("draw").agg(F.avg("_moved").alias("_null"))
        seen = base.agg(F.avg(F.when(F.col("_f"), F.col(x))).alias("observed"))
    else:
        null = statistic.evaluate(met.select("draw", F.col("_moved").alias(x)), ["draw"]).select("draw", F.col("value").alias("_null"))
        seen = statistic.evaluate(base.where("_f"), []).select(F.col("value").alias("observed"))
    both = null.crossJoin(F.broadcast(seen))  # a single row
    return both.groupBy("observed").agg(F.avg(F.when(F.col("_null") >= F.col("observed"), 1.0).otherwise(0.0)).alias("p_value"), F.avg("_null").alias("null_mean"), F.count(F.lit(1)).alias("draws"))


def mean_bootstrap(df: DataFrame, t: str, x: str, flag: Column, draws: int, seed: int = 0) -> DataFrame:
    """p-value of the flagged mean against means of as many rows drawn from all rows."""
    base = _numbered(df.withColumn("_f", flag), [], t)
    n = base.agg(F.count(F.when(F.col("_f"), 1)).alias("_n"), F.max("_len").alias("_all"), F.avg(F.when(F.col("_f"), F.col(x))).alias("observed"))
    plan = n.where("_n > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    plan = plan.withColumn("_src", hash_int(F.col("_all"), seed, F.col("draw"), F.col("k")))
    null = plan.join(base.select("_src", x), "_src").groupBy("draw", "observed").agg(F.avg(x).alias("_null"))
    return null.groupBy("observed").agg(F.avg(F.when(F.col("_null") >= F.col("observed"), 1.0).otherwise(0.0)).alias("p_value"), F.count(F.lit(1)).alias("draws"))


def shuffle_within_months(df: DataFrame, site: str, d: str, x: str, draws: int, seed: int = 0) -> DataFrame:
    """Each site's days permuted among days of the same calendar month, per draw.

    A permutation pairs the order by date with the order by hash inside (site, month).
    """
    month = F.month(d)
    keys = [site, "_m"]
    base = df.select(site, d, x, month.alias("_m"))
    slots = base.select(*keys, d, F.row_number().over(Window.partitionBy(*keys).orderBy(d)).alias("_i"))
    many = base.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    place = F.row_number().over(Window.partitionBy("draw", *keys).orderBy(F.xxhash64(F.lit(seed), F.col("draw"), F.col(site), F.col(d)), d))
    values = many.select("draw", *keys, place.alias("_i"), x)
    return values.join(slots, [*keys, "_i"]).select("draw", site, d, x)


def independent_years(df: DataFrame, site: str, d: str, x: str, draws: int, seed: int = 0) -> DataFrame:
    """Each site draws its own year; monthly totals over sites per draw."""
    monthly = df.groupBy(site, F.year(d).alias("_y"), F.month(d).alias("month")).agg(F.sum(x).alias("_v"))
    years = monthly.select("_y").distinct().agg(F.array_sort(F.collect_set("_y")).alias("_years"))  # one row of years
    sites = monthly.select(site).distinct().crossJoin(F.broadcast(years)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = F.get("_years", hash_int(F.size("_years"), seed, F.col("draw"), F.col(site)).cast("int"))
    return sites.select(site, "draw", pick.alias("_y")).join(monthly, [site, "_y"]).groupBy("draw", "month").agg(F.sum("_v").alias("total"), F.count(F.lit(1)).alias("sites"))


def error_overlay(base: DataFrame, errors: DataFrame, site: str, d: str, x: str, err: str, draws: int, half: int = 30, seed: int = 0) -> DataFrame:
    """Add to each base day the errors of one past day of the same season (same pick for all sites).

    A base day looks up an error day by a hash pick among the days within ``half`` of its
    day of the year.  Days are numbered per day of year first, so a pick is an equi-join.
    """
    doy = lambda c: F.pmod(F.dayofyear(c) - 1, F.lit(365))
    days = errors.select(F.col(d).alias("_ed")).distinct().withColumn("_doy", doy("_ed"))
    near = days.withColumn("_o", F.explode(F.sequence(F.lit(-half), F.lit(half)))).select(F.pmod(F.col("_doy") + F.col("_o"), F.lit(365)).alias("_doy"), "_ed")
    place = F.row_number().over(Window.partitionBy("_doy").orderBy("_ed")) - 1
    near = near.select("_doy", "_ed", place.alias("_i"), F.count(F.lit(1)).over(Window.partitionBy("_doy")).alias("_n"))
    size = near.select("_doy", "_n").distinct()
    targets = base.select(d).distinct().withColumn("_doy", doy(d)).join(size, "_doy").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = targets.withColumn("_i", hash_int(F.col("_n"), seed, F.col("draw"), F.unix_date(d)).cast("int")).join(near.select("_doy", "_i", "_ed"), ["_doy", "_i"])
    e = errors.select(F.col(site), F.col(d).alias("_ed"), F.col(err))
    return picked.select("draw", d, "_ed").join(base, d).join(e, [site, "_ed"]).select("draw", site, d, (F.col(x) + F.col(err)).alias(x))
