"""Statistics that can be merged, and their intervals under hashed Poisson weights.

A statistic is evaluated per group (``evaluate``) or per group and bootstrap draw (``drawn``).  In a draw each unit (a row, a cluster, a block
of periods) counts 0, 1, 2, ... times, a Poisson(1) number that is a hash of (seed, draw, unit): no unit is numbered, nothing is joined to a
plan of draws, and the result doesn't depend on the layout.  Partial states merge before the shuffle, which carries one row per task, group and draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordering import exact_quantiles, join_on, locate, planned_edges
from strandline.operators.resample import hash_uniform
from strandline.storage import staged

RANGE = 4096
_POISSON = list(accumulate(math.exp(-1) / math.factorial(k) for k in range(13)))


def poisson_weight(*parts) -> Column:
    """Poisson(1) number from a hash of the parts."""
    u = hash_uniform(*parts)
    return sum((F.when(u >= c, 1).otherwise(0) for c in _POISSON), F.lit(0))


def _draws(df: DataFrame, unit: Sequence[str], draws: int, seed: int) -> DataFrame:
    out = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return out.withColumn("_w", poisson_weight(F.lit(seed), F.col("draw"), *[F.col(u) for u in unit])).where("_w > 0")


@dataclass(frozen=True)
class Sums:
    """A function of sums over rows: ``parts`` are the summed columns, ``finish`` makes the value from their totals."""

    parts: Sequence[Column]
    finish: Callable[..., Column]

    def _value(self, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
        return totals.select(*keys, self.finish(*[F.col(f"_p{i}") for i in range(len(self.parts))]).alias("value"))

    def _totals(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(p).alias(f"_p{i}") for i, p in enumerate(self.parts)])

    def evaluate(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return self._value(self._totals(df, keys), keys)

    def drawn(self, df: DataFrame, keys: Sequence[str], unit: Sequence[str], draws: int, seed: int) -> DataFrame:
        each = _draws(self._totals(df, list(dict.fromkeys([*keys, *unit]))), unit, draws, seed)
        sums = [F.sum(F.col(f"_p{i}") * F.col("_w")).alias(f"_p{i}") for i in range(len(self.parts))]
        return self._value(each.groupBy(*keys, "draw").agg(*sums), [*keys, "draw"])


@dataclass(frozen=True)
class Quantile:
    """Exact quantile with linear interpolation between the two rows next to it.

    Values lie in ranges of about 4,096 rows; those far from the quantile are taken together.  The weight of every range is known per draw
    first; only rows of the ranges that hold a sought rank of some draw are weighed one by one.
    """

    x: str
    q: float = 0.5

    def evaluate(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return exact_quantiles(df, keys, self.x, [self.q]).select(*keys, F.col(self.x).alias("value"))

    def drawn(self, df: DataFrame, keys: Sequence[str], unit: Sequence[str], draws: int, seed: int) -> DataFrame:
        keys, unit = list(keys), list(unit)
        cols = list(dict.fromkeys([*keys, *unit]))
        rows = staged(df.where(F.col(self.x).isNotNull()).select(*cols, F.col(self.x).cast("double").alias("_v")), "values")
        ranged = staged(locate(rows, keys, "_v", "_range", planned_edges(rows, keys, "_v", rows=RANGE)), "ranged")
        ranged = self._bracketed(ranged, keys, unit)
        weighed = _draws(ranged.groupBy(*list(dict.fromkeys([*cols, "_range"]))).agg(F.count(F.lit(1)).alias("_c")), unit, draws, seed)
        per = weighed.groupBy(*keys, "draw", "_range").agg(F.sum(F.col("_c") * F.col("_w")).alias("_n"))
        whole = Window.partitionBy(*keys, "draw")  # one row per range
        below = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.withColumn("_below", below).withColumn("_h", (F.sum("_n").over(whole) - 1) * self.q)
        holds = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_n"))
        lower, upper = F.floor("_h"), F.ceil("_h")
        wanted = staged(per.where(holds(lower) | holds(upper)).select(*keys, "draw", "_range", "_below", "_h"), "wanted")
        near = join_on(ranged, wanted, [*keys, "_range"])
        near = near.withColumn("_w", poisson_weight(F.lit(seed), F.col("draw"), *[F.col(u) for u in unit])).where("_w > 0")
        near = near.groupBy(*keys, "draw", "_range", "_below", "_h", "_v").agg(F.sum("_w").alias("_n"))
        inside = Window.partitionBy(*keys, "draw", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        near = near.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        ends = near.groupBy(*keys, "draw").agg(
            F.max(F.when(holds(lower), F.col("_v"))).alias("_lo"), F.max(F.when(holds(upper), F.col("_v"))).alias("_hi"), F.max(F.col("_h") - F.floor("_h")).alias("_f")
        )
        return ends.select(*keys, "draw", (F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))).alias("value"))

    def _bracketed(self, ranged: DataFrame, keys: list[str], unit: list[str]) -> DataFrame:
        """Ranges on either side of where draws can be expected to fall become one each, so that a unit is weighed there once.

        A unit moves the sought rank of a draw by its rows at or below the quantile minus ``q`` times its rows, times a number of variance one.
        Eight standard deviations and a range's rows are kept on both sides; a draw outside would still be exact, as its one range is ordered as a whole.
        """
        per = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
        whole = Window.partitionBy(*keys)  # one row per range
        upto = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
        per = staged(per.withColumn("_upto", upto).withColumn("_h", F.sum("_n").over(whole) * self.q), "ranges")
        middle = staged(per.where(F.col("_upto") >= F.col("_h")).groupBy(*keys).agg(F.min("_range").alias("_at")), "middle")
        share = F.when(F.col("_range") <= F.col("_at"), 1 - self.q).otherwise(-self.q)
        moved = join_on(ranged, middle, keys).groupBy(*list(dict.fromkeys([*keys, *unit]))).agg(F.sum(share).alias("_d"))
        spread = moved.groupBy(*keys).agg((F.sqrt(F.sum(F.col("_d") * F.col("_d"))) * 8 + RANGE).alias("_reach"))
        kept = join_on(per, spread, keys).where((F.col("_upto") >= F.col("_h") - F.col("_reach")) & (F.col("_upto") - F.col("_n") <= F.col("_h") + F.col("_reach")))
        ends = staged(kept.groupBy(*keys).agg(F.min("_range").alias("_from"), F.max("_range").alias("_to")), "bracket")
        return join_on(ranged, ends, keys).withColumn("_range", F.greatest(F.col("_from") - 1, F.least(F.col("_to") + 1, F.col("_range")))).drop("_from", "_to")


def mean(x: str) -> Sums:
    return Sums([F.col(x), F.when(F.col(x).isNotNull(), 1)], lambda s, n: F.try_divide(s, n))


def median(x: str) -> Quantile:
    return Quantile(x)


def correlation(x: str, y: str) -> Sums:
    """Pearson correlation over rows that have both; centre columns with a mean far above their spread first."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))

    def finish(n, sa, sb, aa, bb, ab):
        spread = F.greatest(n * aa - sa * sa, F.lit(0.0)) * F.greatest(n * bb - sb * sb, F.lit(0.0))
        return F.when(spread > 0, (n * ab - sa * sb) / F.sqrt(spread))

    return Sums([F.when(both, 1.0), a, b, a * a, b * b, a * b], finish)


def interval(
    df: DataFrame, keys: Sequence[str], unit: Sequence[str], statistic: Sums | Quantile, draws: int, seed: int = 0, levels: tuple[float, float] = (0.05, 0.95)
) -> DataFrame:
    """Per group: the statistic (``value``), its ``lo`` and ``hi`` over draws of whole units, and the ``draws`` that gave a value.

    A block bootstrap takes the number of the block as unit.  A unit is the same in all groups of a draw, so groups move together.  Null keys and
    null units count as values; draws without a row of a group, or without a value, are left out; a group without a value has null bounds.
    """
    keys = list(keys)
    boot = staged(statistic.drawn(df, keys, unit, draws, seed).where("value IS NOT NULL"), "draws")
    at = exact_quantiles(boot, keys, "value", list(levels)).groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    band = join_on(at, boot.groupBy(*keys).agg(F.count(F.lit(1)).alias("draws")), keys)
    return join_on(statistic.evaluate(df, keys), band, keys, "left")
