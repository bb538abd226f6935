"""Data-quality checks on cube rows ``(ts, cell, variables)``.

``run_checks`` makes one scan: every count and extreme of every check is a conditional
aggregate of the same pass, and the time axis a small aggregate of distinct timestamps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The solar constant and the physically possible range of each variable.
SOLAR_CONSTANT = 1361.0
SECONDS_PER_HOUR = 3600.0
RANGES = {
    "2t": (200.0, 335.0),
    "tcc": (0.0, 1.0),
    "100u": (-100.0, 100.0),
    "100v": (-100.0, 100.0),
    "ssrd": (0.0, SOLAR_CONSTANT * SECONDS_PER_HOUR),
}


def check_time_axis(df: DataFrame, ts: str, step: int, by: Sequence[str] = ()) -> DataFrame:
    """Irregular steps between distinct timestamps (whole-number clock) of each series: count and first.

    Distinct timestamps are one row per series and period of the record.
    """
    by = list(by)
    t = df.select(*by, ts).distinct()
    gap = F.lead(ts).over(Window.partitionBy(*by).orderBy(ts)) - F.col(ts)
    return t.withColumn("_gap", gap).groupBy(*by).agg(
        F.count(F.lit(1)).alias("steps"), F.count(F.when(F.col("_gap") != step, 1)).alias("irregular"),
        F.min(F.when(F.col("_gap") != step, F.col(ts))).alias("first_after"),
    ).withColumn("ok", F.col("irregular") == 0)


def _long(df: DataFrame, name: str, cells: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """One aggregate row -> one row per variable."""
    rows = F.array(*[F.struct(F.lit(v).alias(name), *[c.alias(k) for k, c in parts.items()]) for v, parts in cells])
    return df.select(F.inline(rows))


def check_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    agg = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")), 1)).alias(f"m{i}") for i, c in enumerate(cols)])
    return _long(agg, "variable", [(c, {"missing": F.col(f"m{i}"), "ok": F.col(f"m{i}") == 0}) for i, c in enumerate(cols)])


def check_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    known = {c: r for c, r in ranges.items() if c in df.columns}
    agg = df.agg(*[f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(known) for n, f in (("lo", F.min), ("hi", F.max))])
    return _long(agg, "variable", [
        (c, {"lowest": F.col(f"lo{i}"), "highest": F.col(f"hi{i}"), "ok": ~((F.col(f"lo{i}") < lo) | (F.col(f"hi{i}") > hi))}) for i, (c, (lo, hi)) in enumerate(known.items())
    ])


def check_units(df: DataFrame, x: str, least: float = 10_000.0) -> DataFrame:
    """A peak far too low means a rate instead of an accumulation."""
    return df.agg(F.max(x).alias("peak")).withColumn("ok", F.col("peak") >= least)


def with_previous(df: DataFrame, ts: str, cell: Sequence[str], x: str) -> DataFrame:
    """Value of the step before at the same cell (its own at the first step).

    A window along one cell is bounded by the record length.
    """
    w = Window.partitionBy(*cell).orderBy(ts)
    return df.withColumn("_prev", F.coalesce(F.lag(x).over(w), F.col(x)))


def _bound(ins: str, tolerance: float, naive: bool) -> Column:
    strongest = F.col(ins) if naive else F.greatest(F.col(ins), F.col("_prev"))
    return strongest * SOLAR_CONSTANT * tolerance + 1.0


def check_upper_bound(df: DataFrame, ts: str, cell: Sequence[str], x: str, ins: str, tolerance: float = 1.02, naive: bool = False) -> DataFrame:
    """Rate above what the sun of this or the previous hour allows."""
    rate = F.col(x) / SECONDS_PER_HOUR
    over = rate > _bound(ins, tolerance, naive)
    out = with_previous(df, ts, cell, ins).agg(F.count(F.when(over, 1)).alias("over"), F.min(F.when(over, F.col(ts))).alias("first"))
    return out.withColumn("ok", F.col("over") == 0)


def check_zero_when_dark(df: DataFrame, ts: str, cell: Sequence[str], x: str, ins: str, threshold: float = 1.0) -> DataFrame:
    night = (F.col(ins) <= 0) & (F.col("_prev") <= 0)
    lit = night & (F.col(x) / SECONDS_PER_HOUR > threshold)
    out = with_previous(df, ts, cell, ins).agg(F.count(F.when(lit, 1)).alias("lit"), F.count(F.when(night, 1)).alias("night"))
    return out.withColumn("ok", F.col("lit") == 0)


def run_checks(df: DataFrame, ts: str, step: int, cell: Sequence[str], x: str, ins: str, ranges: dict[str, tuple[float, float]],
               checks: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None, skip: Sequence[str] = ()) -> DataFrame:
    """All checks as ``(check, ok, detail)`` from one pass over the rows.

    ``checks`` registers more by name: an aggregate over the rows (which carry the previous value of ``ins`` as ``_prev``) and the test that its
    value must pass.  It joins the same pass; one named like a built-in check takes its place.  ``skip`` names checks to leave out.
    """
    own = {n: c for n, c in (checks or {}).items() if n not in skip}
    cols = [c for c in df.columns if c not in (ts, *cell)]
    known = {c: r for c, r in ranges.items() if c in df.columns}
    rate = F.col(x) / SECONDS_PER_HOUR
    over = rate > _bound(ins, 1.02, False)
    night = (F.col(ins) <= 0) & (F.col("_prev") <= 0)
    lit = night & (rate > 1.0)
    outside = [(F.min(F.col(f"`{c}`")) < lo) | (F.max(F.col(f"`{c}`")) > hi) for c, (lo, hi) in known.items()]
    n_out = sum((F.when(o, 1).otherwise(0) for o in outside), F.lit(0))
    gone = sum((F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in cols), F.lit(0))
    one = with_previous(df, ts, cell, ins).agg(
        F.sum(gone).alias("missing"), n_out.alias("ranges"), F.max(x).alias("peak"), F.count(F.when(over, 1)).alias("over"), F.count(F.when(lit, 1)).alias("lit"),
        *[value.alias(f"_own{i}") for i, (value, _) in enumerate(own.values())],
    )
    axis = check_time_axis(df, ts, step).select("irregular")
    both = one.crossJoin(F.broadcast(axis))  # a single row
    name = lambda n, ok, value: (n, {"ok": ok, "detail": value.cast("long")})
    built_in = [
        name("time axis", F.col("irregular") == 0, F.col("irregular")), name("missing values", F.col("missing") == 0, F.col("missing")),
        name("physical ranges", F.col("ranges") == 0, F.col("ranges")), name("units", F.col("peak") >= 10_000, F.floor("peak")),
        name("upper bound", F.col("over") == 0, F.col("over")), name("dark at night", F.col("lit") == 0, F.col("lit")),
    ]
    added = [name(n, test(F.col(f"_own{i}")), F.col(f"_own{i}")) for i, (n, (_, test)) in enumerate(own.items())]
    return _long(both, "check", [c for c in built_in if c[0] not in own and c[0] not in skip] + added)
