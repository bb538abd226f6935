"""Set operations, sorts and top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_labelled(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Union of frames by column name, each with its label."""
    return reduce(DataFrame.unionByName, [df.withColumn(label, F.lit(name)) for name, df in parts.items()])


def undirected_edges(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs, loops dropped."""
    return edges.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).where(F.col(a) != F.col(b)).distinct()


def ids_in_all(frames: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(DataFrame.intersect, [f.select(key) for f in frames])


def left_to_do(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return jobs.select(*keys).exceptAll(done.select(*keys))


def role_table(groups: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per id with its role; the first role named wins when an id has several."""
    ranked = union_labelled({f"{i:03d}|{n}": df.select(key) for i, (n, df) in enumerate(groups.items())}, "_r")
    return ranked.groupBy(key).agg(F.substring_index(F.min("_r"), "|", -1).alias("role"))


def top_n_abs(df: DataFrame, x: str, n: int, ties: Sequence[str]) -> DataFrame:
    """n rows with the largest absolute value: a top-k, no full sort."""
    return df.where(F.col(x).isNotNull()).orderBy(F.abs(x).desc(), *ties).limit(n)


def top_per_group(df: DataFrame, by: Sequence[str], score: Column, ties: Sequence[str]) -> DataFrame:
    """Row with the largest score per group, first by ``ties``: an aggregate with partial results."""
    others = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct((-score).alias("s"), *ties)).alias("_b")).select(*by, "_b.*")


def known_value(df: DataFrame, by: Sequence[str], x: str, order: Sequence[str], which: str = "last") -> DataFrame:
    """Last or first non-null value per group."""
    pick = F.max_by if which == "last" else F.min_by
    return df.where(F.col(x).isNotNull()).groupBy(*by).agg(pick(F.col(x), F.struct(*order)).alias(x))


def hashed_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows in hash order: the same rows on any layout."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *key)).orderBy("_h", *key).limit(n).drop("_h")


def first_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, salts: int = 32) -> DataFrame:
    """First n rows per group in two steps: n per (group, salt), then n of those.

    No task sorts a whole hot group; the second step sees at most salts * n rows per group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = salted.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("_k") <= n)
    return first.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= n).withColumn("place", F.col("_k").cast("long")).drop("_k", "_salt")
