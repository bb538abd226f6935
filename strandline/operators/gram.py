"""Sufficient statistics: cross-product sums, the one shuffle behind most matrix analytics.

``gram`` is for vectors (tens to hundreds of variables): each task keeps one
variables-by-variables sum over its Arrow batches, and only those sums are shuffled.
``moments`` is for a handful of columns and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def vectors(long: DataFrame, t: Sequence[str], var: str, x: str, names: Sequence) -> DataFrame:
    """Long table -> one array per observation, in the order of ``names``; incomplete rows drop."""
    order = {n: i for i, n in enumerate(names)}
    cells = long.where(F.col(x).isNotNull() & F.col(var).isin(list(names)))
    at = F.col(var)
    if list(names) != list(range(len(names))):
        at = F.try_element_at(F.create_map(*[F.lit(v) for kv in order.items() for v in kv]), F.col(var))
    packed = cells.groupBy(*t).agg(F.sort_array(F.collect_list(F.struct(at.alias("i"), F.col(x).cast("double").alias("v")))).alias("_c"))
    whole = F.transform("_c", lambda c: c["i"]) == F.array(*[F.lit(i) for i in range(len(names))])  # each variable once
    return packed.where(whole).select(*t, F.transform("_c", lambda c: c["v"]).alias("vec"))


def gram(df: DataFrame, vec: str, by: Sequence[str] = (), weight=None) -> DataFrame:
    """Sums of products ``(by, i, j, s)`` for i <= j; index 0 is a constant one.

    So ``(0, 0)`` is the row count, ``(0, j)`` the sum of variable j (numbered from 1).
    """
    by = list(by)
    fields = [df.schema[b] for b in by]
    out = T.StructType([*fields, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType())])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def flush():
            for key, g in sums.items():
                i, j = np.triu_indices(len(g))
                yield pd.DataFrame({**dict(zip(by, key)), "i": i.astype("int32"), "j": j.astype("int32"), "s": g[i, j]})

        for pdf in batches:
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = np.stack(part[vec].to_numpy()).astype(float)
                x = np.hstack([np.ones((len(x), 1)), x])
                g = x.T @ (x if weight is None else x * weight(x[:, 1:])[:, None])
                sums[key] = sums[key] + g if key in sums else g
            if len(sums) > 256:  # bounded memory when a task meets many groups
                yield from flush()
                sums.clear()
        yield from flush()

    sums = df.select(*by, vec).mapInPandas(partial, out)
    return sums.groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))


def covariances(g: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, i, j, n, cov, vi, vj)`` for i <= j from a Gram table; variables from 0, ddof 0.

    The parts joined are the first row and the diagonal, one row per variable.
    """
    by = list(by)
    n = g.where("i = 0 AND j = 0").select(*by, F.col("s").alias("n"))
    mean = g.where("i = 0 AND j > 0").select(*by, F.col("j").alias("k"), F.col("s").alias("m"))
    diag = g.where("i > 0 AND i = j").select(*by, F.col("i").alias("k"), F.col("s").alias("q"))
    one = mean.join(diag, [*by, "k"])
    cells = g.where("i > 0")
    left = one.select(*by, F.col("k").alias("i"), F.col("m").alias("_mi"), F.col("q").alias("_qi"))
    right = one.select(*by, F.col("k").alias("j"), F.col("m").alias("_mj"), F.col("q").alias("_qj"))
    full = cells.join(left, [*by, "i"]).join(right, [*by, "j"])
    full = full.join(n, by) if by else full.crossJoin(F.broadcast(n))  # a single row
    mi, mj = F.col("_mi") / F.col("n"), F.col("_mj") / F.col("n")
    return full.select(
        *by, (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.col("n").cast("long").alias("n"),
        (F.col("s") / F.col("n") - mi * mj).alias("cov"),
        F.greatest(F.col("_qi") / F.col("n") - mi * mi, F.lit(0.0)).alias("vi"),
        F.greatest(F.col("_qj") / F.col("n") - mj * mj, F.lit(0.0)).alias("vj"),
    )


def correlations(g: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, i, j, n, r)`` for i <= j; a flat variable has 0 with everything else and 1 with itself."""
    c = covariances(g, by)
    r = F.coalesce(F.try_divide(F.col("cov"), F.sqrt(F.col("vi") * F.col("vj"))), F.lit(0.0))
    return c.select(*by, "i", "j", "n", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(r).alias("r"))


def per_matrix(cells: DataFrame, by: Sequence[str], value: str, fn, schema: str) -> DataFrame:
    """Apply ``fn(matrix, n, key) -> frame`` to each symmetric matrix held as upper-triangle rows.

    A group is one matrix: its size is set by the number of variables, not by the data.
    """
    by = list(by)
    keyed = cells if by else cells.withColumn("_all", F.lit(0))
    keys = by or ["_all"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["j"].max()) + 1
        m = np.zeros((size, size))
        i, j, v = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf[value].to_numpy(dtype=float)
        m[i, j] = v
        m[j, i] = v
        out = fn(m, float(pdf["n"].iloc[0]), key)
        for name, k in zip(by, key):
            out[name] = k
        return out

    prefix = "".join(f"{b} {cells.schema[b].dataType.simpleString()}, " for b in by)
    return keyed.groupBy(*keys).applyInPandas(run, prefix + schema)


def upper(m: np.ndarray, name: str) -> pd.DataFrame:
    i, j = np.triu_indices(len(m))
    return pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), name: m[i, j]})


def moments(cols: Sequence[Column | str], where: Column | None = None) -> Column:
    """Flat Gram of ``[1, cols...]`` as one aggregate expression (row major, full square)."""
    cs = [F.lit(1.0)] + [F.col(c).cast("double") if isinstance(c, str) else c for c in cols]
    complete = F.lit(True) if where is None else where
    for c in cs[1:]:
        complete = complete & c.isNotNull()
    cell = lambda a, b: F.coalesce(F.sum(F.when(complete, a * b)), F.lit(0.0))
    upper_cells = {(a, b): cell(cs[a], cs[b]) for a in range(len(cs)) for b in range(a, len(cs))}
    return F.array(*[upper_cells[min(a, b), max(a, b)] for a in range(len(cs)) for b in range(len(cs))])


def add_arrays(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda u, v: u + v * sign)


def ols_from_gram(g: np.ndarray, xs: Sequence[int], y: int) -> tuple[np.ndarray, float, float]:
    """Least squares on a Gram of [1, ...]: coefficients (intercept first), R2, residual sum of squares."""
    use = [0, *xs]
    n, mean = g[0, 0], g[0] / max(g[0, 0], 1.0)
    c = g - n * np.outer(mean, mean)  # centred sums: better conditioned than raw ones
    slope = np.linalg.pinv(c[np.ix_(use[1:], use[1:])], rcond=1e-12) @ c[use[1:], y] if len(use) > 1 else np.zeros(0)
    rss = float(c[y, y] - slope @ c[use[1:], y]) if len(use) > 1 else float(c[y, y])
    beta = np.r_[mean[y] - slope @ mean[use[1:]], slope] if len(use) > 1 else np.array([mean[y]])
    return beta, (1 - rss / c[y, y] if c[y, y] > 0 else np.nan), rss


@pandas_udf(T.StructType([T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("r2", T.DoubleType()), T.StructField("rss", T.DoubleType()), T.StructField("n", T.LongType())]))
def solve_ols(g: pd.Series) -> pd.DataFrame:
    """Regression of the last column on the others from a flat Gram."""
    rows = []
    for flat in g:
        k = int(round(len(flat) ** 0.5))
        m = np.asarray(flat, dtype=float).reshape(k, k)
        if m[0, 0] < k - 1:
            rows.append((None, None, None, int(m[0, 0])))
            continue
        beta, r2, rss = ols_from_gram(m, range(1, k - 1), k - 1)
        rows.append((beta.tolist(), None if np.isnan(r2) else r2, rss, int(m[0, 0])))
    return pd.DataFrame(rows, columns=["beta", "r2", "rss", "n"])
