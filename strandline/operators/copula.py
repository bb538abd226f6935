"""Copula fits on parameter grids and correlation decay with distance.

The likelihood of every grid value is a sum over rows; the grid is a literal array, so a
fit is one pass and one small aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.linalg import spectrum, with_unit_diagonal
from strandline.functions.normal import norm_ppf, normal_quantile
from strandline.operators.gram import per_matrix
from strandline.operators.joins import cross_params
from strandline.operators.ordering import value_ranks


def pseudo_pair(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Average ranks over n + 1 of both columns: ``u, v``."""
    keys = list(keys)
    out = df.select(*keys, x, y)
    for c, name in ((x, "u"), (y, "v")):
        ranks = value_ranks(out, keys, c)
        u = (F.col("n_below") + (F.col("n_eq") + 1) / 2) / (F.col("n_all") + 1)
        table = ranks.select(*keys, c, u.alias(name))
        out = out.join(table, [*keys, c])
    return out.select(*keys, "u", "v")


def gumbel_logdensity(u: Column, v: Column, theta: Column) -> Column:
    a, b = -F.log(u), -F.log(v)
    log_s = F.log(F.pow(a, theta) + F.pow(b, theta))
    big_a = F.exp(log_s / theta)
    return a + b - big_a + F.log(big_a + theta - 1) + (theta - 1) * F.log(a * b) + (F.lit(1.0) / theta - 2) * log_s


def gaussian_logdensity(x: Column, y: Column, rho: Column) -> Column:
    r2 = rho * rho
    return -F.log(F.lit(1.0) - r2) / 2 - (r2 * (x * x + y * y) - rho * x * y * 2) / ((F.lit(1.0) - r2) * 2)


def _grid_fit(df: DataFrame, keys: Sequence[str], grid: Sequence[float], density, name: str) -> DataFrame:
    keys = list(keys)
    long = cross_params(df, **{name: [float(g) for g in grid]})
    ll = long.groupBy(*keys, name).agg(F.sum(density(F.col(name))).alias("loglik"), F.count(F.lit(1)).alias("n"))
    best = ll.groupBy(*keys).agg(F.max_by(F.struct(name, "loglik", "n"), F.struct(F.round("loglik", 6), -F.col(name))).alias("_b"))
    return best.select(*keys, f"_b.{name}", "_b.loglik", "_b.n", (F.lit(2.0) - F.col("_b.loglik") * 2).alias("aic"))


def gumbel_grid_fit(df: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """Best theta per key from pseudo-observations ``u, v``, AIC and upper tail dependence."""
    fit = _grid_fit(df, keys, grid, lambda th: gumbel_logdensity(F.col("u"), F.col("v"), th), "theta")
    return fit.withColumn("tail", F.lit(2.0) - F.pow(F.lit(2.0), F.lit(1.0) / F.col("theta")))


def gaussian_copula_fit(df: DataFrame, keys: Sequence[str], grid: Sequence[float]) -> DataFrame:
    scored = df.withColumn("_x", normal_quantile("u")).withColumn("_y", normal_quantile("v"))
    return _grid_fit(scored, keys, grid, lambda rho: gaussian_logdensity(F.col("_x"), F.col("_y"), rho), "rho")


def student_quantile(u: np.ndarray, nu: float) -> np.ndarray:
    """Student-t quantile by inverting the integrated density on a stretched grid."""
    s = np.linspace(0.0, math.asinh(1e6), 40001)
    x = np.sinh(s)
    log_c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
    f = np.exp(log_c - (nu + 1) / 2 * np.log1p(x * x / nu)) * np.cosh(s)
    half = np.concatenate([[0.0], np.cumsum((f[1:] + f[:-1]) / 2) * (s[1] - s[0])])
    p = np.abs(np.asarray(u, dtype=float) - 0.5)
    return np.sign(u - 0.5) * np.sinh(np.interp(p, half, s))


def t_copula_grid_fit(vec: DataFrame, col: str, kendall_r: DataFrame, nus: Sequence[float]) -> DataFrame:
    """Log-likelihood of a t copula (and of the Gaussian one, ``nu`` null) per degrees of freedom.

    ``vec`` holds pseudo-observations; ``kendall_r`` the pair correlations ``i, j, n, r``.
    The inverse matrix travels as one row; tasks return one sum per grid value.
    """

    def inverse(m, n, key):
        np.fill_diagonal(m, 1.0)
        values, vecs = spectrum(m)
        if values.min() < 1e-6:
            m = with_unit_diagonal((vecs * np.maximum(values, 1e-6)) @ vecs.T)
        return pd.DataFrame([{"inverse": np.linalg.inv(m).ravel().tolist(), "logdet": float(np.linalg.slogdet(m)[1])}])

    shape = per_matrix(kendall_r, [], "r", inverse, "inverse array<double>, logdet double")
    joined = vec.select(col).crossJoin(F.broadcast(shape))  # one row of variables squared

    def loglik(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            u = np.stack(pdf[col].to_numpy()).astype(float)
            d = u.shape[1]
            inv, logdet = np.asarray(pdf["inverse"].iloc[0]).reshape(d, d), pdf["logdet"].iloc[0]
            z = norm_ppf(u)
            rows = [(None, float((-(np.einsum("ti,ij,tj->t", z, inv, z) - (z * z).sum(1)) / 2 - logdet / 2).sum()))]
            for nu in nus:
                x = student_quantile(u, nu)
                q = np.einsum("ti,ij,tj->t", x, inv, x)
                const = math.lgamma((nu + d) / 2) + (d - 1) * math.lgamma(nu / 2) - d * math.lgamma((nu + 1) / 2) - logdet / 2
                terms = const - (nu + d) / 2 * np.log1p(q / nu) + (nu + 1) / 2 * np.log1p(x * x / nu).sum(1)
                rows.append((float(nu), float(terms.sum())))
            yield pd.DataFrame(rows, columns=["nu", "loglik"])

    return joined.mapInPandas(loglik, "nu double, loglik double").groupBy("nu").agg(F.sum("loglik").alias("loglik"))


def distance_decay(pairs: DataFrame, by: Sequence[str], d: str, r: str, lengths: Sequence[float], powers: Sequence[float]) -> DataFrame:
    """Least-squares fit of exp(-(d/L)^p) on a grid; ties go to the smaller L, then p."""
    by = list(by)
    grid = cross_params(pairs, L=[float(v) for v in lengths], p=[float(v) for v in powers])
    gap = F.col(r) - F.exp(-F.pow(F.col(d) / F.col("L"), F.col("p")))
    sse = grid.groupBy(*by, "L", "p").agg(F.sum(gap * gap).alias("sse"), F.count(F.lit(1)).alias("n_pairs"))
    best = sse.groupBy(*by).agg(F.min(F.struct(F.round("sse", 9).alias("sse"), "L", "p", "n_pairs")).alias("_b"))
    return best.where("_b IS NOT NULL").select(*by, "_b.*")
