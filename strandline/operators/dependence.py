"""Correlation, dependence and matrix analytics.

Every estimator goes through sums that shuffle once (Gram tables, rank tables, block
histograms).  No operator emits the pairs of a group: Kendall and distance correlation
count pairs by blocks, matrices are summed inside tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.functions import linalg as L
from strandline.functions.normal import normal_quantile
from strandline.operators import gram as G
from strandline.operators.ordering import cut, default_slices, join_on, quantile_columns, row_position, slice_values, sliced_lag, value_ranks
from strandline.operators.windows import autocorr, effective_n_pair
from strandline.storage import staged


# ---- correlation matrices -------------------------------------------------------------


def rank_scores(long: DataFrame, var: str, x: str, method: str, slices: int | None = None) -> DataFrame:
    """Replace values by average ranks or by normal scores, per variable."""
    if method == "pearson":
        return long
    ranks = value_ranks(long, [var], x, slices)
    rank = F.col("n_below") + (F.col("n_eq") + 1) / 2
    score = rank - (F.col("n_all") + 1) / 2 if method == "spearman" else normal_quantile((rank - 0.5) / F.col("n_all"))
    table = ranks.select(var, x, score.cast("double").alias("_score"))
    return long.join(table, [var, x]).withColumn(x, F.col("_score")).drop("_score")


def corr_pairs(long: DataFrame, t: str, var: str, x: str, names: Sequence, method: str = "pearson") -> DataFrame:
    """Correlation of every pair of variables i <= j: ``(i, j, n, r)``."""
    scored = rank_scores(long, var, x, method)
    return G.correlations(G.gram(G.vectors(scored, [t], var, x, names), "vec"))


def partial_corr(corr: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Partial correlations from a correlation table, one small matrix per task."""
    return G.per_matrix(corr, by, "r", lambda m, n, k: G.upper(L.partial_from(m), "r"), "i int, j int, r double")


# ---- pair counts without pairs -----------------------------------------------------------


def signed_pair_sums(
    df: DataFrame, keys: Sequence[str], x: str, y: str, products: Sequence[tuple[str, str]], slices: int | None = None
) -> DataFrame:
    """Per key, sums over row pairs with x1 < x2 of sign(y2 - y1) * u1 * v2, for each (u, v).

    u and v are among ``w`` (row count), ``wx``, ``wy``, ``wxy``.  Pairs split exactly into
    those of one x slice, those of one y slice but different x slices, and those of
    different slices both ways.  The last are counted by halving the x slices again and again: at each level the
    left halves' sums below and above a y slice meet the right halves' sums on it, so a window holds one row per y
    slice and no task holds the table of slice pairs.
    """
    keys = list(keys)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).cast("double").alias("w"))
    slices = slices or default_slices(df)
    rows = slice_values(slice_values(staged(rows, "pairs"), keys, x, "_bx", slices, True), keys, y, "_by", slices, True)
    rows = rows.withColumn("wx", F.col("w") * F.col(x)).withColumn("wy", F.col("w") * F.col(y)).withColumn("wxy", F.col("wx") * F.col(y))
    rows = staged(rows, "sliced")
    names = [f"p{i}" for i in range(len(products))]
    used = sorted({c for p in products for c in p})
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} double" for n in names])

    def counter(a: str, b: str, n_keys: int):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            sums = L.signed_products(pdf[a].to_numpy(), pdf[b].to_numpy(), [(pdf[u].to_numpy(), pdf[v].to_numpy()) for u, v in products])
            return pd.DataFrame([list(key[:n_keys]) + sums])

        return run

    same_x = rows.where("_bx % 2 = 0").select(*keys, "_bx", x, y, *used)
    same_y = rows.where("_by % 2 = 0").select(*keys, "_by", "_bx", y, *used)
    cells = rows.groupBy(*keys, "_bx", "_by").agg(*[F.sum(u).alias(u) for u in used])
    parts = [
        same_x.groupBy(*keys, "_bx").applyInPandas(counter(x, y, len(keys)), schema),
        same_y.groupBy(*keys, "_by").applyInPandas(counter("_bx", y, len(keys)), schema),
        _halved(cells, keys, products, names),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def _halved(cells: DataFrame, keys: list[str], products: Sequence[tuple[str, str]], names: list[str]) -> DataFrame:
    """Signed sums over pairs of cells that differ in both slices; a pair is met at the level where its x slices part."""
    bits = F.length(F.bin(F.col("_bx")))  # levels that a slice number takes part in; beyond, all are on the left
    top = cells.groupBy(*keys).agg(F.max(bits).alias("_top"))
    level = join_on(cells, top, keys).withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_top") - 1)))
    at = F.call_function("shiftright", F.col("_bx"), F.col("_level"))
    right = at % 2 == 1
    lefts, rights = sorted({u for u, _ in products}), sorted({v for _, v in products})
    sums = level.groupBy(*keys, "_level", F.floor(at / 2).alias("_node"), "_by").agg(
        *[F.sum(F.when(~right, F.col(u)).otherwise(0.0)).alias(f"l_{u}") for u in lefts], *[F.sum(F.when(right, F.col(v)).otherwise(0.0)).alias(f"r_{v}") for v in rights]
    )
    node = Window.partitionBy(*keys, "_level", "_node")
    below = node.orderBy("_by").rowsBetween(Window.unboundedPreceding, -1)
    signed = {u: F.coalesce(F.sum(f"l_{u}").over(below), F.lit(0.0)) * 2 + F.col(f"l_{u}") - F.sum(f"l_{u}").over(node) for u in lefts}
    met = sums.select(*keys, *[(signed[u] * F.col(f"r_{v}")).alias(n) for n, (u, v) in zip(names, products)])
    return met.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def _tied_pairs(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    c = df.groupBy(*keys, x).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    return c.groupBy(*keys).agg((F.sum(F.col("_c") * (F.col("_c") - 1)) / 2).alias(out), F.sum("_c").alias(f"{out}_n"))


def kendall(df: DataFrame, keys: Sequence[str], x: str, y: str, slices: int | None = None) -> DataFrame:
    """tau-b and the correlation it implies for elliptical data, per key; exact, O(n log n)."""
    keys = list(keys)
    both = staged(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y), "both")
    s = signed_pair_sums(both, keys, x, y, [("w", "w")], slices)
    full = join_on(join_on(s, _tied_pairs(both, keys, x, "_tx"), keys), _tied_pairs(both, keys, y, "_ty"), keys)
    n0 = F.col("_tx_n") * (F.col("_tx_n") - 1) / 2
    tau = F.try_divide(F.col("p0"), F.sqrt((n0 - F.col("_tx")) * (n0 - F.col("_ty"))))
    return full.select(*keys, F.col("_tx_n").cast("long").alias("n"), tau.alias("tau"), F.sin(tau * (np.pi / 2)).alias("r"))


def distance_corr(df: DataFrame, keys: Sequence[str], x: str, y: str, slices: int | None = None) -> DataFrame:
    """Distance correlation per key, exact, without the n x n distance table.

    Row sums of distances come from running counts and sums in value order; the sum of
    distance products is a signed pair sum.  Values are centred first for accuracy.
    """
    keys = list(keys)
    both = staged(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x0"), F.col(y).cast("double").alias("_y0")), "values")
    mean = both.groupBy(*keys).agg(F.avg("_x0").alias("_mx"), F.avg("_y0").alias("_my"))
    both = join_on(both, mean, keys).select(*keys, (F.col("_x0") - F.col("_mx")).alias("x"), (F.col("_y0") - F.col("_my")).alias("y"))
    both = staged(both, "both")
    d = signed_pair_sums(both, keys, "x", "y", [("w", "wxy"), ("wxy", "w"), ("wx", "wy"), ("wy", "wx")], slices)
    cross = d.select(*keys, ((F.col("p0") + F.col("p1") - F.col("p2") - F.col("p3")) * 2).alias("_d"))

    def row_sums(c: str, out: str) -> DataFrame:
        ranks = value_ranks(both, keys, c, slices, sums=True)
        v = F.col(c)
        above_n = F.col("n_all") - F.col("n_below") - F.col("n_eq")
        above_s = F.col("s_all") - F.col("s_below") - v * F.col("n_eq")
        return ranks.select(*keys, c, (v * F.col("n_below") - F.col("s_below") + above_s - v * above_n).alias(out))

    a = join_on(join_on(both, row_sums("x", "_a"), [*keys, "x"]), row_sums("y", "_b"), [*keys, "y"])
    stats = a.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"), F.sum(F.col("_a") * F.col("_b")).alias("_ab"),
        F.sum(F.col("_a") * F.col("_a")).alias("_aa"), F.sum(F.col("_b") * F.col("_b")).alias("_bb"), F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"),
    )
    stats = join_on(stats, cross, keys)
    n = F.col("_n")
    grand = lambda u, v: F.col(u) * F.col(v) / (n * n * n * n)
    rows = lambda c: F.col(c) * 2 / (n * n * n)
    cov = F.col("_d") / (n * n) + grand("_sa", "_sb") - rows("_ab")
    var_x = F.col("_vx") * 2 + grand("_sa", "_sa") - rows("_aa")
    var_y = F.col("_vy") * 2 + grand("_sb", "_sb") - rows("_bb")
    r = F.when((var_x > 0) & (var_y > 0), F.sqrt(F.greatest(cov, F.lit(0.0)) / F.sqrt(var_x * var_y))).otherwise(0.0)
    return stats.select(*keys, n.cast("long").alias("n"), r.alias("dcor"))


# ---- tails ------------------------------------------------------------------------------


def tail_dependence(df: DataFrame, keys: Sequence[str], x: str, y: str, qs: Sequence[float], side: str = "lower") -> DataFrame:
    """Share of x's tail rows that are in y's tail too (inclusive), for each q."""
    keys = list(keys)
    at = [q if side == "lower" else 1 - q for q in qs]
    cuts = {}
    for c in (x, y):
        cuts[c] = quantile_columns(df, keys, c, {f"_{c}{i}": a for i, a in enumerate(at)})
    edges = cuts[x].join(cuts[y], keys) if keys else cuts[x].crossJoin(F.broadcast(cuts[y]))
    edges = staged(edges, "cuts")  # one row per key, of known size: the rows needn't meet by key
    rows = df.join(edges, keys) if keys else df.crossJoin(F.broadcast(edges))
    beyond = (lambda c, i: F.col(c) <= F.col(f"_{c}{i}")) if side == "lower" else (lambda c, i: F.col(c) >= F.col(f"_{c}{i}"))
    aggs = [F.avg(F.when(beyond(x, i), F.when(beyond(y, i), 1.0).otherwise(0.0))).alias(f"_chi{i}") for i in range(len(qs))]
    out = rows.groupBy(*keys).agg(*aggs)
    table = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.coalesce(F.col(f"_chi{i}"), F.lit(0.0)).alias("chi")) for i, q in enumerate(qs)])
    return out.select(*keys, F.inline(table))


def pairwise_chi(long: DataFrame, t: str, var: str, x: str, names: Sequence, qs: Sequence[float]) -> DataFrame:
    """Mean over variable pairs of P(both in the tail) / q on pseudo-observations (strict).

    Tail flags of one observation are a 0/1 vector, so the pair counts are a Gram matrix.
    """
    ranks = value_ranks(long, [var], x)
    u = (F.col("n_below") + (F.col("n_eq") + 1) / 2) / (F.col("n_all") + 1)
    pseudo = long.join(ranks.select(var, x, u.alias("_u")), [var, x])
    vec = G.vectors(pseudo, [t], var, "_u", names)
    grid = [F.struct(F.lit(float(q)).alias("q"), F.lit(s).alias("side")) for q in qs for s in ("lower", "upper")]
    flagged = vec.select("vec", F.explode(F.array(*grid)).alias("_g")).select(
        "_g.q", "_g.side",
        F.transform("vec", lambda v: F.when(F.when(F.col("_g.side") == "lower", v < F.col("_g.q")).otherwise(v > 1 - F.col("_g.q")), 1.0).otherwise(0.0)).alias("flags"),
    )
    g = G.gram(flagged, "flags", ["q", "side"])
    n = g.where("i = 0 AND j = 0").select("q", "side", F.col("s").alias("n"))
    pairs = g.where("i > 0 AND i < j").groupBy("q", "side").agg(F.avg("s").alias("_both"))
    return pairs.join(n, ["q", "side"]).select("q", "side", (F.col("_both") / F.col("n") / F.col("q")).alias("chi"))


# ---- lead and lag -------------------------------------------------------------------------


def _corr(x: str, y: str) -> Column:
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def lead_lag(df: DataFrame, keys: Sequence[str], t: str, x: str, y: str, max_lag: int) -> DataFrame:
    """Correlation of x(t) with y(t + lag) for each lag, complete calendar-bounded series."""
    keys = list(keys)
    base = df.select(*keys, F.row_number().over(C.by_time(keys, t)).alias("_i"), x, y)
    moved = base.select(*keys, F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"), "_i", F.col(x))
    moved = moved.withColumn("_i", F.col("_i") + F.col("lag"))
    out = moved.join(base.select(*keys, "_i", y), [*keys, "_i"]).groupBy(*keys, "lag").agg(_corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("r", F.when(F.col("n") > 2, F.col("r")).otherwise(0.0))


def best_lag(scan: DataFrame, by: Sequence[str], digits: int = 12) -> DataFrame:
    """Strongest lag of either sign; ties go to the smaller lag."""
    key = F.struct(F.round(F.abs("r"), digits), -F.col("lag"))
    return scan.groupBy(*by).agg(F.max_by(F.struct("lag", "r"), key).alias("_b")).select(*by, F.col("_b.lag").alias("lag"), F.col("_b.r").alias("r"))


def lag_scan(wide: DataFrame, t: str, hazards: Sequence[str], targets: Sequence[str], lags: Sequence[int], gaussian: bool = False) -> DataFrame:
    """Each hazard against each target ``lag`` periods later, with a significance band.

    The plain band uses n - 3; the rank version takes normal scores of the overlapping rows
    and the effective number of observations of the two series.
    """
    base = wide.withColumn("_i", F.row_number().over(Window.orderBy(t)))  # one row per period
    h = base.unpivot(["_i"], list(hazards), "hazard", "_x").where("_x IS NOT NULL")
    y = base.unpivot(["_i"], list(targets), "target", "_y").where("_y IS NOT NULL")
    shifted = explode_values(h, "lag", lags).withColumn("_i", F.col("_i") + F.col("lag"))
    pairs = shifted.join(y, "_i")
    keys = ["hazard", "target", "lag"]
    if not gaussian:
        out = pairs.groupBy(*keys).agg(_corr("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n"))
        out = out.withColumn("n_eff", F.col("n").cast("double"))
    else:
        for c in ("_x", "_y"):
            group = Window.partitionBy(*keys)
            rank = F.rank().over(group.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2
            pairs = pairs.withColumn(c + "s", (rank - 0.5) / F.count(F.lit(1)).over(group))
        scored = pairs.withColumn("_xs", normal_quantile("_xs")).withColumn("_ys", normal_quantile("_ys"))
        out = scored.groupBy(*keys).agg(_corr("_xs", "_ys").alias("r"), F.count(F.lit(1)).alias("n"))
        both = h.select(F.col("hazard").alias("v"), "_i", F.col("_x").alias("x")).unionByName(y.select(F.col("target").alias("v"), "_i", F.col("_y").alias("x")))
        ne = effective_n_pair(autocorr(both, ["v"], "_i", "x"), "v")
        ne = ne.unionByName(ne.select(F.col("j").alias("i"), F.col("i").alias("j"), "n_eff"))
        out = out.join(ne.select(F.col("i").alias("hazard"), F.col("j").alias("target"), "n_eff"), ["hazard", "target"])
    band = F.lit(1.96) / F.sqrt(F.greatest(F.col("n_eff") - 3, F.lit(1.0)))
    return out.withColumn("band", band).withColumn("significant", F.abs("r") > band)


def explode_values(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def corr_with_reference(vec: DataFrame, col: str, ref: int) -> DataFrame:
    """Every variable of a vector against one of them."""
    x = vec.select(F.posexplode(col).alias("var", "_x"), F.get(col, F.lit(ref)).alias("_ref"))
    x = x.select("var", F.col("_x").cast("double").alias("_x"), F.col("_ref").cast("double").alias("_ref"))
    return x.groupBy("var").agg(_corr("_x", "_ref").alias("r"))


# ---- factors and modes --------------------------------------------------------------------


def regress_out(long: DataFrame, var: str, x: str, factor: str) -> tuple[DataFrame, DataFrame]:
    """One known factor: residual rows and a loadings table with the shared variance."""
    load = long.groupBy(var).agg(
        F.regr_slope(x, factor).alias("loading"), F.avg(x).alias("_mx"), F.avg(factor).alias("_mf"), F.regr_r2(x, factor).alias("shared")
    )
    res = long.join(load, var).withColumn("residual", F.col(x) - F.col("_mx") - F.col("loading") * (F.col(factor) - F.col("_mf")))
    return res.drop("_mx", "_mf", "loading", "shared"), load.select(var, "loading", "shared")


def regress_out_many(long: DataFrame, var: str, x: str, factors: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Several known factors: one Gram per variable, solved where it lies, joined back."""
    load = long.groupBy(var).agg(G.moments([*factors, x]).alias("_g")).select(var, G.solve_ols("_g").alias("_s"))
    load = load.select(var, F.col("_s.beta").alias("beta"), F.col("_s.r2").alias("shared"))
    fit = F.get("beta", F.lit(0))
    for k, f in enumerate(factors, start=1):
        fit = fit + F.get("beta", F.lit(k)) * F.col(f)
    return long.join(load, var).withColumn("residual", F.col(x) - fit).drop("beta", "shared"), load


def mode_loadings(corr: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Top k eigenvectors (``mode, var, u``) and eigenvalues of each correlation matrix."""

    def top(m, n, key):
        values, vecs = L.spectrum(m)
        u = vecs[:, :k] * np.where(vecs[:, :k].sum(axis=0) < 0, -1.0, 1.0)
        mode, var = np.meshgrid(np.arange(k), np.arange(len(m)), indexing="ij")
        return pd.DataFrame({"mode": mode.ravel().astype("int32"), "var": var.ravel().astype("int32"), "u": u.T.ravel(), "eigenvalue": np.repeat(values[:k], len(m))})

    return G.per_matrix(corr, by, "r", top, "mode int, var int, u double, eigenvalue double")


def remove_modes(long: DataFrame, t: str, var: str, x: str, loadings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Project standardised data off the given modes: residual rows and mode series.

    ``var`` is the 0-based variable number.  Loadings join by variable; the mode value of
    an observation is one aggregate.
    """
    stats = long.groupBy(var).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z = long.join(stats, var).withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))
    z = z.withColumn("_z", (F.col(x) - F.col("_m")) / F.col("_s"))
    load = loadings.select(F.col("var").alias(var), "mode", "u")
    series = z.join(load, var).groupBy(t, "mode").agg(F.sum(F.col("u") * F.col("_z")).alias("mode_value"))
    packed = series.groupBy(t).agg(F.map_from_entries(F.collect_list(F.struct("mode", "mode_value"))).alias("_a"))
    u_map = load.groupBy(var).agg(F.collect_list(F.struct("mode", "u")).alias("_u"))
    both = z.join(u_map, var).join(packed, t)
    shared = F.aggregate("_u", F.lit(0.0), lambda acc, p: acc + p["u"] * F.element_at(F.col("_a"), p["mode"]))
    res = both.select(t, var, ((F.col("_z") - shared) * F.col("_s")).alias("residual"))
    return res, series


def remove_modes_matrix(corr: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    return G.per_matrix(corr.select(*by, "i", "j", "n", "r"), by, "r", lambda m, n, key: G.upper(L.remove_modes(m, k)[0], "r").assign(n=int(n)), "i int, j int, r double, n long")


def effective_rank(corr: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """trace^2 / sum of squares and N^2 / sum, straight from the cells i <= j."""
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("r")))
    count = F.sum(F.when(F.col("i") == F.col("j"), 1.0))
    return corr.groupBy(*by).agg(
        (trace * trace / F.sum(twice * F.col("r") * F.col("r"))).alias("effective_rank"), F.try_divide(count * count, F.sum(twice * F.col("r"))).alias("n_effective")
    )


def squared_norms(vec: DataFrame, col: str, project: np.ndarray | None = None) -> tuple[float, int]:
    """Mean over the rows of the squared squared length of a standardised vector, and the number of rows.

    ``project`` (variables squared) is applied to the standardised rows first.  Two passes of partial sums; only one row
    per variable and one row per task reach the driver.
    """
    stats = vec.select(F.posexplode(col).alias("v", "x")).groupBy("v").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("v").collect()
    mean, sd = (np.array([r[c] for r in stats]) for c in "ms")
    sd = np.where(sd > 0, sd, 1.0)

    def sums(batches):
        for pdf in batches:
            if len(pdf):
                z = (np.stack(pdf[col].to_numpy()) - mean) / sd
                z = z if project is None else z @ project.T
                yield pd.DataFrame([((np.square(z).sum(1) ** 2).sum(), len(z))], columns=["s", "n"])

    total = vec.select(col).mapInPandas(sums, "s double, n long").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return float(total["s"] or 0.0) / max(total["n"] or 0, 1), int(total["n"] or 0)


def measured_noise(c: np.ndarray, norms: tuple[float, int]) -> float:
    """Expected squared error of ``c``: mean squared distance of single rows' products from it, per row."""
    return (norms[0] - float((c * c).sum())) / norms[1]


def clean_corr(corr: DataFrame, method: str, by: Sequence[str] = (), n_removed: int = 0, norms: tuple[float, int] | None = None) -> DataFrame:
    """Cleaned matrices, one per group: clip, linear (Ledoit-Wolf) or nonlinear shrinkage.

    ``norms`` (of ``squared_norms``) lets linear shrinkage use the noise of the data instead of the Gaussian formula.
    """
    noise = lambda m: measured_noise(m, norms) if norms else None
    return G.per_matrix(corr, by, "r", lambda m, n, k: G.upper(L.clean(m, n, method, n_removed, noise(m)), "r").assign(n=int(n)), "i int, j int, r double, n long")


def noise_summary(corr: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Noise band, bulk variance, eigenvalues above the band and effective rank per matrix."""

    def describe(m, n, key):
        values = L.spectrum(m)[0]
        variance = L.bulk_variance(values, n)
        lo, hi = L.noise_band(len(values), n, variance)
        return pd.DataFrame([{"variance": variance, "lower": lo, "upper": hi, "n_signal": int((values > hi).sum()), "largest": values[0], "effective_rank": L.effective_rank(m)}])

    return G.per_matrix(corr, by, "r", describe, "variance double, lower double, upper double, n_signal long, largest double, effective_rank double")


def tyler_corr(vec: DataFrame, col: str, max_iterations: int = 100, tol: float = 1e-6) -> DataFrame:
    """Robust fixed-point correlation.

    Each round is one pass over the cached vectors: tasks weight their rows with the
    current matrix and return a variables-by-variables sum, the only thing the driver sees.
    """
    spark = vec.sparkSession
    stats = vec.select(F.posexplode(col).alias("v", "x")).groupBy("v").agg(F.avg("x").alias("m")).orderBy("v").collect()  # one row per variable
    mean = np.array([r["m"] for r in stats])
    centred = vec.select(F.zip_with(col, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b).alias("vec")).persist()

    def reweighted(shape: np.ndarray) -> np.ndarray:
        """One pass: each row counts by the inverse of its length under ``shape``."""
        precision = np.linalg.pinv(shape)
        weight = lambda x: 1.0 / np.clip(((x @ precision) * x).sum(1), 1e-12, None)
        out = np.zeros_like(shape)
        for cell in G.gram(centred, "vec", weight=weight).where("i > 0").collect():  # variables squared
            out[cell["i"] - 1, cell["j"] - 1] = out[cell["j"] - 1, cell["i"] - 1] = cell["s"]
        return out / np.trace(out) * len(out)

    c, moved, rounds = np.eye(len(mean)), np.inf, 0
    try:
        while moved >= tol:
            if rounds == max_iterations:
                raise RuntimeError(f"the scatter matrix did not settle in {max_iterations} rounds (last step {moved:.2g})")
            last, c, rounds = c, reweighted(c), rounds + 1
            moved = float(np.abs(c - last).max())
    finally:
        centred.unpersist()
    return spark.createDataFrame(G.upper(L.with_unit_diagonal(c), "r"), "i int, j int, r double")


class Correlator:
    """Measure, remove known factors, correlate, remove modes, clean, optionally partial.

    Known factors cost observations, modes cost variables; both enter the noise band.
    """

    CHOICES = {"measure": ("pearson", "spearman", "gaussian_rank"), "clean": tuple(L.RULES), "output": ("correlation", "partial"), "effective_n": (None, "bartlett")}

    def __init__(self, measure="pearson", factors: Sequence[str] = (), modes=0, clean="raw", robust=False, effective_n=None, output="correlation"):
        self.measure, self.factors, self.modes, self.clean = measure, list(factors), modes, clean
        self.robust, self.effective_n, self.output = robust, effective_n, output
        wrong = {k: getattr(self, k) for k, allowed in self.CHOICES.items() if getattr(self, k) not in allowed}
        if wrong:
            raise ValueError(f"not among the choices: {wrong}")

    def fit(self, long: DataFrame, t: str, var: str, x: str, names: Sequence) -> DataFrame:
        """Matrix rows ``(i, j, r)``; factor columns, if any, are columns of ``long``."""
        data = long.select(t, var, x, *self.factors)
        z = rank_scores(data, var, x, self.measure)
        if self.factors:
            for f in self.factors:
                if self.measure != "pearson":
                    one = z.select(t, f).distinct()
                    scored = rank_scores(one.withColumn("_v", F.lit(0)).withColumnRenamed(f, "_f"), "_v", "_f", self.measure)
                    z = z.drop(f).join(scored.select(t, F.col("_f").alias(f)), t)
            z = regress_out_many(z, var, x, self.factors)[0].drop(x).withColumnRenamed("residual", x)
        z = staged(z, "scores")  # the vectors and the autocorrelations read it
        vec = G.vectors(z, [t], var, x, names)
        corr = G.correlations(staged(G.gram(vec, "vec"), "gram"))  # its row count, sums, diagonal and cells are read one by one
        if self.robust:
            n = corr.select(F.max("n").alias("n"))
            corr = tyler_corr(vec, "vec").crossJoin(F.broadcast(n))  # a single row
        cost = len(self.factors)
        obs = F.col("n").cast("double") - cost
        if self.effective_n == "bartlett":
            ac = autocorr(z, [var], t, x)
            mean = ac.groupBy("lag").agg(F.avg("rho").alias("_m"), F.max("n").alias("_t"))
            infl = F.greatest(F.sum(F.col("_m") * F.col("_m")) * 2 + 1, F.lit(1.0))
            ne = mean.agg((F.max("_t") / infl).alias("_ne"))
            corr = corr.crossJoin(F.broadcast(ne))  # a single row
            obs = F.col("_ne") - cost
        corr = corr.withColumn("n", obs).select("i", "j", "n", "r")
        modes, method, partial, norms = self.modes, self.clean, self.output == "partial", None
        if L.RULES[method] is L.towards_mean:  # the only method that looks at the noise of the data
            norms = squared_norms(vec, "vec", self._residual(corr) if modes else None)

        def finish(m, n_obs, key):
            left, _, _ = L.remove_modes(m, modes)
            out = L.clean(left, n_obs, method, modes, measured_noise(left, norms) if norms else None)
            return G.upper(L.partial_from(out) if partial else out, "r").assign(n_effective=n_obs)

        return G.per_matrix(corr, [], "r", finish, "i int, j int, r double, n_effective double")


    def _residual(self, corr: DataFrame) -> np.ndarray:
        """What takes standardised rows to their part without the strongest modes, on a unit variance (variables squared)."""
        cells = corr.select("i", "j", "r").collect()
        m = np.eye(max(c["i"] for c in cells) + 1)
        for c in cells:
            m[c["i"], c["j"]] = m[c["j"], c["i"]] = c["r"]
        u = L.spectrum(m)[1][:, : self.modes]
        rest = np.eye(len(m)) - u @ u.T
        return rest / np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", rest, m, rest), 1e-12))[:, None]


def min_variance_weights(cov: DataFrame, by: Sequence[str], value: str = "cov") -> DataFrame:
    def weights(m, n, key):
        w = L.min_variance(m)
        return pd.DataFrame({"var": np.arange(len(w), dtype="int32"), "weight": w})

    return G.per_matrix(cov, by, value, weights, "var int, weight double")


def oos_risk(vec: DataFrame, t: str, col: str, window: int, hold: int, methods: Sequence[str]) -> DataFrame:
    """Predicted and realised risk of minimum-variance portfolios on rolling blocks.

    An observation belongs to the training windows that cover it and to one test block;
    windows are numbered by ``hold`` rows.  Each window becomes one Gram, so no window of
    rows is ever gathered.  Observations are numbered in planned ranges of ``t`` and staged,
    so that neighbours are in one task and no task has all of them.
    """
    pos = staged(row_position(vec.select(t, col), [], [t], out="_i").withColumn("_i", F.col("_i") - 1), "oos-positions")
    last = pos.agg(F.max("_i").alias("_last"))
    pos = pos.crossJoin(F.broadcast(last))  # a single row
    first_block = F.greatest(F.lit(0), F.ceil((F.col("_i") - window + 1) / hold))
    top = F.least(F.floor(F.col("_i") / hold), F.floor((F.col("_last") + 1 - window - hold) / hold))
    train = pos.withColumn("block", F.explode(F.when(first_block <= top, F.sequence(first_block, top)).otherwise(F.array().cast("array<bigint>"))))
    cov = G.covariances(G.gram(train, col, ["block"]), ["block"])

    def portfolios(m, n, key):
        sd = np.sqrt(np.diag(m))
        rows = []
        for name in methods:
            w = L.min_variance(L.rescale(L.clean(L.with_unit_diagonal(m), n, name), sd))
            rows.append({"method": name, "weights": w.tolist(), "predicted": float(np.sqrt(max(w @ m @ w, 0.0)))})
        return pd.DataFrame(rows)

    chosen = G.per_matrix(cov, ["block"], "cov", portfolios, "method string, weights array<double>, predicted double")
    test = pos.where(F.col("_i") >= window).withColumn("block", F.floor((F.col("_i") - window) / hold)).select("block", col)
    value = F.aggregate(F.zip_with(col, "weights", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return test.join(chosen, "block").withColumn("_p", value).groupBy("block", "method").agg(
        F.first("predicted").alias("predicted"), F.stddev_pop("_p").alias("realised"), F.count(F.lit(1)).alias("n")
    )


# ---- prices on a clock and ticks ------------------------------------------------------------


def _product_table(df: DataFrame, names: Sequence[str], left, right, out: str, by: Sequence[str] = ()) -> DataFrame:
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    aggs = [F.sum(left(names[i]) * right(names[j])).alias(f"_{i}_{j}") for i, j in cells]
    rows = F.array(*[F.struct(F.lit(names[i]).alias("i"), F.lit(names[j]).alias("j"), F.col(f"_{i}_{j}").alias(out)) for i, j in cells])
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(rows)).where(F.col(out).isNotNull())


def sampled_returns(wide: DataFrame, t: str, names: Sequence[str], step: int) -> DataFrame:
    """Log returns of every step-th row of an aligned price panel (one row per period)."""
    w = Window.orderBy(t)
    pos = wide.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i") % step == 0)
    return pos.select(t, *[(F.log(n) - F.lag(F.log(n)).over(w)).alias(n) for n in names]).where(F.col(names[0]).isNotNull())


def realised_cov(wide: DataFrame, t: str, names: Sequence[str], step: int = 1) -> DataFrame:
    r = sampled_returns(wide, t, names, step)
    return _product_table(r, names, F.col, F.col, "cov")


def lead_lag_adjusted(wide: DataFrame, t: str, names: Sequence[str], step: int = 1) -> DataFrame:
    """Adds the products of neighbouring steps, both ways."""
    r = sampled_returns(wide, t, names, step)
    w = Window.orderBy(t)
    r = r.select(t, *names, *[F.coalesce(F.lag(n).over(w), F.lit(0.0)).alias(f"_p_{n}") for n in names])
    past = lambda n: F.col(f"_p_{n}")
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    total = lambda a, b: F.sum(F.col(a) * F.col(b) + F.col(a) * past(b) + past(a) * F.col(b))
    agg = r.agg(*[total(names[i], names[j]).alias(f"_{i}_{j}") for i, j in cells])
    rows = F.array(*[F.struct(F.lit(names[i]).alias("i"), F.lit(names[j]).alias("j"), F.col(f"_{i}_{j}").alias("cov")) for i, j in cells])
    return agg.select(F.inline(rows)).where("cov IS NOT NULL")


def block_averaged_cov(wide: DataFrame, t: str, names: Sequence[str], window: int) -> DataFrame:
    """Covariance of returns between means of full blocks."""
    pos = wide.withColumn("_b", F.floor((F.row_number().over(Window.orderBy(t)) - 1) / window))
    blocks = pos.groupBy("_b").agg(*[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("_n")).where(F.col("_n") == window)
    return realised_cov(blocks.select("_b", *names), "_b", names)


def epps_curve(wide: DataFrame, t: str, assets: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """Correlation of every pair of assets against the sampling step, in one pass over the panel."""
    pos = explode_values(wide.withColumn("_i", F.row_number().over(Window.orderBy(t)) - 1), "step", list(steps)).where(F.col("_i") % F.col("step") == 0)
    w = Window.partitionBy("step").orderBy("_i")
    returns = pos.select("step", *[(F.log(n) - F.lag(F.log(n)).over(w)).alias(n) for n in assets])
    s = lambda x, y: F.sum(F.col(x) * F.col(y))
    cells = [(x, y) for i, x in enumerate(assets) for y in assets[i + 1 :]]
    rows = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.coalesce(F.try_divide(s(x, y), F.sqrt(s(x, x) * s(y, y))), F.lit(0.0)).alias("r")) for x, y in cells]
    return returns.groupBy("step").agg(F.array(*rows).alias("_rows")).select("step", F.inline("_rows"))


def hayashi_yoshida(ticks: DataFrame, asset: str, sec: str, price: str, assets: Sequence[str]) -> DataFrame:
    """Covariance from irregular ticks: return products over overlapping intervals, all asset pairs.

    The returns of another asset that overlap one interval add up to its log price at the
    first tick at or after the end minus that at the last tick at or before the start.  Each
    tick looks up those prices of every asset in its time slice (slices hold about the same number
    of ticks, planned from a quantile sketch); what crosses a slice comes from a table with one row per slice.  No pair of intervals is formed.
    """
    t = cut(ticks.select(F.col(asset).alias("asset"), F.col(sec).alias("sec"), F.log(price).alias("lp")), [], ["sec"], None)
    of = lambda a: F.when(F.col("asset") == a, F.struct(F.col("lp").alias("v")))
    ends = t.groupBy("_slice").agg(
        *[F.max_by(of(a), F.when(F.col("asset") == a, F.col("sec"))).alias(f"_l{k}") for k, a in enumerate(assets)],
        *[F.min_by(of(a), F.when(F.col("asset") == a, F.col("sec"))).alias(f"_f{k}") for k, a in enumerate(assets)],
    )
    # looking ahead runs backwards with a growing frame: a frame to the end is quadratic
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    after = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(
        "_slice",
        *[F.last(f"_l{k}", ignorenulls=True).over(before).alias(f"_before{k}") for k in range(len(assets))],
        *[F.last(f"_f{k}", ignorenulls=True).over(after).alias(f"_after{k}") for k in range(len(assets))],
        *[F.first(f"_f{k}", ignorenulls=True).over(whole).alias(f"_open{k}") for k in range(len(assets))],
        *[F.last(f"_l{k}", ignorenulls=True).over(whole).alias(f"_close{k}") for k in range(len(assets))],
    )
    upto = Window.partitionBy("_slice").orderBy("sec").rangeBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("_slice").orderBy(F.desc("sec")).rangeBetween(Window.unboundedPreceding, 0)
    known = t.join(carried, "_slice")
    last = [F.coalesce(F.last(of(a), ignorenulls=True).over(upto), F.col(f"_before{k}"), F.col(f"_open{k}"))["v"] for k, a in enumerate(assets)]
    nxt = [F.coalesce(F.last(of(a), ignorenulls=True).over(on), F.col(f"_after{k}"), F.col(f"_close{k}"))["v"] for k, a in enumerate(assets)]
    seen = known.select("asset", "sec", "lp", "_slice", F.array(*last).alias("_last"), F.array(*nxt).alias("_next"))
    gone = sliced_lag(seen, ["asset"], ["sec"], {"_lp0": "lp", "_from": "_last"}, F.col("_slice")).where("_lp0 IS NOT NULL")
    rows = gone.select("asset", (F.col("lp") - F.col("_lp0")).alias("ret"), F.posexplode(F.zip_with("_next", "_from", lambda a, b: a - b)).alias("_k", "move"))
    other = F.get(F.array(*[F.lit(a) for a in assets]), F.col("_k"))
    rows = rows.withColumn("other", other).where("asset <= other")
    contribution = F.when(F.col("asset") == F.col("other"), F.col("ret") * F.col("ret")).otherwise(F.col("ret") * F.col("move"))
    return rows.groupBy(F.col("asset").alias("i"), F.col("other").alias("j")).agg(F.sum(contribution).alias("cov"))


# ---- sensor stacking ------------------------------------------------------------------------


def stack(long: DataFrame, i: str, sensor: str, x: str, weights: DataFrame, out: str = "stack") -> DataFrame:
    """Weighted sum over sensors at each sample; weights are a small table joined by sensor."""
    return long.join(weights.select(sensor, "weight"), sensor).groupBy(i).agg(F.sum(F.col("weight") * F.col(x)).alias(out))


def mean_weights(long: DataFrame, sensor: str) -> DataFrame:
    s = long.select(sensor).distinct()
    return s.crossJoin(F.broadcast(s.agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))))  # a single row


def snr_weights(long: DataFrame, i: str, sensor: str, x: str, noise: tuple[int, int], signal: tuple[int, int]) -> DataFrame:
    part = lambda w: F.var_pop(F.when((F.col(i) >= w[0]) & (F.col(i) < w[1]), F.col(x)))
    s = long.groupBy(sensor).agg((part(signal) / F.greatest(part(noise), F.lit(1e-12))).alias("_snr"))
    return s.crossJoin(F.broadcast(s.agg(F.sum("_snr").alias("_t")))).select(sensor, (F.col("_snr") / F.col("_t")).alias("weight"))


def mvdr_weights(cov: DataFrame, method: str = "linear_shrinkage") -> DataFrame:
    """Minimum-variance weights for a signal that arrives the same at every sensor (ddof 1)."""

    def weights(m, n, key):
        w = L.min_variance(L.clean(m * n / (n - 1), n, method))
        return pd.DataFrame({"sensor": np.arange(len(w), dtype="int32"), "weight": w})

    return G.per_matrix(cov, [], "cov", weights, "sensor int, weight double")


def common_mode_weights(cov: DataFrame) -> DataFrame:
    def weights(m, n, key):
        top = L.spectrum(m)[1][:, 0]
        return pd.DataFrame({"sensor": np.arange(len(top), dtype="int32"), "weight": top / top.sum()})

    return G.per_matrix(cov, [], "cov", weights, "sensor int, weight double")


def align_traces(long: DataFrame, i: str, sensor: str, x: str, reference, max_lag: int) -> tuple[DataFrame, DataFrame]:
    """Delay of each sensor against the reference, and the traces moved back, zero padded."""
    ref = long.where(F.col(sensor) == F.lit(reference)).select(i, F.col(x).alias("_ref"))
    pairs = long.join(ref, i)
    shifts = best_lag(lead_lag(pairs, [sensor], i, "_ref", x, max_lag), [sensor]).select(sensor, F.col("lag").alias("shift"))
    grid = long.select(sensor, i)
    moved = long.join(shifts, sensor).select(sensor, (F.col(i) - F.col("shift")).alias(i), F.col(x).alias("aligned"))
    return grid.join(moved, [sensor, i], "left").fillna(0.0, subset=["aligned"]), shifts


def gain_db(stacked: DataFrame, single: DataFrame, i: str, a: str, b: str, noise: tuple[int, int]) -> DataFrame:
    """Noise reduction of a stack against one sensor."""
    both = stacked.join(single, i).where((F.col(i) >= noise[0]) & (F.col(i) < noise[1]))
    return both.agg((F.log10(F.try_divide(F.stddev_pop(b), F.stddev_pop(a))) * 20).alias("gain"))


def pca_denoise(vec: DataFrame, col: str) -> DataFrame:
    """Project traces on the leading eigenvectors above the noise edge of their covariance.

    The sample-by-sample covariance is a Gram; the basis (samples squared) joins as one row.
    """
    cov = G.covariances(G.gram(vec, col))

    def basis(m, n, key):
        values, vecs = L.spectrum(m)
        edge = L.noise_band(len(values), n, L.bulk_variance(values, n))[1]
        keep = vecs[:, : max(1, int((values > edge).sum()))]
        return pd.DataFrame([{"projector": (keep @ keep.T).ravel().tolist(), "kept": keep.shape[1]}])

    p = G.per_matrix(cov, [], "cov", basis, "projector array<double>, kept int")
    mean = G.gram(vec, col).where("i = 0").groupBy().agg(F.sort_array(F.collect_list(F.struct("j", "s"))).alias("_m"))
    p = p.crossJoin(F.broadcast(mean))  # one row each
    joined = vec.crossJoin(F.broadcast(p))  # one row of samples squared
    kept_cols = [c for c in vec.columns if c != col]
    schema = ", ".join(f"{c} {vec.schema[c].dataType.simpleString()}" for c in kept_cols)

    def project(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[col].to_numpy()).astype(float)
            proj = np.asarray(pdf["projector"].iloc[0], dtype=float).reshape(x.shape[1], -1)
            sums = np.array([c["s"] for c in pdf["_m"].iloc[0]])
            mean = sums[1:] / sums[0]
            out = pdf[kept_cols].copy()
            out["clean"] = list((x - mean) @ proj + mean)
            out["kept"] = pdf["kept"]
            yield out

    return joined.mapInPandas(project, schema + ", clean array<double>, kept int")


def picker_scoreboard(picks: DataFrame, by: str, pick: str, arrival: Column, rate: float, within: float, snr: str, raw_snr: str, motion: str, truth: str) -> DataFrame:
    """Per method: share of picks within tolerance, median absolute error, bias, right polarities and median SNR gain.

    A pick of -1 is none: it counts as a miss and has no error.  The bias is the median error of the picks within tolerance.
    """
    scored = picks.withColumn("_err", F.when(F.col(pick) >= 0, (F.col(pick) - arrival) / rate))
    scored = scored.withColumns({"_abs": F.abs("_err"), "_good": F.coalesce(F.abs("_err") <= within, F.lit(False)), "_gain": F.col(snr) - F.col(raw_snr)})
    out = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_good").cast("double")).alias("share"), F.avg((F.col(motion) == F.col(truth)).cast("double")).alias("polarity"))
    for rows, column, name in ((scored, "_abs", "median_error"), (scored.where("_good"), "_err", "bias"), (scored, "_gain", "snr_gain")):
        out = join_on(out, quantile_columns(rows, [by], column, {name: 0.5}), [by], "left")
    return out
