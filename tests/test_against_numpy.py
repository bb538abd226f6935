"""Operators SQL cannot state, against NumPy, brute force and invariants on small frames."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import linalg as L
from strandline.operators import copula, dependence, graph, hedging, ordering, quality, raster, regress, resample
from strandline.operators import gram as G


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows and one value a third of them."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(4000) < 0.33, 2.5, np.round(rng.normal(size=4000), 2))
    pdf = pd.DataFrame({"k": np.where(rng.random(4000) < 0.9, "hot", "cold"), "x": x, "y": np.round(x + rng.normal(size=4000), 1), "i": np.arange(4000)})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("slices", [3, 8, 200])
def test_ranks_and_quantiles(skewed, slices):
    pdf, df = skewed
    got = ordering.average_rank(df, ["k"], "x", slices=slices).toPandas().sort_values("i")
    want = pdf.groupby("k").x.rank(method="average")
    assert np.allclose(got["rank"].to_numpy(), want.to_numpy())
    q = ordering.exact_quantiles(df, ["k"], "x", [0.05, 0.5, 0.95], slices).toPandas()
    for r in q.itertuples():
        assert r.x == pytest.approx(np.quantile(pdf[pdf.k == r.k].x, r.q))


def test_tail_means(skewed):
    pdf, df = skewed
    got = {r.k: r.m for r in ordering.tail_mean(df, ["k"], "x", F.lit(37), "m").toPandas().itertuples()}
    top = {r.k: r.m for r in ordering.tail_mean(df, ["k"], "x", F.lit(37), "m", largest=True).toPandas().itertuples()}
    for k, g in pdf.groupby("k"):
        s = np.sort(g.x)
        assert got[k] == pytest.approx(s[:37].mean()) and top[k] == pytest.approx(s[-37:].mean())


def test_position_and_lag_cross_slices(skewed):
    pdf, df = skewed
    cut = F.floor(F.col("i") / 50)
    got = ordering.row_position(df, ["k"], ["i"], cut).toPandas().sort_values("i")
    assert (got.pos.to_numpy() == (pdf.groupby("k").cumcount() + 1).to_numpy()).all()
    lagged = ordering.sliced_lag(df.where("i % 400 > 250"), ["k"], ["i"], {"px": "x"}, cut).toPandas().sort_values("i")
    want = pdf[pdf.i % 400 > 250].groupby("k").x.shift()
    assert np.allclose(lagged.px.to_numpy(dtype=float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("slices", [1, 4, 90])
def test_kendall_and_distance_correlation(spark, slices):
    rng = np.random.default_rng(3)
    x = np.where(rng.random(300) < 0.3, 1.0, np.round(rng.normal(size=300), 1))
    y = np.where(rng.random(300) < 0.3, 0.0, np.round(x * x + rng.normal(size=300), 1))
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x, "y": y}))
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    iu = np.triu_indices(300, 1)
    tau = (dx * dy)[iu].sum() / math.sqrt((dx[iu] != 0).sum() * (dy[iu] != 0).sum())
    assert dependence.kendall(df, ["k"], "x", "y", slices).first().tau == pytest.approx(tau)

    def centred(v):
        a = np.abs(v[:, None] - v)
        return a - a.mean(0) - a.mean(1)[:, None] + a.mean()

    a, b = centred(x), centred(y)
    want = math.sqrt((a * b).mean() / math.sqrt((a * a).mean() * (b * b).mean()))
    assert dependence.distance_corr(df, ["k"], "x", "y", slices).first().dcor == pytest.approx(want, abs=1e-9)


@pytest.fixture(scope="module")
def blocks(spark):
    """Market 0.4 and sector 0.5 in 3 blocks of 4 variables."""
    rng = np.random.default_rng(5)
    market, sector = rng.normal(size=400), rng.normal(size=(3, 400))
    x = np.array([0.4 * market + 0.5 * sector[i // 4] + rng.normal(size=400) for i in range(12)])
    long = pd.DataFrame([(t, i, x[i, t]) for t in range(400) for i in range(12)], columns=["t", "v", "x"])
    return x, spark.createDataFrame(long).cache()


def square(rows, col="r"):
    n = int(rows.j.max()) + 1
    m = np.zeros((n, n))
    for r in rows.itertuples():
        m[r.i, r.j] = m[r.j, r.i] = getattr(r, col)
    return m


def test_correlation_partial_and_modes(blocks):
    x, long = blocks
    corr = dependence.corr_pairs(long, "t", "v", "x", range(12)).cache()
    c = square(corr.toPandas())
    assert np.allclose(c, np.corrcoef(x))
    p = square(dependence.partial_corr(corr).toPandas())
    inv = np.linalg.inv(np.corrcoef(x))
    d = np.sqrt(np.diag(inv))
    assert np.allclose(p[np.triu_indices(12, 1)], (-inv / np.outer(d, d))[np.triu_indices(12, 1)])
    load = dependence.mode_loadings(corr, 2)
    res = dependence.remove_modes(long, "t", "v", "x", load)[0].toPandas().pivot(index="v", columns="t", values="residual").to_numpy()
    z = (x - x.mean(1)[:, None]) / x.std(1)[:, None]
    u = L.spectrum(np.corrcoef(x))[1][:, :2]
    assert np.allclose(res, (z - u @ (u.T @ z)) * x.std(1)[:, None], atol=1e-8)
    er = dependence.effective_rank(corr).first().effective_rank
    assert er == pytest.approx(L.effective_rank(np.corrcoef(x)))


@pytest.mark.parametrize("method", ["clip", "linear_shrinkage", "nonlinear_shrinkage"])
@pytest.mark.parametrize("removed", [0, 1])
def test_cleaners_keep_a_correlation_matrix(blocks, method, removed):
    c = np.corrcoef(blocks[0])
    base = L.remove_modes(c, removed)[0]
    out = L.clean(base, 400, method, removed)
    assert np.allclose(np.diag(out), 1) and np.allclose(out, out.T) and np.linalg.eigvalsh(out).min() > -1e-9
    scaled = L.clean(base * 9.0, 400, method, removed)
    assert np.allclose(scaled, out * 9.0)


def test_nonlinear_shrinkage_of_pure_noise_is_nearly_flat():
    rng = np.random.default_rng(7)
    values = np.linalg.eigvalsh(np.corrcoef(rng.normal(size=(100, 300))))[::-1]
    assert L.analytical_spectrum(values, 300).std() < values.std() / 3
    assert L.bulk_variance(values, 300) == pytest.approx(1.0, abs=0.1)


def test_tyler_is_a_fixed_point(blocks):
    x, long = blocks
    vec = G.vectors(long, ["t"], "v", "x", range(12))
    got = square(dependence.tyler_corr(vec, "vec").toPandas())
    c, z = np.eye(12), x - x.mean(1)[:, None]
    for _ in range(200):
        w = 1 / np.einsum("it,ij,jt->t", z, np.linalg.inv(c), z)
        c = (z * w) @ z.T
        c *= 12 / np.trace(c)
    d = np.sqrt(np.diag(c))
    assert np.allclose(got, c / np.outer(d, d), atol=1e-5)


@pytest.mark.parametrize("options", list(itertools.product(["pearson", "spearman", "gaussian_rank"], [0, 1], ["raw", "clip"], ["correlation", "partial"])))
def test_correlator_combinations(blocks, options):
    measure, modes, clean, output = options
    m = square(dependence.Correlator(measure, modes=modes, clean=clean, output=output).fit(blocks[1], "t", "v", "x", range(12)).toPandas())
    assert np.allclose(np.diag(m), 1) and np.abs(m).max() <= 1 + 1e-9


def test_oos_risk_blocks(blocks):
    x, long = blocks
    vec = G.vectors(long, ["t"], "v", "x", range(12))
    got = dependence.oos_risk(vec, "t", "vec", 100, 50, ["raw"]).toPandas().sort_values("block")
    assert got.block.tolist() == list(range(6)) and (got.n == 50).all()
    w = L.min_variance(np.cov(x[:, 50:150], ddof=0))
    assert got.realised.iloc[1] == pytest.approx((w @ x[:, 150:200]).std())


def test_pca_denoise_projects(blocks):
    x, long = blocks
    vec = G.vectors(long, ["t"], "v", "x", range(12))
    got = dependence.pca_denoise(vec, "vec").toPandas().sort_values("t")
    clean = np.stack(got.clean.to_numpy())
    kept = got.kept.iloc[0]
    u = L.spectrum(np.cov(x, ddof=0))[1][:, :kept]
    mean = x.mean(1)
    assert np.allclose(clean, (x.T - mean) @ u @ u.T + mean)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 3))
    u = np.convolve(rng.normal(size=n + 3), [1, 0.5, 0.25, 0.1], "valid")
    pdf = pd.DataFrame({"t": np.arange(n), "g": np.arange(n) % 7, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": 1 + 2 * x[:, 0] - x[:, 1] + u})
    return pdf, spark.createDataFrame(pdf).cache()


def test_ols_newey_west_and_shapley(panel):
    pdf, df = panel
    X = np.column_stack([np.ones(600), pdf[["a", "b"]]])
    b = np.linalg.lstsq(X, pdf.y, rcond=None)[0]
    assert np.allclose(regress.ols(df, "y", ["a", "b"]).first().beta, b)
    e = pdf.y.to_numpy() - X @ b
    m = X * e[:, None]
    meat = m.T @ m
    for lag in range(1, 6):
        g = m[lag:].T @ m[:-lag]
        meat = meat + (1 - lag / 6) * (g + g.T)
    bread = np.linalg.inv(X.T @ X)
    nw = regress.newey_west(df, [], "t", "y", ["a", "b"], 5).toPandas().sort_values("term")
    assert np.allclose(nw.se, np.sqrt(np.diag(bread @ meat @ bread)))
    sh = regress.shapley_r2(df, "y", {"one": ["a"], "two": ["b", "c"]}).toPandas()
    assert sh.share.sum() == pytest.approx(sh.total.iloc[0])


def test_out_of_sample_and_left_out_groups(panel):
    pdf, df = panel
    tr, te = pdf[pdf.t < 400], pdf[pdf.t >= 400]
    full = lambda d: np.column_stack([np.ones(len(d)), d[["a", "b", "c"]]])
    b = np.linalg.lstsq(full(tr), tr.y, rcond=None)[0]
    want = 1 - ((te.y - full(te) @ b) ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum()
    got = regress.oos_r2(df, "y", ["a", "b", "c"], F.col("t") < 400).toPandas()
    assert got[got.left_out.isna()].r2.iloc[0] == pytest.approx(want)
    sse = 0.0
    for g in range(7):
        a, o = pdf[pdf.g != g], pdf[pdf.g == g]
        sse += ((o.y - full(o) @ np.linalg.lstsq(full(a), a.y, rcond=None)[0]) ** 2).sum()
    out = regress.leave_group_out_r2(df, "g", "y", ["a", "b", "c"]).first()
    assert out.r2_out == pytest.approx(1 - sse / ((pdf.y - pdf.y.mean()) ** 2).sum()) and out.groups == 7


def test_cluster_bootstrap_covers_the_estimate(panel):
    pdf, df = panel
    got = regress.cluster_bootstrap(df, "g", "y", ["a", "b"], 100).toPandas().set_index("term")
    X = (pdf[["a", "b"]] - pdf[["a", "b"]].mean()) / pdf[["a", "b"]].std(ddof=0)
    b = np.linalg.lstsq(np.column_stack([np.ones(600), X]), pdf.y, rcond=None)[0]
    assert got.beta["a"] == pytest.approx(b[1]) and got.lo["a"] < b[1] < got.hi["a"]


def test_pca_index_and_decisions(panel):
    pdf, df = panel
    got = regress.pca_index(df, ["a", "y"]).toPandas().sort_values("t")
    z = (pdf[["a", "y"]] - pdf[["a", "y"]].mean()) / pdf[["a", "y"]].std(ddof=0)
    u = np.linalg.eigh(np.cov(z.T))[1][:, -1]
    assert np.allclose(got["index"], z.to_numpy() @ (u * np.sign(u.sum())))
    d = regress.expanding_decisions(df, [], "t", "y", ["a"], ["a"], "y", 3, 36, 3, 100).toPandas().sort_values("t")
    row = d.iloc[5]
    past = pdf[pdf.t <= row.t - 3]
    b = np.polyfit(past.a, past.y, 1)
    assert row.pred == pytest.approx(np.polyval(b, pdf.a[row.t])) and (np.diff(d.t) == 3).all()


def test_regression_kriging_beats_its_trend(spark):
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 200, size=(40, 2))
    gap = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    chol = np.linalg.cholesky(np.exp(-gap / 80) + 0.01 * np.eye(40))
    rows = [(d, s, s % 5, *map(float, xy[s]), float(v)) for d in range(15) for s, v in enumerate(chol @ rng.normal(size=40) + 0.01 * xy[:, 0])]
    df = spark.createDataFrame(rows, "d int, s int, fold int, x double, y double, v double")
    out = regress.regression_kriging(df, "d", "s", "fold", "x", "y", "v", ["x"]).toPandas()
    assert len(out) == 600
    assert ((out.pred - out.obs) ** 2).mean() < 0.7 * ((out.trend - out.obs) ** 2).mean()


def test_paired_bootstrap_point(panel):
    pdf, df = panel
    out = regress.paired_bootstrap(df.withColumn("m", F.col("a") * 2), "g", "y", "a", "m", 100).first()
    rmse = lambda e: math.sqrt((e**2).mean())
    assert out.difference == pytest.approx(rmse(pdf.a - pdf.y) - rmse(2 * pdf.a - pdf.y)) and out.lo <= out.hi


def test_resampling_invariants(spark):
    df = spark.createDataFrame([(k, i, float(i)) for k in ("p", "q") for i in range(100)], "k string, t int, x double")
    b = resample.block_resample(df, ["k"], "t", 7, 6).toPandas()
    assert b.groupby(["k", "draw"]).size().eq(100).all()
    runs = b.sort_values(["k", "draw", "slot"]).groupby(["k", "draw"]).t.diff()
    assert (runs == 1).mean() > 0.75
    one = resample.block_resample(df.repartition(3), ["k"], "t", 7, 6).toPandas()
    pick = lambda p: p.iloc[:, :].sort_values(list(p.columns)).to_numpy().tolist()
    assert pick(b[sorted(b.columns)]) == pick(one[sorted(one.columns)])
    st = resample.stationary_resample(df, ["k"], "t", 5, 6).toPandas()
    assert st.groupby(["k", "draw"]).size().eq(100).all()
    days = spark.createDataFrame([(s, d, float(s * 1000 + i)) for s in range(3) for i, d in enumerate(pd.date_range("2001-01-01", periods=400).date)], "s int, d date, x double")
    sh = resample.shuffle_within_months(days, "s", "d", "x", 2).toPandas()
    base = days.toPandas()
    for _, g in sh.groupby("draw"):
        assert sorted(g.x) == sorted(base.x) and (g.sort_values(["s", "d"]).x.to_numpy() != base.sort_values(["s", "d"]).x.to_numpy()).any()


def test_copulas(spark):
    assert np.allclose(copula.student_quantile(np.array([0.01, 0.3, 0.9]), 1.0), np.tan(np.pi * (np.array([0.01, 0.3, 0.9]) - 0.5)), rtol=1e-4)
    assert copula.student_quantile(np.array([0.975]), 10.0)[0] == pytest.approx(2.228139, abs=1e-4)
    rng = np.random.default_rng(4)
    z = rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], size=800)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": z[:, 0], "y": z[:, 1]}))
    fit = copula.gaussian_copula_fit(copula.pseudo_pair(df, ["k"], "x", "y"), ["k"], [i / 20 for i in range(-18, 19)]).first()
    assert fit.rho == pytest.approx(0.6, abs=0.06)


def test_hedging(spark):
    rng = np.random.default_rng(9)
    f = 100 * np.exp(np.cumsum(np.c_[np.zeros((40, 1)), rng.normal(size=(40, 63)) * 0.01], axis=1))
    rows = [("c", pd.Timestamp("2000-01-01").date(), pd.Timestamp("2000-04-01").date(), r.tolist(), [0.16] * 63, [0.16] * 63) for r in f]
    df = spark.createDataFrame(rows, "k string, start date, end date, f array<double>, s array<double>, g array<double>")
    out = hedging.hedge_backtest(df, "k").toPandas()
    sd = out.groupby("strategy").pnl.std()
    assert sd["daily"] < sd["weekly"] < sd["none"] and sd["garch"] == pytest.approx(sd["daily"])
    none = out[out.strategy == "none"].pnl.to_numpy()
    prem = out[out.strategy == "none"].premium.to_numpy()
    assert np.allclose(np.sort(none), np.sort(prem - np.maximum(f[:, -1] - f[:, 0], 0) / f[:, 0]))
    assert (out[out.strategy == "none"].trades == 0).all() and (out[out.strategy == "static"].trades == 1).all()


def test_garch_recovers_its_parameters():
    rng = np.random.default_rng(12)
    r, s2 = np.empty(4000), 1.0
    for t in range(4000):
        r[t] = math.sqrt(s2) * rng.normal()
        s2 = 0.05 + 0.1 * r[t] ** 2 + 0.85 * s2
    omega, alpha, beta = hedging.fit_garch(r)
    assert alpha == pytest.approx(0.1, abs=0.04) and beta == pytest.approx(0.85, abs=0.07) and omega > 0


@pytest.mark.parametrize("n", [60])
def test_components_and_cascades(spark, n):
    rng = np.random.default_rng(n)
    e = {tuple(sorted(p)) for p in rng.integers(0, n, size=(45, 2)).tolist() if p[0] != p[1]} | {(0, i) for i in range(1, 12)}
    df = spark.createDataFrame(list(e), "a long, b long")
    comp = {i: i for i in range(n)}
    for _ in range(n):
        for a, b in e:
            comp[a] = comp[b] = min(comp[a], comp[b])
    nodes = spark.range(n)
    got = {r.id: r.component for r in graph.connected_components(df, "a", "b", nodes).collect()}
    assert got == comp
    near = {i: {b for a, b in e if a == i} | {a for a, b in e if b == i} for i in range(n)}
    failed = {0}
    while True:
        more = {i for i in range(n) if i not in failed and near[i] & failed and len(near[i] & failed) >= 0.5 * len(near[i])}
        if not more:
            break
        failed |= more
    out = graph.threshold_cascade(df, "a", "b", spark.createDataFrame([(0,)], "id long"), 0.5)
    assert {r.id for r in out.collect()} == failed
    reach, todo = {5}, [5]
    while todo:
        for a, b in e:
            if a == todo[0] and b not in reach:
                reach.add(b)
                todo.append(b)
        todo.pop(0)
    assert {r.id for r in graph.cascade_reach(df, spark.createDataFrame([(5,)], "id long"), "a", "b").collect()} == reach


def test_correlated_threshold_matches_the_plain_formula_on_a_ring(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)], "a long, b long")
    assert graph.correlated_threshold(ring, "a", "b").first().threshold == pytest.approx(1.0)


def test_objects_and_masks(spark):
    img = np.full((16, 16), 0.1)
    img[3:6, 3:6] = 5.0
    img[10, 2:14] = 5.0
    df = spark.createDataFrame([(0, y, x, float(img[y, x])) for y in range(16) for x in range(16)], "scene int, iy int, ix int, v double")
    out = raster.detect_objects(df, "scene", F.col("v") > 1, "v", (16, 16), (2, 40), 1.0, 6.0).toPandas()
    assert out["size"].tolist() == [9] and out.cy.iloc[0] == 4.0
    land = raster.static_mask(df.withColumn("g", F.lit(1)), ["g"], "scene", F.col("v") > 1, 1, (16, 16), 0.6).toPandas()
    assert land[(land.iy == 4) & (land.ix == 4)].land.all() and not land[land.iy > 6].land.any()


def test_quality_catches_each_broken_copy(spark):
    hours, cells = range(48), range(3)
    sun = lambda h: max(0.0, math.cos(2 * math.pi * (h % 24 - 12) / 24))
    good = pd.DataFrame([(h, c, 285.0 + c, sun(h) * 0.5 * 1361 * 3600, sun(h)) for h in hours for c in cells], columns=["h", "c", "2t", "ssrd", "ins"])

    def failing(pdf):
        out = quality.run_checks(spark.createDataFrame(pdf), "h", 1, ["c"], "ssrd", "ins", {k: quality.RANGES[k] for k in ("2t", "ssrd")})
        return {r["check"] for r in out.collect() if not r["ok"]}

    assert failing(good) == set()
    assert failing(good[good.h != 20]) == {"time axis"}
    assert failing(good.assign(**{"2t": good["2t"] - 273.15})) == {"physical ranges"}
    assert failing(good.assign(ssrd=good.ssrd / 3600)) == {"units"}
    assert {"upper bound", "dark at night"} & failing(good.assign(ssrd=np.roll(good.ssrd, 18)))
    holes = good.astype(object).copy()
    holes.loc[5, "2t"] = None
    df = spark.createDataFrame(holes.where(holes.notna(), None).values.tolist(), "h long, c long, `2t` double, ssrd double, ins double")
    bad = {r["check"] for r in quality.run_checks(df, "h", 1, ["c"], "ssrd", "ins", {"ssrd": quality.RANGES["ssrd"]}).collect() if not r["ok"]}
    assert bad == {"missing values"}


@pytest.mark.parametrize("modes", [0, 2])
def test_linear_shrinkage_measures_the_noise_of_the_data(blocks, modes):
    x, long = blocks
    got = square(dependence.Correlator(modes=modes, clean="linear_shrinkage").fit(long, "t", "v", "x", range(12)).toPandas())
    z = (x - x.mean(1)[:, None]) / x.std(1)[:, None]
    left, u, _ = L.remove_modes(np.corrcoef(x), modes)
    z = z - u @ (u.T @ z)
    z = z / z.std(1)[:, None]
    errors = np.mean([((np.outer(v, v) - left) ** 2).sum() for v in z.T]) / z.shape[1]
    assert np.allclose(got, L.clean(left, 400, "linear_shrinkage", modes, errors), atol=1e-8)


def test_normal_expressions(spark):
    from statistics import NormalDist

    from strandline.functions.normal import normal_cdf, normal_quantile

    u = [1e-12, 1e-6, 0.02, 0.075, 0.3, 0.5, 0.8, 0.925, 0.999999]
    x = [-30.0, -8.0, -7.06, -3.3, -0.1, 0.0, 0.7, 5.0, 9.0]
    rows = spark.createDataFrame([*zip(u, x), (0.0, None), (1.0, None), (None, None)], "u double, x double").select(normal_quantile("u").alias("q"), normal_cdf("x").alias("p")).collect()
    assert [r["q"] for r in rows[:9]] == pytest.approx([NormalDist().inv_cdf(v) for v in u], abs=1e-12)
    assert [r["p"] for r in rows[:9]] == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in x], abs=1e-14)
    assert all(r["q"] is None and r["p"] is None for r in rows[9:])


def test_null_keys_and_values_keep_their_rows(spark):
    """One key holds most rows, one is null, and some values are null."""
    from strandline.operators import aggregate

    rng = np.random.default_rng(2)
    rows = [(None if i % 11 == 0 else "hot" if i % 10 else "cold", i, None if i % 17 == 3 else float(rng.integers(0, 40))) for i in range(900)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "x"])
    df = spark.createDataFrame(rows, "k string, t int, x double")
    group = pdf.assign(k=pdf.k.fillna("?")).groupby("k").x
    got = ordering.average_rank(df, ["k"], "x").toPandas().sort_values("t")
    assert np.allclose(got["rank"].to_numpy(float), group.rank().to_numpy(), equal_nan=True)
    got = aggregate.median_anomaly(df, ["k"], "x", "a").toPandas().sort_values("t")
    assert np.allclose(got["a"].to_numpy(float), (pdf.x - group.transform("median")).to_numpy(), equal_nan=True)
    got = ordering.row_position(df, ["k"], ["t"], (F.col("t") / 100).cast("int")).toPandas().sort_values("t")
    assert (got["pos"].to_numpy() == group.cumcount().to_numpy() + 1).all()
    got = ordering.sliced_lag(df, ["k"], ["t"], {"before": "t"}, (F.col("t") / 100).cast("int")).toPandas().sort_values("t")
    want = pdf.assign(k=pdf.k.fillna("?")).groupby("k").t.shift()
    assert np.allclose(got["before"].to_numpy(float), want.to_numpy(), equal_nan=True)
    q = ordering.quantile_columns(df, ["k"], "x", {"m": 0.5}).toPandas().set_index("k")["m"]
    assert len(q) == 3 and q[q.index.isna()].iloc[0] == group.median()["?"]


def test_no_round_or_fold_is_cut(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    reach = graph.cascade_reach(chain, spark.createDataFrame([(0,)], "id long"), "src", "dst")
    assert reach.count() == 13
    rows = spark.createDataFrame([(y, float(x), 2.0 * x + y % 2) for y in range(2000, 2014) for x in range(9)], "y int, x double, z double")
    assert regress.time_ordered_cv(rows, F.col("y"), "z", ["x"]).count() == 11
    rng = np.random.default_rng(1)
    vec = spark.createDataFrame([(rng.normal(size=3).tolist(),) for _ in range(50)], "vec array<double>")
    with pytest.raises(RuntimeError):
        dependence.tyler_corr(vec, "vec", max_iterations=2)


def test_vectors_want_each_variable_once(spark):
    rows = spark.createDataFrame([(1, v, float(v)) for v in (0, 0, 2)] + [(2, v, float(v)) for v in range(3)], "t int, v int, x double")
    assert [r["t"] for r in G.vectors(rows, ["t"], "v", "x", range(3)).collect()] == [2]


def test_a_run_at_the_end_stays_open(spark):
    from strandline.operators import windows

    rows = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 1.0), ("a", 3, 9.0), ("a", 4, None)], "k string, t int, x double")
    got = windows.episodes(rows, ["k"], "t", F.col("x") > 5).orderBy("start").collect()
    assert [(r["start"], r["length"], r["closed"]) for r in got] == [(1, 1, True), (3, 1, False)]


def test_threshold_cascade_in_slices_that_follow_the_rows(spark):
    """Links given twice and both ways, loops and missing ends; the slices are more than the shuffle partitions."""
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 60, (150, 2))]
    rows += rows[:10] + [(b, a) for a, b in rows[5:25]] + [(3, 3), (None, 4), (4, None)]
    links = set(rows) | {(b, a) for a, b in rows}
    near = {v: [a for a, b in links if b == v] for v in {b for _, b in links}}
    want, step = dict.fromkeys(range(8), 0), 0
    while new := [v for v, f in near.items() if v is not None and v not in want and sum(a in want for a in f if a is not None) >= max(0.4 * len(f), 1)]:
        step += 1
        want |= dict.fromkeys(new, step)
    df, seeds = spark.createDataFrame(rows, "a long, b long"), spark.createDataFrame([(i,) for i in range(8)], "id long")
    out = graph.threshold_cascade(df, "a", "b", seeds, 0.4, slice_rows=20)
    assert {r["id"]: r["round"] for r in out.collect()} == want and step > 1
