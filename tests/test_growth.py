"""Steps that must neither depend on the order of sums nor grow faster than their input."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from strandline.operators import aggregate, dependence, hedging, joins, ordering, raster, spatial, statistics


def test_grid_scores_ties_of_large_values(spark):
    """Sites with the same values, added up in another order, share their rank."""
    rng = np.random.default_rng(3)
    rows = []
    for base in range(8):
        obs = 250_000 + 1_000 * base + rng.normal(0, 500, 7)
        for copy in range(6):
            noise = rng.normal(0, 2e-9, 7)
            rows += [(base + 100 * copy, 1990 + y, 40.0 + base + y * 0.5 * base + 3 * copy, float(obs[y] + noise[y])) for y in range(7)]
    score = lambda rs: hedging.grid_scores(spark.createDataFrame(rs, "site int, year int, m double, o double").selectExpr("1.0D AS p", "*"), ["p"], "site", "year", "m", "o", 5)
    exact = [(s, y, m, round(o, 6)) for s, y, m, o in rows]
    got, want = score(rows).first(), score(exact).first()
    assert got["level"] == pytest.approx(want["level"], abs=1e-12)
    assert got["trend"] == pytest.approx(want["trend"], abs=1e-12)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_looks_up_a_position_once(spark):
    """Copies of a position are one look-up: few places are an array beside it, not rows of their own."""
    points = spark.range(4000).selectExpr("id AS p", "CAST(id % 7 AS DOUBLE) AS lat", "CAST(id % 5 AS DOUBLE) AS lon")
    grid = spark.createDataFrame([(1, 0.0, 0.0), (2, 6.0, 4.0), (3, 3.0, 2.0)], "gid long, lat double, lon double")
    out = spatial.nearest(points, grid, "p", "gid")
    near = {tuple(r) for r in out.join(points, "p").select("lat", "lon", "gid").distinct().collect()}
    assert out.count() == 4000 and len(near) == 35
    assert (0.0, 0.0, 1) in near and (6.0, 4.0, 2) in near and (3.0, 2.0, 3) in near
    assert "Aggregate [_pid" not in _plan(out)


def test_regrid_sums_nothing_by_point(spark):
    coarse = spark.createDataFrame([("a", y, x, float(10 * y + x)) for y in range(3) for x in range(3) if (y, x) != (1, 1)], "k string, iy int, ix int, v double")
    fine = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.5, 0.5), (3, 1.0, 1.0), (4, 9.0, 9.0)], "f long, row double, col double")
    out = raster.bilinear_regrid(coarse, fine, ["k"], "v", "f", (3, 3))
    got = {r["f"]: r["v"] for r in out.collect()}
    assert got == {1: 0.5, 2: 0.25 * (0 + 1 + 10), 4: 22.0}  # a missing corner has no share; point 3 lies on it
    assert "Aggregate [k" not in _plan(out).split("Join")[0]


def test_top_rows_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([(k % 3, float(k)) for k in range(60)] + [(None, 5.0), (9, None)], "k int, x double")
    out = aggregate.top_k_mean(df, ["k"], "x", 3)
    assert {r["k"]: r["top"] for r in out.collect()} == {0: 54.0, 1: 55.0, 2: 56.0, None: 5.0}
    assert "WindowGroupLimit" in _plan(out)


def test_shared_times_give_the_same_answers(spark):
    left = spark.createDataFrame([(i, "ab"[i % 2], i % 11) for i in range(300)] + [(900, None, 3), (901, "a", 99)], "id int, k string, t int")
    right = spark.createDataFrame([(k, t, 10 * t) for k in ("a", "b", None) for t in (0, 2, 3, 7, 10)], "k string, t int, x int")
    plain = joins.asof_next(left, right, ["k"], "t", ["x"])
    once = joins.asof_next(left, right, ["k"], "t", ["x"], shared_times=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, plain.select(once.columns).collect()))
    assert "Window" not in _plan(once)  # the rows themselves are joined, not sorted in ranges


def test_quantiles_and_tails_order_one_range_only(spark, monkeypatch):
    """Whole ranges count by their sums; the rows that are ordered are those of the ranges the cuts go through."""
    rng = np.random.default_rng(5)
    x = {"a": np.round(rng.normal(0, 100, 5000), 1), None: np.repeat(7.0, 300), "b": np.array([3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in x.items() for v in vs] + [("b", None)], "k string, x double")
    joined = []
    inner = ordering._ranked_inside
    monkeypatch.setattr(ordering, "_ranked_inside", lambda ranged, wanted, *a: joined.append(ordering.join_on(ranged, wanted, ["k", "_range"]).where("k = 'a'").count()) or inner(ranged, wanted, *a))
    got = {(r["k"], r["q"]): r["x"] for r in ordering.exact_quantiles(df, ["k"], "x", [0.05, 0.5, 1.0]).collect()}
    for k, vs in x.items():
        for q in (0.05, 0.5, 1.0):
            assert got[k, q] == pytest.approx(np.quantile(vs, q), abs=1e-12)
    for largest in (False, True):
        tail = ordering.tail_mean(df, ["k"], "x", F.ceil(F.col("n_all") * 0.1), "m", largest)
        for r in tail.collect():
            vs = np.sort(x[r["k"]])[:: -1 if largest else 1]
            assert r["m"] == pytest.approx(vs[: int(np.ceil(len(vs) * 0.1))].mean(), abs=1e-9)
    assert len(joined) == 3 and max(joined) < 500


def test_draws_of_a_median_weigh_far_ranges_once(spark, monkeypatch):
    monkeypatch.setattr(statistics, "RANGE", 16)
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([("ab"[i % 2], i % 150, float(v)) for i, v in enumerate(np.round(rng.normal(0, 50, 6000), 1))], "k string, u int, x double")
    calls = []
    draws = statistics._draws
    monkeypatch.setattr(statistics, "_draws", lambda df, *a: calls.append(df.select("k", "_range").distinct().count()) or draws(df, *a))
    got = {(r["k"], r["draw"]): r["value"] for r in statistics.median("x").drawn(rows, ["k"], ["u"], 6, 1).collect()}
    ranges = len(calls) and calls[0]
    assert 0 < ranges < 300  # of some 375 ranges of 16 rows
    w = draws(rows, ["u"], 6, 1).select("k", "draw", "x", "_w").toPandas()
    for (k, d), part in w.groupby(["k", "draw"]):
        assert got[k, d] == pytest.approx(np.median(np.repeat(part["x"], part["_w"])), abs=1e-12)


def test_oos_risk_numbers_no_table_in_one_task(spark):
    """Observations are numbered in ranges: no window goes over all of them, and blocks are those of the plain order."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(330, 3))
    vec = spark.createDataFrame([(int(1000 - 3 * i), [float(v) for v in x[i]]) for i in range(330)], "t long, vec array<double>").repartition(5)
    out = dependence.oos_risk(vec, "t", "vec", 60, 30, ["raw"])
    assert "Window [row_number" not in _plan(out)
    got = {r["block"]: r for r in out.collect()}
    rows = x[::-1]
    for b in range(9):
        train, test = rows[30 * b : 30 * b + 60], rows[30 * b + 60 : 30 * b + 90]
        w = np.linalg.solve(np.cov(train.T, ddof=0), np.ones(3))
        assert got[b]["n"] == 30 and got[b]["realised"] == pytest.approx((test @ (w / w.sum())).std())
    assert len(got) == 9


def test_correlator_reads_its_scores_and_sums_from_one_write(spark):
    """Ranking and the sums of products run once, however many parts of the matrix read them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4))
    long = spark.createDataFrame([(t, v, float(x[t, v])) for t in range(80) for v in range(4)], "t long, var int, value double")
    fit = dependence.Correlator(measure="spearman", effective_n="bartlett").fit(long, "t", "var", "value", range(4))
    got = {(r["i"], r["j"]): r["r"] for r in fit.collect()}
    ranks = np.argsort(np.argsort(x, 0), 0)
    assert all(got[i, j] == pytest.approx(np.corrcoef(ranks[:, i], ranks[:, j])[0, 1]) for i in range(4) for j in range(i, 4))
    assert "MapInPandas" not in _plan(fit)
