"""Nearest neighbours against all distances: a crowded town, copies, groups, nulls, poles and the date line."""

import numpy as np
import pandas as pd
import pytest

from strandline.operators.spatial import nearest


def _crowded(rng, town, world):
    near = np.c_[45 + rng.random(town) * 0.05, 7 + rng.random(town) * 0.05]
    far = np.c_[rng.uniform(-90, 90, world), rng.uniform(-180, 180, world)]
    edge = np.array([[90.0, 0.0], [-90.0, 10.0], [0.0, 180.0], [0.0, -180.0], [10.0, 179.99], [10.0, -179.99]])
    return np.r_[near, far, edge].round(5)


def _km(p, g):
    la1, la2 = np.radians(p[:, 0])[:, None], np.radians(g[:, 0])
    dlon = np.radians(g[:, 1] - p[:, 1][:, None])
    a = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin(dlon / 2) ** 2
    return (2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(a, 1)))).round(9)


@pytest.mark.parametrize("group", [None, "g"])
@pytest.mark.parametrize("size", [(4, 2), (1800, 200)])
def test_nearest_in_a_crowd(spark, group, size):
    rng = np.random.default_rng(2)
    p, g = _crowded(rng, 450, 60), _crowded(rng, *size)
    g = np.r_[g, np.repeat(g[:1], 300, axis=0)]  # copies of one place
    pg, gg = rng.integers(0, 3, len(p)), np.where(np.arange(len(g)) % 10 > 0, 1, rng.integers(0, 3, len(g)))
    points = spark.createDataFrame(pd.DataFrame({"pid": range(len(p)), "lat": p[:, 0], "lon": p[:, 1], "g": pg}))
    grid = spark.createDataFrame(pd.DataFrame({"gid": range(len(g)), "lat": g[:, 0], "lon": g[:, 1], "g": gg}))
    nothing = "CAST(NULL AS DOUBLE)"
    points = points.unionByName(spark.sql(f"SELECT -1L AS pid, {nothing} AS lat, 1D AS lon, 1L AS g"))
    grid = grid.unionByName(spark.sql(f"SELECT -1L AS gid, 1D AS lat, {nothing} AS lon, 1L AS g"))
    got = nearest(points, grid, "pid", "gid", group=group).toPandas().sort_values("pid")
    km = _km(p, g)
    if group:
        km = np.where(pg[:, None] == gg, np.inf, km)
    assert len(got) == len(p) and np.abs(got.km.to_numpy() - km.min(axis=1)).max() < 2e-9
    assert np.abs(km[np.arange(len(p)), got.gid] - km.min(axis=1)).max() < 2e-9
    copies = got.gid[np.isin(got.gid, [0, *range(len(g) - 300, len(g))])]
    assert group or (copies == 0).all(), "the smallest id of a place"


def test_no_other_group_and_no_rows(spark):
    one = spark.sql("SELECT 1L AS id, 1D AS lat, 2D AS lon, 'a' AS g UNION ALL SELECT 2L, 3D, 4D, NULL")
    assert nearest(one, one.withColumnRenamed("id", "other"), "id", "other", group="g").count() == 0
    assert nearest(one.where("id > 5"), one.withColumnRenamed("id", "other"), "id", "other").count() == 0
    assert nearest(one, one.withColumnRenamed("id", "other").where("other > 5"), "id", "other").count() == 0


def test_a_cell_meets_few_nodes(spark):
    """Most of the grid lies in one town; the plan holds no all-by-all join of it."""
    rng = np.random.default_rng(3)
    g = _crowded(rng, 3000, 50)
    grid = spark.createDataFrame(pd.DataFrame({"gid": range(len(g)), "lat": g[:, 0], "lon": g[:, 1]}))
    plan = nearest(grid.withColumnRenamed("gid", "pid"), grid, "pid", "gid")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan.replace("Join Cross, rightHint=(strategy=broadcast)", "")


def test_rank_dependence_keeps_null_keys_and_many_slices(spark):
    from strandline.operators import dependence

    rng = np.random.default_rng(6)
    x = rng.integers(0, 60, 900) / 4
    y = np.round(x + rng.normal(0, 3, 900), 1)
    y[:200] = 1.5
    rows = pd.DataFrame({"k": ["a"] * 500 + [None] * 400, "x": x, "y": y})
    df = spark.createDataFrame(rows, "k string, x double, y double")
    tau = {r["k"]: r["tau"] for r in dependence.kendall(df, ["k"], "x", "y", slices=24).collect()}
    dcor = {r["k"]: r["dcor"] for r in dependence.distance_corr(df, ["k"], "x", "y", slices=24).collect()}
    for k, lo, hi in (("a", 0, 500), (None, 500, 900)):
        a, b = x[lo:hi], y[lo:hi]
        sx, sy = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
        assert tau[k] == pytest.approx((sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum()), abs=1e-12)
        da, db = np.abs(a[:, None] - a), np.abs(b[:, None] - b)
        centre = lambda d: d - d.mean(0) - d.mean(1)[:, None] + d.mean()
        ca, cb = centre(da), centre(db)
        assert dcor[k] == pytest.approx(np.sqrt((ca * cb).mean() / np.sqrt((ca**2).mean() * (cb**2).mean())), abs=1e-9)
