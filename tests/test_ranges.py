"""Planned time ranges: as-of joins, positions and overlapping intervals of one crowded series, with null keys."""

import numpy as np
import pandas as pd
import pytest

from strandline.operators import joins, ordering, windows


def _series(rng, n):
    keys = np.where(np.arange(n) % 10 > 0, "hot", rng.choice(["a", "b"], n)).astype(object)
    keys[::50] = None
    t = np.round(np.r_[rng.uniform(0, 10, n // 2), rng.uniform(0, 10000, n - n // 2)], 1)
    return pd.DataFrame({"k": keys, "t": t, "v": np.arange(n)})


def test_asof_of_a_crowded_series(spark):
    rng = np.random.default_rng(1)
    left, right = _series(rng, 1500), _series(rng, 1200)
    frame = lambda d: spark.createDataFrame(d, "k string, t double, v long")
    l, r = frame(left).withColumnRenamed("v", "id"), frame(right).withColumnRenamed("v", "x")
    last = {row["id"]: row["x"] for row in joins.asof_last(l, r, ["k"], "t", ["x"], tie=["x"]).collect()}
    nxt = {row["id"]: row["x"] for row in joins.asof_next(l, r, ["k"], "t", ["x"], tie=["x"]).collect()}
    assert len(last) == len(nxt) == len(left)
    for k, group in left.groupby("k", dropna=False):
        own = right[right.k.isna() if pd.isna(k) else right.k == k].sort_values(["t", "v"])
        for i, t in zip(group.v, group.t):
            before, after = own[own.t <= t], own[own.t >= t]
            assert last[i] == (before.v.iloc[-1] if len(before) else None)
            assert nxt[i] == (after.v.iloc[0] if len(after) else None)


def test_every_seventh_of_a_crowded_series(spark):
    d = _series(np.random.default_rng(2), 2000)
    got = {r["v"] for r in windows.every_kth(spark.createDataFrame(d, "k string, t double, v long"), ["k"], ["t", "v"], 7).collect()}
    want = {v for _, g in d.sort_values(["t", "v"]).groupby("k", dropna=False) for v in g.v.iloc[::7]}
    assert got == want


@pytest.mark.parametrize("endpoints", [512, 3])
def test_overlapping_intervals(spark, monkeypatch, endpoints):
    monkeypatch.setattr(joins, "ENDPOINTS", endpoints)
    monkeypatch.setattr(ordering, "WIDE", 8 if endpoints == 3 else 256)
    rng = np.random.default_rng(3)

    def side(n):
        start = np.round(np.r_[rng.uniform(0, 5, n // 2), rng.uniform(0, 500, n - n // 2)], 1)
        length = np.where(rng.random(n) < 0.05, 300, np.round(rng.exponential(1, n), 1))
        k = np.where(rng.random(n) < 0.9, 1.0, np.where(rng.random(n) < 0.5, 2.0, np.nan))
        return pd.DataFrame({"k": pd.array(k, "Int64"), "start": start, "end": start + length, "id": range(n)})

    a, b = side(400), side(300)
    frame = lambda d: spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in d.astype(object).itertuples(index=False)], "k long, start double, end double, id long")
    for keys in (["k"], []):
        drop = [] if keys else ["k"]
        got = joins.interval_overlap(frame(a).drop(*drop), frame(b).drop(*drop), keys, "start", "end").select("a_id", "b_id").collect()
        same = (a.k.fillna(-1).to_numpy()[:, None] == b.k.fillna(-1).to_numpy()) if keys else True
        hit = same & (a.start.to_numpy()[:, None] < b.end.to_numpy()) & (b.start.to_numpy() < a.end.to_numpy()[:, None])
        hit &= (a.end > a.start).to_numpy()[:, None] & (b.end > b.start).to_numpy()
        assert sorted((r["a_id"], r["b_id"]) for r in got) == sorted(zip(*map(list, np.nonzero(hit))))


def test_null_keys_stay(spark):
    from strandline.operators import hedging, regress

    d = _series(np.random.default_rng(4), 600)
    df = spark.createDataFrame(d, "k string, t double, v long")
    assert {r["k"] for r in windows.autocorr(df, ["k"], "v", "t", 3).collect()} == {"hot", "a", "b", None}
    from pyspark.sql import functions as F

    assert {r["k"] for r in hedging.importance_summary(df, ["k"], "t", F.lit(0.0)).collect()} == {"hot", "a", "b", None}
    years = spark.createDataFrame([(s, y, y * 2.0 + (y % 3), float(y % 5)) for s in ("a", None) for y in range(1990, 2015)], "s string, y long, value double, x double")
    assert {r["s"] for r in regress.residual_trend(years, "s", "y", "value", "x").collect()} == {"a", None}


@pytest.mark.parametrize("block, max_lag", [(1 << 14, None), (7, None), (7, 3), (5, 60)])
def test_autocorrelation_across_blocks(spark, block, max_lag):
    rng = np.random.default_rng(11)
    values = {"hot": rng.normal(3, 1, 900).cumsum(), "short": np.array([1.0, 4.0, 2.0]), "one": np.array([5.0]), "flat": np.full(30, 2.5), None: rng.normal(0, 1, 50), "gaps": rng.normal(0, 1, 80)}
    values["gaps"][::7] = np.nan
    rows = [(k, int(i * 3), None if np.isnan(v) else float(v)) for k, x in values.items() for i, v in enumerate(x)]
    rng.shuffle(rows := np.array(rows, object))
    df = spark.createDataFrame([tuple(r) for r in rows], "k string, t long, v double")
    got = {(r["k"], r["lag"]): (r["n"], r["rho"]) for r in windows.autocorr(df, ["k"], "t", "v", max_lag, block).collect()}
    want = {}
    for k, x in values.items():
        c = x - np.nanmean(x)
        for lag in range(1, min(int(len(x) ** 0.5) if max_lag is None else max_lag, len(x) - 1) + 1):
            v, a = np.nanmean(c * c), np.nanmean(c[:-lag] * c[lag:])
            want[k, lag] = (len(x), a / v if v > 0 else 0.0)
    assert got.keys() == want.keys()
    for at, (n, rho) in want.items():
        assert got[at][0] == n and abs(got[at][1] - rho) < 1e-9
    alone = windows.autocorr(df.where("k = 'hot'").drop("k"), [], "t", "v", 4, block).collect()
    assert {r["lag"]: round(r["rho"], 9) for r in alone} == {lag: round(v, 9) for (k, lag), (_, v) in _autocorrelations("hot", values, 4).items()}
    assert windows.autocorr(df.where("false"), ["k"], "t", "v", max_lag, block).count() == 0


def _autocorrelations(key, values, lags):
    c = values[key] - values[key].mean()
    return {(key, lag): (len(c), (c[:-lag] * c[lag:]).mean() / (c * c).mean()) for lag in range(1, lags + 1)}


def test_binned_medians_with_a_crowded_value(spark):
    from strandline.operators import aggregate

    rng = np.random.default_rng(7)
    x = np.r_[np.full(300, 5.0), np.round(rng.uniform(0, 10, 500), 2)]
    y = np.where(rng.random(800) < 0.5, 1.25, np.round(rng.normal(0, 3, 800), 1))
    rows = [(float(a), None if k % 9 == 0 else float(b)) for k, (a, b) in enumerate(zip(x, y))] + [(None, 1.0)]
    got = aggregate.binned_median(spark.createDataFrame(rows, "x double, y double"), "x", "y", 4, slices=16).toPandas().set_index("bin")
    d = pd.DataFrame(rows, columns=["x", "y"]).dropna(subset=["x"])
    d["bin"] = sum((d.x >= d.x.quantile(q)).astype(int) for q in (0.25, 0.5, 0.75))
    want = d.groupby("bin").agg(x=("x", "median"), y=("y", "median"), n=("x", "size"))
    assert sorted(got.index) == sorted(want.index)
    for c in want:
        assert np.allclose(got.loc[want.index, c].astype(float), want[c])
