"""Medians of pairwise slopes by selection against all pairs."""

import numpy as np
import pandas as pd
import pytest

from strandline.operators import slopes


def _brute(t, x):
    ok = np.isfinite(t) & np.isfinite(x)
    t, x = t[ok], x[ok]
    i, j = np.triu_indices(len(t), 1)
    use = t[i] != t[j]
    i, j = i[use], j[use]
    return np.median((x[j] - x[i]) / (t[j] - t[i])) if len(i) else None


def _groups(rng):
    n = 500
    t = np.sort(rng.uniform(0, 50, n))
    return {
        "line": (t, 2 * t + rng.normal(0, 3, n)),
        "steps": (np.arange(n) // 3 * 1.0, rng.integers(0, 4, n) * 1.0),  # most slopes tie at zero
        "thirds": (np.arange(n) * 3.0, np.arange(n) * 1.0 + (rng.uniform(size=n) < 0.2) * rng.normal(0, 9, n)),  # ties at 1/3, which is not exact
        "halves": (np.repeat([0.0, 1.0], n // 2), np.r_[np.zeros(n // 2), np.tile([0.0, 1.0], n // 4)]),  # the two middle slopes differ
        "far": (t, np.where(np.arange(n) % 50 == 0, 1e9, np.cos(t))),
        "one time": (np.full(n, 7.0), rng.normal(size=n)),
        "copies": (np.tile(t[: n // 10], 10), np.tile(np.sin(t[: n // 10]) * 5, 10)),
        None: (t - 1e6, rng.normal(0, 1, n) - 0.1 * t),
        "short": (np.arange(9.0), rng.normal(size=9)),
        "gaps": (np.where(np.arange(n) % 7 == 0, np.nan, t), np.where(np.arange(n) % 5 == 0, np.inf, t**2)),
        "single": (np.array([1.0]), np.array([2.0])),
    }


@pytest.mark.parametrize("listed", [64, 3])
def test_selected_slopes_equal_all_pairs(spark, listed):
    groups = _groups(np.random.default_rng(5))
    rows = pd.concat([pd.DataFrame({"k": pd.Series([k] * len(t), dtype=object), "t": t, "x": x, "z": -x}) for k, (t, x) in groups.items()]).sample(frac=1, random_state=1)
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "k string, t double, x double, z double")
    got = {r["k"]: r for r in slopes.median_slopes(df, ["k"], "t", ["x", "z"], listed).collect()}
    assert set(got) == set(groups)
    for k, (t, x) in groups.items():
        want = _brute(t, x)
        assert got[k]["n_years"] == len(t)
        if want is None:
            assert got[k]["x_slope"] is None and got[k]["z_slope"] is None
        else:
            assert got[k]["x_slope"] == pytest.approx(want, rel=1e-11, abs=1e-12), k
            assert got[k]["z_slope"] == pytest.approx(-want, rel=1e-11, abs=1e-12), k


def test_no_key_and_no_rows(spark):
    rng = np.random.default_rng(6)
    t, x = rng.uniform(0, 9, 300), rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"t": t, "x": x}), "t double, x double")
    whole = slopes.median_slopes(df, [], "t", ["x"]).collect()
    assert [r["x_slope"] for r in whole] == [pytest.approx(_brute(t, x), rel=1e-11)]
    assert slopes.median_slopes(df.limit(0).withColumn("k", df.x), ["k"], "t", ["x"]).count() == 0
