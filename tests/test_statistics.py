"""Bootstrap intervals of mergeable statistics against a replay of the same weights in NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import statistics as S


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    n = 900
    d = pd.DataFrame({"k": rng.choice(np.array(["a", "b", None], dtype=object), n, p=[0.9, 0.05, 0.05]), "u": rng.integers(0, 60, n), "x": np.round(rng.normal(3, 2, n), 1)})
    d["y"] = d.x * 0.5 + rng.normal(size=n)
    d.loc[::40, "x"] = np.nan
    return d


def _spark(spark, d):
    rows = d.astype(object).where(d.notna(), None)
    return spark.createDataFrame(rows, "k string, u long, x double, y double")


def _weights(spark, units, draws, seed):
    w = S.poisson_weight(F.lit(seed), F.col("draw"), F.col("u"))
    at = spark.createDataFrame([(int(u), d) for u in units for d in range(draws)], "u long, draw int")
    return {(r["u"], r["draw"]): r["w"] for r in at.select("u", "draw", w.alias("w")).collect()}


def _mean(g):
    return g.x.mean()


def _corr(g):
    both = g.dropna(subset=["x", "y"])
    return np.corrcoef(both.x, both.y)[0, 1]


@pytest.mark.parametrize("name, statistic, plain", [("mean", lambda: S.mean("x"), _mean), ("median", lambda: S.median("x"), lambda g: g.x.median()), ("corr", lambda: S.correlation("x", "y"), _corr)])
def test_intervals_equal_a_replay(spark, table, name, statistic, plain, monkeypatch):
    monkeypatch.setattr(S, "RANGE", 50)
    draws, seed = 30, 4
    got = {r["k"]: r for r in S.interval(_spark(spark, table), ["k"], ["u"], statistic(), draws, seed).collect()}
    w = _weights(spark, table.u.unique(), draws, seed)
    groups = {k: table[table.k.isna() if k is None else table.k == k] for k in ("a", "b", None)}
    assert len(got) == len(groups) == 3
    for k, g in groups.items():
        r = got[k]
        assert r["value"] == pytest.approx(plain(g), rel=1e-9)
        boot = [plain(g.loc[g.index.repeat([w[u, d] for u in g.u])]) for d in range(draws)]
        assert r["draws"] == draws
        assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.quantile(boot, [0.05, 0.95])), rel=1e-8)


def test_own_statistic_empty_groups_and_tables(spark, table):
    ratio = S.Sums([F.col("x"), F.col("y")], lambda a, b: F.try_divide(a, b))
    df = _spark(spark, table)
    hollow = df.withColumn("k", F.lit("none")).withColumn("x", F.lit(None).cast("double"))
    got = {r["k"]: r for r in S.interval(df.unionByName(hollow), ["k"], ["u"], ratio, 10).collect()}
    assert got["a"]["lo"] < got["a"]["value"] < got["a"]["hi"]
    assert got["none"]["value"] is None and got["none"]["lo"] is None
    for statistic in (ratio, S.median("x")):
        assert S.interval(df.limit(0), ["k"], ["u"], statistic, 10).count() == 0


def test_weights_are_poisson(spark):
    r = spark.range(20000).select(S.poisson_weight(F.lit(1), F.col("id")).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("z")).first()
    assert r["m"] == pytest.approx(1, abs=0.03) and r["v"] == pytest.approx(1, abs=0.05) and r["z"] == pytest.approx(np.exp(-1), abs=0.012)


def test_block_forms_take_a_statistic(spark, table):
    from strandline.operators import resample

    d = table[table.k == "a"].dropna().reset_index(drop=True).assign(t=lambda g: np.arange(len(g)) * 1.0)
    df = spark.createDataFrame(d, "k string, u long, x double, y double, t double")
    on = d[d.y > 1]
    for statistic, want in ((S.median("x"), on.x.median()), (S.correlation("x", "y"), _corr(on)), (S.mean("x"), on.x.mean())):
        r = resample.block_ci(df, ["k"], "t", "x", F.col("y") > 1, 20, statistic=statistic).first()
        assert r["n"] == len(on) and r["value"] == pytest.approx(want, rel=1e-9) and r["lo"] <= r["hi"]
    plain = resample.block_ci(df, ["k"], "t", "x", F.col("y") > 1, 20).first()
    assert (plain["lo"], plain["hi"]) == pytest.approx((r["lo"], r["hi"]), rel=1e-9)
    p = resample.permutation_p(df, "t", "x", F.col("y") > 1, 20, statistic=S.median("x")).first()
    assert p["observed"] == pytest.approx(on.x.median()) and 0 <= p["p_value"] <= 1 and p["draws"] == 20


def test_flag_rule_with_intervals(spark, table):
    from strandline.operators import regress

    df = _spark(spark, table)
    flags = {"high": F.col("y") > 1, "never": F.col("y") > 1e9}
    got = {(r["k"], r["flag"]): r for r in regress.flag_rule(df, ["k"], "x", flags, unit=["u"], draws=40).collect()}
    bare = {(r["k"], r["flag"]): r for r in regress.flag_rule(df, ["k"], "x", flags).collect()}
    assert set(got) == set(bare) and len(got) == 6
    for key, r in got.items():
        assert (r["n"], r["mean"], r["all_rows"]) == (bare[key]["n"], bare[key]["mean"], bare[key]["all_rows"])
        assert r["lo"] is None if key[1] == "never" else r["lo"] <= r["mean"] <= r["hi"]
