"""Regression, forecast tests and validation from sufficient statistics.

A fit needs only the sums of products of its columns.  They are aggregated once with
partial aggregation; training and test scores, dropped drivers, subsets, bootstrap draws
and left-out groups are all solved from those sums, never from the rows again.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from strandline.functions import columns as C
from strandline.functions import linalg as L
from strandline.operators import gram as G
from strandline.operators import statistics as S
from strandline.operators.ordering import exact_quantiles, join_on
from strandline.operators.slopes import median_slopes

_D = T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _square(flat) -> np.ndarray:
    k = int(round(len(flat) ** 0.5))
    return np.asarray(flat, dtype=float).reshape(k, k)


def _sse(g: np.ndarray, beta: np.ndarray, xs: Sequence[int], y: int) -> float:
    """Squared error of given coefficients on the rows behind a Gram."""
    use = [0, *xs]
    return float(g[y, y] - 2 * beta @ g[use, y] + beta @ g[np.ix_(use, use)] @ beta)


def _sst(g: np.ndarray, y: int) -> float:
    return float(g[y, y] - g[0, y] ** 2 / g[0, 0])


def ols(df: DataFrame, y: str | Column, xs: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """Least squares per group: coefficients (intercept first), R2, residual sum, rows used."""
    return df.groupBy(*by).agg(G.moments([*xs, y]).alias("_g")).select(*by, G.solve_ols("_g").alias("_s")).select(*by, "_s.*")


def oos_r2(df: DataFrame, y: str, xs: Sequence[str], train: Column, by: Sequence[str] = ()) -> DataFrame:
    """Out-of-sample R2 of the full fit and the loss when each driver is left out.

    One pass makes two Grams, of the training and of the test rows.
    """
    names = list(xs)

    @pandas_udf(T.ArrayType(_struct(left_out=T.StringType(), r2=_D, drop=_D)))
    def score(tr: pd.Series, te: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(tr, te):
            a, b = _square(a), _square(b)
            last = len(a) - 1

            def r2(use):
                beta, _, _ = G.ols_from_gram(a, use, last)
                return 1 - _sse(b, beta, use, last) / _sst(b, last)

            everyone = list(range(1, last))
            full = r2(everyone)
            rows = [(None, full, 0.0)]
            for k, n in enumerate(names, start=1):
                part = r2([i for i in everyone if i != k])
                rows.append((n, part, full - part))
            out.append(rows)
        return pd.Series(out)

    g = df.groupBy(*by).agg(G.moments([*xs, y], train).alias("_a"), G.moments([*xs, y], ~train).alias("_b"))
    return g.select(*by, F.inline(score("_a", "_b")))


def shapley_r2(df: DataFrame, y: str, groups: dict[str, Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """R2 split over driver groups by their average gain over all orders, from one Gram."""
    cols = [c for g in groups.values() for c in g]
    place = {c: i + 1 for i, c in enumerate(cols)}
    members = {g: [place[c] for c in cs] for g, cs in groups.items()}

    @pandas_udf(T.ArrayType(_struct(driver=T.StringType(), share=_D, total=_D)))
    def split(series: pd.Series) -> pd.Series:
        out = []
        for flat in series:
            g = _square(flat)
            last = len(g) - 1
            value = {}
            for k in range(len(members) + 1):
                for subset in itertools.combinations(sorted(members), k):
                    use = [i for m in subset for i in members[m]]
                    value[frozenset(subset)] = G.ols_from_gram(g, use, last)[1] if use else 0.0
            n, every = len(members), frozenset(members)
            rows = []
            for m in members:
                gain = 0.0
                for s in value:
                    if m not in s:
                        weight = 1.0 / (n * math.comb(n - 1, len(s)))
                        gain += weight * (value[s | {m}] - value[s])
                rows.append((m, float(gain), float(value[every])))
            out.append(rows)
        return pd.Series(out)

    return df.groupBy(*by).agg(G.moments([*cols, y]).alias("_g")).select(*by, F.inline(split("_g")))


def newey_west(df: DataFrame, keys: Sequence[str], t: str, y: str, xs: Sequence[str], lags: int = 5) -> DataFrame:
    """Coefficients with heteroskedasticity and autocorrelation robust errors (Bartlett weights)."""
    keys = list(keys)
    fit = df.groupBy(*keys).agg(G.moments([*xs, y]).alias("_g")).withColumn("_beta", G.solve_ols("_g")["beta"])
    rows = df.join(fit, keys) if keys else df.crossJoin(F.broadcast(fit))  # a single row
    pred = F.get("_beta", F.lit(0))
    for k, x in enumerate(xs, start=1):
        pred = pred + F.get("_beta", F.lit(k)) * F.col(x)
    scores = [F.col("_u")] + [F.col("_u") * F.col(x) for x in xs]
    rows = rows.withColumn("_u", F.col(y) - pred).select(*keys, t, "_g", "_beta", F.array(*scores).alias("_m"))
    w = C.by_time(keys, t)
    size = len(xs) + 1
    sums = []
    for lag in range(lags + 1):
        past = F.col("_m") if lag == 0 else F.col(f"_m{lag}")
        if lag:
            rows = rows.withColumn(f"_m{lag}", F.lag("_m", lag).over(w))
        sums.append(F.array(*[F.coalesce(F.sum(F.get("_m", F.lit(a)) * F.get(past, F.lit(b))), F.lit(0.0)) for a in range(size) for b in range(size)]))
    total = rows.groupBy(*keys).agg(F.first("_g").alias("_g"), F.first("_beta").alias("_beta"), F.array(*sums).alias("_s"))

    @pandas_udf(T.ArrayType(_struct(term=T.IntegerType(), beta=_D, se=_D)))
    def errors(g: pd.Series, beta: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for gi, bi, si in zip(g, beta, s):
            bread = np.linalg.inv(_square(gi)[:-1, :-1])
            meat = np.zeros_like(bread)
            for lag, flat in enumerate(si):
                m = _square(flat)
                meat += m if lag == 0 else (1 - lag / (lags + 1)) * (m + m.T)
            se = np.sqrt(np.diag(bread @ meat @ bread))
            out.append([(i, float(b), float(v)) for i, (b, v) in enumerate(zip(bi, se))])
        return pd.Series(out)

    return total.select(*keys, F.inline(errors("_g", "_beta", "_s")))


def diebold_mariano(df: DataFrame, keys: Sequence[str], t: str, a: str, b: str) -> DataFrame:
    """t statistic of the mean loss difference with floor(n^(1/3)) Newey-West lags."""
    keys = list(keys)
    one = Window.partitionBy(*keys)
    base = df.withColumn("_d", F.col(a) - F.col(b)).select(
        *keys, F.row_number().over(C.by_time(keys, t)).alias("_i"), F.avg("_d").over(one).alias("_mean"), F.count(F.lit(1)).over(one).alias("_n"), "_d"
    )
    base = base.withColumn("_c", F.col("_d") - F.col("_mean"))
    top = F.floor(F.pow("_n", F.lit(1.0 / 3)) + 1e-9)
    shifted = base.select(*keys, "_mean", "_n", top.alias("_top"), F.explode(F.sequence(F.lit(0).cast("long"), top)).alias("_lag"), "_i", F.col("_c").alias("_p"))
    shifted = shifted.withColumn("_i", F.col("_i") + F.col("_lag"))
    gamma = shifted.join(base.select(*keys, "_i", "_c"), [*keys, "_i"]).groupBy(*keys, "_lag").agg(
        F.avg(F.col("_c") * F.col("_p")).alias("_g"), F.first("_mean").alias("_mean"), F.first("_n").alias("n"), F.first("_top").alias("_top")
    )
    weight = F.when(F.col("_lag") == 0, 1.0).otherwise((F.lit(1.0) - F.col("_lag") / (F.col("_top") + 1)) * 2)
    out = gamma.groupBy(*keys).agg(F.sum(weight * F.col("_g")).alias("_v"), F.max("_mean").alias("_mean"), F.max("n").alias("n"))
    return out.select(*keys, "n", F.col("_mean").alias("mean_diff"), F.try_divide(F.col("_mean"), F.sqrt(F.greatest(F.col("_v"), F.lit(0.0)) / F.col("n"))).alias("t"))


def qlike(df: DataFrame, by: Sequence[str], realised: Column, forecast: Column, null: Column | None = None) -> DataFrame:
    """Mean of r/f - ln(r/f) - 1, and the gain over a null forecast in percent."""
    loss = lambda f: F.avg(realised / f - F.log(realised / f) - 1)
    out = [loss(forecast).alias("qlike")]
    if null is not None:
        out += [loss(null).alias("qlike_null"), ((F.lit(1.0) - F.try_divide(loss(forecast), loss(null))) * 100).alias("gain_pct")]
    return df.groupBy(*by).agg(*out)


def theil_sen(df: DataFrame, by: Sequence[str], t: str, xs: Sequence[str]) -> DataFrame:
    """Median of the slopes between all rows of a site with different t, per column: ``<x>_slope``.

    Long records are solved by slope selection, see ``slopes.median_slopes``.
    """
    return median_slopes(df, by, t, xs)


def residual_trend(df: DataFrame, site: str, year: str, y: str, x: str, min_years: int = 20) -> DataFrame:
    """Per site: trend of y, of y without x, and of x, in percent of the mean per decade."""
    line = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(site).agg(
        F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.avg(y).alias("y_mean"), F.avg(x).alias("x_mean"),
        F.try_divide(F.covar_pop(y, x), F.stddev_pop(y) * F.stddev_pop(x)).alias("x_r"),
        F.count(F.lit(1)).alias("_n"),
    ).where(F.col("_n") >= min_years)
    rows = join_on(df, line, [site]).withColumn("residual", F.col(y) - F.col("_a") - F.col("_b") * F.col(x))
    slopes = theil_sen(rows, [site], year, [y, "residual", x])
    pct = lambda s, m: F.col(f"{s}_slope") * 1000 / F.col(m)
    return join_on(slopes, line, [site]).select(
        site, "n_years", F.col("_b").alias("x_slope"), "x_r", pct(y, "y_mean").alias("y_trend"), pct("residual", "y_mean").alias("residual_trend"), pct(x, "x_mean").alias("x_trend")
    )


def _standard_beta(g: np.ndarray) -> np.ndarray:
    """Coefficients on standardised regressors (ddof 0) from a Gram of [1, xs, y]."""
    last = len(g) - 1
    beta, _, _ = G.ols_from_gram(g, range(1, last), last)
    sd = np.sqrt(np.maximum(np.diag(g)[1:last] / g[0, 0] - (g[0, 1:last] / g[0, 0]) ** 2, 0))
    return beta[1:] * sd


def cluster_bootstrap(df: DataFrame, cluster: str, y: str, xs: Sequence[str], draws: int, seed: int = 0) -> DataFrame:
    """Standardised betas with a 90% interval from resampled clusters.

    The Gram of a cluster is computed once; a draw is a sum of cluster Grams weighted with Poisson numbers.  A null cluster is one.
    """
    names = list(xs)
    per = df.groupBy(cluster).agg(G.moments([*xs, y]).alias("_g"))
    point = per.select(F.lit(-1).alias("draw"), F.lit(1).cast("long").alias("times"), "_g")
    weight = S.poisson_weight(F.lit(seed), F.col("draw"), F.col(cluster)).cast("long")
    drawn = per.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("draw", weight.alias("times"), "_g").where("times > 0").unionByName(point)
    cells = drawn.select("draw", "times", F.posexplode("_g").alias("c", "v")).groupBy("draw", "c").agg(F.sum(F.col("times") * F.col("v")).alias("v"))
    grams = cells.groupBy("draw").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("_c")).select("draw", F.transform("_c", lambda c: c["v"]).alias("_g"))

    @pandas_udf(T.ArrayType(_struct(term=T.StringType(), beta=_D)))
    def betas(g: pd.Series) -> pd.Series:
        return pd.Series([[(n, float(b)) for n, b in zip(names, _standard_beta(_square(flat)))] for flat in g])

    long = grams.select("draw", F.inline(betas("_g")))
    at = exact_quantiles(long.where("draw >= 0"), ["term"], "beta", [0.05, 0.95]).groupBy("term").agg(F.min("beta").alias("lo"), F.max("beta").alias("hi"))
    return long.where("draw < 0").select("term", "beta").join(at, "term")


def leave_group_out_r2(df: DataFrame, cluster: str, y: str, xs: Sequence[str]) -> DataFrame:
    """R2 in sample and with each cluster predicted from the others: total Gram minus cluster Gram."""
    per = df.groupBy(cluster).agg(G.moments([*xs, y]).alias("_g"))
    cells = per.select(F.posexplode("_g").alias("c", "v")).groupBy("c").agg(F.sum("v").alias("v"))
    total = cells.agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda c: c["v"]).alias("_t"))

    @pandas_udf(_struct(sse=_D, sse_in=_D, sst=_D))
    def errors(g: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = []
        for flat, whole in zip(g, t):
            one, every = _square(flat), _square(whole)
            last = len(one) - 1
            use = range(1, last)
            out, _, _ = G.ols_from_gram(every - one, use, last)
            into, _, _ = G.ols_from_gram(every, use, last)
            rows.append((_sse(one, out, use, last), _sse(one, into, use, last), _sst(every, last)))
        return pd.DataFrame(rows, columns=["sse", "sse_in", "sst"])

    e = per.crossJoin(F.broadcast(total)).select(errors("_g", "_t").alias("e")).select("e.*")  # one row of k squared sums
    return e.agg((F.lit(1.0) - F.sum("sse_in") / F.max("sst")).alias("r2_in"), (F.lit(1.0) - F.sum("sse") / F.max("sst")).alias("r2_out"), F.count(F.lit(1)).alias("groups"))


def interaction_ols(df: DataFrame, y: str, a: str, b: str, controls: Sequence[str]) -> DataFrame:
    """Fit with the product of two z-scores; R2 with and without the second factor and the product."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in (a, b) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")
    rows = df.crossJoin(F.broadcast(stats)).withColumn("_ab", z(a) * z(b))  # a single row
    full = ols(rows, y, [a, b, "_ab", *controls]).select("beta", F.col("r2").alias("r2_full"), "n")
    part = ols(rows, y, [a, *controls]).select(F.col("r2").alias("r2_without"))
    return full.crossJoin(F.broadcast(part))


def panel_fe(df: DataFrame, entity: str, year: str, y: str, x: str) -> DataFrame:
    """One-pass two-way demeaning (entity, then year), slope and counts.

    Means are aggregates joined back, so neither a long entity nor a full year is one task.
    """
    def centre(d: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
        m = d.groupBy(key).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)])
        d = d.join(m, key)
        for i, c in enumerate(cols):
            d = d.withColumn(c, F.col(c) - F.col(f"_m{i}"))
        return d.drop(*[f"_m{i}" for i in range(len(cols))])

    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(entity, year, F.col(y).cast("double").alias("_y"), F.col(x).cast("double").alias("_x"))
    rows = centre(centre(rows, entity, ["_y", "_x"]), year, ["_y", "_x"])
    return rows.agg(F.try_divide(F.sum(F.col("_x") * F.col("_y")), F.sum(F.col("_x") * F.col("_x"))).alias("slope"), F.count(F.lit(1)).alias("n"))


def expanding_oos(df: DataFrame, keys: Sequence[str], t: str, y: str, x: str, gap: int, min_n: int, start) -> DataFrame:
    """Each date forecast from the rows up to ``gap`` before it; R2 against a zero forecast."""
    past = C.by_time(keys, t).rowsBetween(Window.unboundedPreceding, -gap)
    rows = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(past))
    rows = rows.withColumn("_p", F.regr_intercept(y, x).over(past) + F.regr_slope(y, x).over(past) * F.col(x))
    used = rows.where((F.col("_n") >= min_n) & (F.col(t) >= F.lit(start).cast(df.schema[t].dataType)) & F.col("_p").isNotNull())
    miss = F.col(y) - F.col("_p")
    return used.groupBy(*keys).agg((F.lit(1.0) - F.try_divide(F.sum(miss * miss), F.sum(F.col(y) * F.col(y)))).alias("oos_r2"), F.count(F.lit(1)).alias("n"))


def time_ordered_cv(df: DataFrame, year: Column, y: str, xs: Sequence[str], min_train_years: int = 3) -> DataFrame:
    """Linear expanding-window validation: train on the years before, test on each year after the first ones.

    The rows become one Gram per year; training sums are running totals over years.
    """
    per = df.groupBy(year.alias("year")).agg(G.moments([*xs, y]).alias("_g"))
    w = Window.orderBy("year")  # one row per year
    place = per.withColumn("_i", F.row_number().over(w))
    past = F.collect_list("_g").over(w.rowsBetween(Window.unboundedPreceding, -1))
    size = (len(xs) + 2) ** 2
    train = F.aggregate(past, F.array_repeat(F.lit(0.0), size), lambda acc, g: G.add_arrays(acc, g))
    tests = place.withColumn("_train", train).where(F.col("_i") > min_train_years)

    @pandas_udf(_struct(sse=_D, n=T.LongType()))
    def score(tr: pd.Series, te: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(tr, te):
            a, b = _square(a), _square(b)
            last = len(a) - 1
            beta, _, _ = G.ols_from_gram(a, range(1, last), last)
            rows.append((_sse(b, beta, range(1, last), last), int(b[0, 0])))
        return pd.DataFrame(rows, columns=["sse", "n"])

    return tests.select("year", score("_train", "_g").alias("s")).select("year", "s.n", F.sqrt(F.col("s.sse") / F.col("s.n")).alias("rmse"))


def time_ordered_cv_ml(df: DataFrame, year: str, y: str, xs: Sequence[str], make_estimator, min_train_years: int = 3) -> DataFrame:
    """The same validation for any Spark ML estimator; one distributed fit per test year."""
    from functools import reduce

    from pyspark.ml.feature import VectorAssembler

    years = [r[0] for r in df.select(year).distinct().orderBy(year).collect()]  # a handful of years
    ready = VectorAssembler(inputCols=list(xs), outputCol="features").transform(df.dropna(subset=[y, *xs])).select(year, F.col(y).alias("label"), "features")
    scored = []
    for test in years[min_train_years:]:
        model = make_estimator().fit(ready.where(F.col(year) < test))
        scored.append(model.transform(ready.where(F.col(year) == test)).select(year, "label", "prediction"))
    both = reduce(DataFrame.unionByName, scored)
    miss = F.col("label") - F.col("prediction")
    return both.groupBy(year).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(miss * miss)).alias("rmse"))


def expanding_decisions(df: DataFrame, keys: Sequence[str], t: str, y: str, xs: Sequence[str], x_now: Sequence[str], actual: str, embargo: int, min_train: int, every: int, start) -> DataFrame:
    """Expanding fit with an embargo; a decision every ``every`` periods on the forecast drivers.

    Training sums are running window sums over the calendar; each decision row solves its own
    small system.  ``saving`` is the outcome where the forecast says act, else zero.
    """
    keys = list(keys)
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in (*xs, y)]]
    complete = F.lit(True)
    for c in cols[1:]:
        complete = complete & c.isNotNull()
    past = C.by_time(keys, t).rowsBetween(Window.unboundedPreceding, -embargo)
    size = len(cols)
    cell = {(a, b): F.coalesce(F.sum(F.when(complete, cols[a] * cols[b])).over(past), F.lit(0.0)) for a in range(size) for b in range(a, size)}
    gram = F.array(*[cell[min(a, b), max(a, b)] for a in range(size) for b in range(size)])
    since = F.sum(F.when(F.col(t) >= F.lit(start).cast(df.schema[t].dataType), 1).otherwise(0)).over(C.by_time(keys, t).rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_g", gram).withColumn("_k", since).where((F.col("_k") > 0) & ((F.col("_k") - 1) % every == 0))
    ready = F.get("_g", F.lit(0)) >= min_train
    for c in (*x_now, actual):
        ready = ready & F.col(c).isNotNull()

    @pandas_udf(_D)
    def predict(g: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for flat, now in zip(g, x):
            m = _square(flat)
            beta, _, _ = G.ols_from_gram(m, range(1, len(m) - 1), len(m) - 1)
            out.append(float(beta[0] + np.asarray(now, dtype=float) @ beta[1:]))
        return pd.Series(out)

    out = rows.where(ready).withColumn("pred", predict("_g", F.array(*[F.col(c).cast("double") for c in x_now])))
    hedge = F.col("pred") > 0
    return out.select(*keys, t, "pred", F.col(actual).alias("actual"), hedge.alias("hedge"), F.when(hedge, F.col(actual)).otherwise(0.0).alias("saving"))


def forecast_skill(df: DataFrame, by: Sequence[str], fc: str, obs: str) -> DataFrame:
    """Correlation, and skill of the linearly mapped forecast against a zero anomaly."""
    both = df.where(F.col(fc).isNotNull() & F.col(obs).isNotNull())
    n = F.count(F.lit(1))
    sse = F.regr_syy(obs, fc) - F.try_divide(F.pow(F.regr_sxy(obs, fc), F.lit(2)), F.regr_sxx(obs, fc))
    return both.groupBy(*by).agg(
        F.try_divide(F.covar_pop(fc, obs), F.stddev_pop(fc) * F.stddev_pop(obs)).alias("r"),
        (F.lit(1.0) - F.try_divide(sse / n, F.avg(F.col(obs) * F.col(obs)))).alias("msss"), n.alias("n"),
    )


def bias_correct(df: DataFrame, keys: Sequence[str], fc: str, obs: str, train: Column, out: str = "corrected") -> DataFrame:
    """Straight-line correction per site and lead, fitted on the training rows."""
    line = df.where(train).groupBy(*keys).agg(F.regr_slope(obs, fc).alias("_b"), F.regr_intercept(obs, fc).alias("_a"))
    return df.join(line, list(keys), "left").withColumn(out, F.col("_a") + F.col("_b") * F.col(fc)).drop("_a", "_b")


def spatial_folds(points: DataFrame, pid: str, x: str, y: str, block: float, k: int = 5, seed: int = 0) -> DataFrame:
    """Blocks of the map dealt to folds, largest first, each to the emptiest fold.

    The deal runs over the table of occupied blocks (bounded by the map), not the points.
    """
    placed = points.withColumn("bx", F.floor(F.col(x) / block)).withColumn("by", F.floor(F.col(y) / block))
    sizes = placed.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", F.xxhash64(F.lit(seed), "bx", "by"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_n", "_h"], ascending=[False, True])
        load = np.zeros(k, dtype=np.int64)
        folds = []
        for n in pdf["_n"]:
            f = int(load.argmin())
            folds.append(f)
            load[f] += n
        return pd.DataFrame({"bx": pdf["bx"].to_numpy(), "by": pdf["by"].to_numpy(), "fold": np.array(folds, dtype="int32")})

    folds = sizes.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda p: deal(p), "bx long, by long, fold int")
    return placed.join(folds, ["bx", "by"])


def pair_differences(long: DataFrame, day: str, site: str, x: str, sites: Sequence) -> DataFrame:
    """Per pair of sites i < j: days both report and the sum of half squared differences.

    Each day becomes one vector of values, presence and squares; the pair sums are blocks of
    its Gram matrix, so no pair of rows is formed and missing sites are handled exactly.
    """
    n = len(sites)
    at = F.try_element_at(F.create_map(*[F.lit(v) for k, s in enumerate(sites) for v in (s, k)]), F.col(site))
    days = long.where(F.col(x).isNotNull()).withColumn("_i", at).where("_i IS NOT NULL").groupBy(day).agg(
        F.map_from_entries(F.collect_list(F.struct("_i", F.col(x).cast("double").alias("v")))).alias("_m")
    )
    got = [F.try_element_at("_m", F.lit(i)) for i in range(n)]
    vec = F.array(*[F.coalesce(v, F.lit(0.0)) for v in got], *[F.when(v.isNull(), 0.0).otherwise(1.0) for v in got], *[F.coalesce(v * v, F.lit(0.0)) for v in got])
    g = G.gram(days.select(vec.alias("vec")), "vec").where("i > 0")
    g = g.select((F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), "s")
    kind = lambda c: F.floor(F.col(c) / n)
    ref = lambda c: (F.col(c) % n).cast("int")
    named = g.select(kind("i").alias("ki"), kind("j").alias("kj"), ref("i").alias("a"), ref("j").alias("b"), "s")
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    part = F.when((F.col("ki") == 0) & (F.col("kj") == 0), -F.col("s")).when((F.col("ki") == 1) & (F.col("kj") == 2), F.col("s") / 2).otherwise(0.0)
    days_both = F.when((F.col("ki") == 1) & (F.col("kj") == 1), F.col("s")).otherwise(0.0)
    names = F.array(*[F.lit(s) for s in sites])
    return named.where("a <> b").groupBy(lo.alias("_i"), hi.alias("_j")).agg(F.sum(days_both).cast("long").alias("days"), F.sum(part).alias("half_sq")).where("days > 0").select(
        F.get(names, F.col("_i")).alias("i"), F.get(names, F.col("_j")).alias("j"), "days", "half_sq"
    )


def variogram(pairs: DataFrame, km: str, edges: Sequence[float]) -> DataFrame:
    """Mean half squared difference of same-day pairs by distance bin [lo, hi)."""
    b = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        b = F.when((F.col(km) >= lo) & (F.col(km) < hi), k).otherwise(b)
    return pairs.withColumn("bin", b).where("bin IS NOT NULL").groupBy("bin").agg(F.sum("days").alias("n"), (F.sum("half_sq") / F.sum("days")).alias("gamma"))


def _fit_variogram(mid: np.ndarray, emp: np.ndarray) -> tuple[float, float, float]:
    """Nugget, sill and range of an exponential variogram: ranges on a grid, the rest linear."""
    best = (np.inf, 0.0, 1e-3, 60.0)
    for rng in np.geomspace(5, 400, 160):
        f = 1 - np.exp(-mid / rng)
        a = np.column_stack([np.ones_like(f), f])
        nug, sill = np.linalg.lstsq(a, emp, rcond=None)[0]
        if nug < 0:
            nug, sill = 0.0, max(f @ emp / (f @ f), 1e-3)
        if sill < 1e-3:
            sill, nug = 1e-3, max(float(np.mean(emp - 1e-3 * f)), 0.0)
        sse = float(((nug + sill * f - emp) ** 2).sum())
        if sse < best[0]:
            best = (sse, float(nug), float(sill), float(rng))
    return best[1:]


def regression_kriging(df: DataFrame, day: str, site: str, fold: str, x: str, y: str, target: str, covs: Sequence[str], k: int = 5, edges=None) -> DataFrame:
    """Held-out predictions: clipped linear trend plus ordinary kriging of training residuals.

    One copy of the rows per fold, held-out or training.  The trend is a Gram per fold, the
    variogram a few bins per fold; kriging solves one system per (fold, day), whose size is
    the number of stations of the network.
    """
    edges = np.linspace(0, 250, 13) if edges is None else np.asarray(edges, dtype=float)
    mid = (edges[1:] + edges[:-1]) / 2
    rows = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_test", F.col(fold) == F.col("_k"))
    train = rows.where(~F.col("_test"))
    fit = train.groupBy("_k").agg(G.moments([*covs, target]).alias("_g"), *[f(c).alias(f"_{n}_{c}") for c in covs for n, f in (("lo", F.min), ("hi", F.max))])
    fit = fit.withColumn("_beta", G.solve_ols("_g")["beta"]).drop("_g")
    both = rows.join(fit, "_k")  # one row per fold
    trend = F.get("_beta", F.lit(0))
    for i, c in enumerate(covs, start=1):
        trend = trend + F.get("_beta", F.lit(i)) * F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))
    keep = both.select("_k", day, site, "_test", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col(target).cast("double").alias("_t"), trend.alias("_trend"))
    keep = keep.withColumn("_e", F.col("_t") - F.col("_trend"))

    def bins(pdf: pd.DataFrame) -> pd.DataFrame:
        xy, e = pdf[["_x", "_y"]].to_numpy(), pdf["_e"].to_numpy()
        if len(e) < 3:
            return pd.DataFrame({"_k": [], "b": [], "s": [], "n": []})
        i, j = np.triu_indices(len(e), 1)
        b = np.searchsorted(edges, np.hypot(*(xy[i] - xy[j]).T), side="right") - 1
        ok = (b >= 0) & (b < len(mid))
        half = 0.5 * (e[i] - e[j]) ** 2
        s, n = np.bincount(b[ok], half[ok], len(mid)), np.bincount(b[ok], minlength=len(mid))
        return pd.DataFrame({"_k": int(pdf["_k"].iloc[0]), "b": np.arange(len(mid), dtype="int32"), "s": s, "n": n.astype("int64")})

    binned = keep.where(~F.col("_test")).groupBy("_k", day).applyInPandas(bins, "_k int, b int, s double, n long").groupBy("_k", "b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["n"] > 0].sort_values("b")
        nug, sill, rng = _fit_variogram(mid[pdf["b"].to_numpy()], (pdf["s"] / pdf["n"]).to_numpy()) if len(pdf) else (0.0, 1e-3, 60.0)
        return pd.DataFrame([{"_k": int(pdf["_k"].iloc[0]) if len(pdf) else 0, "_nugget": nug, "_sill": sill, "_range": rng}])

    params = binned.groupBy("_k").applyInPandas(shape, "_k int, _nugget double, _sill double, _range double")
    site_type, day_type = df.schema[site].dataType.simpleString(), df.schema[day].dataType.simpleString()

    def krige(pdf: pd.DataFrame) -> pd.DataFrame:
        te, tr = pdf[pdf["_test"]], pdf[~pdf["_test"]]
        pred = te["_trend"].to_numpy(dtype=float)
        if len(tr) and len(te):
            nug, sill, rng = (float(pdf[c].iloc[0]) for c in ("_nugget", "_sill", "_range"))
            a, b = tr[["_x", "_y"]].to_numpy(), te[["_x", "_y"]].to_numpy()
            gap = lambda p, q: np.hypot(p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1])
            n = len(a)
            m = np.ones((n + 1, n + 1))
            m[:n, :n] = sill * np.exp(-gap(a, a) / rng) + max(nug, 1e-9) * np.eye(n)
            m[n, n] = 0.0
            rhs = np.vstack([sill * np.exp(-gap(a, b) / rng), np.ones((1, len(b)))])
            pred = pred + np.linalg.solve(m, rhs)[:n].T @ tr["_e"].to_numpy()
        return pd.DataFrame({day: te[day], site: te[site], "obs": te["_t"], "trend": te["_trend"], "pred": pred})

    return keep.join(params, "_k").groupBy("_k", day).applyInPandas(krige, f"{day} {day_type}, {site} {site_type}, obs double, trend double, pred double")


def paired_bootstrap(df: DataFrame, unit: str, obs: str, a: str, b: str, draws: int, seed: int = 0) -> DataFrame:
    """RMSE difference of two models with a 95% interval over resampled stations.

    Squared errors are summed per station once; a draw weights those sums with the station's Poisson number.
    """
    e = lambda m: F.pow(F.col(m) - F.col(obs), F.lit(2))
    gain = S.Sums([e(a), e(b), F.lit(1)], lambda sa, sb, n: F.sqrt(sa / n) - F.sqrt(sb / n))
    return S.interval(df, [], [unit], gain, draws, seed, (0.025, 0.975)).select(F.col("value").alias("difference"), "lo", "hi")


def flag_rule(df: DataFrame, by: Sequence[str], x: str, flags: dict[str, Column], unit: Sequence[str] = (), draws: int = 500, seed: int = 0) -> DataFrame:
    """Mean outcome, share up and count under each named flag, against the other rows.

    With ``unit`` columns (a block of periods, a station) also the 5-95% interval ``lo``, ``hi`` of the mean over resampled units.
    """
    rows = F.array(*[F.struct(F.lit(n).alias("flag"), c.alias("on")) for n, c in flags.items()])
    cols = list(dict.fromkeys([*by, *unit]))
    long = df.where(F.col(x).isNotNull()).select(*cols, F.col(x).alias("_x"), F.inline(rows)).where("on IS NOT NULL")
    on = F.col("on")
    out = long.groupBy(*by, "flag").agg(
        F.count(F.when(on, 1)).alias("n"), F.avg(F.when(on, F.col("_x"))).alias("mean"), F.avg(F.when(on, F.when(F.col("_x") > 0, 1.0).otherwise(0.0))).alias("share_up"),
        F.avg(F.when(~on, F.col("_x"))).alias("others"), F.avg("_x").alias("all_rows"),
    )
    if not unit:
        return out
    band = S.interval(long.where(on), [*by, "flag"], unit, S.mean("_x"), draws, seed).select(*by, "flag", "lo", "hi")
    return join_on(out, band, [*by, "flag"], "left")


def pca_index(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), out: str = "index") -> DataFrame:
    """First principal component of the standardised columns, loadings summing positive."""

    @pandas_udf(_struct(mean=T.ArrayType(_D), sd=T.ArrayType(_D), u=T.ArrayType(_D), share=_D))
    def component(g: pd.Series) -> pd.DataFrame:
        rows = []
        for flat in g:
            m = _square(flat)
            n, mean = m[0, 0], m[0, 1:] / m[0, 0]
            cov = m[1:, 1:] / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            sd = np.where(sd > 0, sd, 1.0)
            values, vecs = L.spectrum(cov / sd[:, None] / sd[None, :])
            u = vecs[:, 0] * (1 if vecs[:, 0].sum() >= 0 else -1)
            rows.append((mean.tolist(), sd.tolist(), u.tolist(), float(values[0] / values.sum())))
        return pd.DataFrame(rows, columns=["mean", "sd", "u", "share"])

    fit = df.groupBy(*by).agg(G.moments(cols).alias("_g")).select(*by, component("_g").alias("_p"))
    rows = df.join(fit, list(by)) if by else df.crossJoin(F.broadcast(fit))  # a single row
    score = F.lit(0.0)
    for i, c in enumerate(cols):
        score = score + F.get("_p.u", F.lit(i)) * (F.col(c) - F.get("_p.mean", F.lit(i))) / F.get("_p.sd", F.lit(i))
    return rows.withColumn(out, score).withColumn("share", F.col("_p.share")).drop("_p")


def two_regressor_calibration(df: DataFrame, by: Sequence[str], params: Sequence[str], y: str, x: str, cover: str, fit: Column, test: Column) -> DataFrame:
    """Observation line on two drivers per site and parameter set, fitted on one span and
    scored on another; best in-sample fit with a positive weight of ``cover``."""

    @pandas_udf(_struct(r2_fit=_D, r2_test=_D, w_cover=_D, r2_single=_D))
    def solve(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for tr, te in zip(a, b):
            tr, te = _square(tr), _square(te)
            if tr[0, 0] < 3 or te[0, 0] < 2:
                rows.append((None, None, None, None))
                continue
            beta, r2, _ = G.ols_from_gram(tr, [1, 2], 3)
            one, r2_one, _ = G.ols_from_gram(tr, [1], 3)
            rows.append((float(r2), 1 - _sse(te, beta, [1, 2], 3) / _sst(te, 3), float(beta[2]), float(r2_one)))
        return pd.DataFrame(rows, columns=["r2_fit", "r2_test", "w_cover", "r2_single"])

    g = df.groupBy(*by, *params).agg(G.moments([x, cover, y], fit).alias("_a"), G.moments([x, cover, y], test).alias("_b"))
    scored = g.select(*by, *params, solve("_a", "_b").alias("s")).select(*by, *params, "s.*").where("w_cover > 0")
    return scored.groupBy(*by).agg(F.max_by(F.struct(*params, "r2_fit", "r2_test", "w_cover", "r2_single"), F.struct(F.round("r2_fit", 9), *[-F.col(p) for p in params])).alias("_b")).select(*by, "_b.*")
