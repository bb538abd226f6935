"""Regression, forecast tests and validation."""

from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import regress as R
from strandline.plans.family_f2 import site_pairs  # noqa: F401
from strandline.plans.registry import query


def r(c, n=6):
    return F.round(c, n)


@query(
    "g1_ols",
    """SELECT l_suppkey, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS a, round(regr_slope(l_extendedprice, l_quantity), 4) AS b,
    round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""",
)
def g1(t):
    out = R.ols(t.raw("lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"])
    return out.select("l_suppkey", "n", r(F.get("beta", F.lit(0)), 4).alias("a"), r(F.get("beta", F.lit(1)), 4).alias("b"), r("r2").alias("r2"))


@query("g1_ols_many")
def g1m(t):
    out = R.ols(t.raw("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])
    return out.select("l_returnflag", "n", F.transform("beta", lambda b: F.round(b, 4)).alias("beta"), r("r2").alias("r2"))


@query("g2_oos_r2")
def g2(t):
    x = t.raw("lineitem").withColumn("train", F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    out = R.oos_r2(x, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], F.col("train"), ["l_returnflag"])
    return out.select("l_returnflag", F.coalesce("left_out", F.lit("none")).alias("left_out"), r("r2").alias("r2"), r("drop", 8).alias("drop"))


@query("g3_shapley_r2")
def g3(t):
    out = R.shapley_r2(t.raw("lineitem"), "l_extendedprice", {"size": ["l_quantity"], "terms": ["l_discount", "l_tax"], "line": ["l_linenumber"]})
    return out.select("driver", r("share", 8).alias("share"), r("total", 8).alias("total"))


@query("g4_newey_west")
def g4(t):
    out = R.newey_west(t.ship(), ["entity"], "d", "price", ["disc", "qty"], 5)
    return out.select("entity", "term", r("beta", 4).alias("beta"), r("se", 4).alias("se"))


_LOSS = "l AS (SELECT entity, d, pow(price - 1500, 2) / 1e6 AS la, pow(price - 1000 - 10000 * disc, 2) / 1e6 AS lb FROM ship)"


def _losses(t):
    return t.ship().select("entity", "d", (F.pow(F.col("price") - 1500, F.lit(2)) / 1e6).alias("la"), (F.pow(F.col("price") - 1000 - F.col("disc") * 10000, F.lit(2)) / 1e6).alias("lb"))


@query(
    "g5_diebold_mariano",
    f"""WITH {_LOSS}, b AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY d) AS i, la - lb - avg(la - lb) OVER (PARTITION BY entity) AS c, avg(la - lb) OVER (PARTITION BY entity) AS m,
        count(*) OVER (PARTITION BY entity) AS n FROM l), s AS (SELECT entity, n, m, floor(pow(n, 1.0 / 3) + 1e-9) AS top FROM b GROUP BY ALL),
    k AS (SELECT *, unnest(range(0, CAST(top AS BIGINT) + 1)) AS lag FROM s),
    g AS (SELECT k.entity, k.n, k.m, k.top, lag, avg(x.c * y.c) AS g FROM k JOIN b x ON x.entity = k.entity JOIN b y ON y.entity = k.entity AND y.i = x.i + lag GROUP BY 1, 2, 3, 4, 5)
    SELECT entity, n, round(m, 6) AS mean_diff, round(m / sqrt(sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / (top + 1)) * g END) / n), 5) AS t FROM g GROUP BY entity, n, m""",
    "ship",
)
def g5(t):
    out = R.diebold_mariano(_losses(t), ["entity"], "d", "la", "lb")
    return out.select("entity", "n", r("mean_diff").alias("mean_diff"), r("t", 5).alias("t"))


@query(
    "g6_qlike",
    """WITH x AS (SELECT l_returnflag, l_quantity AS r, 1 + l_extendedprice / 2000 AS f, 25.5 AS z FROM lineitem)
    SELECT l_returnflag, round(avg(r / f - ln(r / f) - 1), 6) AS qlike, round(avg(r / z - ln(r / z) - 1), 6) AS qlike_null,
    round(100 * (1 - avg(r / f - ln(r / f) - 1) / avg(r / z - ln(r / z) - 1)), 4) AS gain_pct FROM x GROUP BY 1""",
)
def g6(t):
    out = R.qlike(t.raw("lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice") / 2000 + 1, F.lit(25.5))
    return out.select("l_returnflag", r("qlike").alias("qlike"), r("qlike_null").alias("qlike_null"), r("gain_pct", 4).alias("gain_pct"))


@query(
    "g7_theil_sen",
    """WITH p AS (SELECT a.site, (b.value - a.value) / (b.year - a.year) AS v, (b.n - a.n) / (b.year - a.year) AS k FROM site_year a JOIN site_year b ON a.site = b.site AND a.year < b.year)
    SELECT site, round(quantile_cont(v, 0.5), 5) AS value_slope, round(quantile_cont(k, 0.5), 5) AS n_slope FROM p GROUP BY 1""",
    "site_year",
)
def g7(t):
    out = R.theil_sen(t.site_year(), ["site"], "year", ["value", "n"])
    return out.select("site", r("value_slope", 5).alias("value_slope"), r("n_slope", 5).alias("n_slope"))


_RES_TREND = """l AS (SELECT site, regr_slope(value, n) AS b, regr_intercept(value, n) AS a, avg(value) AS my, avg(n) AS mx, corr(value, n) AS r, count(*) AS c FROM site_year GROUP BY 1 HAVING count(*) >= 5),
    y AS (SELECT s.site, s.year, s.value, s.n, s.value - a - b * s.n AS res FROM site_year s JOIN l ON l.site = s.site),
    p AS (SELECT u.site, (v.value - u.value) / (v.year - u.year) AS sv, (v.res - u.res) / (v.year - u.year) AS sr, (v.n - u.n) / (v.year - u.year) AS sn FROM y u JOIN y v ON u.site = v.site AND u.year < v.year),
    q AS (SELECT site, quantile_cont(sv, 0.5) AS sv, quantile_cont(sr, 0.5) AS sr, quantile_cont(sn, 0.5) AS sn FROM p GROUP BY 1)"""


@query(
    "g8_residual_trend",
    f"""WITH {_RES_TREND} SELECT q.site, c AS n_years, round(b, 4) AS x_slope, round(r, 6) AS x_r, round(sv * 1000 / my, 5) AS y_trend, round(sr * 1000 / my, 5) AS residual_trend, round(sn * 1000 / mx, 5) AS x_trend
    FROM q JOIN l ON l.site = q.site""",
    "site_year",
)
def g8(t):
    out = R.residual_trend(t.site_year(), "site", "year", "value", "n", 5)
    return out.select("site", "n_years", r("x_slope", 4).alias("x_slope"), r("x_r").alias("x_r"), *[r(c, 5).alias(c) for c in ("y_trend", "residual_trend", "x_trend")])


def _lines(t):
    return t.raw("lineitem").withColumn("band", F.col("l_suppkey") % 12)


@query("g9_cluster_bootstrap")
def g9(t):
    out = R.cluster_bootstrap(_lines(t), "band", "l_extendedprice", ["l_quantity", "l_discount", "l_linenumber"], 200)
    return out.select("term", r("beta", 4).alias("beta"), r("lo", 4).alias("lo"), r("hi", 4).alias("hi"))


@query("g10_leave_group_out_r2")
def g10(t):
    out = R.leave_group_out_r2(_lines(t), "band", "l_extendedprice", ["l_quantity", "l_discount", "l_linenumber"])
    return out.select(r("r2_in", 8).alias("r2_in"), r("r2_out", 8).alias("r2_out"), "groups")


@query("g11_interaction_ols")
def g11(t):
    out = R.interaction_ols(t.raw("lineitem"), "l_extendedprice", "l_quantity", "l_discount", ["l_tax"])
    return out.select(F.transform("beta", lambda b: F.round(b, 3)).alias("beta"), r("r2_full", 8).alias("r2_full"), r("r2_without", 8).alias("r2_without"), "n")


@query(
    "g12_panel_fe",
    """WITH a AS (SELECT l_suppkey AS e, year(l_shipdate) AS y, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS v, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS x FROM lineitem),
    b AS (SELECT v - avg(v) OVER (PARTITION BY y) AS v, x - avg(x) OVER (PARTITION BY y) AS x FROM a) SELECT round(sum(x * v) / sum(x * x), 5) AS slope, count(*) AS n FROM b""",
)
def g12(t):
    x = t.raw("lineitem").withColumn("year", F.year("l_shipdate"))
    return R.panel_fe(x, "l_suppkey", "year", "l_extendedprice", "l_quantity").withColumn("slope", r("slope", 5))


@query(
    "g13_expanding_oos",
    """WITH x AS (SELECT entity, d, ln(price) - 7.3 AS y, disc AS x FROM ship),
    z AS (SELECT entity, d, y, count(*) OVER w AS n, regr_intercept(y, x) OVER w + regr_slope(y, x) OVER w * x AS p FROM x WINDOW w AS (PARTITION BY entity ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING))
    SELECT entity, round(1 - sum((y - p) * (y - p)) / sum(y * y), 6) AS oos_r2, count(*) AS n FROM z WHERE n >= 52 AND d >= DATE '1997-01-01' GROUP BY 1""",
    "ship",
)
def g13(t):
    x = t.ship().select("entity", "d", (F.log("price") - 7.3).alias("y"), F.col("disc").alias("x"))
    return R.expanding_oos(x, ["entity"], "d", "y", "x", 5, 52, "1997-01-01").withColumn("oos_r2", r("oos_r2"))


@query(
    "g14_time_ordered_cv",
    """WITH x AS (SELECT year(l_shipdate) AS y, l_extendedprice AS v, l_quantity AS q FROM lineitem), f AS (SELECT t.y, regr_slope(v, q) AS b, regr_intercept(v, q) AS a FROM (SELECT DISTINCT y FROM x WHERE y >= 1998) t JOIN x ON x.y < t.y GROUP BY 1)
    SELECT CAST(x.y AS INTEGER) AS year, count(*) AS n, round(sqrt(avg(pow(v - a - b * q, 2))), 4) AS rmse FROM x JOIN f ON f.y = x.y GROUP BY 1""",
)
def g14(t):
    return R.time_ordered_cv(t.raw("lineitem"), F.year("l_shipdate"), "l_extendedprice", ["l_quantity"]).withColumn("rmse", r("rmse", 4))


@query("g14_time_ordered_cv_trees")
def g14t(t):
    from pyspark.ml.regression import GBTRegressor

    x = t.ship_all().withColumn("year", F.year("d")).withColumn("month", F.month("d"))
    make = lambda: GBTRegressor(maxIter=5, maxDepth=3, seed=7)
    return R.time_ordered_cv_ml(x, "year", "price", ["qty", "disc", "tax", "month"], make, 4).withColumn("rmse", r("rmse", 3))


@query("g15_seasonal_backtest")
def g15(t):
    from pyspark.sql import Window

    w = Window.partitionBy("site").orderBy("d")
    x = t.site_month().withColumn("dry", F.log("value") - F.log(F.lag("value").over(w))).withColumn("next3", F.log(F.lead("value", 3).over(w)) - F.log("value"))
    x = x.withColumn("dry_fc", F.col("dry") * 0.8)
    d = R.expanding_decisions(x, ["site"], "d", "next3", ["dry"], ["dry_fc"], "next3", 3, 36, 3, "1998-06-01")
    from strandline.operators.aggregate import hit_stats

    out = hit_stats(d, ["site"], F.col("hedge"), "actual")
    return out.select("site", "decisions", *[r(c).alias(c) for c in out.columns[2:]])


@query(
    "g16_forecast_skill",
    """WITH x AS (SELECT lead, value - 25 AS fc, avg(value - 25) OVER (PARTITION BY site, target) AS obs FROM leads)
    SELECT lead, count(*) AS n, round(corr(fc, obs), 6) AS r, round(1 - (regr_syy(obs, fc) - pow(regr_sxy(obs, fc), 2) / regr_sxx(obs, fc)) / count(*) / avg(obs * obs), 6) AS msss FROM x GROUP BY 1""",
    "leads",
)
def g16(t):
    mean = t.leads().groupBy("site", "target").agg(F.avg(F.col("value") - 25).alias("obs"))
    x = t.leads().withColumn("fc", F.col("value") - 25).join(mean, ["site", "target"])
    return R.forecast_skill(x, ["lead"], "fc", "obs").select("lead", "n", r("r").alias("r"), r("msss").alias("msss"))


@query(
    "g17_bias_correct",
    """WITH x AS (SELECT site, lead, target, value, avg(value) OVER (PARTITION BY site, target) AS obs FROM leads),
    f AS (SELECT site, lead, regr_slope(obs, value) AS b, regr_intercept(obs, value) AS a FROM x WHERE target < DATE '1999-01-01' GROUP BY 1, 2)
    SELECT x.site, x.target, x.lead, round(a + b * value, 5) AS corrected FROM x LEFT JOIN f ON f.site = x.site AND f.lead = x.lead""",
    "leads",
)
def g17(t):
    mean = t.leads().groupBy("site", "target").agg(F.avg("value").alias("obs"))
    x = t.leads().join(mean, ["site", "target"])
    out = R.bias_correct(x, ["site", "lead"], "value", "obs", F.col("target") < F.lit("1999-01-01").cast("date"))
    return out.select("site", "target", "lead", r("corrected", 5).alias("corrected"))


def _map_points(t):
    k = F.col("c_custkey")
    return t.raw("customer").join(t.sites(), F.col("c_nationkey") == F.col("site")).select(k, ((F.col("lon") + (k % 37) / 50.0) * 90).alias("x"), ((F.col("lat") + (k % 100) / 100.0) * 111).alias("y"))


@query("g18_spatial_folds")
def g18(t):
    return R.spatial_folds(_map_points(t), "c_custkey", "x", "y", 50.0).select("c_custkey", "bx", "by", "fold")


_EDGES = [0.0, 150.0, 300.0, 450.0, 600.0, 900.0, 1500.0]


@query(
    "g19_variogram",
    """WITH z AS (SELECT site, d, (value - avg(value) OVER (PARTITION BY site)) / 1e5 AS e FROM site_day),
    p AS (SELECT 12742.0 * asin(sqrt(least(1.0, pow(sin(radians(h.lat - g.lat) / 2), 2) + cos(radians(g.lat)) * cos(radians(h.lat)) * pow(sin(radians(h.lon - g.lon) / 2), 2)))) AS km,
        0.5 * pow(a.e - b.e, 2) AS s FROM z a JOIN z b ON a.d = b.d AND a.site < b.site JOIN sites g ON g.site = a.site JOIN sites h ON h.site = b.site),
    e AS (SELECT unnest(range(6)) AS bin, unnest([0, 150, 300, 450, 600, 900]) AS lo, unnest([150, 300, 450, 600, 900, 1500]) AS hi)
    SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(s), 5) AS gamma FROM p JOIN e ON km >= lo AND km < hi GROUP BY 1""",
    "site_day sites",
)
def g19(t):
    x = t.site_day()
    m = x.groupBy("site").agg(F.avg("value").alias("_m"))
    z = x.join(m, "site").withColumn("e", (F.col("value") - F.col("_m")) / 1e5)
    p = R.pair_differences(z, "d", "site", "e", list(range(25)))
    s = t.sites()
    a = s.select(F.col("site").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = s.select(F.col("site").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    p = p.join(a, "i").join(b, "j").withColumn("km", C.haversine_km("lat1", "lon1", "lat2", "lon2"))
    return R.variogram(p, "km", _EDGES).withColumn("gamma", r("gamma", 5))


@query("g20_regression_kriging")
def g20(t):
    s = t.sites().select("site", (F.col("lon") * 90).alias("x"), (F.col("lat") * 111).alias("y"), "lat", "lon", (F.col("site") % 5).alias("fold"))
    x = t.site_month().join(s, "site").withColumn("t", F.col("value") / 1e5)
    out = R.regression_kriging(x, "d", "site", "fold", "x", "y", "t", ["lat", "lon"], 5)
    return out.select("d", "site", r("obs").alias("obs"), r("trend").alias("trend"), r("pred", 5).alias("pred"))


@query("g21_paired_bootstrap")
def g21(t):
    x = t.raw("lineitem").select("l_suppkey", "l_quantity", F.lit(25.5).alias("flat"), (F.col("l_extendedprice") / 1500).alias("price"))
    out = R.paired_bootstrap(x, "l_suppkey", "l_quantity", "price", "flat", 500)
    return out.select(*[r(c).alias(c) for c in ("difference", "lo", "hi")])


@query(
    "g22_flag_rule",
    """WITH f AS (SELECT l_returnflag, l_extendedprice / 1000 - 38 AS x, unnest(['big', 'cheap', 'both', 'either']) AS flag,
        unnest([l_quantity > 40, l_discount > 0.07, l_quantity > 40 AND l_discount > 0.07, l_quantity > 40 OR l_discount > 0.07]) AS f_on FROM lineitem)
    SELECT l_returnflag, flag, count(*) FILTER (WHERE f_on) AS n, round(avg(x) FILTER (WHERE f_on), 5) AS mean, round(avg((x > 0)::INT) FILTER (WHERE f_on), 6) AS share_up,
    round(avg(x) FILTER (WHERE NOT f_on), 5) AS others, round(avg(x), 5) AS all_rows FROM f GROUP BY 1, 2""",
)
def g22(t):
    big, cheap = F.col("l_quantity") > 40, F.col("l_discount") > 0.07
    x = t.raw("lineitem").withColumn("x", F.col("l_extendedprice") / 1000 - 38)
    out = R.flag_rule(x, ["l_returnflag"], "x", {"big": big, "cheap": cheap, "both": big & cheap, "either": big | cheap})
    return out.select("l_returnflag", "flag", "n", r("mean", 5).alias("mean"), r("share_up").alias("share_up"), r("others", 5).alias("others"), r("all_rows", 5).alias("all_rows"))


@query(
    "g22_flag_rule_interval",
    """WITH f AS (SELECT l_returnflag, l_extendedprice / 1000 - 38 AS x, unnest(['big', 'cheap']) AS flag, unnest([l_quantity > 40, l_discount > 0.07]) AS f_on FROM lineitem)
    SELECT l_returnflag, flag, count(*) FILTER (WHERE f_on) AS n, round(avg(x) FILTER (WHERE f_on), 5) AS mean, round(avg(x) FILTER (WHERE NOT f_on), 5) AS others, TRUE AS inside FROM f GROUP BY 1, 2""",
)
def g22i(t):
    x = t.raw("lineitem").withColumn("x", F.col("l_extendedprice") / 1000 - 38)
    out = R.flag_rule(x, ["l_returnflag"], "x", {"big": F.col("l_quantity") > 40, "cheap": F.col("l_discount") > 0.07}, ["l_suppkey"], 200)
    return out.select("l_returnflag", "flag", "n", r("mean", 5).alias("mean"), r("others", 5).alias("others"), F.col("mean").between(F.col("lo"), F.col("hi")).alias("inside"))


@query("g35_pca_index")
def g35(t):
    x = t.raw("lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    out = R.pca_index(x, ["l_quantity", "l_extendedprice", "unit"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", r("index").alias("index"), r("share").alias("share"))


@query("g34_two_regressor_calibration")
def g34(t):
    from strandline.operators.joins import cross_params

    x = cross_params(t.site_month().withColumn("m", F.month("d")), power=[0.5, 1.0, 2.0]).withColumn("rain", F.sin(F.col("m") * 0.5))
    x = x.withColumn("cover", F.pow(F.pmod(F.col("value"), F.lit(1000.0)) / 1000, F.col("power")))
    out = R.two_regressor_calibration(x, ["site"], ["power"], "value", "rain", "cover", F.year("d") <= 1998, F.year("d") > 1998)
    return out.select("site", "power", *[r(c).alias(c) for c in ("r2_fit", "r2_test", "r2_single")], r("w_cover", 2).alias("w_cover"))
