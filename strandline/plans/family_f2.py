"""Resampling, copulas and distance decay."""

from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import copula as K
from strandline.operators import dependence as D
from strandline.operators import gram as G
from strandline.operators import resample as R
from strandline.operators import statistics as S
from strandline.operators.ordering import exact_quantiles
from strandline.plans.family_c import PRIORITIES
from strandline.plans.family_f import NAMES, _PAIR_SQL, _WIDE, _pair_rows, r
from strandline.plans.registry import query


@query("f20_block_resample")
def f20(t):
    out = R.block_resample(t.monthly(), ["entity"], "d", 20, 6)
    return out.groupBy("entity", "draw").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4).alias("mean"))


@query("f20_stationary_resample")
def f20s(t):
    out = R.stationary_resample(t.monthly(), ["entity"], "d", 20, 6)
    return out.groupBy("entity", "draw").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 4).alias("mean"))


@query("f21_block_ci")
def f21(t):
    x = C.log_return(t.monthly(), ["entity"], "d", "value").where("ret IS NOT NULL")
    out = R.block_ci(x, ["entity"], "d", "ret", F.month("d").isin(6, 7, 8), 200)
    return out.select("entity", "n", r("mean").alias("mean"), r("lo").alias("lo"), r("hi").alias("hi"))


@query("f21_permutation_p")
def f21p(t):
    out = R.permutation_p(t.ship_all(), "d", "price", F.col("disc") > 0.055, 200)
    return out.select(r("observed").alias("observed"), "p_value", r("null_mean").alias("null_mean"), "draws")


@query("f21_mean_bootstrap")
def f21m(t):
    out = R.mean_bootstrap(t.ship_all(), "d", "price", F.col("disc") > 0.055, 100)
    return out.select(r("observed").alias("observed"), "p_value", "draws")


@query("f21_block_ci_median")
def f21bm(t):
    x = C.log_return(t.monthly(), ["entity"], "d", "value").where("ret IS NOT NULL")
    out = R.block_ci(x, ["entity"], "d", "ret", F.month("d").isin(6, 7, 8), 200, statistic=S.median("ret"))
    return out.select("entity", "n", r("value").alias("median"), r("lo").alias("lo"), r("hi").alias("hi"))


def _intervals(t, statistic):
    out = S.interval(t.raw("lineitem"), ["l_returnflag"], ["l_suppkey"], statistic, 100)
    return out.select("l_returnflag", r("value").alias("value"), F.col("value").between(F.col("lo"), F.col("hi")).alias("inside"), F.col("draws").cast("long").alias("draws"))


_INTERVAL_SQL = "SELECT l_returnflag, round({}, 6) AS value, TRUE AS inside, CAST(100 AS BIGINT) AS draws FROM lineitem GROUP BY 1"


@query("f21_interval_median", _INTERVAL_SQL.format("quantile_cont(l_extendedprice, 0.5)"))
def f21im(t):
    return _intervals(t, S.median("l_extendedprice"))


@query("f21_interval_corr", _INTERVAL_SQL.format("corr(l_quantity, l_extendedprice)"))
def f21ic(t):
    return _intervals(t, S.correlation("l_quantity", "l_extendedprice"))


@query(
    "f22_shuffle_invariants",
    """SELECT CAST(draw AS INTEGER) AS draw, site, CAST(month(d) AS INTEGER) AS month, count(*) AS n, round(sum(value), 2) AS total, max(value) AS top
    FROM site_day, (SELECT unnest(range(3)) AS draw) GROUP BY 1, 2, 3""",
    "site_day",
)
def f22(t):
    out = R.shuffle_within_months(t.site_day(), "site", "d", "value", 3)
    return out.groupBy("draw", "site", F.month("d").alias("month")).agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"), F.max("value").alias("top"))


@query("f22_shuffled_fleet_p5")
def f22p(t):
    out = R.shuffle_within_months(t.site_day(), "site", "d", "value", 10)
    fleet = out.groupBy("draw", "d").agg(F.sum("value").alias("fleet"))
    return exact_quantiles(fleet, ["draw"], "fleet", [0.05]).select("draw", r("fleet", 2).alias("p5"))


@query("f23_independent_years")
def f23(t):
    return R.independent_years(t.site_day(), "site", "d", "value", 50).select("draw", "month", "sites", r("total", 2).alias("total"))


_THETAS = [1.0 + i / 20 for i in range(1, 41)]
_RHOS = [i / 50 for i in range(-40, 41)]
_U_SQL = """u AS (SELECT a, b, (rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2) / (count(*) OVER (PARTITION BY a, b) + 1) AS u,
    (rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2) / (count(*) OVER (PARTITION BY a, b) + 1) AS v FROM p)"""


@query(
    "f24_gumbel_grid_fit",
    f"""WITH {_WIDE}, {_PAIR_SQL}, {_U_SQL}, g AS (SELECT unnest({_THETAS})::DOUBLE AS theta),
    z AS (SELECT a, b, theta, -ln(u) AS x, -ln(v) AS y, pow(pow(-ln(u), theta) + pow(-ln(v), theta), 1 / theta) AS big, pow(-ln(u), theta) + pow(-ln(v), theta) AS s FROM u, g),
    l AS (SELECT a, b, theta, sum(-big + ln(big + theta - 1) + (1 - 2 * theta) / theta * ln(s) + (theta - 1) * (ln(x) + ln(y)) + x + y) AS ll, count(*) AS n FROM z GROUP BY 1, 2, 3),
    m AS (SELECT a, b, arg_max(theta, (round(ll, 6), -theta)) AS theta, arg_max(ll, (round(ll, 6), -theta)) AS ll, any_value(n) AS n FROM l GROUP BY 1, 2)
    SELECT a, b, n, round(theta, 4) AS theta, round(ll, 4) AS loglik, round(2 - 2 * ll, 4) AS aic, round(2 - pow(2, 1 / theta), 6) AS tail FROM m""",
    "daily",
)
def f24(t):
    out = K.gumbel_grid_fit(K.pseudo_pair(_pair_rows(t), ["a", "b"], "x", "y"), ["a", "b"], _THETAS)
    return out.select("a", "b", "n", r("theta", 4).alias("theta"), r("loglik", 4).alias("loglik"), r("aic", 4).alias("aic"), r("tail").alias("tail"))


@query("f24_gaussian_copula_fit")
def f24g(t):
    out = K.gaussian_copula_fit(K.pseudo_pair(_pair_rows(t), ["a", "b"], "x", "y"), ["a", "b"], _RHOS)
    return out.select("a", "b", "n", "rho", r("loglik", 4).alias("loglik"), r("aic", 4).alias("aic"))


@query("f24_gumbel_rolling")
def f24r(t):
    """Rolling windows of 36 months, every third month: a row joins the windows that cover it."""
    from pyspark.sql import Window

    from strandline.operators.joins import align

    m = t.monthly()
    wide = align({n: (m.where(F.col("entity") == p), "d", "value") for n, p in PRIORITIES.items()}, "d")
    pos = wide.withColumn("_i", F.row_number().over(Window.orderBy("d"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    lo = F.greatest(F.lit(0), F.ceil((F.col("_i") - 36) / 3))
    hi = F.floor(F.least(F.col("_n") - 36, F.col("_i") - 1) / 3)
    rolled = pos.where(lo <= hi).withColumn("window", F.explode(F.sequence(lo, hi)))
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]])
    keys = ["window", "a", "b"]
    out = K.gumbel_grid_fit(K.pseudo_pair(rolled.select("window", F.inline(both)), keys, "x", "y"), keys, _THETAS)
    return out.select(*keys, "n", r("theta", 4).alias("theta"), r("tail").alias("tail"))


@query("f24_t_copula_grid_fit")
def f24t(t):
    pairs = _pair_rows(t)
    at = {n: i for i, n in enumerate(NAMES)}
    number = F.create_map(*[F.lit(v) for kv in at.items() for v in kv])
    k = D.kendall(pairs, ["a", "b"], "x", "y").select(number[F.col("a")].alias("i"), number[F.col("b")].alias("j"), "n", "r")
    from strandline.plans.family_c import aligned_daily

    long = aligned_daily(t).unpivot(["d"], NAMES, "var", "value")
    from strandline.operators.ordering import value_ranks

    ranks = value_ranks(long, ["var"], "value")
    u = (F.col("n_below") + (F.col("n_eq") + 1) / 2) / (F.col("n_all") + 1)
    pseudo = long.join(ranks.select("var", "value", u.alias("u")), ["var", "value"])
    out = K.t_copula_grid_fit(G.vectors(pseudo, ["d"], "var", "u", NAMES), "vec", k, [3, 5, 8, 12, 20, 40])
    return out.select("nu", r("loglik", 4).alias("loglik"))


_SITE_PAIRS = (
    "full_d AS (SELECT d FROM site_month GROUP BY 1 HAVING count(*) = 25), sm AS (SELECT * FROM site_month WHERE d IN (FROM full_d)), "
    "c AS (SELECT a.site AS i, b.site AS j, count(*) AS n, corr(a.value, b.value) AS r FROM sm a JOIN sm b ON a.d = b.d AND a.site < b.site GROUP BY 1, 2), "
    "pr AS (SELECT i, j, n, r, 12742.0 * asin(sqrt(least(1.0, pow(sin(radians(g.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - p.lon) / 2), 2)))) AS km "
    "FROM c JOIN sites p ON p.site = i JOIN sites g ON g.site = j)"
)


def site_pairs(t):
    """Correlation of every pair of sites i < j with their distance; sums per pair, not rows per pair."""
    corr = G.correlations(G.gram(G.vectors(t.site_month(), ["d"], "site", "value", list(range(25))), "vec")).where("i < j")
    s = t.sites()
    a = s.select(F.col("site").alias("i"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = s.select(F.col("site").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return corr.join(a, "i").join(b, "j").select("i", "j", "n", "r", C.haversine_km("lat1", "lon1", "lat2", "lon2").alias("km"))


@query("c9_pairs", f"WITH {_SITE_PAIRS} SELECT i, j, n, round(r, 6) AS r, round(km, 4) AS km FROM pr", "site_month sites")
def c9(t):
    return site_pairs(t).select("i", "j", "n", r("r").alias("r"), r("km", 4).alias("km"))


_LS, _PS = [50.0, 100.0, 200.0, 400.0, 800.0], [0.5, 1.0, 1.5, 2.0]


@query(
    "f25_distance_decay",
    f"""WITH {_SITE_PAIRS}, l AS (SELECT unnest({_LS})::DOUBLE AS "L"), q AS (SELECT unnest({_PS})::DOUBLE AS p),
    s AS (SELECT "L", p, round(sum(pow(r - exp(-pow(km / "L", p)), 2)), 9) AS sse, count(*) AS n_pairs FROM pr, l, q GROUP BY 1, 2)
    SELECT round(sse, 6) AS sse, "L", p, n_pairs FROM s ORDER BY s.sse, "L", p LIMIT 1""",
    "site_month sites",
)
def f25(t):
    return K.distance_decay(site_pairs(t), [], "km", "r", _LS, _PS).withColumn("sse", r("sse"))


@query("g37_error_overlay")
def g37(t):
    base = t.site_day()
    mean = base.groupBy("site").agg(F.avg("value").alias("_m"))
    errors = base.join(mean, "site").select("site", "d", (F.col("value") - F.col("_m")).alias("err"))
    out = R.error_overlay(base, errors, "site", "d", "value", "err", 5)
    return exact_quantiles(out, ["draw", "site"], "value", [0.05]).select("draw", "site", r("value", 2).alias("p5"))
