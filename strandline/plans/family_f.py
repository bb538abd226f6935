"""Dependence and matrix analytics."""

from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.functions.normal import normal_quantile_sql
from strandline.operators import dependence as D
from strandline.operators import gram as G
from strandline.operators.aggregate import zscore_by
from strandline.operators.joins import align
from strandline.operators.windows import sta_lta_pick
from strandline.plans.family_c import INTERVALS_SQL, PRIORITIES, WIDE_SQL, aligned_daily
from strandline.plans.registry import query
from strandline.plans.tables import keep

VARS = list(range(64))
NAMES = list(PRIORITIES)
TYPES = ["click", "error", "purchase", "signup", "view"]


def r(c, n=6):
    return F.round(c, n)


def var_vectors(t, by=()):
    return t.raw("embeddings").select(F.col("vec_id").alias("t"), *by, F.transform("embedding", lambda v: v.cast("double")).alias("vec"))


_CORR_SQL = """SELECT a.var AS i, b.var AS j, count(*) AS n, round(CASE WHEN a.var = b.var THEN 1.0 ELSE corr(a.{v}, b.{v}) END, 6) AS r
    FROM {src} a JOIN {src} b ON a.t = b.t AND a.var <= b.var GROUP BY 1, 2"""
_RANKED = "k AS (SELECT t, var, rank() OVER (PARTITION BY var ORDER BY value) + (count(*) OVER (PARTITION BY var, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY var) AS n FROM variables)"


@query("f1_corr_pearson", _CORR_SQL.format(v="value", src="variables"), "variables")
def f1(t):
    return G.correlations(G.gram(var_vectors(t), "vec")).withColumn("r", r("r"))


@query("f2_corr_spearman", f"WITH {_RANKED} " + _CORR_SQL.format(v="rk", src="k"), "variables")
def f2(t):
    return D.corr_pairs(t.variables(), "t", "var", "value", VARS, "spearman").withColumn("r", r("r"))


@query(
    "f3_corr_gaussian_rank",
    f"""WITH x AS (SELECT t, var, (rank() OVER (PARTITION BY var ORDER BY value) + (count(*) OVER (PARTITION BY var, value) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY var) AS u FROM variables WHERE var < {len(VARS)}),
    z AS (SELECT t, var, {normal_quantile_sql("u")} AS z FROM x)
    SELECT a.var AS i, b.var AS j, count(*) AS n, round(corr(a.z, b.z), 6) AS r FROM z a JOIN z b ON a.t = b.t AND a.var <= b.var GROUP BY 1, 2""",
    "variables",
)
def f3(t):
    return D.corr_pairs(t.variables(), "t", "var", "value", VARS, "gaussian_rank").withColumn("r", r("r"))


_PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
_WIDE = f"w AS (SELECT d, {WIDE_SQL} FROM daily GROUP BY d), c AS (SELECT * FROM w WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in NAMES) + ")"
_PAIR_SQL = "p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, d, {a} AS x, {b} AS y FROM c" for a, b in _PAIRS) + ")"


def _pair_rows(t):
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in _PAIRS])
    return keep(aligned_daily(t).select("d", F.inline(rows)))  # days times pairs of series


@query(
    "f4_kendall",
    f"""WITH {_WIDE}, {_PAIR_SQL}, s AS (SELECT u.a, u.b, sum(sign(v.x - u.x) * sign(v.y - u.y)) AS s, count(*) FILTER (WHERE v.x = u.x) AS tx,
        count(*) FILTER (WHERE v.y = u.y) AS ty, count(*) AS n0 FROM p u JOIN p v ON u.a = v.a AND u.b = v.b AND u.d < v.d GROUP BY 1, 2),
    n AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2)
    SELECT a, b, n, round(s / sqrt((n0 - tx) * (n0 - ty)), 6) AS tau, round(sin(pi() / 2 * s / sqrt((n0 - tx) * (n0 - ty))), 6) AS r FROM s JOIN n USING (a, b)""",
    "daily",
)
def f4(t):
    out = D.kendall(_pair_rows(t), ["a", "b"], "x", "y")
    return out.select("a", "b", "n", r("tau").alias("tau"), r("r").alias("r"))


@query("f5_partial_corr")
def f5(t):
    return D.partial_corr(G.correlations(G.gram(var_vectors(t), "vec"))).withColumn("r", r("r"))


@query(
    "f6_distance_corr",
    f"""WITH {_WIDE}, {_PAIR_SQL}, z AS (SELECT u.a, u.b, u.d, abs(u.x - v.x) AS dx, abs(u.y - v.y) AS dy FROM p u JOIN p v ON u.a = v.a AND u.b = v.b),
    m AS (SELECT a, b, d, avg(dx) AS mx, avg(dy) AS my, avg(dx * dy) AS xy, avg(dx * dx) AS xx, avg(dy * dy) AS yy, count(*) AS n FROM z GROUP BY 1, 2, 3),
    g AS (SELECT a, b, count(*) AS n, avg(xy) - 2 * avg(mx * my) + avg(mx) * avg(my) AS cov, avg(xx) - 2 * avg(mx * mx) + avg(mx) * avg(mx) AS vx,
        avg(yy) - 2 * avg(my * my) + avg(my) * avg(my) AS vy FROM m GROUP BY 1, 2)
    SELECT a, b, n, round(sqrt(cov / sqrt(vx * vy)), 5) AS dcor FROM g""",
    "daily",
)
def f6(t):
    return D.distance_corr(_pair_rows(t), ["a", "b"], "x", "y").withColumn("dcor", r("dcor", 5))


_QS = [0.3, 0.2, 0.1, 0.05]


def _tail_sql(op, at):
    return f"""WITH q AS (SELECT unnest({_QS})::DOUBLE AS q), c AS (SELECT l_returnflag, q, {', '.join(f'CASE q ' + ' '.join(f'WHEN {v} THEN quantile_cont({col}, {at(v)})' for v in _QS) + f' END AS c{n}' for n, col in enumerate(('l_extendedprice', 'l_quantity')))}
        FROM lineitem, q GROUP BY 1, 2)
    SELECT l_returnflag, q, round(avg(CASE WHEN l_quantity {op} c1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE l_extendedprice {op} c0), 6) AS chi
    FROM lineitem JOIN c USING (l_returnflag) GROUP BY 1, 2"""


@query("f7_tail_dependence_lower", _tail_sql("<=", lambda q: q))
def f7(t):
    return D.tail_dependence(t.raw("lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", _QS).withColumn("chi", r("chi"))


@query("f7_chi_curve_upper", _tail_sql(">=", lambda q: 1 - q))
def f7u(t):
    return D.tail_dependence(t.raw("lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", _QS, "upper").withColumn("chi", r("chi"))


@query(
    "f8_pairwise_chi",
    f"""WITH {_RANKED}, u AS (SELECT t, var, rk / (n + 1) AS u FROM k), q AS (SELECT unnest([0.05, 0.1])::DOUBLE AS q),
    x AS (SELECT q, a.var AS i, b.var AS j, avg((a.u < q AND b.u < q)::INT) / q AS lo, avg((a.u > 1 - q AND b.u > 1 - q)::INT) / q AS hi
        FROM u a JOIN u b ON a.t = b.t AND a.var < b.var, q GROUP BY 1, 2, 3)
    SELECT q, 'lower' AS side, round(avg(lo), 6) AS chi FROM x GROUP BY 1 UNION ALL SELECT q, 'upper', round(avg(hi), 6) FROM x GROUP BY 1""",
    "variables",
)
def f8(t):
    return D.pairwise_chi(t.variables(), "t", "var", "value", VARS, [0.05, 0.1]).withColumn("chi", r("chi"))


_LAG_SQL = """b AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY d) AS i, price AS x, disc AS y FROM ship),
    s AS (SELECT a.entity, CAST(lag AS INTEGER) AS lag, corr(a.x, c.y) AS r, count(*) AS n FROM b a, (SELECT unnest(range(-10, 11)) AS lag) l JOIN b c ON c.entity = a.entity AND c.i = a.i + lag GROUP BY 1, 2)"""


@query("f9_lead_lag", f"WITH {_LAG_SQL} SELECT entity, lag, n, round(r, 6) AS r FROM s", "ship")
def f9(t):
    return D.lead_lag(t.ship(), ["entity"], "d", "price", "disc", 10).select("entity", "lag", "n", r("r").alias("r"))


@query("f9_best_lag", f"WITH {_LAG_SQL} SELECT entity, arg_max(lag, (round(abs(r), 12), -lag)) AS lag, round(arg_max(r, (round(abs(r), 12), -lag)), 6) AS r FROM s GROUP BY 1", "ship")
def f9b(t):
    return D.best_lag(D.lead_lag(t.ship(), ["entity"], "d", "price", "disc", 10), ["entity"]).withColumn("r", r("r"))


@query(
    "f10_lag_scan",
    """WITH b AS (SELECT row_number() OVER (ORDER BY d) AS i, * FROM ship_all),
    h AS (UNPIVOT (SELECT i, disc, tax FROM b) ON disc, tax INTO NAME hazard VALUE x), y AS (UNPIVOT (SELECT i, price, qty FROM b) ON price, qty INTO NAME target VALUE y),
    s AS (SELECT hazard, target, CAST(lag AS INTEGER) AS lag, corr(x, y) AS r, count(*) AS n FROM h, (SELECT unnest(range(0, 7)) AS lag) l JOIN y ON y.i = h.i + lag GROUP BY 1, 2, 3)
    SELECT hazard, target, lag, n, round(r, 6) AS r, round(1.96 / sqrt(n - 3), 6) AS band, abs(r) > 1.96 / sqrt(n - 3) AS significant FROM s""",
    "ship_all",
)
def f10(t):
    out = D.lag_scan(t.ship_all(), "d", ["disc", "tax"], ["price", "qty"], range(7))
    return out.select("hazard", "target", "lag", "n", r("r").alias("r"), r("band").alias("band"), "significant")


@query("f10_lag_scan_rank")
def f10g(t):
    out = D.lag_scan(t.ship_all(), "d", ["disc", "tax"], ["price", "qty"], range(7), gaussian=True)
    return out.select("hazard", "target", "lag", "n", r("r").alias("r"), r("n_eff").alias("n_eff"), r("band").alias("band"), "significant")


_FACTOR = """f AS (SELECT *, any_value(value) FILTER (WHERE var = 0) OVER (PARTITION BY t) AS f FROM variables),
    l AS (SELECT var, regr_slope(value, f) AS loading, avg(value) AS mx, avg(f) AS mf, regr_r2(value, f) AS shared FROM f WHERE var > 0 GROUP BY 1)"""


def _with_factors(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("t"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(2)], F.posexplode("embedding").alias("var", "value"))
    return e.withColumn("value", F.col("value").cast("double"))


@query("f11_regress_out", f"WITH {_FACTOR} SELECT t, f.var, round(value - mx - loading * (f - mf), 6) AS residual FROM f JOIN l ON l.var = f.var", "variables")
def f11(t):
    res, _ = D.regress_out(_with_factors(t).where("var > 0"), "var", "value", "f0")
    return res.select("t", "var", r("residual").alias("residual"))


@query("f11_loadings", f"WITH {_FACTOR} SELECT var, round(loading, 6) AS loading, round(shared, 6) AS shared FROM l", "variables")
def f11l(t):
    _, load = D.regress_out(_with_factors(t).where("var > 0"), "var", "value", "f0")
    return load.select("var", r("loading").alias("loading"), r("shared").alias("shared"))


@query("f11_regress_out_many")
def f11m(t):
    res, _ = D.regress_out_many(_with_factors(t).where("var > 1"), "var", "value", ["f0", "f1"])
    return res.groupBy("var").agg(r(F.corr("residual", "f0"), 9).alias("left_f0"), r(F.stddev_pop("residual")).alias("sd"))


@query("f12_remove_modes")
def f12(t):
    load = D.mode_loadings(G.correlations(G.gram(var_vectors(t), "vec")), 2)
    res, _ = D.remove_modes(t.variables(), "t", "var", "value", load)
    return res.select("t", "var", r("residual").alias("residual"))


@query("f12_remove_modes_matrix")
def f12m(t):
    return D.remove_modes_matrix(G.correlations(G.gram(var_vectors(t), "vec")), 2).withColumn("r", r("r"))


@query(
    "f13_effective_rank",
    """WITH x AS (SELECT entity, d, ln(value) - lag(ln(value)) OVER (PARTITION BY entity ORDER BY d) AS ret FROM monthly),
    y AS (SELECT entity, d, ret - avg(ret) OVER (PARTITION BY entity, month(d)) AS z FROM x WHERE ret IS NOT NULL),
    f AS (SELECT d FROM y GROUP BY 1 HAVING count(*) = 5), v AS (SELECT * FROM y WHERE d IN (FROM f)),
    c AS (SELECT a.entity AS i, b.entity AS j, CASE WHEN a.entity = b.entity THEN 1.0 ELSE corr(a.z, b.z) END AS r FROM v a JOIN v b ON a.d = b.d GROUP BY 1, 2)
    SELECT round(25.0 / sum(r * r), 6) AS effective_rank, round(25.0 / sum(r), 6) AS n_effective FROM c""",
    "monthly",
)
def f13(t):
    ret = C.log_return(t.monthly(), ["entity"], "d", "value").where("ret IS NOT NULL")
    z = zscore_by(ret, ["entity", F.month("d")], "ret", "z", "demean")
    corr = D.corr_pairs(z, "d", "entity", "z", list(PRIORITIES.values()))
    return D.effective_rank(corr).select(r("effective_rank").alias("effective_rank"), r("n_effective").alias("n_effective"))


def _label_corr(t):
    return G.correlations(G.gram(var_vectors(t, ["label"]), "vec", ["label"]), ["label"])


@query("f14_noise_band")
def f14(t):
    out = D.noise_summary(_label_corr(t), ["label"])
    return out.select("label", "n_signal", *[r(c).alias(c) for c in ("variance", "lower", "upper", "largest", "effective_rank")])


@query("f14_clean_corr")
def f14c(t):
    parts = [D.clean_corr(_label_corr(t), m, ["label"]).withColumn("method", F.lit(m)) for m in ("clip", "linear_shrinkage", "nonlinear_shrinkage")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("r", r("r"))


@query("f15_tyler_corr")
def f15(t):
    return D.tyler_corr(var_vectors(t), "vec").withColumn("r", r("r", 4))


@query("f16_correlator")
def f16(t):
    c = D.Correlator(measure="gaussian_rank", modes=1, clean="nonlinear_shrinkage", output="partial", effective_n="bartlett")
    return c.fit(t.variables(), "t", "var", "value", VARS).withColumn("r", r("r"))


@query("f17_min_variance_weights")
def f17(t):
    cov = G.covariances(G.gram(var_vectors(t), "vec"))
    return D.min_variance_weights(cov, []).withColumn("weight", r("weight"))


@query("f17_oos_risk")
def f17o(t):
    out = D.oos_risk(var_vectors(t), "t", "vec", 120, 40, ["raw", "clip", "linear_shrinkage", "nonlinear_shrinkage"])
    return out.select("block", "method", "n", r("predicted").alias("predicted"), r("realised").alias("realised"))


def _hour_prices(t):
    h = t.hourly()
    return align({n: (h.where(F.col("entity") == n), "h", "value") for n in TYPES}, "h")


_HOURS = "hp AS (SELECT h, " + ", ".join(f"max(value) FILTER (WHERE entity = '{n}') AS {n}" for n in TYPES) + " FROM hourly GROUP BY h), al AS (SELECT row_number() OVER (ORDER BY h) - 1 AS i, * FROM hp WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in TYPES) + ")"
_RETURNS = "long AS (UNPIVOT (SELECT i, " + ", ".join(TYPES) + " FROM {src}) ON " + ", ".join(TYPES) + " INTO NAME v VALUE p), ret AS (SELECT v, i, row_number() OVER w AS k, ln(p / lag(p) OVER w) AS x FROM long {where} WINDOW w AS (PARTITION BY v ORDER BY i))"


@query("f18_realised_cov", f"WITH {_HOURS}, {_RETURNS.format(src='al', where='WHERE i % 3 = 0')} SELECT a.v AS i, b.v AS j, round(sum(a.x * b.x), 5) AS cov FROM ret a JOIN ret b ON a.k = b.k AND a.v <= b.v GROUP BY 1, 2", "hourly")
def f18(t):
    return D.realised_cov(_hour_prices(t), "h", TYPES, 3).withColumn("cov", r("cov", 5))


@query("f18_lead_lag_adjusted", f"WITH {_HOURS}, {_RETURNS.format(src='al', where='')} SELECT a.v AS i, b.v AS j, round(sum(a.x * b.x), 5) AS cov FROM ret a JOIN ret b ON abs(a.k - b.k) <= 1 AND a.v <= b.v GROUP BY 1, 2", "hourly")
def f18l(t):
    return D.lead_lag_adjusted(_hour_prices(t), "h", TYPES).withColumn("cov", r("cov", 5))


@query("f18_block_averaged_cov", f"WITH {_HOURS}, bl AS (SELECT i // 10 AS i, " + ", ".join(f"avg({n}) AS {n}" for n in TYPES) + f" FROM al GROUP BY 1 HAVING count(*) = 10), {_RETURNS.format(src='bl', where='')} SELECT a.v AS i, b.v AS j, round(sum(a.x * b.x), 6) AS cov FROM ret a JOIN ret b ON a.k = b.k AND a.v <= b.v GROUP BY 1, 2", "hourly")
def f18b(t):
    return D.block_averaged_cov(_hour_prices(t), "h", TYPES, 10).withColumn("cov", r("cov"))


@query(
    "f18_epps_curve",
    f"""WITH {_HOURS}, s AS (SELECT unnest([1, 2, 4, 8]) AS step), z AS (SELECT step, """ + ", ".join(f"ln({n} / lag({n}) OVER w) AS {n}" for n in TYPES) + """ FROM al, s WHERE i % step = 0 WINDOW w AS (PARTITION BY step ORDER BY i))
    """ + " UNION ALL ".join(f"SELECT step, '{a}' AS a, '{b}' AS b, round(sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})), 6) AS r FROM z GROUP BY 1" for i, a in enumerate(TYPES) for b in TYPES[i + 1 :]),
    "hourly",
)
def f18e(t):
    return D.epps_curve(_hour_prices(t), "h", TYPES, [1, 2, 4, 8]).withColumn("r", r("r"))


@query(
    "f19_hayashi_yoshida",
    f"""WITH {INTERVALS_SQL} SELECT a.asset AS i, b.asset AS j, round(sum(a.ret * b.ret), 4) AS cov FROM iv a JOIN iv b ON a.start < b."end" AND b.start < a."end" AND (a.asset < b.asset OR (a.asset = b.asset AND a.start = b.start)) GROUP BY 1, 2""",
    "ticks",
)
def f19(t):
    ticks = t.ticks().withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return D.hayashi_yoshida(ticks, "asset", "sec", "price", TYPES).withColumn("cov", r("cov", 4))


@query("f26_corr_with_reference", "SELECT a.var, round(corr(a.value, b.value), 6) AS r FROM variables a JOIN variables b ON a.t = b.t AND b.var = 5 GROUP BY 1", "variables")
def f26(t):
    return D.corr_with_reference(var_vectors(t), "vec", 5).withColumn("r", r("r"))


def _sensors(t):
    """Five sensors (event types) sampled each hour; the sample number is the hour of the record."""
    h = t.hourly()
    first = h.agg(F.min("h").alias("_h0"))
    return h.crossJoin(F.broadcast(first)).select((F.col("h") - F.col("_h0")).alias("i"), "entity", "value")


_SENSOR_SQL = "s AS (SELECT h - min(h) OVER () AS i, entity, value FROM hourly)"


@query("f27_stack_mean", f"WITH {_SENSOR_SQL} SELECT i, round(sum(value) / 5, 5) AS stack FROM s GROUP BY 1", "hourly")
def f27(t):
    s = _sensors(t)
    return D.stack(s, "i", "entity", "value", D.mean_weights(s, "entity")).withColumn("stack", r("stack", 5))


_SNR = "w AS (SELECT entity, var_pop(value) FILTER (WHERE i >= 300 AND i < 500) / greatest(var_pop(value) FILTER (WHERE i < 300), 1e-12) AS snr FROM s GROUP BY 1), q AS (SELECT entity, snr / sum(snr) OVER () AS weight FROM w)"


@query("f27_stack_snr", f"WITH {_SENSOR_SQL}, {_SNR} SELECT i, round(sum(value * weight), 5) AS stack FROM s JOIN q USING (entity) GROUP BY 1", "hourly")
def f27s(t):
    s = _sensors(t)
    return D.stack(s, "i", "entity", "value", D.snr_weights(s, "i", "entity", "value", (0, 300), (300, 500))).withColumn("stack", r("stack", 5))


@query(
    "f27_gain_db",
    f"WITH {_SENSOR_SQL}, m AS (SELECT i, sum(value) / 5 AS stack FROM s GROUP BY 1) SELECT round(20 * log10(stddev_pop(value) / stddev_pop(stack)), 5) AS gain FROM m JOIN s USING (i) WHERE entity = 'view' AND i < 300",
    "hourly",
)
def f27g(t):
    s = _sensors(t)
    one = s.where("entity = 'view'").select("i", F.col("value").alias("single"))
    return D.gain_db(D.stack(s, "i", "entity", "value", D.mean_weights(s, "entity")), one, "i", "stack", "single", (0, 300)).withColumn("gain", r("gain", 5))


def _sensor_vectors(t):
    return G.vectors(_sensors(t), ["i"], "entity", "value", TYPES)


def _numbered(t):
    at = F.create_map(*[F.lit(v) for k in enumerate(TYPES) for v in (k[1], k[0])])
    return _sensors(t).withColumn("sensor", F.try_element_at(at, F.col("entity")))


@query("f27_stack_mvdr")
def f27m(t):
    w = D.mvdr_weights(G.covariances(G.gram(_sensor_vectors(t), "vec")))
    return D.stack(_numbered(t), "i", "sensor", "value", w).withColumn("stack", r("stack", 5))


@query("f27_common_mode")
def f27c(t):
    w = D.common_mode_weights(G.covariances(G.gram(_sensor_vectors(t), "vec")))
    return D.stack(_numbered(t), "i", "sensor", "value", w).withColumn("stack", r("stack", 5))


@query(
    "f27_align_traces",
    """WITH b AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY d) AS i, qty AS x FROM ship), l AS (SELECT unnest(range(-10, 11)) AS lag),
    z AS (SELECT a.entity, a.i, f.x AS fx, a.x FROM b a JOIN b f ON f.i = a.i AND f.entity = 'A'),
    s AS (SELECT a.entity, lag, corr(a.fx, c.x) AS r FROM z a, l JOIN z c ON c.entity = a.entity AND c.i = a.i + lag GROUP BY 1, 2),
    k AS (SELECT entity, arg_max(lag, (round(abs(r), 12), -lag)) AS shift FROM s GROUP BY 1)
    SELECT g.entity, g.i, coalesce(m.x, 0.0) AS aligned FROM b g JOIN k ON k.entity = g.entity LEFT JOIN b m ON m.entity = g.entity AND m.i = g.i + shift""",
    "ship",
)
def f27a(t):
    from pyspark.sql import Window

    s = t.ship().select("entity", F.row_number().over(Window.partitionBy("entity").orderBy("d")).cast("long").alias("i"), "qty")
    return D.align_traces(s, "i", "entity", "qty", "A", 10)[0]


@query("f28_pca_denoise")
def f28(t):
    out = D.pca_denoise(var_vectors(t), "vec")
    return out.select("t", "kept", r(F.aggregate("clean", F.lit(0.0), lambda a, v: a + v * v)).alias("energy"))


@query(
    "f29_picker_scoreboard",
    """WITH two AS (SELECT t, var, unnest(['raw', 'smooth']) AS method, unnest([value, m]) AS a FROM (SELECT t, var, value, avg(value) OVER (PARTITION BY t ORDER BY var ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM variables)),
    x AS (SELECT *, avg(a * a) OVER (PARTITION BY method, t ORDER BY var ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / greatest(avg(a * a) OVER (PARTITION BY method, t ORDER BY var ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 1e-20) AS ratio FROM two),
    p AS (SELECT method, t, coalesce(min(var) FILTER (WHERE var >= 20 AND ratio > 1.5), -1) AS pick, 10 * log10(greatest(var_pop(a) FILTER (WHERE var BETWEEN 32 AND 51), 1e-20) / greatest(var_pop(a) FILTER (WHERE var BETWEEN 2 AND 26), 1e-20)) AS snr,
        CASE WHEN avg(a) FILTER (WHERE var BETWEEN 33 AND 35) - avg(a) FILTER (WHERE var BETWEEN 22 AND 31) > 0 THEN 0 ELSE 1 END AS motion FROM x GROUP BY 1, 2),
    e AS (SELECT p.*, CASE WHEN pick >= 0 THEN (pick - 32) / 10.0 END AS err, label % 2 AS truth, q.snr AS raw_snr FROM p JOIN (SELECT t, snr FROM p WHERE method = 'raw') q USING (t) JOIN embeddings ON vec_id = t)
    SELECT method, count(*) AS n, round(avg(CASE WHEN abs(err) <= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS share, round(quantile_cont(err, 0.5) FILTER (WHERE abs(err) <= 0.8), 6) AS bias, round(quantile_cont(abs(err), 0.5), 6) AS median_error,
        round(avg(CASE WHEN motion = truth THEN 1.0 ELSE 0.0 END), 6) AS polarity, round(quantile_cont(snr - raw_snr, 0.5), 5) AS snr_gain FROM e GROUP BY 1""",
    "variables",
)
def f29(t):
    """Each trace as it is and smoothed; the label's parity stands for the true first motion."""
    from pyspark.sql import Window

    from strandline.operators.windows import first_motion, snr_db

    tr = t.variables().select(F.col("t").alias("trace"), F.col("var").alias("i"), F.col("value").alias("a"))
    last = Window.partitionBy("trace").orderBy("i").rowsBetween(-2, 0)  # a trace has a fixed number of samples
    both = tr.select("trace", "i", "a", F.lit("raw").alias("method")).unionByName(tr.select("trace", "i", F.avg("a").over(last).alias("a"), F.lit("smooth").alias("method")))
    keys = ["method", "trace"]
    found = sta_lta_pick(both, keys, "i", "a", 5, 20, 1.5, 20).join(snr_db(both, keys, "i", "a", F.lit(32), 20, 30, 5), keys).join(first_motion(both, keys, "i", "a", F.lit(32)), keys)
    raw_snr = found.where("method = 'raw'").select("trace", F.col("snr").alias("raw_snr"))
    truth = t.raw("embeddings").select(F.col("vec_id").alias("trace"), (F.col("label") % 2).alias("truth"))
    out = D.picker_scoreboard(found.join(raw_snr, "trace").join(truth, "trace"), "method", "pick", F.lit(32), 10.0, 0.8, "snr", "raw_snr", "motion", "truth")
    return out.select("method", "n", *[r(c).alias(c) for c in ("share", "bias", "median_error", "polarity")], r("snr_gain", 5).alias("snr_gain"))
