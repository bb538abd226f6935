"""Aggregations."""

from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import aggregate as A
from strandline.operators.ordering import first_per_group
from strandline.plans.family_c import PRIORITIES
from strandline.plans.registry import query


def r(c, n=6):
    return F.round(c, n)


_BIN_SQL = """x AS (SELECT user_id, CAST(ts AS DATE) AS d, ts, event_id, value FROM events),
    b AS (SELECT user_id, CAST({bin} AS DATE) AS d, round(sum(value), 4) AS total, count(*) AS n, round(max(value), 4) AS top,
        arg_max(value, (ts, event_id)) AS latest, arg_min(value, (ts, event_id)) AS earliest FROM x GROUP BY 1, 2),
    s AS (SELECT user_id, CAST(unnest(generate_series(min(d), max(d), INTERVAL {step})) AS DATE) AS d FROM b GROUP BY 1)
    SELECT s.user_id, s.d, coalesce(total, 0) AS total, coalesce(n, 0) AS n, top, latest, earliest FROM s LEFT JOIN b ON b.user_id = s.user_id AND b.d = s.d"""


def _resample(t, freq):
    e = t.raw("events").withColumn("d", F.to_date("ts"))
    return A.resample(
        e, ["user_id"], "d", freq,
        {
            "total": r(F.sum("value"), 4), "n": F.count(F.lit(1)), "top": r(F.max("value"), 4),
            "latest": A.last_known("value", "ts", "event_id"),
            "earliest": F.min_by("value", F.struct("ts", "event_id")),
        },
        zero=["total", "n"],
    )


@query("d1_resample_day", "WITH " + _BIN_SQL.format(bin="d", step="1 DAY"))
def d1(t):
    return _resample(t, "D")


@query("d1_resample_week_friday", "WITH " + _BIN_SQL.format(bin="d + CAST((12 - isodow(d)) % 7 AS INTEGER)", step="7 DAY"))
def d1w(t):
    return _resample(t, "W-FRI")


@query(
    "d1_resample_quarter_end",
    """WITH b AS (SELECT c.c_nationkey AS site, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, round(sum(o_totalprice), 2) AS total,
        round(stddev_samp(o_totalprice), 2) AS sd FROM orders JOIN customer c ON c_custkey = o_custkey GROUP BY 1, 2),
    s AS (SELECT site, CAST(unnest(generate_series(min(q), max(q), INTERVAL 3 MONTH)) AS DATE) AS q FROM b GROUP BY 1)
    SELECT s.site, CAST(s.q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS d, coalesce(total, 0) AS total, sd
    FROM s LEFT JOIN b ON b.site = s.site AND b.q = s.q""",
)
def d1q(t):
    aggs = {"total": r(F.sum("o_totalprice"), 2), "sd": r(F.stddev_samp("o_totalprice"), 2)}
    return A.resample(t._site_orders(), ["site"], "d", "QE", aggs, zero=["total"])


@query(
    "d2_weighted_sum",
    """SELECT o_custkey, CASE WHEN count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) >= 2 THEN
    round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END * (o_orderkey % 7 + 1)), 4) END AS total FROM orders GROUP BY 1""",
)
def d2(t):
    o = t.raw("orders").withColumn("x", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).withColumn("w", F.col("o_orderkey") % 7 + 1)
    return A.weighted_sum(o, ["o_custkey"], "x", "w", 2).withColumn("total", r("total", 4))


@query(
    "d3_complete_sum",
    """SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') = 0 THEN round(sum(o_totalprice), 2) END AS total FROM orders GROUP BY 1""",
)
def d3(t):
    o = t.raw("orders").withColumn("x", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return A.complete_sum(o, ["o_custkey"], "x").withColumn("total", r("total", 2))


@query(
    "d4_zscore_by",
    """WITH g AS (SELECT entity, month(d) AS m, avg(value) AS mu, stddev_samp(value) AS sd FROM monthly GROUP BY 1, 2)
    SELECT entity, d, round((value - mu) / sd, 6) AS z, round(value - mu, 3) AS centred, round(value / sd, 6) AS scaled
    FROM monthly JOIN g USING (entity) WHERE g.m = month(d)""",
    "monthly",
)
def d4(t):
    g = ["entity", F.month("d")]
    out = A.zscore_by(t.monthly(), g, "value")
    out = A.zscore_by(out, g, "value", "centred", "demean")
    out = A.zscore_by(out, g, "value", "scaled", "scale")
    return out.select("entity", "d", r("z").alias("z"), r("centred", 3).alias("centred"), r("scaled").alias("scaled"))


@query(
    "d5_median_anomaly",
    """WITH x AS (SELECT event_id, event_type, month(ts) AS m, hour(ts) AS h, value FROM events),
    g AS (SELECT event_type, m, h, quantile_cont(value, 0.5) AS med FROM x GROUP BY 1, 2, 3)
    SELECT event_id, round(value - med, 6) AS anomaly FROM x JOIN g USING (event_type, m, h)""",
)
def d5(t):
    e = t.raw("events").select("event_id", "event_type", F.month("ts").alias("m"), F.hour("ts").alias("h"), "value")
    return A.median_anomaly(e, ["event_type", "m", "h"], "value").select("event_id", r("anomaly").alias("anomaly"))


@query(
    "d6_climatology",
    """WITH p AS (SELECT site, dayofyear(d) AS doy, avg(value) AS clim FROM site_day GROUP BY 1, 2),
    g AS (SELECT s.site, q.doy, p.clim FROM (SELECT DISTINCT site FROM p) s CROSS JOIN (SELECT unnest(range(1, 367)) AS doy) q LEFT JOIN p ON p.site = s.site AND p.doy = q.doy),
    k AS (SELECT *, last_value(CASE WHEN clim IS NOT NULL THEN doy END IGNORE NULLS) OVER (PARTITION BY site ORDER BY doy) AS pa,
        last_value(clim IGNORE NULLS) OVER (PARTITION BY site ORDER BY doy) AS va,
        first_value(CASE WHEN clim IS NOT NULL THEN doy END IGNORE NULLS) OVER (PARTITION BY site ORDER BY doy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb,
        first_value(clim IGNORE NULLS) OVER (PARTITION BY site ORDER BY doy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vb FROM g),
    f AS (SELECT site, doy, CASE WHEN clim IS NOT NULL THEN clim WHEN pb IS NULL THEN va WHEN pa IS NULL THEN NULL ELSE va + (vb - va) * (doy - pa) / (pb - pa) END AS v FROM k),
    z AS (SELECT site, doy, v, doy AS pos FROM f UNION ALL SELECT site, doy, v, doy - 366 FROM f WHERE doy > 351 UNION ALL SELECT site, doy, v, doy + 366 FROM f WHERE doy <= 15),
    m AS (SELECT site, doy, pos, CASE WHEN count(v) OVER w = 31 THEN avg(v) OVER w END AS clim FROM z WINDOW w AS (PARTITION BY site ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))
    SELECT site, CAST(doy AS INTEGER) AS doy, round(clim + 1e-6, 4) AS clim FROM m WHERE pos BETWEEN 1 AND 366""",
    "site_day",
)
def d6(t):
    return A.climatology(t.site_day(), ["site"], "d", "value").withColumn("clim", r(F.col("clim") + 1e-6, 4))  # off exact halves


@query(
    "d7_reference_zscore",
    """WITH x AS (SELECT site, CAST(date_trunc('month', target) AS DATE) AS d, lead, avg(value) AS value FROM leads WHERE lead <= 3 GROUP BY 1, 2, 3),
    f AS (SELECT site, d, avg(value) AS value FROM x GROUP BY 1, 2 HAVING count(DISTINCT lead) = 3),
    c AS (SELECT site, month(d) AS m, avg(value) AS mu, stddev_samp(value) AS sd FROM f WHERE year(d) BETWEEN 1995 AND 1999 GROUP BY 1, 2)
    SELECT f.site, f.d, round((value - mu) / sd, 5) AS value_z FROM f LEFT JOIN c ON c.site = f.site AND c.m = month(f.d)""",
    "leads",
)
def d7(t):
    x = t.leads().groupBy("site", F.trunc("target", "MM").alias("d"), "lead").agg(F.avg("value").alias("value"))
    out = A.reference_zscore(x, ["site"], "d", "lead", ["value"], (1995, 1999))
    return out.select("site", "d", r("value_z", 5).alias("value_z"))


@query(
    "d8_trailing_zscore",
    """WITH x AS (SELECT site, d, value, count(value) OVER w AS n, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd FROM site_month
        WINDOW w AS (PARTITION BY site, month(d) ORDER BY year(d) RANGE BETWEEN 15 PRECEDING AND 1 PRECEDING))
    SELECT site, d, CASE WHEN n >= 3 THEN round((value - mu) / sd, 5) END AS z FROM x""",
    "site_month",
)
def d8(t):
    return A.trailing_zscore(t.site_month(), ["site"], "d", "value", 15, 3).select("site", "d", r("z", 5).alias("z"))


@query(
    "d9_group_quantiles",
    """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
    round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1, 2""",
)
def d9(t):
    out = A.group_quantiles(t.raw("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return out.select("l_returnflag", "l_linestatus", *[r(c, 4).alias(c) for c in ("p05", "p50", "p95")])


@query(
    "d10_cvar_count",
    """WITH x AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k,
        count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority, round(avg(o_totalprice), 4) AS cvar FROM x WHERE k <= greatest(1, ceil(n * 0.05::DOUBLE)) GROUP BY 1""",
)
def d10(t):
    return A.cvar_count(t.raw("orders"), ["o_orderpriority"], "o_totalprice").withColumn("cvar", r("cvar", 4))


@query(
    "d10_cvar_quantile",
    """WITH c AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.05) AS cut FROM orders GROUP BY 1)
    SELECT o_orderpriority, round(avg(o_totalprice), 4) AS cvar FROM orders JOIN c USING (o_orderpriority) WHERE o_totalprice <= cut GROUP BY 1""",
)
def d10q(t):
    return A.cvar_quantile(t.raw("orders"), ["o_orderpriority"], "o_totalprice").withColumn("cvar", r("cvar", 4))


@query(
    "d11_capture_price",
    """SELECT l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS capture,
    round(sum(l_quantity * l_extendedprice) / sum(l_quantity) / avg(l_extendedprice), 6) AS ratio FROM lineitem GROUP BY 1""",
)
def d11(t):
    out = A.capture_price(t.raw("lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return out.select("l_suppkey", r("capture", 4).alias("capture"), r("ratio").alias("ratio"))


@query(
    "d12_top_k_mean",
    """WITH x AS (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS k FROM lineitem)
    SELECT l_suppkey, round(avg(l_extendedprice), 4) AS top FROM x WHERE k <= 3 GROUP BY 1""",
)
def d12(t):
    return A.top_k_mean(t.raw("lineitem"), ["l_suppkey"], "l_extendedprice", 3).withColumn("top", r("top", 4))


_PRED_SQL = """p AS (SELECT l_quantity AS obs, l_suppkey % 80 AS anchor, l_linenumber AS lead, l_returnflag AS flag,
    25.5 AS flat, 20.0 + l_extendedprice / 10000 AS price, l_quantity * (1 - l_discount) + 1.5 AS shrunk FROM lineitem)"""


def _pred(t):
    return t.raw("lineitem").select(
        F.col("l_quantity").alias("obs"), (F.col("l_suppkey") % 80).alias("anchor"), F.col("l_linenumber").alias("lead"), F.col("l_returnflag").alias("flag"),
        F.lit(25.5).alias("flat"), (F.col("l_extendedprice") / 10000 + 20.0).alias("price"),
        (F.col("l_quantity") * (1 - F.col("l_discount")) + 1.5).alias("shrunk"),
    )


@query(
    "d13_skill_table",
    f"""WITH {_PRED_SQL}, c AS (SELECT quantile_cont(obs, 0.95) AS cut FROM p),
    u AS (SELECT CASE WHEN anchor < 30 THEN '< 30 km' WHEN anchor < 60 THEN '30-60 km' ELSE '> 60 km' END AS band, anchor >= 60 AS far, obs, cut,
        unnest(['flat', 'price', 'shrunk']) AS model, unnest([flat, price, shrunk]) - obs AS err FROM p, c)
    SELECT model, coalesce(band, 'all') AS "group", round(sqrt(avg(err * err)), 6) AS rmse, round(avg(err), 6) AS bias, count(err) AS n,
    round(sqrt(avg(err * err) FILTER (WHERE obs >= cut)), 6) AS rmse_hot, round(sqrt(avg(err * err) FILTER (WHERE far)), 6) AS rmse_far
    FROM u GROUP BY GROUPING SETS ((model), (model, band))""",
)
def d13(t):
    bands = [("< 30 km", 0.0, 30.0), ("30-60 km", 30.0, 60.0), ("> 60 km", 60.0, 1e9)]
    out = A.skill_table(_pred(t), ["flat", "price", "shrunk"], "obs", C.band_label("anchor", bands), 0.05, F.col("anchor") >= 60)
    return out.select("model", "group", r("rmse").alias("rmse"), r("bias").alias("bias"), "n", r("rmse_hot").alias("rmse_hot"), r("rmse_far").alias("rmse_far"))


@query(
    "d14_skill_score",
    f"""WITH {_PRED_SQL} SELECT lead, round(1 - avg((shrunk - obs) * (shrunk - obs)) / avg((flat - obs) * (flat - obs)), 6) AS skill FROM p GROUP BY 1""",
)
def d14(t):
    out = A.skill_score(_pred(t), ["lead"], F.col("shrunk") - F.col("obs"), F.col("flat") - F.col("obs"))
    return out.select("lead", r("skill").alias("skill"))


@query(
    "d15_interval_coverage",
    f"""WITH {_PRED_SQL} SELECT flag, round(avg(CASE WHEN obs >= price - 12 AND obs <= price + 8 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
    round(avg(price + 8 - (price - 12)), 6) AS width FROM p GROUP BY 1""",
)
def d15(t):
    out = A.interval_coverage(_pred(t), ["flag"], "obs", F.col("price") - 12, F.col("price") + 8)
    return out.select("flag", r("coverage").alias("coverage"), r("width").alias("width"))


@query(
    "d16_conformal_width",
    f"""WITH {_PRED_SQL}, w AS (SELECT flag, quantile_cont(greatest(shrunk - 2 - obs, obs - shrunk - 1), 0.9) AS widen FROM p WHERE lead <= 3 GROUP BY 1)
    SELECT flag, round(any_value(widen), 6) AS widen, round(avg(CASE WHEN obs >= shrunk - 2 - widen AND obs <= shrunk + 1 + widen THEN 1.0 ELSE 0.0 END), 6) AS coverage
    FROM p JOIN w USING (flag) WHERE lead > 3 GROUP BY 1""",
)
def d16(t):
    p = _pred(t).withColumn("lo", F.col("shrunk") - 2).withColumn("hi", F.col("shrunk") + 1)
    w = A.conformal_width(p.where("lead <= 3"), "flag", "obs", "lo", "hi")
    test = p.where("lead > 3").join(w, "flag")
    out = A.interval_coverage(test, ["flag", "widen"], "obs", F.col("lo") - F.col("widen"), F.col("hi") + F.col("widen"))
    return out.select("flag", r("widen").alias("widen"), r("coverage").alias("coverage"))


@query(
    "d17_rank_bins",
    """WITH x AS (SELECT o_totalprice AS x, o_orderkey % 100 AS y, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER () AS n FROM orders)
    SELECT CAST(greatest(1, ceil((k - 1) * 20 / (n - 1))) AS INTEGER) AS bin, round(avg(x), 4) AS x, round(avg(y), 6) AS y, count(*) AS n FROM x GROUP BY 1""",
)
def d17(t):
    o = t.raw("orders").select(F.col("o_totalprice").alias("x"), (F.col("o_orderkey") % 100).alias("y"), F.col("o_orderkey").alias("_tie"))
    return A.binned_stat(o, "x", "y", 20).select("bin", r("x", 4).alias("x"), r("y").alias("y"), "n")


@query(
    "d17_quantile_bins",
    """WITH c AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem),
    x AS (SELECT l_extendedprice AS x, l_discount AS y, len(list_filter(e, lambda v: l_extendedprice >= v)) AS bin FROM lineitem, c)
    SELECT CAST(bin AS INTEGER) AS bin, round(avg(x), 4) AS x, round(avg(y), 6) AS y, count(*) AS n FROM x GROUP BY 1""",
)
def d17q(t):
    li = t.raw("lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("y"))
    return A.quantile_bins(li, "x", "y", 5).select("bin", r("x", 4).alias("x"), r("y").alias("y"), "n")


@query(
    "d17_binned_median",
    """WITH c AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM lineitem),
    x AS (SELECT l_extendedprice AS x, l_quantity AS y, len(list_filter(e, lambda v: l_extendedprice >= v)) AS bin FROM lineitem, c)
    SELECT CAST(bin AS INTEGER) AS bin, round(quantile_cont(x, 0.5), 4) AS x, round(quantile_cont(y, 0.5), 4) AS y, count(*) AS n FROM x GROUP BY 1""",
)
def d17m(t):
    li = t.raw("lineitem").select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return A.binned_median(li, "x", "y", 5).select("bin", r("x", 4).alias("x"), r("y", 4).alias("y"), "n")


@query(
    "d17_fixed_bins",
    """WITH x AS (SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 15 THEN 0 WHEN l_quantity > 15 AND l_quantity <= 30 THEN 1
        WHEN l_quantity > 30 AND l_quantity <= 45 THEN 2 END AS bin, l_extendedprice AS x FROM lineitem)
    SELECT bin, count(*) AS n, round(stddev_samp(x), 4) AS sd FROM x GROUP BY 1""",
)
def d17f(t):
    b = A.fixed_bins("l_quantity", [0, 15, 30, 45]).alias("bin")
    return t.raw("lineitem").groupBy(b).agg(F.count(F.lit(1)).alias("n"), r(F.stddev_samp("l_extendedprice"), 4).alias("sd"))


@query(
    "d18_histogram",
    """WITH b AS (SELECT unnest([0, 1, 2, 3, 4]) AS bin, unnest([0.0, 10.0, 20.0, 30.0, 40.0])::DOUBLE AS lo, unnest([10.0, 20.0, 30.0, 40.0, 50.0]) AS hi)
    SELECT bin, lo, (SELECT count(*) FROM lineitem WHERE l_quantity >= lo AND (l_quantity < hi OR (bin = 4 AND l_quantity <= hi))) AS n FROM b""",
)
def d18(t):
    return A.histogram(t.raw("lineitem"), "l_quantity", [0, 10, 20, 30, 40, 50])


@query(
    "d19_seasonal_factor",
    """WITH x AS (SELECT site, d, ln(value) - lag(ln(value)) OVER (PARTITION BY site ORDER BY d) AS ret FROM site_month),
    y AS (SELECT site, d, ret / stddev_samp(ret) OVER (PARTITION BY site, year(d)) AS z FROM x WHERE ret IS NOT NULL),
    m AS (SELECT site, CAST(month(d) AS INTEGER) AS month, stddev_samp(z) AS sd, count(z) AS n FROM y GROUP BY 1, 2)
    SELECT site, month, n, round(sd / avg(sd) OVER (PARTITION BY site), 6) AS factor, round(sd / avg(sd) OVER (PARTITION BY site) / sqrt(2 * n), 6) AS se FROM m""",
    "site_month",
)
def d19(t):
    x = C.log_return(t.site_month(), ["site"], "d", "value")
    out = A.seasonal_factor(x, ["site"], "d", "ret")
    return out.select("site", "month", "n", r("factor").alias("factor"), r("se").alias("se"))


@query(
    "d20_hit_stats",
    """WITH x AS (SELECT o_orderpriority AS source, o_totalprice % 3 > 1.4 AS hedge, o_totalprice / 1000 - 250 AS a FROM orders)
    SELECT source, count(*) AS decisions, round(avg(CASE WHEN hedge THEN 1.0 ELSE 0.0 END), 6) AS hedged_share,
    round(avg(CASE WHEN hedge = (a > 0) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN a > 0 THEN 1.0 ELSE 0.0 END), 6) AS base_rate_up,
    round(avg(CASE WHEN hedge THEN a ELSE 0.0 END), 4) AS saving, round(avg(a), 4) AS "always", round(avg(a) FILTER (WHERE hedge), 4) AS when_hedged,
    round(avg(a) FILTER (WHERE NOT hedge), 4) AS when_waited FROM x GROUP BY 1""",
)
def d20(t):
    x = t.raw("orders").select(F.col("o_orderpriority").alias("source"), (F.col("o_totalprice") % 3 > 1.4).alias("hedge"), (F.col("o_totalprice") / 1000 - 250).alias("a"))
    out = A.hit_stats(x, ["source"], F.col("hedge"), "a")
    shares = ["hedged_share", "hit_rate", "base_rate_up"]
    return out.select("source", "decisions", *[r(c, 6 if c in shares else 4).alias(c) for c in out.columns[2:]])


@query(
    "d21_before_after",
    """WITH p AS (SELECT entity, year(d) AS y, avg(value) FILTER (WHERE strftime(d, '%m-%d') BETWEEN '03-01' AND '04-30') AS a,
        avg(value) FILTER (WHERE strftime(d, '%m-%d') BETWEEN '05-15' AND '07-15') AS b,
        count(*) FILTER (WHERE strftime(d, '%m-%d') BETWEEN '03-01' AND '04-30') AS na, count(*) FILTER (WHERE strftime(d, '%m-%d') BETWEEN '05-15' AND '07-15') AS nb
        FROM daily GROUP BY 1, 2)
    SELECT entity, round(max(a) FILTER (WHERE y = 1999) + 1e-7, 4) AS pre_mean, round(max(b) FILTER (WHERE y = 1999) + 1e-7, 4) AS post_mean,
    round(max(b / a) FILTER (WHERE y = 1999), 6) AS ratio, round(avg(b / a) FILTER (WHERE y BETWEEN 1995 AND 1998), 6) AS ratio_base,
    max(na) FILTER (WHERE y = 1999) AS n_pre, max(nb) FILTER (WHERE y = 1999) AS n_post FROM p GROUP BY 1""",
    "daily",
)
def d21(t):
    out = A.before_after(t.daily(), ["entity"], "d", "value", ("03-01", "04-30"), ("05-15", "07-15"), 1999, range(1995, 1999))
    means = [r(F.col(c) + 1e-7, 4).alias(c) for c in ("pre_mean", "post_mean")]  # off exact halves
    return out.select("entity", *means, r("ratio").alias("ratio"), r("ratio_base").alias("ratio_base"), "n_pre", "n_post")


@query(
    "d22_independence_check",
    """WITH x AS (SELECT l_returnflag, (l_quantity > 40)::INT AS a, (l_discount > 0.07)::INT AS b FROM lineitem)
    SELECT l_returnflag, round(avg(a), 6) AS p_a, round(avg(b), 6) AS p_b, round(avg(a * b), 6) AS p_both, round(avg(a) * avg(b), 6) AS p_if_independent,
    count(*) FILTER (WHERE a * b = 1) AS n_both FROM x GROUP BY 1""",
)
def d22(t):
    out = A.independence_check(t.raw("lineitem"), ["l_returnflag"], F.col("l_quantity") > 40, F.col("l_discount") > 0.07)
    return out.select("l_returnflag", *[r(c).alias(c) for c in out.columns[1:5]], "n_both")


@query(
    "d23_pivot_wide",
    "SELECT d, " + ", ".join(f"max(value) FILTER (WHERE entity = '{p}') AS \"{p}\"" for p in PRIORITIES.values()) + " FROM monthly GROUP BY d",
    "monthly",
)
def d23(t):
    return t.monthly().groupBy("d").pivot("entity", list(PRIORITIES.values())).agg(F.max("value"))


@query("d23_melt", "SELECT d, unnest(['qty', 'price', 'disc', 'tax']) AS var, unnest([qty, price, disc, tax]) AS value FROM ship_all", "ship_all")
def d23m(t):
    return t.ship_all().unpivot(["d"], ["qty", "price", "disc", "tax"], "var", "value")


@query(
    "d24_coverage_filter",
    """WITH ok AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus <> 'P') / count(*) >= 0.8)
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (FROM ok)""",
)
def d24(t):
    o = t.raw("orders").withColumn("x", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return A.coverage_filter(o, ["o_custkey"], "x", 0.8).select("o_orderkey", "o_custkey")


@query(
    "d25_relative_index",
    """WITH x AS (SELECT n_regionkey AS region, site, d, value FROM site_month JOIN nation ON n_nationkey = site), own AS (SELECT site, avg(value) AS m FROM x GROUP BY 1)
    SELECT region, d, CASE WHEN count(*) >= 3 THEN round(avg(value / m), 6) END AS index, count(*) AS n FROM x JOIN own USING (site) GROUP BY 1, 2""",
    "site_month",
)
def d25(t):
    x = t.site_month().join(t.raw("nation").select(F.col("n_nationkey").alias("site"), F.col("n_regionkey").alias("region")), "site")
    return A.relative_index(x, "site", "d", "value", ["region"]).select("region", "d", r("index").alias("index"), "n")


@query(
    "d26_exceedance",
    """WITH x AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS rank,
        count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority, o_totalprice, rank, round((n + 1) / rank, 6) AS return_period FROM x""",
)
def d26(t):
    return A.exceedance(t.raw("orders"), ["o_orderpriority"], "o_totalprice").withColumn("return_period", r("return_period"))


@query(
    "d27_shortfall",
    """SELECT site, CAST(month(d) AS INTEGER) AS month, round((avg(value) - quantile_cont(value, 0.05)) / avg(value), 6) AS shortfall FROM site_month GROUP BY 1, 2""",
    "site_month",
)
def d27(t):
    x = t.site_month().withColumn("month", F.month("d"))
    return A.shortfall(x, ["site", "month"], "value").select("site", "month", r("shortfall").alias("shortfall"))


@query(
    "d27_worst_month",
    """WITH m AS (SELECT site, month(d) AS mm, avg(value) AS mu FROM site_month GROUP BY 1, 2)
    SELECT x.site, CAST(year(d) AS INTEGER) AS year, round(max((mu - value) / mu), 6) AS worst FROM site_month x JOIN m ON m.site = x.site AND mm = month(d) GROUP BY 1, 2""",
    "site_month",
)
def d27w(t):
    x = t.site_month().withColumn("month", F.month("d")).withColumn("year", F.year("d"))
    return A.worst_month(x, ["site"], "year", "month", "value").withColumn("worst", r("worst"))


@query(
    "d28_group_summary",
    """WITH x AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'calm' ELSE 'storm' END AS regime, l_returnflag AS strategy, CAST(l_linenumber AS VARCHAR) AS commodity,
        l_extendedprice AS err, l_tax AS cost FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY regime, strategy ORDER BY err) AS k1, count(*) OVER (PARTITION BY regime, strategy) AS n1,
        row_number() OVER (PARTITION BY commodity, regime, strategy ORDER BY err) AS k2, count(*) OVER (PARTITION BY commodity, regime, strategy) AS n2 FROM x)
    SELECT NULL::VARCHAR AS commodity, regime, strategy, count(*) AS n, round(avg(err), 4) AS mean, round(stddev_samp(err), 4) AS sd,
        round(avg(err) FILTER (WHERE k1 <= ceil(n1 * 0.05::DOUBLE)), 4) AS cvar, round(avg(cost), 6) AS mean_cost FROM k GROUP BY 2, 3
    UNION ALL SELECT commodity, regime, strategy, count(*), round(avg(err), 4), round(stddev_samp(err), 4),
        round(avg(err) FILTER (WHERE k2 <= ceil(n2 * 0.05::DOUBLE)), 4), round(avg(cost), 6) FROM k GROUP BY 1, 2, 3""",
)
def d28(t):
    x = t.raw("lineitem").select(
        F.when(F.col("l_linestatus") == "F", "calm").otherwise("storm").alias("regime"), F.col("l_returnflag").alias("strategy"),
        F.col("l_linenumber").cast("string").alias("commodity"), F.col("l_extendedprice").alias("err"), F.col("l_tax").alias("cost"),
    )
    out = A.group_summary(x, [["regime", "strategy"], ["commodity", "regime", "strategy"]], "err", "cost")
    return out.select("commodity", "regime", "strategy", "n", r("mean", 4).alias("mean"), r("sd", 4).alias("sd"), r("cvar", 4).alias("cvar"), r("mean_cost").alias("mean_cost"))


@query(
    "d29_extreme_count",
    """SELECT entity, d, count(*) FILTER (WHERE price < 1200 OR price > 2100) OVER (PARTITION BY entity, date_trunc('month', d)) AS extreme_days FROM ship""",
    "ship",
)
def d29(t):
    return A.extreme_count(t.ship(), ["entity"], "d", "price", 1200, 2100).select("entity", "d", "extreme_days")


@query(
    "d30_distinct_first",
    """SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1""",
)
def d30(t):
    o = t.raw("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return first_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")
