"""Window functions."""

from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.functions.normal import normal_quantile, normal_quantile_sql
from strandline.operators import windows as W
from strandline.operators.aggregate import interpolate
from strandline.operators.ordering import average_rank
from strandline.plans.registry import query


def r(c, n=6):
    return F.round(c, n)


@query(
    "e1_rolling",
    """SELECT entity, d, CASE WHEN count(price) OVER a = 30 THEN round(avg(price) OVER a, 5) END AS trailing,
    CASE WHEN count(price) OVER b >= 10 THEN round(stddev_samp(price) OVER b, 5) END AS centred_sd, CASE WHEN count(price) OVER c = 31 THEN round(sum(price) OVER c, 4) END AS centred_sum
    FROM ship WINDOW a AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), c AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)""",
    "ship",
)
def e1(t):
    x = W.rolling(t.ship(), ["entity"], "d", "price", 30, out="trailing")
    x = W.rolling(x, ["entity"], "d", "price", 30, "std", 10, True, "centred_sd")
    x = W.rolling(x, ["entity"], "d", "price", 31, "sum", None, True, "centred_sum")
    return x.select("entity", "d", r("trailing", 5).alias("trailing"), r("centred_sd", 5).alias("centred_sd"), r("centred_sum", 4).alias("centred_sum"))


@query(
    "e2_rolling_corr",
    """SELECT entity, d, CASE WHEN count(*) OVER a = 60 THEN round(corr(price, disc) OVER a, 6) END AS before, CASE WHEN count(*) OVER b = 60 THEN round(corr(price, disc) OVER b, 6) END AS including
    FROM ship WINDOW a AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "ship",
)
def e2(t):
    x = W.rolling_corr(t.ship(), ["entity"], "d", "price", "disc", 60, False, "before")
    x = W.rolling_corr(x, ["entity"], "d", "price", "disc", 60, True, "including")
    return x.select("entity", "d", r("before").alias("before"), r("including").alias("including"))


_RET = "ret AS (SELECT entity, d, ln(price) - lag(ln(price)) OVER (PARTITION BY entity ORDER BY d) AS ret FROM ship)"


@query(
    "e3_realised_vol",
    f"""WITH {_RET} SELECT entity, d, round(sqrt(avg(ret * ret) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) * 252), 6) AS vol
    FROM ret WHERE ret IS NOT NULL""",
    "ship",
)
def e3(t):
    x = C.log_return(t.ship(), ["entity"], "d", "price").where("ret IS NOT NULL")
    return W.realised_vol(x, ["entity"], "d", "ret").select("entity", "d", r("vol").alias("vol"))


@query(
    "e4_forward",
    """SELECT entity, d, round(lead(price, 3) OVER w - price, 6) AS fwd, CASE WHEN count(price) OVER f = 3 THEN round(sum(price) OVER f, 6) END AS fwd_sum
    FROM ship WINDOW w AS (PARTITION BY entity ORDER BY d), f AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""",
    "ship",
)
def e4(t):
    x = W.forward_sum(W.forward_change(t.ship(), ["entity"], "d", "price", 3), ["entity"], "d", "price", 3)
    return x.select("entity", "d", r("fwd").alias("fwd"), r("fwd_sum").alias("fwd_sum"))


_RANK_SQL = """x AS (SELECT l_returnflag, l_orderkey, l_partkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS k,
    count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS c, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)"""


@query("e5_avg_rank", f"WITH {_RANK_SQL} SELECT l_returnflag, l_orderkey, l_partkey, l_linenumber, k + (c - 1) / 2 AS rank, round((k + (c - 1) / 2) / (n + 1), 8) AS u FROM x")
def e5(t):
    li = t.raw("lineitem").select("l_returnflag", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    out = average_rank(li, ["l_returnflag"], "l_quantity")
    return out.select("l_returnflag", "l_orderkey", "l_partkey", "l_linenumber", "rank", r(F.col("rank") / (F.col("rank_n") + 1), 8).alias("u"))


@query(
    "e5_normal_scores",
    f"""WITH x AS (SELECT o_orderkey, (rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY o_orderpriority) AS u FROM orders)
    SELECT o_orderkey, round({normal_quantile_sql("u")}, 6) AS score FROM x""",
)
def e5n(t):
    out = average_rank(t.raw("orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderkey", r(normal_quantile((F.col("rank") - 0.5) / F.col("rank_n"))).alias("score"))


@query(
    "e6_first_crossings",
    """WITH a AS (SELECT entity, d, value, d - lag(d) OVER (PARTITION BY entity ORDER BY d) AS gap FROM daily WHERE value >= 700000)
    SELECT entity, d, value FROM a WHERE gap IS NULL OR gap > 10""",
    "daily",
)
def e6(t):
    return W.first_crossings(t.daily(), ["entity"], "d", "value", 700000, 10)


@query(
    "e7_episodes",
    """WITH m AS (SELECT entity, d, price < 1500 AS c, max(d) OVER (PARTITION BY entity) AS last, count(*) FILTER (WHERE price >= 1500) OVER (PARTITION BY entity ORDER BY d) AS run FROM ship)
    SELECT entity, min(d) AS start, count(*) AS length, max(d) < any_value(last) AS closed, CASE WHEN max(d) < any_value(last) THEN count(*) END AS duration FROM m WHERE c GROUP BY entity, run""",
    "ship",
)
def e7(t):
    return W.episodes(t.ship(), ["entity"], "d", F.col("price") < 1500)


@query(
    "e8_first_last_when",
    """WITH g AS (SELECT entity, d, value, CASE WHEN value > 300000 THEN d - max(CASE WHEN value > 300000 THEN d END) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS gap FROM daily)
    SELECT entity, min(d) FILTER (WHERE value < 50000) AS first_low, min(d) FILTER (WHERE value > 500000 AND d > DATE '1998-01-01') AS recovered,
    max(d) FILTER (WHERE value > 300000 AND d < DATE '1998-01-01') AS last_before, CAST(max(gap) AS INTEGER) AS longest_gap FROM g GROUP BY 1""",
    "daily",
)
def e8(t):
    d, v = F.col("d"), F.col("value")
    conds = {
        "first_low": ("first", v < 50000),
        "recovered": ("first", (v > 500000) & (d > F.lit("1998-01-01").cast("date"))),
        "last_before": ("last", (v > 300000) & (d < F.lit("1998-01-01").cast("date"))),
    }
    return W.first_last_when(t.daily(), ["entity"], "d", conds, v > 300000)


@query(
    "e9_heat_weeks",
    """SELECT entity, d, round(sum(CASE WHEN price / 100 - 14 >= 1 THEN price / 100 - 14 ELSE 0.0 END) OVER (PARTITION BY entity ORDER BY d RANGE BETWEEN INTERVAL 83 DAY PRECEDING AND CURRENT ROW) / 7, 5) AS dhw FROM ship""",
    "ship",
)
def e9(t):
    return W.heat_weeks(t.ship(), ["entity"], "d", F.col("price") / 100, 14.0).select("entity", "d", r("dhw", 5).alias("dhw"))


@query(
    "e10_good_streak",
    """WITH m AS (SELECT entity, d, price > 1300 AS c, count(*) FILTER (WHERE NOT (price > 1300)) OVER (PARTITION BY entity ORDER BY d) AS island FROM ship)
    SELECT entity, d, least(count(*) FILTER (WHERE c) OVER (PARTITION BY entity, island ORDER BY d), 100) AS streak FROM m""",
    "ship",
)
def e10(t):
    return W.good_streak(t.ship(), ["entity"], "d", F.col("price") > 1300).select("entity", "d", "streak")


_SPINE = """s AS (SELECT entity, CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY 1),
    f AS (SELECT s.entity, s.d, value FROM s LEFT JOIN daily x ON x.entity = s.entity AND x.d = s.d)"""


def _spined(t):
    from strandline.operators.aggregate import resample

    o = t.raw("orders").select(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("d"), "o_totalprice")
    return resample(o, ["entity"], "d", "D", {"value": r(F.sum("o_totalprice"), 2)})


@query(
    "e11_fill",
    f"""WITH {_SPINE}, k AS (SELECT entity, d, value, last_value(value IGNORE NULLS) OVER w AS va, last_value(CASE WHEN value IS NOT NULL THEN d END IGNORE NULLS) OVER w AS pa,
    first_value(value IGNORE NULLS) OVER v AS vb, first_value(CASE WHEN value IS NOT NULL THEN d END IGNORE NULLS) OVER v AS pb FROM f
    WINDOW w AS (PARTITION BY entity ORDER BY d), v AS (PARTITION BY entity ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT entity, d, va AS filled, round(CASE WHEN value IS NOT NULL THEN value ELSE va + (vb - va) * (d - pa) / (pb - pa) END + 1e-6, 4) AS line FROM k""",
    "daily",
)
def e11(t):
    x = W.ffill(_spined(t).withColumn("line", F.col("value")).withColumn("day", F.unix_date("d")), ["entity"], "d", "value", "filled")
    x = interpolate(x, ["entity"], "day", "line")
    return x.select("entity", "d", "filled", r(F.col("line") + 1e-6, 4).alias("line"))  # off exact halves


@query(
    "e12_event_paths",
    """WITH a AS (SELECT entity, d, d - lag(d) OVER (PARTITION BY entity ORDER BY d) AS gap FROM daily WHERE value >= 900000),
    ev AS (SELECT entity, d AS event FROM a WHERE gap IS NULL OR gap > 10),
    cal AS (SELECT entity, d, ln(price) AS lx, row_number() OVER w AS i, count(*) OVER (PARTITION BY entity) AS n FROM ship WINDOW w AS (PARTITION BY entity ORDER BY d)),
    pl AS (SELECT c.entity, event, min(i) AS pos, any_value(n) AS n FROM (SELECT DISTINCT event FROM ev) e JOIN cal c ON c.d >= event GROUP BY 1, 2)
    SELECT pl.entity, event, CAST(k AS INTEGER) AS k, round(x.lx - b.lx, 6) AS cum FROM pl, (SELECT unnest(range(-10, 11)) AS k) ks
    JOIN cal x ON x.entity = pl.entity AND x.i = pos + k JOIN cal b ON b.entity = pl.entity AND b.i = pos - 11 WHERE pos - 10 > 1 AND pos + 10 <= pl.n""",
    "daily ship",
)
def e12(t):
    days = W.first_crossings(t.daily(), ["entity"], "d", "value", 900000, 10).select("d").distinct()
    events = days.withColumn("entity", F.explode(F.array(*[F.lit(f) for f in "ANR"])))
    return W.event_paths(t.ship(), events, ["entity"], "d", "price").withColumn("cum", r("cum"))


def _traces(t):
    return t.variables().select(F.col("t").alias("trace"), F.col("var").alias("i"), F.col("value").alias("a"))


@query(
    "e13_sta_lta_pick",
    """WITH x AS (SELECT t, var, avg(value * value) OVER (PARTITION BY t ORDER BY var ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / greatest(avg(value * value) OVER (PARTITION BY t ORDER BY var ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 1e-20) AS ratio FROM variables)
    SELECT t AS trace, coalesce(min(var) FILTER (WHERE var >= 20 AND ratio > 1.8), -1) AS pick FROM x GROUP BY 1""",
    "variables",
)
def e13(t):
    return W.sta_lta_pick(_traces(t), ["trace"], "i", "a", 5, 20, 1.8, 20)


@query(
    "e14_first_motion",
    """SELECT t AS trace, CASE WHEN avg(value) FILTER (WHERE var BETWEEN 33 AND 35) - avg(value) FILTER (WHERE var BETWEEN 22 AND 31) > 0 THEN 0 ELSE 1 END AS motion FROM variables GROUP BY 1""",
    "variables",
)
def e14(t):
    return W.first_motion(_traces(t), ["trace"], "i", "a", F.lit(32))


@query(
    "e15_snr_db",
    """SELECT t AS trace, round(10 * log10(greatest(var_pop(value) FILTER (WHERE var BETWEEN 32 AND 51), 1e-20) / greatest(var_pop(value) FILTER (WHERE var BETWEEN 2 AND 26), 1e-20)), 5) AS snr FROM variables GROUP BY 1""",
    "variables",
)
def e15(t):
    return W.snr_db(_traces(t), ["trace"], "i", "a", F.lit(32), 20, 30, 5).withColumn("snr", r("snr", 5))


@query(
    "e16_early_warning",
    """WITH a AS (SELECT entity, d, price - avg(price) OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING) AS x FROM ship),
    b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) AS i FROM a),
    p AS (SELECT b.entity, b.i, c.i AS j, c.x, lag(c.x) OVER (PARTITION BY b.entity, b.i ORDER BY c.i) AS px, avg(c.x) OVER (PARTITION BY b.entity, b.i) AS m FROM b JOIN b c ON c.entity = b.entity AND c.i BETWEEN b.i - 40 AND b.i - 1 WHERE b.i > 40),
    s AS (SELECT entity, i, sum((x - m) * (x - m)) / 40 AS v, sum((x - m) * (px - m)) / sum((x - m) * (x - m)) AS ac FROM p GROUP BY 1, 2)
    SELECT b.entity, b.d, round(v, 1) AS variance, round(ac, 5) AS ac1 FROM b LEFT JOIN s ON s.entity = b.entity AND s.i = b.i""",
    "ship",
)
def e16(t):
    x = W.early_warning(t.ship(), ["entity"], "d", "price", 60, 40)
    return x.select("entity", "d", r("variance", 1).alias("variance"), r("ac1", 5).alias("ac1"))


_AC = """b AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY d) AS i, price - avg(price) OVER (PARTITION BY entity) AS c, count(*) OVER (PARTITION BY entity) AS n FROM ship),
    v AS (SELECT entity, avg(c * c) AS v, max(n) AS n FROM b GROUP BY 1),
    l AS (SELECT entity, n, v, unnest(range(1, CAST(floor(sqrt(n)) AS BIGINT) + 1)) AS lag FROM v),
    ac AS (SELECT l.entity, l.lag, any_value(l.n) AS n, avg(x.c * y.c) / any_value(v) AS rho FROM l JOIN b x ON x.entity = l.entity JOIN b y ON y.entity = l.entity AND y.i = x.i + l.lag GROUP BY 1, 2)"""


@query("e17_autocorr", f"WITH {_AC} SELECT entity, lag, n, round(rho, 6) AS rho FROM ac", "ship")
def e17(t):
    return W.autocorr(t.ship(), ["entity"], "d", "price").withColumn("rho", r("rho"))


@query(
    "e18_effective_n",
    f"WITH {_AC}, m AS (SELECT lag, avg(rho) AS m, max(n) AS n FROM ac GROUP BY 1) SELECT max(n) AS n, round(max(n) / greatest(1 + 2 * sum(m * m), 1), 3) AS n_eff FROM m",
    "ship",
)
def e18(t):
    ac = W.autocorr(t.ship(), ["entity"], "d", "price")
    return W.effective_n(ac).withColumn("n_eff", r("n_eff", 3))


@query(
    "e18_effective_n_pair",
    f"WITH {_AC} SELECT a.entity AS i, b.entity AS j, round(max(a.n) / greatest(1 + 2 * sum(a.rho * b.rho), 1), 3) AS n_eff FROM ac a JOIN ac b ON a.lag = b.lag AND a.entity < b.entity GROUP BY 1, 2",
    "ship",
)
def e18p(t):
    return W.effective_n_pair(W.autocorr(t.ship(), ["entity"], "d", "price"), "entity").withColumn("n_eff", r("n_eff", 3))


@query("e19_every_kth", "SELECT asset, event_id FROM (SELECT asset, event_id, row_number() OVER (PARTITION BY asset ORDER BY ts, event_id) AS i FROM ticks) WHERE (i - 1) % 7 = 0", "ticks")
def e19(t):
    return W.every_kth(t.ticks(), ["asset"], ["ts", "event_id"], 7).select("asset", "event_id")


@query(
    "e19_block_average",
    """WITH x AS (SELECT asset, price, (row_number() OVER (PARTITION BY asset ORDER BY ts, event_id) - 1) // 10 AS block FROM ticks)
    SELECT asset, block, round(avg(price), 5) AS mean FROM x GROUP BY 1, 2 HAVING count(*) = 10""",
    "ticks",
)
def e19b(t):
    return W.block_average(t.ticks(), ["asset"], ["ts", "event_id"], "price", 10).withColumn("mean", r("mean", 5))


@query(
    "e20_beta_lag_sum",
    "SELECT entity, d, round(" + " + ".join(f"{p!r} * lag(value, {k}) OVER w" for k, p in enumerate(W.beta_weights(12, 3.0), start=1)) + ", 3) AS midas FROM monthly WINDOW w AS (PARTITION BY entity ORDER BY d)",
    "monthly",
)
def e20(t):
    return W.beta_lag_sum(t.monthly(), ["entity"], "d", "value", 12, 3.0).select("entity", "d", r("midas", 3).alias("midas"))


@query(
    "e21_cum_index",
    """SELECT entity, d, round(sum(disc) OVER w, 6) AS total, round(exp(sum(ln(1 + disc / 100)) OVER w), 9) AS growth FROM ship WINDOW w AS (PARTITION BY entity ORDER BY d)""",
    "ship",
)
def e21(t):
    x = W.cum_index(t.ship().withColumn("rate", F.col("disc") / 100), ["entity"], "d", "disc", out="total")
    return W.cum_index(x, ["entity"], "d", "rate", True, "growth").select("entity", "d", r("total").alias("total"), r("growth", 9).alias("growth"))


@query(
    "e22_top_events",
    f"WITH {_RET} SELECT r.entity, r.d, round(ret, 6) AS ret, disc, n FROM ret r JOIN ship s ON s.entity = r.entity AND s.d = r.d WHERE ret IS NOT NULL ORDER BY abs(ret) DESC, r.entity, r.d LIMIT 12",
    "ship",
)
def e22(t):
    x = C.log_return(t.ship(), ["entity"], "d", "price")
    return W.top_events(x, "ret", 12, ["entity", "d"]).select("entity", "d", r("ret").alias("ret"), "disc", "n")
