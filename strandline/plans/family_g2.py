"""Hedging, option chains, ensembles and calibration."""

from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import hedging as H
from strandline.operators.joins import cross_params
from strandline.operators.windows import realised_vol
from strandline.plans.registry import query


def r(c, n=6):
    return F.round(c, n)


def _returns(t):
    return C.log_return(t.ship(), ["entity"], "d", "price").withColumn("ret", F.col("ret") / 20)


@query("g23_garch_refit_panel")
def g23(t):
    out = H.garch_refit_panel(_returns(t), "entity", "d", "ret")
    vol = H.garch_term_vol("variance", "omega", "alpha", "beta", F.lit(63))
    return out.select("entity", "year", "d", r(F.sqrt("variance")).alias("sigma"), r("alpha").alias("alpha"), r("beta").alias("beta"), r(vol).alias("term_vol"))


def _trades(t):
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    x = _returns(t)
    prices = x.withColumn("close", F.exp(F.coalesce(F.sum("ret").over(w), F.lit(0.0))) * 100)
    vol = realised_vol(x.where("ret IS NOT NULL"), ["entity"], "d", "ret", 60).select("entity", "d", "vol")
    paths = H.trade_paths(prices.join(vol, ["entity", "d"], "left"), "entity", "d", "close", "vol", H.garch_refit_panel(x, "entity", "d", "ret"))
    return H.hedge_backtest(paths, "entity")


@query("g24_hedge_backtest")
def g24(t):
    out = _trades(t)
    return out.select("entity", "start", "end", "strategy", "regime", "trades", *[r(c).alias(c) for c in ("sigma_sold", "sigma_realised", "move", "pnl", "cost", "premium")])


_RATIOS = [i / 20 for i in range(25)]


@query(
    "g25_hedge_ratio_sweep",
    f"""WITH x AS (SELECT l_returnflag, 1 + l_discount AS q, p_retailprice AS f0, l_extendedprice / l_quantity AS ft FROM lineitem JOIN part ON p_partkey = l_partkey),
    s AS (SELECT l_returnflag, h AS ratio, stddev_pop(q * ft + h * (f0 - ft)) AS sd FROM x, (SELECT unnest({_RATIOS})::DOUBLE AS h) GROUP BY 1, 2)
    SELECT l_returnflag, ratio, round(sd, 4) AS sd, arg_min(ratio, (round(sd, 9), ratio)) OVER (PARTITION BY l_returnflag) AS optimum FROM s""",
)
def g25(t):
    li, p = t.raw("lineitem"), t.raw("part")
    x = li.join(p, li.l_partkey == p.p_partkey).select(
        "l_returnflag", (F.col("l_discount") + 1).alias("q"), F.col("p_retailprice").alias("f0"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("ft")
    )
    return H.hedge_ratio_sweep(x, ["l_returnflag"], "q", "f0", "ft", _RATIOS).withColumn("sd", r("sd", 4))


_CHAIN = """ch AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS expiry, l_quantity AS strike, CAST(max(90 - dayofmonth(l_shipdate)) AS DOUBLE) AS dte,
        avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') / 1000 - 1 AS call_bid, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') / 1000 + avg(l_discount) * 20 AS call_ask,
        avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') / 1000 - 1 + 2 * l_quantity AS put_bid, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') / 1000 + 2 * l_quantity + avg(l_tax) * 30 AS put_ask,
        CAST(count(*) FILTER (WHERE l_returnflag = 'A') - 3 AS DOUBLE) AS call_volume, CAST(count(*) FILTER (WHERE l_returnflag = 'R') - 3 AS DOUBLE) AS put_volume,
        avg(l_discount) FILTER (WHERE l_returnflag = 'A') * 4 AS call_iv, avg(l_tax) FILTER (WHERE l_returnflag = 'R') * 5 AS put_iv FROM lineitem GROUP BY 1, 2)"""
_GOOD = " OR ".join(f"coalesce({s}_ask > 0 AND {s}_ask > {s}_bid AND {s}_ask - {s}_bid <= 0.25 * ({s}_ask + {s}_bid) AND {s}_volume > 0, false)" for s in ("call", "put"))
_FWD = "fw AS (SELECT expiry, -regr_slope(x, strike) AS discount, regr_intercept(x, strike) / -regr_slope(x, strike) AS forward FROM (SELECT expiry, strike, (call_bid + call_ask - put_bid - put_ask) / 2 AS x FROM ch) WHERE x IS NOT NULL GROUP BY 1 HAVING count(*) >= 3)"


def _chain(t):
    li = t.raw("lineitem")
    a, rr = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"
    ext = lambda c: F.avg(F.when(c, F.col("l_extendedprice"))) / 1000
    d = F.to_date("l_shipdate")
    return li.groupBy(F.trunc(d, "QUARTER").alias("expiry"), F.col("l_quantity").alias("strike")).agg(
        F.max(F.lit(90) - F.dayofmonth(d)).cast("double").alias("dte"),
        (ext(a) - 1).alias("call_bid"), (ext(a) + F.avg("l_discount") * 20).alias("call_ask"),
        (ext(rr) - 1 + F.col("l_quantity") * 2).alias("put_bid"), (ext(rr) + F.col("l_quantity") * 2 + F.avg("l_tax") * 30).alias("put_ask"),
        (F.count(F.when(a, 1)) - 3).cast("double").alias("call_volume"), (F.count(F.when(rr, 1)) - 3).cast("double").alias("put_volume"),
        (F.avg(F.when(a, F.col("l_discount"))) * 4).alias("call_iv"), (F.avg(F.when(rr, F.col("l_tax"))) * 5).alias("put_iv"),
    )


@query("g26_chain_filter", f"WITH {_CHAIN} SELECT expiry, strike FROM ch WHERE {_GOOD}")
def g26(t):
    return H.chain_filter(_chain(t)).select("expiry", "strike")


@query("g27_parity_forward", f"WITH {_CHAIN}, {_FWD} SELECT expiry, round(discount, 5) AS discount, round(forward, 3) AS forward FROM fw")
def g27(t):
    return H.parity_forward(_chain(t), ["expiry"]).select("expiry", r("discount", 5).alias("discount"), r("forward", 3).alias("forward"))


@query(
    "g28_term_structure",
    f"""WITH {_CHAIN}, {_FWD} SELECT expiry, round(any_value(discount), 5) AS discount, round(any_value(forward), 3) AS forward,
    round(arg_min_null(CASE WHEN call_iv > 0 AND put_iv > 0 THEN (call_iv + put_iv) / 2 WHEN call_iv > 0 THEN call_iv WHEN put_iv > 0 THEN put_iv END, (abs(strike - forward), strike)), 6) AS atm_vol,
    min(dte) AS dte, count(*) AS n_strikes, round(min(dte) / 365, 6) AS years FROM ch JOIN fw USING (expiry) GROUP BY 1 HAVING count(*) >= 5""",
)
def g28(t):
    out = H.term_structure(_chain(t), ["expiry"])
    return out.select("expiry", r("discount", 5).alias("discount"), r("forward", 3).alias("forward"), r("atm_vol").alias("atm_vol"), "dte", "n_strikes", r("years").alias("years"))


@query("g28_smile", f"WITH {_CHAIN}, {_FWD} SELECT expiry, strike, round(CASE WHEN strike < forward THEN put_iv ELSE call_iv END, 6) AS iv FROM ch JOIN fw USING (expiry) WHERE CASE WHEN strike < forward THEN put_iv ELSE call_iv END > 0")
def g28s(t):
    return H.smile(_chain(t), ["expiry"]).withColumn("iv", r("iv"))


@query(
    "g29_curve_panel",
    """WITH fr AS (SELECT d, price FROM ship WHERE entity = 'A'), firsts AS (SELECT make_date(y, m, 1) AS f FROM (SELECT unnest(range(1994, 2004)) AS y), (SELECT unnest([3, 5, 7, 9, 12]) AS m)),
    fm AS (SELECT d, CAST(min(f) + 14 AS DATE) AS mat FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), firsts WHERE d < f - 10 GROUP BY 1),
    li AS (SELECT CAST(l_shipdate AS DATE) AS d, l_linenumber AS k, sum(l_extendedprice) / sum(l_quantity) AS p FROM lineitem GROUP BY 1, 2),
    lt AS (SELECT d, 'KC' || ['H', 'K', 'N', 'U', 'Z', 'H', 'K'][k] || '0' || (k % 4) || '.NYB' AS contract, make_date(2000 + k % 4, [3, 5, 7, 9, 12, 3, 5][k], 15) AS mat, p FROM li),
    u AS (SELECT fr.d, 'front' AS contract, price AS p, mat FROM fr JOIN fm ON fm.d = fr.d UNION ALL SELECT lt.d, contract, p, lt.mat FROM lt JOIN fm ON fm.d = lt.d WHERE lt.mat <> fm.mat)
    SELECT d, contract, round(ln(p), 6) AS log_price, round((mat - d) / 365.25, 6) AS tau FROM u WHERE (mat - d) / 365.25 > 0.02""",
    "ship",
)
def g29(t):
    codes = F.array(*[F.lit(c) for c in "HKNUZHK"])
    k = F.col("l_linenumber")
    ticker = F.concat(F.lit("KC"), F.get(codes, k - 1), F.lit("0"), (k % 4).cast("string"), F.lit(".NYB"))
    listed = t.raw("lineitem").groupBy(F.to_date("l_shipdate").alias("d"), "l_linenumber").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("p"))
    listed = listed.select("d", ticker.alias("ticker"), "p")
    front = t.ship().where("entity = 'A'").select("d", "price")
    return H.curve_panel(listed, front, "d", "ticker", "p", "price").select("d", "contract", r("log_price").alias("log_price"), r("tau").alias("tau"))


_RUNS = "rn AS (SELECT l_returnflag AS grp, l_linenumber AS rate, l_suppkey % 10 AS run, CAST(floor(l_discount * 100) AS INTEGER) AS k, avg(l_quantity) + 3 * l_linenumber AS s, 16.0 AS y FROM lineitem GROUP BY 1, 2, 3, 4)"


def _runs(t):
    li = t.raw("lineitem")
    return li.groupBy(
        F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("rate"), (F.col("l_suppkey") % 10).alias("run"), F.floor(F.col("l_discount") * 100).cast("int").alias("k")
    ).agg((F.avg("l_quantity") + F.col("l_linenumber") * 3).alias("s"), F.lit(16.0).alias("y"))


_POST = f"""WITH {_RUNS}, l AS (SELECT grp, rate, run, k, -0.5 * pow((y - 0.5 * s) / (sqrt(s * 0.25) + 2), 2) - ln(sqrt(s * 0.25) + 2) - 0.5 * ln(2 * pi()) AS ll FROM rn),
    p AS (SELECT grp, h AS horizon, rate, run, sum(ll) AS r FROM l, (SELECT unnest([2, 5, 10])::INTEGER AS h) WHERE k <= h GROUP BY 1, 2, 3, 4),
    m AS (SELECT grp, horizon, rate, max(r) + ln(sum(exp(r - mx)) / count(*)) AS loglik FROM (SELECT *, max(r) OVER (PARTITION BY grp, horizon, rate) AS mx FROM p) GROUP BY 1, 2, 3),
    e AS (SELECT *, exp(loglik - max(loglik) OVER (PARTITION BY grp, horizon)) AS e FROM m), po AS (SELECT grp, horizon, rate, loglik, e / sum(e) OVER (PARTITION BY grp, horizon) AS posterior FROM e),
    c AS (SELECT *, sum(posterior) OVER (PARTITION BY grp, horizon ORDER BY rate) AS cdf FROM po)"""


@query("g30_ensemble_posterior", f"{_POST} SELECT grp, horizon, rate, round(loglik, 5) AS loglik, round(posterior, 6) AS posterior, round(cdf, 6) AS cdf FROM c")
def g30(t):
    out = H.ensemble_posterior(_runs(t), ["grp"], "rate", "run", "k", "s", "y", [2, 5, 10])
    return out.select("grp", "horizon", "rate", r("loglik", 5).alias("loglik"), r("posterior").alias("posterior"), r("cdf").alias("cdf"))


@query(
    "g30_posterior_summary",
    f"{_POST} SELECT grp, horizon, arg_max(rate, (round(posterior, 12), -rate)) AS map, coalesce(min(rate) FILTER (WHERE cdf >= 0.05), max(rate)) AS lo, coalesce(min(rate) FILTER (WHERE cdf >= 0.95), max(rate)) AS hi FROM c GROUP BY 1, 2",
)
def g30s(t):
    return H.posterior_summary(H.ensemble_posterior(_runs(t), ["grp"], "rate", "run", "k", "s", "y", [2, 5, 10]), ["grp"], "rate")


@query(
    "g31_importance_summary",
    """WITH p AS (SELECT l_returnflag AS grp, l_quantity AS x, -0.5 * pow((l_extendedprice / 1000 - 30) / 8, 2) AS lw FROM lineitem),
    w AS (SELECT grp, x, exp(lw - max(lw) OVER (PARTITION BY grp)) AS w FROM p), v AS (SELECT grp, x, sum(w) AS w, sum(w * w) AS w2 FROM w GROUP BY 1, 2),
    c AS (SELECT *, sum(w) OVER (PARTITION BY grp ORDER BY x) / sum(w) OVER (PARTITION BY grp) AS c FROM v)
    SELECT grp, round(sum(w * x) / sum(w), 6) AS mean, min(x) FILTER (WHERE c >= 0.05) AS lo, min(x) FILTER (WHERE c >= 0.95) AS hi, round(pow(sum(w), 2) / sum(w2), 4) AS ess FROM c GROUP BY 1""",
)
def g31(t):
    x = t.raw("lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), "l_extendedprice")
    z = (F.col("l_extendedprice") / 1000 - 30) / 8
    out = H.importance_summary(x, ["grp"], "x", -(z * z) / 2)
    return out.select("grp", r("mean").alias("mean"), "lo", "hi", r("ess", 4).alias("ess"))


@query(
    "g32_multilevel_stats",
    """WITH x AS (SELECT l_linenumber - 1 AS level, l_extendedprice / 1000 AS qf, CASE WHEN l_linenumber > 1 THEN l_quantity * 1.5 END AS qc, pow(2, l_linenumber - 1) AS cost FROM lineitem),
    v AS (SELECT level, count(*) AS runs, avg(qf) AS mean_q, var_samp(qf) AS var_q, avg(CASE WHEN level = 0 THEN qf ELSE qf - qc END) AS mean_diff, var_samp(CASE WHEN level = 0 THEN qf ELSE qf - qc END) AS var_diff, CASE WHEN level > 0 THEN corr(qf, qc) END AS r, avg(cost) AS cost FROM x GROUP BY 1)
    SELECT level, runs, round(mean_q, 5) AS mean_q, round(var_q, 4) AS var_q, round(mean_diff, 5) AS mean_diff, round(var_diff, 4) AS var_diff, round(r, 6) AS corr_pair, cost,
    CAST(ceil(sqrt(var_diff / cost) * sum(sqrt(var_diff * cost)) OVER () / 0.25) AS BIGINT) AS samples FROM v""",
)
def g32(t):
    x = t.raw("lineitem").select(
        (F.col("l_linenumber") - 1).alias("level"), "l_orderkey", (F.col("l_extendedprice") / 1000).alias("qf"),
        F.when(F.col("l_linenumber") > 1, F.col("l_quantity") * 1.5).alias("qc"), F.pow(F.lit(2.0), F.col("l_linenumber") - 1).alias("cost"),
    )
    out = H.multilevel_stats(x, "level", "l_orderkey", "qf", "qc", "cost", 0.5)
    return out.select("level", "runs", r("mean_q", 5).alias("mean_q"), r("var_q", 4).alias("var_q"), r("mean_diff", 5).alias("mean_diff"), r("var_diff", 4).alias("var_diff"), r("corr_pair").alias("corr_pair"), "cost", "samples")


_GRID = """gm AS (SELECT power, site, year, pow(n, power) + site AS model, value AS obs FROM site_year, (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS power)),
    lv AS (SELECT power, site, avg(model) AS lm, avg(obs) AS lo, corr(model, obs) AS yy FROM gm GROUP BY 1, 2 HAVING count(*) >= 5),
    tr AS (SELECT a.power, a.site, quantile_cont((b.model - a.model) / (b.year - a.year), 0.5) AS tm, quantile_cont((b.obs - a.obs) / (b.year - a.year), 0.5) AS tobs FROM gm a JOIN gm b ON a.power = b.power AND a.site = b.site AND a.year < b.year GROUP BY 1, 2),
    sp AS (SELECT power, pow(10, 9 - floor(log10(greatest(max(abs(lm)), 1e-90)))) AS sm, pow(10, 9 - floor(log10(greatest(max(abs(lo)), 1e-90)))) AS so FROM lv GROUP BY 1),
    kt AS (SELECT power, yy, round(lm * sm) AS lm, round(lo * so) AS lo, round(tm * sm) AS tm, round(tobs * so) AS tobs FROM lv JOIN tr USING (power, site) JOIN sp USING (power)),
    rk AS (SELECT power, yy, """ + ", ".join(
    f"rank() OVER (PARTITION BY power ORDER BY {c}) + (count(*) OVER (PARTITION BY power, {c}) - 1) / 2 AS r_{c}" for c in ("lm", "lo", "tm", "tobs")
) + """ FROM kt),
    sc AS (SELECT power, corr(r_lm, r_lo) AS level, corr(r_tm, r_tobs) AS trend, quantile_cont(yy, 0.5) AS yy, count(*) AS sites FROM rk GROUP BY 1)"""


def _scores(t):
    x = cross_params(t.site_year(), power=[0.5, 1.0, 2.0]).withColumn("model", F.pow(F.col("n"), F.col("power")) + F.col("site"))
    return H.grid_scores(x.withColumnRenamed("value", "obs"), ["power"], "site", "year", "model", "obs", 5)


@query("g33_grid_scores", f"WITH {_GRID} SELECT power, round(level, 6) AS level, round(trend, 6) AS trend, round(yy, 6) AS year_to_year, sites FROM sc", "site_year")
def g33(t):
    return _scores(t).select("power", r("level").alias("level"), r("trend").alias("trend"), r("year_to_year").alias("year_to_year"), "sites")


@query("g33_best", f"WITH {_GRID} SELECT power, round(level + trend, 6) AS score FROM sc ORDER BY round(level + trend, 9) DESC, power LIMIT 1", "site_year")
def g33b(t):
    s = F.col("level") + F.col("trend")
    return H.best_row(_scores(t), [], s, ["power"]).select("power", r(s).alias("score"))


@query(
    "g36_scaled_splice",
    """WITH a AS (SELECT d, value FROM monthly WHERE entity = '1-URGENT'), b AS (SELECT d, value FROM monthly WHERE entity = '5-LOW'),
    k AS (SELECT avg(a.value) / avg(b.value) AS k FROM a JOIN b ON a.d = b.d WHERE a.d >= DATE '1998-01-01')
    SELECT d, value, 'main' AS source FROM a WHERE d >= DATE '1998-01-01' UNION ALL SELECT d, round(value * k, 3), 'scaled' FROM b, k WHERE d < DATE '1998-01-01'""",
    "monthly",
)
def g36(t):
    import datetime

    m = t.monthly()
    pick = lambda p: m.where(F.col("entity") == p).select("d", "value")
    out = H.scaled_splice(pick("1-URGENT"), pick("5-LOW"), [], "d", "value", datetime.date(1998, 1, 1))
    return out.withColumn("value", F.when(F.col("source") == "main", F.col("value")).otherwise(r("value", 3)))


@query(
    "g38_product_agreement",
    """SELECT entity, round(avg(price), 5) AS mean_price, round(avg(disc), 6) AS mean_disc, round(avg(qty), 5) AS mean_qty, round(corr(price, disc), 6) AS r_price_disc,
    round(corr(price, qty), 6) AS r_price_qty, round(corr(disc, qty), 6) AS r_disc_qty FROM ship GROUP BY 1""",
    "ship",
)
def g38(t):
    out = H.product_agreement(t.ship(), ["entity"], ["price", "disc", "qty"])
    return out.select("entity", r("mean_price", 5).alias("mean_price"), r("mean_disc").alias("mean_disc"), r("mean_qty", 5).alias("mean_qty"), *[r(c).alias(c) for c in ("r_price_disc", "r_price_qty", "r_disc_qty")])
