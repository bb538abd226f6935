"""Hedging backtests, option chains, ensembles and calibration scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.functions.normal import norm_cdf
from strandline.operators.ordering import exact_quantiles, join_on
from strandline.operators.regress import theil_sen

TRADING_DAYS = 252


# ---- GARCH refits ------------------------------------------------------------------------


def _garch_paths(r: np.ndarray, v0: float, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Variance after each return for many parameter sets at once (time loop, vector of sets)."""
    out = np.empty((len(r) + 1, len(omega)))
    out[0] = v0
    for t, sq in enumerate(r * r):
        out[t + 1] = omega + alpha * sq + beta * out[t]
    return out


def fit_garch(r: np.ndarray, rounds: int = 5) -> tuple[float, float, float]:
    """Gaussian likelihood on a grid of (alpha, beta, long-run variance), refined around the best."""
    r = r - r.mean()
    v0 = float(r.var())
    if len(r) < 20 or v0 <= 0:
        return v0 * 0.05, 0.05, 0.9
    centre, width = np.array([0.10, 0.80, 1.0]), np.array([0.10, 0.20, 0.6])
    for _ in range(rounds):
        axes = [np.unique(np.clip(np.linspace(c - w, c + w, 7), lo, hi)) for c, w, lo, hi in zip(centre, width, (0.001, 0.0, 0.1), (0.6, 0.99, 5.0))]
        a, b, m = (g.ravel() for g in np.meshgrid(*axes, indexing="ij"))
        ok = a + b < 0.999
        a, b, m = a[ok], b[ok], m[ok]
        s2 = np.maximum(_garch_paths(r, v0, m * v0 * (1 - a - b), a, b)[:-1], 1e-18)
        best = int((np.log(s2) + (r * r)[:, None] / s2).sum(axis=0).argmin())
        centre, width = np.array([a[best], b[best], m[best]]), width / 2.5
    return float(centre[2] * v0 * (1 - centre[0] - centre[1])), float(centre[0]), float(centre[1])


def garch_refit_panel(df: DataFrame, key: str, d: str, ret: str, years_back: int = 5, min_years: int = 2) -> DataFrame:
    """GARCH(1,1) refitted each January on the past years: parameters and the next-day variance
    of each day of the year.

    A return takes part in the fits of the following years; a group is one series and year
    (at most ``years_back`` + 1 years of days).
    """
    first = df.where(F.col(ret).isNotNull()).groupBy(key).agg(F.year(F.min(d)).alias("_y0"), F.year(F.max(d)).alias("_y1"))
    rows = df.where(F.col(ret).isNotNull()).select(key, d, F.col(ret).alias("_r")).join(first, key)
    rows = rows.withColumn("year", F.explode(F.sequence(F.year(d), F.year(d) + years_back)))
    rows = rows.where((F.col("year") >= F.col("_y0") + min_years) & (F.col("year") <= F.col("_y1"))).select(key, "year", d, "_r")
    kt, dt = df.schema[key].dataType.simpleString(), df.schema[d].dataType.simpleString()

    def refit(k, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(d)
        live = np.array([v.year for v in pdf[d]]) == k[1]
        past, now = pdf["_r"].to_numpy()[~live], pdf[live]
        if not len(past) or not len(now):
            return pd.DataFrame({key: [], "year": [], d: [], "variance": [], "omega": [], "alpha": [], "beta": []})
        omega, alpha, beta = fit_garch(past)
        known = np.r_[past[-1], now["_r"].to_numpy()[:-1]]  # returns up to the day before
        path = _garch_paths(known, float(past.var()), np.array([omega]), np.array([alpha]), np.array([beta]))[1:, 0]
        return pd.DataFrame({key: k[0], "year": int(k[1]), d: now[d].to_numpy(), "variance": path, "omega": omega, "alpha": alpha, "beta": beta})

    return rows.groupBy(key, "year").applyInPandas(refit, f"{key} {kt}, year int, {d} {dt}, variance double, omega double, alpha double, beta double")


def garch_term_vol(variance, omega, alpha, beta, days) -> Column:
    """Annualised volatility expected over the coming days: geometric reversion in closed form."""
    p = C.col(alpha) + C.col(beta)
    long_run = C.col(omega) / (F.lit(1.0) - p)
    mean = long_run + (C.col(variance) - long_run) * (F.lit(1.0) - F.pow(p, C.col(days))) / (C.col(days) * (F.lit(1.0) - p))
    return F.sqrt(mean * TRADING_DAYS)


# ---- hedged trades -------------------------------------------------------------------------

STRATEGIES = ("none", "static", "weekly", "move", "daily", "garch", "leland", "band")


def _black(f, k, tau, sigma):
    spread = sigma * np.sqrt(np.maximum(tau, 1e-10))
    d1 = np.log(f / k) / spread + spread / 2
    delta = norm_cdf(d1)
    gamma = np.exp(-d1 * d1 / 2) / np.sqrt(2 * np.pi) / (f * spread)
    return f * delta - k * norm_cdf(d1 - spread), delta, gamma


def _positions(strategy: str, f: np.ndarray, sigma: np.ndarray, cost: float, move: float, aversion: float) -> np.ndarray:
    """Futures held each day for many trades at once: ``f`` is trades x (days + 1)."""
    n, days = sigma.shape
    strike = f[:, :1]
    tau = (days - np.arange(days))[None, :] / TRADING_DAYS
    if strategy == "none":
        return np.zeros((n, days))
    if strategy == "leland":
        sigma = sigma * np.sqrt(1 + np.sqrt(2 / np.pi) * cost / (sigma * np.sqrt(1 / TRADING_DAYS)))
    _, delta, gamma = _black(f[:, :-1], strike, tau, sigma)
    if strategy in ("daily", "garch", "leland"):
        return delta
    if strategy in ("static", "weekly"):
        held = np.zeros(days, dtype=int) if strategy == "static" else np.arange(days) // 5 * 5
        return delta[:, held]
    out, now, last = np.empty((n, days)), np.zeros(n), f[:, 0].copy()
    half = (1.5 * cost * f[:, :-1] * gamma**2 / aversion) ** (1 / 3)
    for t in range(days):
        if strategy == "move":
            go = np.abs(f[:, t] / last - 1) >= move if t else np.ones(n, dtype=bool)
            now, last = np.where(go, delta[:, t], now), np.where(go, f[:, t], last)
        else:
            now = np.clip(now, delta[:, t] - half[:, t], delta[:, t] + half[:, t])
        out[:, t] = now
    return out


def trade_paths(df: DataFrame, key: str, d: str, price: str, sigma: str, garch: DataFrame | None, days: int = 63) -> DataFrame:
    """One row per series and month start: prices of the next ``days`` sessions and the
    volatility believed on each.

    A session is sent to the trades that hold it (about ``days`` / 21), so a trade is a short
    array and no series is gathered.
    """
    w = C.by_time([key], d)
    pos = df.where(F.col(price) > 0).withColumn("_i", F.row_number().over(w)).withColumn("_new", F.coalesce(F.trunc(d, "MM") != F.trunc(F.lag(d).over(w), "MM"), F.lit(False)))
    first = F.min(d).over(Window.partitionBy(key))
    starts = pos.withColumn("_first", first).where(F.col("_new") & (F.col(d) >= F.add_months("_first", 24))).select(key, F.col("_i").alias("_s"))
    slots = starts.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(days)))).withColumn("_i", F.col("_s") + F.col("t"))
    held = slots.join(pos.select(key, "_i", d, F.col(price).alias("f"), F.col(sigma).alias("s")), [key, "_i"])
    if garch is None:
        held = held.withColumn("g", F.col("s"))
    else:
        g = garch.select(key, d, "variance", "omega", "alpha", "beta")
        held = held.join(g, [key, d], "left")
        held = held.withColumn("g", F.coalesce(garch_term_vol("variance", "omega", "alpha", "beta", F.greatest(F.lit(days) - F.col("t"), F.lit(1))), F.col("s")))
    packed = held.groupBy(key, "_s").agg(F.sort_array(F.collect_list(F.struct("t", "f", "s", "g", F.col(d).alias("d")))).alias("_p")).where(F.size("_p") == days + 1)
    part = lambda c, n: F.slice(F.transform("_p", lambda p: p[c]), 1, n)
    out = packed.select(key, F.get("_p", F.lit(0))["d"].alias("start"), F.get("_p", F.lit(days))["d"].alias("end"), part("f", days + 1).alias("f"), part("s", days).alias("s"), part("g", days).alias("g"))
    return out.where(~F.exists("s", lambda v: v.isNull() | (v <= 0)))


def hedge_backtest(paths: DataFrame, key: str, strategies: Sequence[str] = STRATEGIES, cost: float = 5e-4, move: float = 0.02, aversion: float = 10.0, shock: float = 1.5) -> DataFrame:
    """Sell an at-the-money call and hedge it: one row per trade and strategy.

    Trades are independent rows of short arrays; tasks value Arrow batches of them.
    """
    kt = paths.schema[key].dataType.simpleString()
    dt = paths.schema["start"].dataType.simpleString()
    schema = f"{key} {kt}, start {dt}, end {dt}, strategy string, regime string, sigma_sold double, sigma_realised double, move double, pnl double, cost double, premium double, trades int"

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            f, s, g = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("f", "s", "g"))
            days = s.shape[1]
            premium = _black(f[:, 0], f[:, 0], days / TRADING_DAYS, s[:, 0])[0]
            realised = np.diff(np.log(f), axis=1).std(axis=1) * np.sqrt(TRADING_DAYS)
            payoff = np.maximum(f[:, -1] - f[:, 0], 0)
            for name in strategies:
                h = _positions(name, f, g if name == "garch" else s, cost, move, aversion)
                step = np.diff(h, axis=1, prepend=0.0)
                paid = cost * (np.abs(step) * f[:, :-1]).sum(axis=1)
                pnl = premium - payoff + (h * np.diff(f, axis=1)).sum(axis=1) - paid
                yield pd.DataFrame({
                    key: pdf[key].to_numpy(), "start": pdf["start"].to_numpy(), "end": pdf["end"].to_numpy(), "strategy": name,
                    "regime": np.where(realised >= shock * s[:, 0], "shock", "calm"), "sigma_sold": s[:, 0], "sigma_realised": realised,
                    "move": f[:, -1] / f[:, 0] - 1, "pnl": pnl / f[:, 0], "cost": paid / f[:, 0], "premium": premium / f[:, 0], "trades": (step != 0).sum(axis=1).astype("int32"),
                })

    return paths.mapInPandas(run, schema)


def hedge_ratio_sweep(df: DataFrame, by: Sequence[str], quantity: str, f0: str, ft: str, ratios: Sequence[float]) -> DataFrame:
    """Revenue spread by hedge ratio and the ratio with the least; from second moments.

    Revenue is linear in the ratio, so its variance at every ratio follows from three sums.
    """
    a, b = F.col(quantity) * F.col(ft), F.col(f0) - F.col(ft)
    m = df.groupBy(*by).agg(F.var_pop(a).alias("_va"), F.covar_pop(a, b).alias("_cab"), F.var_pop(b).alias("_vb"))
    h = F.col("ratio")
    sweep = m.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    sweep = sweep.withColumn("sd", F.sqrt(F.greatest(F.col("_va") + h * F.col("_cab") * 2 + h * h * F.col("_vb"), F.lit(0.0))))
    best = sweep.groupBy(*by).agg(F.min(F.struct(F.round("sd", 9), "ratio"))["ratio"].alias("optimum"))
    return sweep.select(*by, "ratio", "sd").join(best, list(by)) if by else sweep.select("ratio", "sd").crossJoin(F.broadcast(best))


# ---- option chains --------------------------------------------------------------------------


def chain_filter(chain: DataFrame, max_spread: float = 0.5, need_volume: bool = True) -> DataFrame:
    """Quotes with at least one usable side: two-sided, tight enough, traded."""

    def good(side: str) -> Column:
        bid, ask, vol = F.col(f"{side}_bid"), F.col(f"{side}_ask"), F.col(f"{side}_volume")
        ok = (ask > 0) & (ask > bid) & ((ask - bid) <= (ask + bid) / 2 * max_spread)
        return F.coalesce(ok & (vol > 0) if need_volume else ok, F.lit(False))

    return chain.where(good("call") | good("put"))


def parity_forward(chain: DataFrame, by: Sequence[str]) -> DataFrame:
    """Discount and forward per expiry from the line of call minus put mids on strike."""
    diff = (F.col("call_bid") + F.col("call_ask") - F.col("put_bid") - F.col("put_ask")) / 2
    rows = chain.withColumn("_d", diff).where("_d IS NOT NULL")
    fit = rows.groupBy(*by).agg(F.regr_slope("_d", "strike").alias("_b"), F.regr_intercept("_d", "strike").alias("_a"), F.count(F.lit(1)).alias("_n"))
    return fit.where(F.col("_n") >= 3).select(*by, (-F.col("_b")).alias("discount"), F.try_divide(F.col("_a"), -F.col("_b")).alias("forward"))


def term_structure(chain: DataFrame, by: Sequence[str], min_strikes: int = 5) -> DataFrame:
    """At-the-money volatility per expiry: mean of the valid call and put vols at the strike nearest the forward."""
    fwd = parity_forward(chain, by).where("forward IS NOT NULL")
    civ, piv = F.when(F.col("call_iv") > 0, F.col("call_iv")), F.when(F.col("put_iv") > 0, F.col("put_iv"))
    iv = F.coalesce((civ + piv) / 2, civ, piv)
    near = F.struct(F.abs(F.col("strike") - F.col("forward")), F.col("strike"))
    out = chain.join(fwd, list(by)).groupBy(*by, "forward", "discount").agg(F.min_by(F.struct(iv.alias("v")), near)["v"].alias("atm_vol"), F.min("dte").alias("dte"), F.count(F.lit(1)).alias("n_strikes"))
    return out.where(F.col("n_strikes") >= min_strikes).withColumn("years", F.col("dte") / 365.0)


def smile(chain: DataFrame, by: Sequence[str]) -> DataFrame:
    """Out-of-the-money volatility by strike: puts below the forward, calls above."""
    fwd = parity_forward(chain, by).where("forward IS NOT NULL")
    iv = F.when(F.col("strike") < F.col("forward"), F.col("put_iv")).otherwise(F.col("call_iv"))
    return chain.join(fwd.select(*by, "forward"), list(by)).withColumn("iv", iv).where(F.col("iv") > 0).select(*by, "strike", "iv")


def curve_panel(contracts: DataFrame, front: DataFrame, d: str, ticker: str, price: str, front_price: str, months: Sequence[int] = C.COFFEE_MONTHS) -> DataFrame:
    """Log price and years to maturity per day and contract, the front first.

    A listed contract with the front's maturity is dropped, so is anything about to expire.
    """
    near = front.select(d, F.lit("front").alias("contract"), F.col(front_price).alias("_p"), C.front_maturity(d, months).alias("_m"))
    listed = contracts.select(d, F.col(ticker).alias("contract"), F.col(price).alias("_p"), C.contract_maturity(ticker).alias("_m"))
    listed = listed.where(F.col("_m") != C.front_maturity(d, months))
    both = near.unionByName(listed)
    tau = F.datediff("_m", d) / 365.25
    return both.where((F.col("_p") > 0) & (tau > 0.02)).select(d, "contract", F.log("_p").alias("log_price"), tau.alias("tau"))


# ---- ensembles ------------------------------------------------------------------------------


def ensemble_posterior(runs: DataFrame, by: Sequence[str], param: str, run: str, k: str, s: str, y: str, horizons: Sequence[int], detect: float = 0.5) -> DataFrame:
    """Posterior over the parameter at several horizons from simulated counts.

    Gaussian likelihood per run, mean over runs in log space (shifted by the maximum), then
    normalised over parameters, with a running total for the 90% range.
    """
    mean, sd = F.col(s) * detect, F.sqrt(F.col(s) * detect * (1 - detect)) + 2.0
    z = (F.col(y) - mean) / sd
    ll = -(z * z) / 2 - F.log(sd) - float(0.5 * np.log(2 * np.pi))
    wide = runs.withColumn("_ll", ll).withColumn("horizon", F.explode(F.filter(F.array(*[F.lit(h) for h in horizons]), lambda h: F.col(k) <= h)))
    per_run = wide.groupBy(*by, "horizon", param, run).agg(F.sum("_ll").alias("_r"))
    top = per_run.groupBy(*by, "horizon", param).agg(F.max("_r").alias("_top"))
    mixed = join_on(per_run, top, [*by, "horizon", param]).groupBy(*by, "horizon", param).agg((F.max("_top") + F.log(F.avg(F.exp(F.col("_r") - F.col("_top"))))).alias("loglik"))
    one = Window.partitionBy(*by, "horizon")  # one row per parameter value
    post = mixed.withColumn("_e", F.exp(F.col("loglik") - F.max("loglik").over(one))).withColumn("posterior", F.col("_e") / F.sum("_e").over(one))
    return post.withColumn("cdf", F.sum("posterior").over(one.orderBy(param).rowsBetween(Window.unboundedPreceding, 0))).drop("_e")


def posterior_summary(post: DataFrame, by: Sequence[str], param: str) -> DataFrame:
    """Most likely value and the 90% range."""
    at = lambda q: F.coalesce(F.min(F.when(F.col("cdf") >= q, F.col(param))), F.max(param))
    return post.groupBy(*by, "horizon").agg(F.max_by(F.col(param), F.struct(F.round("posterior", 12), -F.col(param))).alias("map"), at(0.05).alias("lo"), at(0.95).alias("hi"))


def importance_summary(df: DataFrame, by: Sequence[str], x: str, logw: Column) -> DataFrame:
    """Weighted mean, 5-95% range and effective sample size of weighted particles.

    Particles with one value share a row before the ordered running total.
    """
    keyed = df.withColumn("_lw", logw)
    top = keyed.groupBy(*by).agg(F.max("_lw").alias("_top"))
    w = join_on(keyed, top, by).withColumn("_w", F.exp(F.col("_lw") - F.col("_top")))
    per = w.groupBy(*by, x).agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_w")).alias("_w2"))
    one = Window.partitionBy(*by)
    run = per.withColumn("_c", F.sum("_w").over(one.orderBy(x).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_w").over(one))
    at = lambda q: F.coalesce(F.min(F.when(F.col("_c") >= q, F.col(x))), F.max(x))
    return run.groupBy(*by).agg((F.sum(F.col("_w") * F.col(x)) / F.sum("_w")).alias("mean"), at(0.05).alias("lo"), at(0.95).alias("hi"), (F.pow(F.sum("_w"), F.lit(2)) / F.sum("_w2")).alias("ess"))


def multilevel_stats(runs: DataFrame, level: str, seed: str, fine: str, coarse: str, cost: str, eps: float) -> DataFrame:
    """Per level: mean, variance, variance of the paired difference, correlation, cost and the
    number of samples that reaches the target error at least cost."""
    diff = F.when(F.col(level) == 0, F.col(fine)).otherwise(F.col(fine) - F.col(coarse))
    lv = runs.withColumn("_d", diff).groupBy(level).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(fine).alias("mean_q"), F.var_samp(fine).alias("var_q"), F.avg("_d").alias("mean_diff"), F.var_samp("_d").alias("var_diff"),
        F.try_divide(F.covar_pop(fine, coarse), F.stddev_pop(F.when(F.col(coarse).isNotNull(), F.col(fine))) * F.stddev_pop(coarse)).alias("corr_pair"), F.avg(cost).alias("cost"),
    )
    total = F.sum(F.sqrt(F.col("var_diff") * F.col("cost"))).over(Window.partitionBy())  # one row per level
    return lv.withColumn("samples", F.ceil(F.sqrt(F.col("var_diff") / F.col("cost")) * total / (eps * eps)))


def grid_scores(df: DataFrame, params: Sequence[str], site: str, year: str, model: str, obs: str, min_years: int = 15) -> DataFrame:
    """Per parameter set: Spearman of site levels and of site trends, and the median
    year-to-year correlation at a site.

    Levels and trends that agree to ten digits of the largest level are ties, whatever the order in which
    the rows of a large table were added up."""
    both = df.where(F.col(model).isNotNull() & F.col(obs).isNotNull())
    keys = [*params, site]
    level = both.groupBy(*keys).agg(
        F.avg(model).alias("_lm"), F.avg(obs).alias("_lo"), F.count(F.lit(1)).alias("_n"),
        F.try_divide(F.covar_pop(model, obs), F.stddev_pop(model) * F.stddev_pop(obs)).alias("_yy"),
    ).where(F.col("_n") >= min_years)
    trend = theil_sen(both, keys, year, [model, obs])
    per = level.join(trend, keys)
    # one row per site: ranks inside a parameter set, at a step of 1e-9 of the largest level's power of ten
    g = Window.partitionBy(*params)
    step = lambda c: F.pow(F.lit(10.0), 9 - F.floor(F.log10(F.greatest(F.max(F.abs(c)).over(g), F.lit(1e-90)))))
    per = per.withColumn("_sm", step("_lm")).withColumn("_so", step("_lo"))
    cols = {"_lm": ("_lm", "_sm"), "_lo": ("_lo", "_so"), "_tm": (f"{model}_slope", "_sm"), "_to": (f"{obs}_slope", "_so")}
    for out, (c, s) in cols.items():
        per = per.withColumn(f"{out}_k", F.round(F.col(c) * F.col(s)))
        per = per.withColumn(f"{out}_r", F.rank().over(g.orderBy(f"{out}_k")) + (F.count(F.lit(1)).over(Window.partitionBy(*params, f"{out}_k")) - 1) / 2)
    r = lambda a, b: F.try_divide(F.covar_pop(f"{a}_r", f"{b}_r"), F.stddev_pop(f"{a}_r") * F.stddev_pop(f"{b}_r"))
    scores = per.groupBy(*params).agg(r("_lm", "_lo").alias("level"), r("_tm", "_to").alias("trend"), F.count(F.lit(1)).alias("sites"))
    med = exact_quantiles(per.where("_yy IS NOT NULL"), params, "_yy", [0.5]).select(*params, F.col("_yy").alias("year_to_year"))
    return scores.join(med, list(params), "left")


def best_row(df: DataFrame, by: Sequence[str], score: Column, ties: Sequence[str]) -> DataFrame:
    """First row with the largest score."""
    others = [c for c in df.columns if c not in by]
    key = F.struct((-F.round(score, 9)).alias("s"), *ties)
    return df.groupBy(*by).agg(F.min_by(F.struct(*others), key).alias("_b")).select(*by, "_b.*")


def scaled_splice(main: DataFrame, extra: DataFrame, keys: Sequence[str], t: str, x: str, split) -> DataFrame:
    """Extend a series backwards by another one scaled by the ratio of their means over the
    common periods from ``split`` on."""
    keys = list(keys)
    m = main.where(F.col(t) >= F.lit(split)).select(*keys, t, F.col(x).alias("_a"))
    e = extra.where(F.col(t) >= F.lit(split)).select(*keys, t, F.col(x).alias("_b"))
    ratio = m.join(e, [*keys, t]).groupBy(*keys).agg(F.try_divide(F.avg("_a"), F.avg("_b")).alias("_k"))
    early = extra.where(F.col(t) < F.lit(split)).join(ratio, keys) if keys else extra.where(F.col(t) < F.lit(split)).crossJoin(F.broadcast(ratio))
    return main.where(F.col(t) >= F.lit(split)).select(*keys, t, x, F.lit("main").alias("source")).unionByName(
        early.select(*keys, t, (F.col(x) * F.col("_k")).alias(x), F.lit("scaled").alias("source"))
    )


def product_agreement(df: DataFrame, by: Sequence[str], products: Sequence[str]) -> DataFrame:
    """Mean of each product and their pairwise correlations over common rows, one pass."""
    aggs = [F.avg(p).alias(f"mean_{p}") for p in products]
    for i, a in enumerate(products):
        for b in products[i + 1 :]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            aggs.append(F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))).alias(f"r_{a}_{b}"))
    return df.groupBy(*by).agg(*aggs)
