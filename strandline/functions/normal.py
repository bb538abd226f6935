"""Normal distribution function and its inverse, for columns, arrays and SQL alike."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximations of the inverse (Wichura 1988, AS 241), lowest power first
_CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
# Distribution function below 7.07 (Hart 1968), lowest power first
_BODY = (
    (220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911),
    (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184),
)


def _poly(coefficients, x):
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = x * out + c
    return out


def _ratio(pair, x):
    return _poly(pair[0], x) / _poly(pair[1], x)


def _poly_sql(coefficients, x: str) -> str:
    out = f"CAST({coefficients[-1]!r} AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        out = f"({x} * {out} + CAST({c!r} AS DOUBLE))"
    return out


def _ratio_sql(pair, x: str) -> str:
    return f"{_poly_sql(pair[0], x)} / {_poly_sql(pair[1], x)}"


def norm_cdf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    z = np.minimum(np.abs(x), 40.0)
    bell = np.exp(-z * z / 2)
    below = np.where(z < 7.07, bell * _ratio(_BODY, np.minimum(z, 7.07)), bell / (math.sqrt(2 * math.pi) * (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65)))))))
    return np.where(x > 0, 1 - below, below)


def norm_ppf(u: np.ndarray) -> np.ndarray:
    """Inverse distribution function inside (0, 1)."""
    u = np.asarray(u, dtype=float)
    q = u - 0.5
    s = np.sqrt(-np.log(np.minimum(u, 1 - u)))
    tail = np.where(s <= 5, _ratio(_MIDDLE, s - 1.6), _ratio(_TAIL, s - 5))
    return np.where(np.abs(q) <= 0.425, q * _ratio(_CENTRE, 0.180625 - q * q), np.sign(q) * tail)


def normal_cdf(x: Column | str) -> Column:
    """Distribution function as an expression; null stays null."""
    x = F.col(x) if isinstance(x, str) else x
    z = F.least(F.abs(x), F.lit(40.0))
    bell = F.exp(-z * z / 2)
    below = F.when(z < 7.07, bell * _ratio(_BODY, z)).otherwise(bell / (F.lit(math.sqrt(2 * math.pi)) * (z + F.lit(1.0) / (z + F.lit(2.0) / (z + F.lit(3.0) / (z + F.lit(4.0) / (z + 0.65)))))))
    return F.when(x > 0, F.lit(1.0) - below).when(x <= 0, below)


def normal_quantile(u: Column | str) -> Column:
    """Inverse distribution function as an expression; null outside (0, 1)."""
    u = F.col(u) if isinstance(u, str) else u
    q = u - 0.5
    s = F.sqrt(-F.ln(F.least(u, F.lit(1.0) - u)))
    tail = F.signum(q) * F.when(s <= 5, _ratio(_MIDDLE, s - 1.6)).otherwise(_ratio(_TAIL, s - 5.0))
    return F.when((u > 0) & (u < 1), F.when(F.abs(q) <= 0.425, q * _ratio(_CENTRE, F.lit(0.180625) - q * q)).otherwise(tail))


def normal_cdf_sql(x: str) -> str:
    """The same formula in SQL, for values within 7.07."""
    z = f"abs({x})"
    below = f"(exp(-{z} * {z} / 2) * {_ratio_sql(_BODY, z)})"
    return f"(CASE WHEN {x} > 0 THEN 1 - {below} ELSE {below} END)"


def normal_quantile_sql(u: str) -> str:
    """The same formula in SQL, for values inside (0, 1)."""
    q, s = f"({u} - 0.5)", f"sqrt(-ln(least({u}, 1 - {u})))"
    middle, tail = _ratio_sql(_MIDDLE, f"({s} - 1.6)"), _ratio_sql(_TAIL, f"({s} - 5)")
    return f"(CASE WHEN abs{q} <= 0.425 THEN {q} * {_ratio_sql(_CENTRE, f'(0.180625 - {q} * {q})')} ELSE sign{q} * (CASE WHEN {s} <= 5 THEN {middle} ELSE {tail} END) END)"


def black_greeks(f: Column, k: Column, tau: Column, sigma: Column) -> Column:
    """Undiscounted futures-call price, delta and gamma (Black 1976), as a struct expression."""
    spread = sigma * F.sqrt(F.greatest(tau, F.lit(1e-10)))
    d1 = F.ln(f / k) / spread + spread / 2
    delta = normal_cdf(d1)
    price = f * delta - k * normal_cdf(d1 - spread)
    gamma = F.exp(-(d1 * d1) / 2) / F.lit(math.sqrt(2 * math.pi)) / (f * spread)
    return F.struct(price.alias("price"), delta.alias("delta"), gamma.alias("gamma"))
