"""Row-level expressions.  All are built-in Column expressions, so they stay in codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Physical constants and model coefficients of the published formulas.
EARTH_RADIUS_KM = 6371.0
SOLAR_CONSTANT = 1361.0
HAURWITZ_SCALE, HAURWITZ_DECAY = 1098.0, -0.059
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
EQUATION_OF_TIME = (0.0000075, 0.001868, -0.032077, -0.014615, -0.040849)
LAPSE_K_PER_KM = 6.5

# Futures month codes and month labels.
DELIVERY_CODES = {"F": 1, "G": 2, "H": 3, "J": 4, "K": 5, "M": 6, "N": 7, "Q": 8, "U": 9, "V": 10, "X": 11, "Z": 12}
COFFEE_MONTHS = (3, 5, 7, 9, 12)
SPANISH_MONTHS = {
    "Ene": 1, "Feb": 2, "Mar": 3, "Abr": 4, "May": 5, "Jun": 6, "Jul": 7,
    "Ago": 8, "Sep": 9, "Set": 9, "Oct": 10, "Nov": 11, "Dic": 12,
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, table: dict) -> Column:
    """Small literal dictionary as an expression; unknown keys give null."""
    flat = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*flat), key)


def by_time(keys: Sequence[str], t: str) -> Window:
    """Window over a series with one row per key and period (length bounded by the calendar)."""
    return Window.partitionBy(*keys).orderBy(t)


def log_return(df: DataFrame, keys: Sequence[str], t: str, x: str, h: int = 1, out: str = "ret") -> DataFrame:
    """``ln x(t) - ln x(t-h)`` along each series; non-positive values count as missing."""
    logged = F.log(F.when(F.col(x) > 0, F.col(x)))
    return df.withColumn(out, logged - F.lag(logged, h).over(by_time(keys, t)))


def log_ratio(df: DataFrame, keys: Sequence[str], t: str, x: str, lag: int, out: str = "ratio") -> DataFrame:
    """``ln(x / x lagged)``; zero on either side gives null instead of infinity."""
    past = F.lag(x, lag).over(by_time(keys, t))
    return df.withColumn(out, F.when((F.col(x) > 0) & (past > 0), F.log(F.col(x) / past)))


def clean_positive(df: DataFrame, x: str, floor: float = 0.0) -> DataFrame:
    return df.where(F.col(x) > floor)


def hinge(x: Column | str, k: float, side: str = "above") -> Column:
    """Positive part of ``x - k`` (above) or ``k - x`` (below)."""
    d = col(x) - k if side == "above" else F.lit(k) - col(x)
    return F.greatest(F.lit(0.0), d)


def clip(x: Column | str, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi))


def season(d: Column | str) -> Column:
    return lookup(
        F.month(col(d)),
        {12: "DJF", 1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM", 6: "JJA", 7: "JJA", 8: "JJA", 9: "SON", 10: "SON", 11: "SON"},
    )


def calendar_cols(df: DataFrame, t: str, drop_leap_day: bool = True) -> DataFrame:
    """Month end, day of year, weekend flag, quarter and season; 29 February dropped."""
    d = F.col(t)
    out = (
        df.withColumn("month_end", F.last_day(d))
        .withColumn("doy", F.dayofyear(d))
        .withColumn("weekend", (F.weekday(d) >= 5).cast("int"))
        .withColumn("quarter", F.quarter(d))
        .withColumn("season", season(d))
    )
    return out.where(~((F.month(d) == 2) & (F.dayofmonth(d) == 29))) if drop_leap_day else out


def local_hour(ts: Column | str, tz: str) -> Column:
    """UTC wall clock -> local hour."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), col(ts).cast("timestamp_ntz"))


def local_time(df: DataFrame, ts: str, tz: str, out: str = "local") -> DataFrame:
    """Floor to the hour and shift to local time; hours of a clock change that two UTC
    hours share are set to null.  The test looks one hour to each side, so it needs no
    shuffle."""
    hour = F.expr(f"timestamp_seconds(floor(unix_seconds(cast({ts} as timestamp)) / 3600) * 3600)").cast("timestamp_ntz")
    here = local_hour(hour, tz)
    before = local_hour(hour - F.expr("INTERVAL 1 HOUR"), tz)
    after = local_hour(hour + F.expr("INTERVAL 1 HOUR"), tz)
    return df.withColumn(out, F.when((here != before) & (here != after), here))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat, half_lon = (p2 - p1) / 2, F.radians(col(lon2) - col(lon1)) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _fourier(angle: Column, const: float, terms: Sequence[tuple[float, float]]) -> Column:
    total = F.lit(const)
    for k, (c, s) in enumerate(terms, start=1):
        total = total + F.lit(c) * F.cos(angle * k) + F.lit(s) * F.sin(angle * k)
    return total


def sin_solar_elevation(lat, lon, ts) -> Column:
    """Sine of the sun's elevation from the day of year (Spencer 1971) and the hour angle."""
    ts = col(ts)
    angle = F.lit(2 * math.pi / 365.0) * (F.dayofyear(ts) - 1)
    d, e = DECLINATION, EQUATION_OF_TIME
    declination = _fourier(angle, d[0], [(d[1], d[2]), (d[3], d[4]), (d[5], d[6])])
    minutes = _fourier(angle, e[0], [(e[1], e[2]), (e[3], e[4])]) * (1440.0 / (2 * math.pi))
    hours = F.hour(ts) + F.minute(ts) / 60.0 + F.floor(F.second(ts)) / 3600.0
    hour_angle = F.radians((hours - 12.0) * 15.0 + col(lon) + minutes / 4.0)
    phi = F.radians(col(lat))
    return F.cos(declination) * F.cos(phi) * F.cos(hour_angle) + F.sin(declination) * F.sin(phi)


def solar_elevation(lat, lon, ts) -> Column:
    return F.degrees(F.asin(sin_solar_elevation(lat, lon, ts)))


def clear_sky_ghi(sin_elev: Column) -> Column:
    """Haurwitz clear-sky irradiance, zero below the horizon."""
    ghi = sin_elev * HAURWITZ_SCALE * F.exp(F.lit(HAURWITZ_DECAY) / F.greatest(sin_elev, F.lit(1e-3)))
    return F.when(sin_elev > 0, ghi).otherwise(0.0)


def top_of_atmosphere(sin_elev: Column) -> Column:
    return F.greatest(F.lit(0.0), sin_elev * SOLAR_CONSTANT)


def clear_sky_index(ghi, clear, elevation=None, min_clear: float = 50.0, min_elevation: float = 10.0) -> Column:
    ok = col(clear) >= min_clear
    if elevation is not None:
        ok = ok & (col(elevation) > min_elevation)
    return F.when(ok, col(ghi) / col(clear))


def accumulated_to_rate(x, ts) -> tuple[Column, Column]:
    """Hourly sums -> mean rate, stamped in the middle of the hour."""
    return col(x) / 3600.0, col(ts) - F.expr("INTERVAL 30 MINUTES")


def grid_cell(x, y, x0: float, y0: float, step: float, nx: int, ny: int) -> dict[str, Column]:
    """Row, column, inside flag and flat id of the cell holding a point."""
    ix = F.floor((col(x) - x0) / step).cast("int")
    iy = F.floor((col(y) - y0) / step).cast("int")
    inside = ix.between(0, nx - 1) & iy.between(0, ny - 1)
    return {"iy": iy, "ix": ix, "inside": inside, "flat": F.when(inside, iy * nx + ix)}


def band_label(x, bands: Sequence[tuple[str, float, float]]) -> Column:
    """Name of the half-open band [lo, hi) holding ``x``."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(list(bands)):
        out = F.when((col(x) >= lo) & (col(x) < hi), name).otherwise(out)
    return out


def spectral_index(red, nir) -> Column:
    """(nir - red) / (nir + red), null where the sum is zero."""
    return F.try_divide(col(nir) - col(red), col(nir) + col(red))


def reflectance(count, baseline) -> Column:
    """Counts -> reflectance; products from baseline 04.00 on carry an offset of 1000."""
    offset = F.when(col(baseline) >= "04.00", 1000.0).otherwise(0.0)
    return F.greatest((col(count) - offset) / 10000.0, F.lit(1e-4))


def hot_pixel(narrow, swir1, swir2) -> Column:
    return (col(swir2) / col(swir1) >= 1.4) & (col(swir2) / col(narrow) >= 1.4) & (col(swir2) >= 0.15)


def bits(flags, shift: int, mask: int) -> Column:
    return F.shiftright(col(flags), shift).bitwiseAND(F.lit(mask))


def landsat_clear(qa) -> Column:
    """No fill, cloud, shadow or snow."""
    return bits(qa, 0, 0b1).eqNullSafe(0) & bits(qa, 3, 0b111).eqNullSafe(0)


def modis_good(qc) -> Column:
    """Good quality, or other quality with a small average error."""
    return (bits(qc, 0, 3) == 0) | ((bits(qc, 0, 3) == 1) & (bits(qc, 6, 3) <= 1))


def avhrr_clear(qa) -> Column:
    return bits(qa, 1, 0b11) == 0


def viirs_clear(cloud_mask, quality) -> Column:
    return (bits(cloud_mask, 6, 3) == 0) & (col(quality) <= 1)


def to_sea_level(temp, z_km) -> Column:
    return col(temp) + F.lit(LAPSE_K_PER_KM) * col(z_km)


def from_sea_level(temp, z_km) -> Column:
    return col(temp) - F.lit(LAPSE_K_PER_KM) * col(z_km)


def contract_maturity(ticker) -> Column:
    """``KCH27`` style code -> 15th of the delivery month."""
    code = F.substring(col(ticker), 3, 1)
    year = F.lit(2000) + F.substring(col(ticker), 4, 2).cast("int")
    return F.make_date(year, lookup(code, DELIVERY_CODES), F.lit(15))


def _listed_firsts(d: Column, months: Sequence[int]) -> Column:
    year = F.year(d)
    return F.array(*[F.make_date(year + y, F.lit(m), F.lit(1)) for y in (0, 1) for m in sorted(months)])


def front_maturity(d, months: Sequence[int] = COFFEE_MONTHS, roll_days: int = 10) -> Column:
    """Maturity of the nearest contract that has not rolled yet.

    The two candidate years are a short literal array, so no calendar join is needed.
    """
    d = col(d)
    live = F.filter(_listed_firsts(d, months), lambda m: d < F.date_sub(m, roll_days))
    return F.date_add(F.array_min(live), 14)


def days_to_next_delivery(d, months: Sequence[int]) -> Column:
    d = col(d)
    return F.datediff(F.array_min(F.filter(_listed_firsts(d, months), lambda m: m > d)), d)


def parse_local_month(label) -> Column:
    """``Ene.2019`` -> first of the month; unknown labels give null."""
    parts = F.split(col(label), r"\.")
    month = lookup(F.get(parts, 0), SPANISH_MONTHS)
    year = F.expr("try_cast(null as int)") if label is None else F.get(parts, 1).try_cast("int")
    return F.when(month.isNotNull() & year.isNotNull(), F.make_date(year, month, F.lit(1)))


def compound_label(a, b, names=("both", "a only", "b only", "neither")) -> Column:
    a, b = col(a), col(b)
    return F.when(a & b, names[0]).when(a, names[1]).when(b, names[2]).otherwise(names[3])


def layer_loss(loss, attach: float, detach: float) -> Column:
    """Share of the layer between ``attach`` and ``detach`` that a loss writes down."""
    width = detach - attach
    return F.least(F.greatest(col(loss) - attach, F.lit(0.0)), F.lit(width)) / width


def structure_payoffs(F0, FT, layers, k: dict[str, Column], side: str) -> dict[str, Column]:
    """Outcome per tonne of eight hedge structures for a seller or a buyer.

    A buyer gains where a seller pays: calls stand for puts and every sign turns.
    ``k`` holds strikes (``outer_collar``, ``outer_fence``) and premiums (``atm``, ``far``).
    """
    F0, FT, layers = col(F0), col(FT), col(layers)
    sign = 1 if side == "seller" else -1
    inner, deep = (0.95, 0.85) if side == "seller" else (1.05, 1.15)
    protect = lambda s: hinge_cols(s, FT, sign)
    give_up = lambda s: hinge_cols(s, FT, -sign)
    deep_spread = deep
    return {
        "no hedge": FT,
        "futures": F0,
        "half futures": (F0 + FT) / 2,
        "option": FT + sign * (protect(F0) - k["atm"]),
        "collar": FT + sign * (protect(F0 * inner) - give_up(k["outer_collar"])),
        "spread": FT + sign * (protect(F0) - protect(F0 * deep_spread) - (k["atm"] - k["far"])),
        "three-way": FT + sign * (protect(F0 * inner) - protect(F0 * deep) - give_up(k["outer_fence"])),
        "layered": layers,
    }


def hinge_cols(strike: Column, price: Column, sign: int) -> Column:
    """Put payoff for ``sign`` +1, call payoff for -1."""
    return F.greatest(F.lit(0.0), (strike - price) * sign)


def ratio_to_base(df: DataFrame, keys: Sequence[str], x: str, in_base: Column, scale: float = 100.0, out: str = "index") -> DataFrame:
    """Index to ``scale`` over the base rows of each series (aggregate + join back)."""
    base = df.where(in_base).groupBy(*keys).agg(F.avg(x).alias("_base"))
    return df.join(base, list(keys), "left").withColumn(out, F.try_divide(F.col(x) * scale, F.col("_base"))).drop("_base")


def log_growth(a, b) -> Column:
    return F.log((col(b) + 1) / (col(a) + 1))
