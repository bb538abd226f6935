"""Projections, filters and scalar expressions."""

from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.functions.normal import black_greeks, normal_cdf_sql
from strandline.plans.registry import query


def r(c, n=6):
    return F.round(c, n)


@query(
    "b1_log_return",
    "SELECT entity, d, round(ln(value) - lag(ln(value)) OVER (PARTITION BY entity ORDER BY d), 6) AS ret FROM daily",
    "daily",
)
def b1(t):
    return C.log_return(t.daily(), ["entity"], "d", "value").select("entity", "d", r("ret").alias("ret"))


@query(
    "b2_log_ratio",
    """WITH x AS (SELECT entity, d, value, lag(value, 12) OVER (PARTITION BY entity ORDER BY d) AS past FROM monthly)
    SELECT entity, d, CASE WHEN value > 0 AND past > 0 THEN round(ln(value / past), 6) END AS ratio FROM x""",
    "monthly",
)
def b2(t):
    return C.log_ratio(t.monthly(), ["entity"], "d", "value", 12).select("entity", "d", r("ratio").alias("ratio"))


@query("b3_clean_positive", "SELECT event_id, ts, value FROM events WHERE value > 0.5")
def b3(t):
    return C.clean_positive(t.raw("events"), "value", 0.5).select("event_id", "ts", "value")


@query(
    "b4_hinge",
    """SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, 18.0 - l_quantity) AS below,
    greatest(0.0, l_quantity - 18.0) AS above, least(greatest(l_quantity, 5.0), 40.0) AS clipped FROM lineitem""",
)
def b4(t):
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        C.hinge("l_quantity", 18.0, "below").alias("below"),
        C.hinge("l_quantity", 18.0).alias("above"),
        C.clip("l_quantity", 5.0, 40.0).alias("clipped"),
    )


@query(
    "b5_calendar_cols",
    """SELECT o_orderkey, CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
    CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS weekend, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
    CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) <= 5 THEN 'MAM'
         WHEN month(o_orderdate) <= 8 THEN 'JJA' ELSE 'SON' END AS season
    FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)""",
)
def b5(t):
    o = t.raw("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return C.calendar_cols(o, "d").drop("d")


@query(
    "b6_local_time",
    """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL 1 HOUR AS utc FROM orders),
    y AS (SELECT o_orderkey, utc, timezone('Europe/Madrid', timezone('UTC', utc)) AS here,
        timezone('Europe/Madrid', timezone('UTC', utc - INTERVAL 1 HOUR)) AS before,
        timezone('Europe/Madrid', timezone('UTC', utc + INTERVAL 1 HOUR)) AS after FROM x)
    SELECT o_orderkey, CASE WHEN here <> before AND here <> after THEN here END AS local FROM y""",
)
def b6(t):
    o = t.raw("orders").select(
        "o_orderkey", F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int), 0, 0)").alias("utc")
    )
    return C.local_time(o, "utc", "Europe/Madrid").select("o_orderkey", "local")


_HAV = """12742.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2)
    + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"""


@query(
    "b7_haversine",
    f"""WITH p AS (SELECT c_custkey, lat + (c_custkey % 100) / 100.0 AS lat, lon + (c_custkey % 37) / 50.0 AS lon
    FROM customer JOIN sites ON site = c_nationkey), o AS (SELECT 40.4 AS lat, -3.7 AS lon)
    SELECT c_custkey, round({_HAV.format(a='p.', b='o.')}, 4) AS km FROM p, o""",
    "sites",
)
def b7(t):
    c = t.raw("customer").join(t.sites(), F.col("c_nationkey") == F.col("site"))
    lat, lon = F.col("lat") + (F.col("c_custkey") % 100) / 100.0, F.col("lon") + (F.col("c_custkey") % 37) / 50.0
    return c.select("c_custkey", r(C.haversine_km(lat, lon, F.lit(40.4), F.lit(-3.7)), 4).alias("km"))


_SUN_SQL = """p AS (SELECT event_id, ts, 36.0 + (user_id % 50) / 5.0 AS lat, -9.0 + (user_id % 70) / 7.0 AS lon, value,
        2 * pi() / 365.0 * (dayofyear(ts) - 1) AS a, hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 AS hours FROM events),
    q AS (SELECT *, 0.006918 - 0.399912 * cos(a) + 0.070257 * sin(a) - 0.006758 * cos(2 * a) + 0.000907 * sin(2 * a)
        - 0.002697 * cos(3 * a) + 0.00148 * sin(3 * a) AS decl,
        (0.0000075 + 0.001868 * cos(a) - 0.032077 * sin(a) - 0.014615 * cos(2 * a) - 0.040849 * sin(2 * a)) * 1440 / (2 * pi()) AS eot FROM p),
    s AS (SELECT *, radians(15.0 * (hours - 12.0) + lon + eot / 4.0) AS ha FROM q),
    sun AS (SELECT *, cos(decl) * cos(radians(lat)) * cos(ha) + sin(decl) * sin(radians(lat)) AS se FROM s)"""


def _sun(t):
    e = t.raw("events").select(
        "event_id", "ts", "value",
        (F.lit(36.0) + (F.col("user_id") % 50) / 5.0).alias("lat"),
        (F.lit(-9.0) + (F.col("user_id") % 70) / 7.0).alias("lon"),
    )
    return e.withColumn("se", C.sin_solar_elevation("lat", "lon", "ts"))


@query(
    "b8_solar_position",
    f"""WITH {_SUN_SQL} SELECT event_id, round(degrees(asin(se)), 4) AS elevation,
    round(CASE WHEN se > 0 THEN 1098.0 * se * exp(-0.059 / greatest(se, 0.001)) ELSE 0.0 END, 4) AS clear_ghi,
    round(greatest(0.0, 1361.0 * se), 4) AS toa FROM sun""",
)
def b8(t):
    return _sun(t).select(
        "event_id",
        r(F.degrees(F.asin("se")), 4).alias("elevation"),
        r(C.clear_sky_ghi(F.col("se")), 4).alias("clear_ghi"),
        r(C.top_of_atmosphere(F.col("se")), 4).alias("toa"),
    )


@query(
    "b9_clear_sky_index",
    f"""WITH {_SUN_SQL}, g AS (SELECT event_id, value, degrees(asin(se)) AS elev,
        CASE WHEN se > 0 THEN 1098.0 * se * exp(-0.059 / greatest(se, 0.001)) ELSE 0.0 END AS clear FROM sun)
    SELECT event_id, CASE WHEN clear >= 50 AND elev > 10 THEN round(value / clear, 6) END AS k FROM g""",
)
def b9(t):
    s = _sun(t).withColumn("clear", C.clear_sky_ghi(F.col("se"))).withColumn("elev", F.degrees(F.asin("se")))
    return s.select("event_id", r(C.clear_sky_index("value", "clear", "elev")).alias("k"))


@query(
    "b10_accumulated_to_rate",
    "SELECT event_id, round(value * 1000 / 3600.0, 6) AS rate, ts - INTERVAL 30 MINUTE AS mid FROM events",
)
def b10(t):
    rate, mid = C.accumulated_to_rate(F.col("value") * 1000, "ts")
    return t.raw("events").select("event_id", r(rate).alias("rate"), mid.alias("mid"))


@query(
    "b11_grid_cell",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor((l_quantity - 3.0) / 4.0) AS INTEGER) AS ix,
        CAST(floor((l_extendedprice / 1000.0 - 5.0) / 4.0) AS INTEGER) AS iy FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, iy, ix, (ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 19) AS inside,
    CASE WHEN ix BETWEEN 0 AND 9 AND iy BETWEEN 0 AND 19 THEN iy * 10 + ix END AS flat FROM x""",
)
def b11(t):
    cell = C.grid_cell("l_quantity", F.col("l_extendedprice") / 1000.0, 3.0, 5.0, 4.0, 10, 20)
    return t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in cell.items()]
    )


@query(
    "b12_band_label",
    """SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 50000 THEN 'low' WHEN o_totalprice >= 50000 AND o_totalprice < 200000
    THEN 'middle' WHEN o_totalprice >= 200000 AND o_totalprice < 400000 THEN 'high' END AS band, count(*) AS n FROM orders GROUP BY 1""",
)
def b12(t):
    bands = [("low", 0, 50000), ("middle", 50000, 200000), ("high", 200000, 400000)]
    return t.raw("orders").groupBy(C.band_label("o_totalprice", bands).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b13_spectral",
    """WITH b AS (SELECT vec_id AS scene, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    c AS (SELECT scene, i, CASE WHEN label >= 5 THEN 1000.0 ELSE 0.0 END AS off, abs(v) * 8000 AS red, abs(v) * 5000 + 900 AS nir,
        v * v * 200000 AS swir FROM b),
    q AS (SELECT scene, i, greatest((red - off) / 10000, 0.0001) AS red, greatest((nir - off) / 10000, 0.0001) AS nir,
        greatest((swir - off) / 10000, 0.0001) AS swir FROM c)
    SELECT scene, CAST(i AS INTEGER) AS i, round((nir - red) / (nir + red), 6) AS ndvi,
    (swir / red >= 1.4 AND swir / nir >= 1.4 AND swir >= 0.15) AS hot FROM q""",
)
def b13(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("scene"), "label", F.posexplode("embedding").alias("i", "v"))
    v, base = F.col("v").cast("double"), F.when(F.col("label") >= 5, "05.00").otherwise("02.00")
    q = e.select(
        "scene", "i",
        C.reflectance(F.abs(v) * 8000, base).alias("red"),
        C.reflectance(F.abs(v) * 5000 + 900, base).alias("nir"),
        C.reflectance(v * v * 200000, base).alias("swir"),
    )
    return q.select("scene", "i", r(C.spectral_index("red", "nir")).alias("ndvi"), C.hot_pixel("nir", "red", "swir").alias("hot"))


@query(
    "b14_qa_bits",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 256 AS INTEGER) AS qa FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, (qa & 57) = 0 AS clear, ((qa & 3) = 0 OR ((qa & 3) = 1 AND ((qa >> 6) & 3) <= 1)) AS good,
    (qa & 6) = 0 AS avhrr, (((qa >> 6) & 3) = 0 AND l_linenumber <= 1) AS viirs FROM x""",
)
def b14(t):
    x = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 256).cast("int").alias("qa"))
    return x.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        C.landsat_clear("qa").alias("clear"), C.modis_good("qa").alias("good"),
        C.avhrr_clear("qa").alias("avhrr"), C.viirs_clear("qa", "l_linenumber").alias("viirs"),
    )


@query(
    "b15_sea_level",
    """SELECT c_custkey, round(c_acctbal / 1000 + 6.5 * (c_nationkey / 10.0), 6) AS sea,
    round(c_acctbal / 1000 + 6.5 * (c_nationkey / 10.0) - 6.5 * (c_custkey % 20) / 10.0, 6) AS back FROM customer""",
)
def b15(t):
    sea = C.to_sea_level(F.col("c_acctbal") / 1000, F.col("c_nationkey") / 10.0)
    return t.raw("customer").select(
        "c_custkey", r(sea).alias("sea"), r(C.from_sea_level(sea, (F.col("c_custkey") % 20) / 10.0)).alias("back")
    )


@query(
    "b16_contract_calendar",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, (o_orderkey % 12 + 1) AS m, (o_orderkey % 30) AS yy FROM orders),
    days AS (SELECT DISTINCT d FROM o),
    firsts AS (SELECT CAST(make_date(y, m, 1) AS DATE) AS f FROM (SELECT unnest(range(1994, 2004)) AS y), (SELECT unnest([3, 5, 7, 9, 12]) AS m)),
    front AS (SELECT d, min(f) FILTER (WHERE d < f - 10) + 14 AS front, min(f) FILTER (WHERE f > d) AS nxt FROM days, firsts GROUP BY d)
    SELECT o_orderkey, make_date(2000 + yy, m, 15) AS maturity, CAST(front AS DATE) AS front, CAST(nxt - d AS INTEGER) AS days_left
    FROM o JOIN front USING (d)""",
)
def b16(t):
    codes = F.array(*[F.lit(c) for c in C.DELIVERY_CODES])
    ticker = F.concat(
        F.lit("KC"), F.get(codes, (F.col("o_orderkey") % 12).cast("int")), F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"), F.lit(".NYB")
    )
    o = t.raw("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), ticker.alias("ticker"))
    return o.select(
        "o_orderkey",
        C.contract_maturity("ticker").alias("maturity"),
        C.front_maturity("d").alias("front"),
        C.days_to_next_delivery("d", C.COFFEE_MONTHS).alias("days_left"),
    )


@query(
    "b17_parse_local_month",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders WHERE o_orderkey % 10 <> 0""",
)
def b17(t):
    names = F.array(*[F.lit(n) for n in ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Set", "Oct", "Nov", "Dic")])
    label = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n.d.")).otherwise(
        F.concat_ws(".", F.get(names, F.month("o_orderdate") - 1), F.year("o_orderdate").cast("string"))
    )
    o = t.raw("orders").select("o_orderkey", label.alias("label"))
    return o.select("o_orderkey", C.parse_local_month("label").alias("month")).where("month IS NOT NULL")


@query(
    "b18_compound_label",
    """SELECT CASE WHEN l_quantity > 40 AND l_discount > 0.07 THEN 'both' WHEN l_quantity > 40 THEN 'a only'
    WHEN l_discount > 0.07 THEN 'b only' ELSE 'neither' END AS label, count(*) AS n, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1""",
)
def b18(t):
    label = C.compound_label(F.col("l_quantity") > 40, F.col("l_discount") > 0.07).alias("label")
    return t.raw("lineitem").groupBy(label).agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_tax")).alias("tax"))


_LAYERS = {"junior": (0.0, 0.03), "mezzanine": (0.03, 0.07), "senior": (0.07, 0.1)}


@query(
    "b19_layer_loss",
    "SELECT l_returnflag AS model, " + ", ".join(
        f"round(avg(least(greatest(l_discount - {a}, 0.0), {d - a:.2f}) / {d - a:.2f}), 6) AS {n}" for n, (a, d) in _LAYERS.items()
    ) + " FROM lineitem GROUP BY 1",
)
def b19(t):
    return t.raw("lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        *[r(F.avg(C.layer_loss("l_discount", a, d))).alias(n) for n, (a, d) in _LAYERS.items()]
    )


_PAY_SQL = """CASE s WHEN 'no hedge' THEN ft WHEN 'futures' THEN f0 WHEN 'half futures' THEN (f0 + ft) / 2
    WHEN 'option' THEN ft + g * (greatest(0.0, g * (f0 - ft)) - 60)
    WHEN 'collar' THEN ft + g * (greatest(0.0, g * (f0 * a - ft)) - greatest(0.0, -g * (kc - ft)))
    WHEN 'spread' THEN ft + g * (greatest(0.0, g * (f0 - ft)) - greatest(0.0, g * (f0 * b - ft)) - 45)
    WHEN 'three-way' THEN ft + g * (greatest(0.0, g * (f0 * a - ft)) - greatest(0.0, g * (f0 * b - ft)) - greatest(0.0, -g * (kf - ft)))
    ELSE f0 * 0.6 + ft * 0.4 END"""


@query(
    "b20_structure_payoffs",
    f"""WITH x AS (SELECT l_orderkey, p_retailprice AS f0, l_extendedprice / l_quantity AS ft FROM lineitem JOIN part ON l_partkey = p_partkey),
    sides AS (SELECT * FROM (VALUES ('seller', 1, 0.95, 0.85, 1.08, 1.04), ('buyer', -1, 1.05, 1.15, 0.92, 0.96)) v(side, g, a, b, c, f)),
    names AS (SELECT unnest(['no hedge', 'futures', 'half futures', 'option', 'collar', 'spread', 'three-way', 'layered']) AS s),
    y AS (SELECT side, s, f0, ft, g, a, b, f0 * c AS kc, f0 * f AS kf FROM x, sides, names)
    SELECT side, s AS structure, count(*) AS n, round(avg({_PAY_SQL}), 4) AS mean, round(stddev_pop({_PAY_SQL}), 4) AS sd FROM y GROUP BY 1, 2""",
)
def b20(t):
    li, p = t.raw("lineitem"), t.raw("part")
    x = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("p_retailprice").alias("f0"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("ft")
    )
    f0 = F.col("f0")
    layered = f0 * 0.6 + F.col("ft") * 0.4
    aggs = []
    for side, (c, f) in {"seller": (1.08, 1.04), "buyer": (0.92, 0.96)}.items():
        k = {"atm": F.lit(60.0), "far": F.lit(15.0), "outer_collar": f0 * c, "outer_fence": f0 * f}
        for name, pay in C.structure_payoffs("f0", "ft", layered, k, side).items():
            aggs.append(F.struct(F.lit(side).alias("side"), F.lit(name).alias("structure"), F.count(F.lit(1)).alias("n"),
                                 r(F.avg(pay), 4).alias("mean"), r(F.stddev_pop(pay), 4).alias("sd")))
    return x.agg(F.array(*aggs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


@query(
    "b21_black_greeks",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS f, p_retailprice AS k, (l_discount + 0.1) * sqrt(greatest(l_quantity / 50.0, 1e-10)) AS spread FROM lineitem JOIN part ON l_partkey = p_partkey),
    d AS (SELECT *, ln(f / k) / spread + spread / 2 AS d1 FROM x), e AS (SELECT *, d1 - spread AS d2 FROM d), n AS (SELECT *, {normal_cdf_sql("d1")} AS n1, {normal_cdf_sql("d2")} AS n2 FROM e)
    SELECT l_orderkey, l_linenumber, l_partkey, round(f * n1 - k * n2, 6) AS price, round(n1, 6) AS delta, round(exp(-(d1 * d1) / 2) / sqrt(2 * pi()) / (f * spread), 6) AS gamma FROM n""",
)
def b21(t):
    li, p = t.raw("lineitem"), t.raw("part")
    x = li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "l_linenumber", "l_partkey", black_greeks(
        F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice"), F.col("l_quantity") / 50.0, F.col("l_discount") + 0.1,
    ).alias("g"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", *[r(f"g.{c}").alias(c) for c in ("price", "delta", "gamma")])


@query(
    "b22_ratio_to_base",
    """WITH b AS (SELECT entity, avg(value) AS base FROM monthly WHERE year(d) = 1996 GROUP BY 1)
    SELECT entity, d, round(value * 100 / base, 6) AS index FROM monthly JOIN b USING (entity)""",
    "monthly",
)
def b22(t):
    out = C.ratio_to_base(t.monthly(), ["entity"], "value", F.year("d") == 1996)
    return out.select("entity", "d", r("index").alias("index"))


@query(
    "b23_log_transforms",
    """SELECT s_suppkey, round(ln(1 + greatest(s_acctbal, 0)), 6) AS lp,
    round(ln((s_nationkey * 3 + 1.0) / (s_nationkey + 1.0)), 6) AS growth FROM supplier""",
)
def b23(t):
    return t.raw("supplier").select(
        "s_suppkey", r(F.log1p(F.greatest("s_acctbal", F.lit(0)))).alias("lp"),
        r(C.log_growth(F.col("s_nationkey"), F.col("s_nationkey") * 3)).alias("growth"),
    )
