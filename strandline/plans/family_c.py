"""Joins."""

from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import joins as J
from strandline.operators.ordering import sliced_lag
from strandline.operators.spatial import nearest
from strandline.plans.registry import query
from strandline.plans.tables import keep


def r(c, n=6):
    return F.round(c, n)


PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unset": "4-NOT SPECIFIED", "low": "5-LOW"}
WIDE_SQL = ", ".join(f"max(value) FILTER (WHERE entity = '{p}') AS {n}" for n, p in PRIORITIES.items())


def aligned_daily(t):
    d = t.daily()
    return keep(J.align({n: (d.where(F.col("entity") == p), "d", "value") for n, p in PRIORITIES.items()}, "d"))


@query(
    "c1_align",
    f"WITH w AS (SELECT d, {WIDE_SQL} FROM daily GROUP BY d) SELECT * FROM w WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in PRIORITIES),
    "daily",
)
def c1(t):
    return aligned_daily(t)


@query(
    "c2_merge_suffix",
    """WITH b AS (SELECT site, CAST(year(d) AS INTEGER) AS year, round(max(value), 4) AS value FROM site_month GROUP BY 1, 2)
    SELECT site, year, round(a.value + 1e-7, 4) AS value_mean, a.n, b.value AS value_peak FROM site_year a JOIN b USING (site, year)""",
    "site_year site_month",
)
def c2(t):
    peak = t.site_month().groupBy("site", F.year("d").alias("year")).agg(r(F.max("value"), 4).alias("value"))
    out = J.merge_suffix(t.site_year(), peak, ["site", "year"], ("_mean", "_peak"))
    return out.withColumn("value_mean", r(F.col("value_mean") + 1e-7, 4))  # off exact halves


@query(
    "c3_asof_last",
    """WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
    v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT p.event_id, v.value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def c3(t):
    e = t.raw("events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").select("user_id", "ts", "value")
    return J.asof_last(left, right, ["user_id"], "ts", ["value"]).select("event_id", "value")


@query(
    "c4_asof_next",
    """WITH cal AS (SELECT DISTINCT entity, d AS trading FROM daily), ev AS (SELECT o_orderkey, o_orderpriority AS entity,
        CAST(o_orderdate AS DATE) + 1 AS d FROM orders)
    SELECT o_orderkey, min(trading) AS trading FROM ev LEFT JOIN cal ON cal.entity = ev.entity AND trading >= d GROUP BY 1""",
    "daily",
)
def c4(t):
    events = t.raw("orders").select("o_orderkey", F.col("o_orderpriority").alias("entity"), F.date_add(F.to_date("o_orderdate"), 1).alias("d"))
    calendar = t.daily().select("entity", "d", F.col("d").alias("trading"))
    return J.asof_next(events, calendar, ["entity"], "d", ["trading"], shared_times=True).select("o_orderkey", "trading")


def tick_intervals(t):
    """Consecutive ticks of one asset -> intervals with their log return (seconds as doubles)."""
    ticks = t.ticks().withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    prev = sliced_lag(ticks, ["asset"], ["ts", "event_id"], {"start": "sec", "p0": "price"})
    return prev.where("start IS NOT NULL").select(
        "asset", "start", F.col("sec").alias("end"), F.log(F.col("price") / F.col("p0")).alias("ret")
    )


INTERVALS_SQL = """iv AS (SELECT * FROM (SELECT asset, lag(epoch_us(ts) / 1e6) OVER w AS start, epoch_us(ts) / 1e6 AS "end",
    ln(price / lag(price) OVER w) AS ret FROM ticks WINDOW w AS (PARTITION BY asset ORDER BY ts, event_id)) WHERE start IS NOT NULL)"""


@query(
    "c5_interval_overlap",
    f"""WITH {INTERVALS_SQL}, a AS (SELECT * FROM iv WHERE asset = 'view'), b AS (SELECT * FROM iv WHERE asset = 'purchase')
    SELECT round(a.start, 3) AS a_start, round(a."end", 3) AS a_end, round(b.start, 3) AS b_start, round(b."end", 3) AS b_end
    FROM a JOIN b ON a.start < b."end" AND b.start < a."end" """,
    "ticks",
)
def c5(t):
    iv = tick_intervals(t)
    side = lambda a: iv.where(F.col("asset") == a).select("start", "end")
    out = J.interval_overlap(side("view"), side("purchase"), [], "start", "end")
    return out.select(*[r(c, 3).alias(c) for c in ("a_start", "a_end", "b_start", "b_end")])


@query(
    "c6_circular_day_pool",
    """WITH x AS (SELECT entity, (dayofyear(d) - 1) % 365 AS p, value FROM daily),
    per AS (SELECT entity, p, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM x GROUP BY 1, 2),
    z AS (SELECT entity, (p + o + 365) % 365 + 1 AS doy, n, s, lo, hi FROM per, (SELECT unnest(range(-30, 31)) AS o))
    SELECT entity, CAST(doy AS INTEGER) AS doy, CAST(sum(n) AS BIGINT) AS n, round(sum(s), 2) AS total, min(lo) AS lowest, max(hi) AS highest FROM z GROUP BY 1, 2""",
    "daily",
)
def c6(t):
    out = J.circular_day_pool(t.daily().withColumn("doy", F.dayofyear("d")), ["entity"], "doy", "value")
    return out.select("entity", "doy", "n", r("total", 2).alias("total"), "lowest", "highest")


def _located(t, table, key, nation):
    """Customers or suppliers scattered around their nation by a rule on the key."""
    k = F.col(key)
    return t.raw(table).join(t.sites(), F.col(nation) == F.col("site")).select(
        k, (F.col("lat") + (k % 100) / 100.0).alias("lat"), (F.col("lon") + (k % 37) / 50.0).alias("lon"), "region", "site"
    )


def located_sql(table, key, nation):
    return f"""(SELECT {key}, lat + ({key} % 100) / 100.0 AS lat, lon + ({key} % 37) / 50.0 AS lon, region, site
        FROM {table} JOIN sites ON {nation} = site)"""


_HAV = """12742.0 * asin(sqrt(least(1.0, pow(sin(radians(g.lat - p.lat) / 2), 2)
    + cos(radians(p.lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - p.lon) / 2), 2))))"""


@query(
    "c7_nearest",
    f"""WITH p AS {located_sql('customer', 'c_custkey', 'c_nationkey')},
    k AS (SELECT c_custkey, g.site, round({_HAV}, 9) AS km FROM p, sites g)
    SELECT c_custkey, arg_min(site, (km, site)) AS site, round(min(km), 4) AS km FROM k GROUP BY 1""",
    "sites",
)
def c7(t):
    points = _located(t, "customer", "c_custkey", "c_nationkey").drop("site")
    return nearest(points, t.sites(), "c_custkey", "site").select("c_custkey", "site", r("km", 4).alias("km"))


@query(
    "c8_nearest_outside_group",
    f"""WITH p AS {located_sql('supplier', 's_suppkey', 's_nationkey')},
    k AS (SELECT p.s_suppkey, round({_HAV}, 9) AS km FROM p JOIN p g ON p.region <> g.region)
    SELECT s_suppkey, round(min(km), 4) AS km FROM k GROUP BY 1""",
    "sites",
)
def c8(t):
    p = _located(t, "supplier", "s_suppkey", "s_nationkey")
    return nearest(p, p.withColumnRenamed("s_suppkey", "other"), "s_suppkey", "other", group="region").select(
        "s_suppkey", r("km", 4).alias("km")
    )


@query(
    "c10_semi_filter",
    """SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
    AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)""",
)
def c10(t):
    li = t.raw("lineitem").withColumnRenamed("l_partkey", "p_partkey")
    both = J.semi_filter(t.raw("part"), li.where("l_returnflag = 'R'"), li.where("l_quantity >= 48"), key="p_partkey")
    return both.select("p_partkey", "p_brand")


@query(
    "c11_cross_params",
    """SELECT l_shipmode AS flag, thr, round(avg(CASE WHEN l_quantity > thr THEN 1.0 ELSE 0.0 END), 6) AS share, count(*) AS n
    FROM (SELECT l_returnflag AS l_shipmode, l_quantity, unnest([10.0, 20.0, 30.0, 40.0])::DOUBLE AS thr FROM lineitem) GROUP BY 1, 2""",
)
def c11(t):
    x = J.cross_params(t.raw("lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity"), thr=[10.0, 20.0, 30.0, 40.0])
    over = F.when(F.col("l_quantity") > F.col("thr"), 1.0).otherwise(0.0)
    return x.groupBy("flag", "thr").agg(r(F.avg(over)).alias("share"), F.count(F.lit(1)).alias("n"))


@query(
    "c12_lookup_weights",
    """WITH w AS (SELECT n_nationkey AS site, (n_nationkey % 7 + 1) / sum(n_nationkey % 7 + 1) OVER () AS weight FROM nation)
    SELECT d, round(sum(value * weight), 4) AS value FROM site_month JOIN w USING (site) GROUP BY 1""",
    "site_month",
)
def c12(t):
    n = t.raw("nation").select(F.col("n_nationkey").alias("site"), (F.col("n_nationkey") % 7 + 1).alias("raw"))
    total = n.agg(F.sum("raw").alias("total"))
    w = n.crossJoin(F.broadcast(total)).select("site", (F.col("raw") / F.col("total")).alias("weight"))
    x = J.lookup_weights(t.site_month(), w, "site")
    return x.groupBy("d").agg(r(F.sum(F.col("value") * F.col("weight")), 4).alias("value"))


@query(
    "c13_merge_shared_cells",
    f"""WITH p AS (SELECT c.*, x.lat, x.lon FROM {located_sql('customer', 'c_custkey', 'c_nationkey')} x JOIN customer c USING (c_custkey))
    SELECT CAST(floor(lat / 0.25) AS BIGINT) AS iy, CAST(floor(lon / 0.25) AS BIGINT) AS ix, min(c_custkey) AS c_custkey, count(*) AS n_merged,
    round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(avg(c_acctbal), 4) AS c_acctbal FROM p GROUP BY 1, 2""",
    "sites",
)
def c13(t):
    c = _located(t, "customer", "c_custkey", "c_nationkey").join(t.raw("customer").select("c_custkey", "c_acctbal"), "c_custkey")
    c = c.withColumn("iy", F.floor(F.col("lat") / 0.25)).withColumn("ix", F.floor(F.col("lon") / 0.25))
    out = J.merge_shared_cells(c, ["iy", "ix"], "c_custkey", ["lat", "lon", "c_acctbal"])
    return out.select("iy", "ix", "c_custkey", "n_merged", r("lat").alias("lat"), r("lon").alias("lon"), r("c_acctbal", 4).alias("c_acctbal"))


@query(
    "c14_forecast_issue_table",
    """SELECT site, CAST(target - lead AS DATE) AS issue, max(value) AS level FROM leads GROUP BY 1, 2 HAVING count(DISTINCT lead) = 7""",
    "leads",
)
def c14(t):
    return J.forecast_issue_table(t.leads(), "site", "target", "lead", "value")
