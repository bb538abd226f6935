"""Set operations, sorts, top-k and the streaming forms."""

from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.operators import sets as K
from strandline.plans.registry import query
from strandline.storage import staging_path
from strandline.streaming import live


def r(c, n=6):
    return F.round(c, n)


@query(
    "j1_union_labelled",
    "SELECT o_orderkey AS k, o_totalprice AS value, 'orders' AS source FROM orders UNION ALL SELECT l_orderkey, l_extendedprice, 'lines' FROM lineitem",
)
def j1(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    li = t.raw("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("value"))
    return K.union_labelled({"orders": o, "lines": li}, "source")


@query("j2_dedupe_edges", "SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey")
def j2(t):
    return K.undirected_edges(t.raw("lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")), "a", "b")


@query("j3_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def j3(t):
    li = t.raw("lineitem")
    return K.ids_in_all([li.where(F.col("l_returnflag") == f) for f in "RAN"], "l_partkey")


@query("j4_except", "SELECT o_orderkey AS l_orderkey FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 40")
def j4(t):
    done = t.raw("lineitem").where("l_quantity >= 40").select("l_orderkey").distinct()
    return K.left_to_do(t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey")), done, ["l_orderkey"])


@query(
    "j5_role_table",
    """SELECT l_suppkey, CASE min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) WHEN 0 THEN 'copper' WHEN 1 THEN 'case' ELSE 'placebo' END AS role FROM lineitem GROUP BY 1""",
)
def j5(t):
    li = t.raw("lineitem")
    return K.role_table({n: li.where(F.col("l_returnflag") == f) for n, f in (("copper", "R"), ("case", "A"), ("placebo", "N"))}, "l_suppkey")


@query("k1_multi_key_sort", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def k1(t):
    return t.raw("orders").select("o_custkey", "o_orderdate", "o_orderkey").orderBy("o_custkey", F.desc("o_orderdate"), "o_orderkey")


@query("k2_top_n_abs", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice - 38000, 2) AS gap FROM lineitem ORDER BY abs(round(l_extendedprice - 38000, 2)) DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25")
def k2(t):
    x = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(F.col("l_extendedprice") - 38000, 2).alias("gap"))
    return K.top_n_abs(x, "gap", 25, ["l_orderkey", "l_linenumber", "l_partkey"])


@query("k3_top_per_group", "SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def k3(t):
    o = t.raw("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return K.top_per_group(o, ["o_custkey"], F.col("o_totalprice"), ["o_orderkey"])


@query("k4_last_known", "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def k4(t):
    e = t.raw("events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return K.known_value(e, ["user_id"], "value", ["ts", "event_id"])


@query("k5_hashed_sample")
def k5(t):
    return K.hashed_sample(t.raw("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500)


@query(
    "k6_first_n_per_group",
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_discount, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem) WHERE place <= 4""",
)
def k6(t):
    li = t.raw("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    return K.first_n_per_group(li, ["l_suppkey"], ["l_discount", "l_orderkey", "l_linenumber", "l_partkey"], 4)


@query(
    "m1_quiet_gap_events",
    """WITH a AS (SELECT event_type, ts, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events WHERE value >= 100),
    s AS (SELECT event_type, ts, count(*) FILTER (WHERE gap IS NULL OR gap >= INTERVAL 2 HOUR) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM a)
    SELECT event_type, min(ts) AS event, max(ts) AS last, count(*) AS n FROM s GROUP BY event_type, k""",
)
def m1(t):
    e = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.quiet_gap_events(e, ["event_type"], "ts", "value", 100.0, "2 hours", "1 hour")
    return out.select("event_type", F.col("event").cast("timestamp_ntz").alias("event"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query(
    "m2_windowed_totals",
    """WITH w AS (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR]) AS "start" FROM events)
    SELECT event_type, "start", "start" + INTERVAL 3 HOUR AS "end", round(sum(value), 4) AS total, count(*) AS n FROM w GROUP BY 1, 2""",
)
def m2(t):
    e = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.windowed_totals(e, ["event_type"], "ts", {"total": r(F.sum("value"), 4), "n": F.count(F.lit(1))}, "3 hours", "1 hour", "1 hour")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "total", "n")


@query("m3_incremental_ingest", "SELECT event_id, user_id, value FROM events")
def m3(t):
    """Stream the event files twice into one table: the second run finds nothing new."""
    source = staging_path(t.spark, "events-in")
    e = t.raw("events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e).repartition(4, "event_id").write.parquet(source)
    out, check = staging_path(t.spark, "events-out"), staging_path(t.spark, "events-offsets")
    for _ in range(2):
        stream = t.spark.readStream.schema("event_id bigint, user_id bigint, value double, ts timestamp").parquet(source)
        live.ingest(live.deduplicated(stream, ["event_id"], "ts", "40 days"), out, check).awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "user_id", "value")
