"""Sources and sinks.

The files are written by Spark from the given tables into the shared folder and read back
with the readers under test, so their size grows with the tables.
"""

from pyspark.sql import functions as F

from strandline.functions import columns as C
from strandline.plans.registry import query
from strandline.sources import readers as S
from strandline.sources.writers import write_table
from strandline.storage import staging_path


def r(c, n=6):
    return F.round(c, n)


def _text(df, t, name, **options):
    path = staging_path(t.spark, name)
    df.write.options(**options).text(path)
    return path


@query("a1_read_series_csv", "SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, c_acctbal AS value, DATE '2000-01-01' + CAST(c_custkey % 365 AS INTEGER) AS d FROM customer")
def a1(t):
    k = F.col("c_custkey")
    line = F.concat_ws(",", F.lpad(k.cast("string"), 9, "0"), F.col("c_acctbal").cast("string"), F.date_add(F.lit("2000-01-01").cast("date"), (k % 365).cast("int")).cast("string"))
    noted = t.raw("customer").select(F.explode(F.array(F.lit("# station, balance, day"), line)).alias("value"))
    return S.read_series_csv(t.spark, _text(noted, t, "series"), "id string, value double, d date", header=False)


@query(
    "a2_read_whitespace_table",
    "SELECT CAST(last_day(make_date(CAST(1950 + o_orderkey % 70 AS BIGINT), CAST(o_orderkey % 12 + 1 AS BIGINT), 1)) AS DATE) AS month, o_totalprice AS total, CAST(o_custkey AS DOUBLE) AS anomaly FROM orders",
)
def a2(t):
    k = F.col("o_orderkey")
    codes = F.array(*[F.lit(c) for c in S.SEASON_CENTRE])
    line = F.concat_ws("   ", F.lit(""), F.get(codes, (k % 12).cast("int")), (k % 70 + 1950).cast("string"), F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string"))
    lines = t.raw("orders").select(line.alias("value"))
    return S.read_whitespace_table(t.spark, _text(lines, t, "seasons"))


@query(
    "a3_parse_period_table",
    "SELECT CAST(last_day(o_orderdate) AS DATE) AS month, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 11 <> 0",
)
def a3(t):
    k = F.col("o_orderkey")
    key = F.when(k % 11 == 0, F.lit("annual")).otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("M"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0")))
    o = t.raw("orders").select(key.alias("period"), F.when(k % 7 == 0, F.lit("..")).otherwise(F.col("o_totalprice").cast("string")).alias("price"))
    return S.parse_period_table(o, "period", ["price"])


@query(
    "a4_parse_market_file",
    """WITH p AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(CASE WHEN month(l_shipdate) <= 6 THEN l_orderkey % 96 + 1 ELSE l_orderkey % 24 + 1 END AS INTEGER) AS period, l_extendedprice AS price FROM lineitem),
    d AS (SELECT date, max(period) AS top FROM p GROUP BY 1)
    SELECT date, CAST((period - 1) // CASE WHEN top > 25 THEN 4 ELSE 1 END AS INTEGER) AS hour, round(avg(price), 6) AS price FROM p JOIN d USING (date) GROUP BY 1, 2""",
)
def a4(t):
    d = F.to_date("l_shipdate")
    period = F.when(F.month(d) <= 6, F.col("l_orderkey") % 96 + 1).otherwise(F.col("l_orderkey") % 24 + 1)
    price = F.regexp_replace(F.format_string("%.2f", "l_extendedprice"), r"\.", ",")
    line = F.concat(F.concat_ws(";", F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"), period.cast("string"), F.lit("0"), price), F.lit(";"))
    lines = t.raw("lineitem").select(line.alias("value"))
    marks = t.raw("region").select(F.explode(F.array(F.lit("HEADER;"), F.lit("*"))).alias("value"))
    path = _text(lines.unionByName(marks), t, "market")
    return S.read_market_files(t.spark, path).withColumn("price", r("price"))


@query("a5_explode_parallel_arrays", "SELECT o_custkey, o_orderkey AS k, o_totalprice AS price FROM orders")
def a5(t):
    docs = t.raw("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("s"))
    body = F.to_json(F.struct("o_custkey", F.col("s.o_orderkey").alias("k"), F.col("s.o_totalprice").alias("price")))
    path = _text(docs.select(body.alias("value")), t, "arrays")
    records = t.spark.read.schema("o_custkey bigint, k array<bigint>, price array<double>").json(path)
    return S.explode_parallel_arrays(records, ["k", "price"], ["o_custkey"])


@query("a6_read_partitioned_files", "SELECT l_returnflag AS origin, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1")
def a6(t):
    path = staging_path(t.spark, "origins")
    t.raw("lineitem").select("l_returnflag", "l_orderkey", "l_quantity").write.partitionBy("l_returnflag").option("header", True).csv(path)
    df = S.read_partitioned_files(t.spark, f"{path}/*/*.csv", "l_orderkey bigint, l_quantity double", r"l_returnflag=(\w)/")
    return df.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("qty"))


@query("a7_read_headerless_gz", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS value FROM supplier")
def a7(t):
    path = staging_path(t.spark, "gz")
    t.raw("supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", False).option("compression", "gzip").csv(path)
    return S.read_headerless_gz(t.spark, path, "id bigint, name string, value double")


@query(
    "a8_with_fallback_tier",
    """WITH p AS (SELECT c_nationkey AS site, o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x FROM orders JOIN customer ON c_custkey = o_custkey),
    g AS (SELECT count(*) >= 10 AS use FROM (SELECT site FROM p GROUP BY 1 HAVING count(x) / count(*) >= 0.8))
    SELECT site, k, x, 'primary' AS tier FROM p, g WHERE use UNION ALL SELECT s_nationkey, s_suppkey, s_acctbal, 'fallback' FROM supplier, g WHERE NOT use""",
)
def a8(t):
    o, c = t.raw("orders"), t.raw("customer")
    p = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("site"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("x"))
    f = t.raw("supplier").select(F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"))
    return S.with_fallback_tier(p, f, "site", "x")


@query("a9_append_new", "SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'first' ELSE 'second' END AS batch FROM orders")
def a9(t):
    o = t.raw("orders").select("o_orderkey", "o_orderdate")
    early = o.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select("o_orderkey", F.lit("first").alias("batch"))
    path = staging_path(t.spark, "resume")
    early.write.parquet(path)
    return S.append_new(t.spark, path, o.select("o_orderkey", F.lit("second").alias("batch")), ["o_orderkey"])


@query(
    "a10_station_inventory",
    """WITH i AS (SELECT l_suppkey AS id, l_returnflag AS element, year(l_shipdate) AS y FROM lineitem), v AS (SELECT id, element, min(y) AS first_year, max(y) AS last_year FROM i GROUP BY 1, 2),
    s AS (SELECT s_suppkey AS id, lat, lon FROM supplier JOIN sites ON site = s_nationkey)
    SELECT s.id, min(s_name) AS name, min(lat) AS lat, min(lon) AS lon, CAST(min(first_year) AS INTEGER) AS first_year, CAST(max(last_year) AS INTEGER) AS last_year FROM s JOIN v ON v.id = s.id LEFT JOIN supplier n ON n.s_suppkey = s.id
    WHERE element IN ('A', 'R') AND first_year <= 1996 AND last_year >= 2000 AND lat BETWEEN 37 AND 41 AND lon BETWEEN -8 AND 1 GROUP BY 1""",
    "sites",
)
def a10(t):
    s = t.raw("supplier").join(t.sites(), F.col("s_nationkey") == F.col("site"))
    inv = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("element")).agg(F.min(F.year("l_shipdate")).alias("first_year"), F.max(F.year("l_shipdate")).alias("last_year"))
    where = "i.element IN ('A', 'R') AND i.first_year <= 1996 AND i.last_year >= 2000 AND s.lat BETWEEN 37 AND 41 AND s.lon BETWEEN -8 AND 1"
    names = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return S.station_inventory(t.spark, s.select(F.col("s_suppkey").alias("id"), "lat", "lon"), inv, names, where)


@query("a11_write_table", "SELECT entity, d, round(value, 1) AS value FROM daily", "daily")
def a11(t):
    path = staging_path(t.spark, "daily")
    write_table(t.daily(), path, "csv", 1, ["entity"], sort_by=["d"])
    return t.spark.read.schema("d date, value double, entity string").option("header", True).csv(path).select("entity", "d", "value")


@query("a11_write_json", "SELECT entity, count(*) AS n, round(sum(value), 2) AS total FROM daily GROUP BY 1", "daily")
def a11j(t):
    path = staging_path(t.spark, "summary")
    write_table(t.daily().groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), path, "json", 2)
    return t.spark.read.schema("entity string, n bigint, total double").json(path)


@query(
    "a12_with_forcings",
    """WITH x AS (SELECT event_id, ts, radians(36.0 + user_id % 50 / 5.0) AS phi, radians(-9.0 + user_id % 70 / 7.0) AS lam, -9.0 + user_id % 70 / 7.0 AS lon FROM events)
    SELECT event_id, round(cos(phi), 6) AS cos_latitude, round(sin(phi), 6) AS sin_latitude, round(cos(lam), 6) AS cos_longitude, round(sin(lam), 6) AS sin_longitude,
    round(cos((dayofyear(ts) - 1 + hour(ts) / 24.0) / 365.25 * 2 * pi()), 6) AS cos_julian_day, round(sin((dayofyear(ts) - 1 + hour(ts) / 24.0) / 365.25 * 2 * pi()), 6) AS sin_julian_day,
    round(cos((hour(ts) / 24.0 + lon / 360.0) * 2 * pi()), 6) AS cos_local_time, round(sin((hour(ts) / 24.0 + lon / 360.0) * 2 * pi()), 6) AS sin_local_time FROM x""",
)
def a12(t):
    e = t.raw("events").select("event_id", "ts", (F.lit(36.0) + (F.col("user_id") % 50) / 5.0).alias("lat"), (F.lit(-9.0) + (F.col("user_id") % 70) / 7.0).alias("lon"))
    out = S.with_forcings(e, "ts", "lat", "lon")
    return out.select("event_id", *[r(c).alias(c) for c in out.columns if c.startswith(("cos_", "sin_"))])


@query(
    "a12_cube_to_rows",
    "SELECT vec_id, label, CAST(unnest(range(32)) AS INTEGER) AS cell, unnest(embedding[1:32]) AS red, unnest(embedding[33:64]) AS nir FROM embeddings",
)
def a12c(t):
    e = t.raw("embeddings").select("vec_id", "label", F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("data"))
    return S.cube_to_rows(e, ["red", "nir"])
