"""Analysis tables derived from the given parquet tables, in Spark and in SQL.

Each derived table is an aggregate whose size is bounded by the calendar, the number of
sites or the shape of a raster; the scans below it grow with the data.
"""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep(df: DataFrame) -> DataFrame:
    """Keep a derived panel for the session, so that a query reading it in several branches scans
    the raw table once.

    Only for panels whose size is set by the calendar and the number of series; they may
    spill to disk, and a lost block is recomputed from the raw table.
    """
    return df if df.storageLevel.useMemory else df.persist(StorageLevel.MEMORY_AND_DISK)


def _panel(build):
    def method(self) -> DataFrame:
        return keep(build(self))

    method.__name__ = build.__name__
    return method


class Tables:
    """Lazy access to the given tables and to the panels derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # one series per order priority and day
    @_panel
    def daily(self) -> DataFrame:
        o = self.raw("orders")
        return o.groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("d")).agg(
            F.round(F.sum("o_totalprice"), 2).alias("value")
        )

    @_panel
    def weekly(self) -> DataFrame:
        o = self.raw("orders")
        week = F.date_sub(F.to_date("o_orderdate"), F.weekday(F.to_date("o_orderdate")))
        return o.groupBy(F.col("o_orderpriority").alias("entity"), week.alias("d")).agg(
            F.round(F.sum("o_totalprice"), 2).alias("value")
        )

    @_panel
    def monthly(self) -> DataFrame:
        o = self.raw("orders")
        return o.groupBy(
            F.col("o_orderpriority").alias("entity"), F.trunc(F.to_date("o_orderdate"), "MM").alias("d")
        ).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))

    # one series per return flag and shipping day: quantity, unit price, discount
    @_panel
    def ship(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.groupBy(F.col("l_returnflag").alias("entity"), F.to_date("l_shipdate").alias("d")).agg(
            F.sum("l_quantity").alias("qty"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"),
            (F.round(F.sum("l_discount"), 2) / F.count(F.lit(1))).alias("disc"),
            F.count(F.lit(1)).alias("n"),
        )

    # all days together: one row per day
    @_panel
    def ship_all(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.groupBy(F.to_date("l_shipdate").alias("d")).agg(
            F.sum("l_quantity").alias("qty"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"),
            (F.round(F.sum("l_discount"), 2) / F.count(F.lit(1))).alias("disc"),
            (F.round(F.sum("l_tax"), 2) / F.count(F.lit(1))).alias("tax"),
            F.count(F.lit(1)).alias("n"),
        )

    # irregular ticks, one clock per event type; a price of zero is a bad print
    def ticks(self) -> DataFrame:
        e = self.raw("events").where("value > 0")
        return e.select(F.col("event_type").alias("asset"), "ts", "event_id", F.col("value").alias("price"))

    # hourly panel per event type
    @_panel
    def hourly(self) -> DataFrame:
        e = self.raw("events")
        hour = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)).alias("h")
        return e.groupBy(F.col("event_type").alias("entity"), hour).agg(
            F.round(F.sum("value"), 4).alias("value"), F.count(F.lit(1)).alias("n")
        )

    # sites: nations placed on a small map by a rule
    def sites(self) -> DataFrame:
        n = self.raw("nation")
        key = F.col("n_nationkey")
        return n.select(
            key.alias("site"),
            F.col("n_regionkey").alias("region"),
            (F.lit(36.0) + (key % 5) * F.lit(1.5)).alias("lat"),
            (F.lit(-9.0) + F.floor(key / 5) * F.lit(2.5) + (key % 3) * F.lit(0.2)).alias("lon"),
        )

    def _site_orders(self) -> DataFrame:
        o, c = self.raw("orders"), self.raw("customer")
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("c_nationkey").alias("site"), F.to_date("o_orderdate").alias("d"), "o_totalprice"
        )

    @_panel
    def site_month(self) -> DataFrame:
        return self._site_orders().groupBy("site", F.trunc("d", "MM").alias("d")).agg(
            F.round(F.sum("o_totalprice"), 2).alias("value")
        )

    @_panel
    def site_day(self) -> DataFrame:
        return self._site_orders().groupBy("site", "d").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))

    @_panel
    def site_year(self) -> DataFrame:
        return self._site_orders().groupBy("site", F.year("d").alias("year")).agg(
            F.avg("o_totalprice").alias("value"), F.count(F.lit(1)).alias("n")
        )

    # forecast table: the line number (1 to 7) is the lead
    @_panel
    def leads(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.groupBy(
            F.col("l_returnflag").alias("site"), F.to_date("l_shipdate").alias("target"), F.col("l_linenumber").alias("lead")
        ).agg(F.round(F.avg("l_quantity"), 6).alias("value"))

    # 64 variables (positions) observed at vec_id
    def variables(self) -> DataFrame:
        e = self.raw("embeddings")
        return e.select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("var", "value")).withColumn(
            "value", F.col("value").cast("double")
        )

    # 8 x 8 rasters, one scene per vector
    def pixels(self) -> DataFrame:
        e = self.raw("embeddings")
        return e.select(F.col("vec_id").alias("scene"), "label", F.posexplode("embedding").alias("i", "v")).select(
            "scene",
            "label",
            (F.col("i") / 8).cast("int").alias("iy"),
            (F.col("i") % 8).alias("ix"),
            F.col("v").cast("double").alias("v"),
        )

    # supplier -> customer graph
    def edges(self) -> DataFrame:
        li, o = self.raw("lineitem"), self.raw("orders")
        return (
            li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst"))
            .distinct()
        )


_SQL: dict[str, str] = {
    "daily": """SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS d,
        round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2""",
    "weekly": """SELECT o_orderpriority AS entity, CAST(date_trunc('week', o_orderdate) AS DATE) AS d,
        round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2""",
    "monthly": """SELECT o_orderpriority AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS d,
        round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2""",
    "ship": """SELECT l_returnflag AS entity, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS qty,
        sum(l_extendedprice) / sum(l_quantity) AS price, round(sum(l_discount), 2) / count(*) AS disc,
        count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "ship_all": """SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS qty,
        sum(l_extendedprice) / sum(l_quantity) AS price, round(sum(l_discount), 2) / count(*) AS disc,
        round(sum(l_tax), 2) / count(*) AS tax, count(*) AS n FROM lineitem GROUP BY 1""",
    "ticks": "SELECT event_type AS asset, ts, event_id, value AS price FROM events WHERE value > 0",
    "hourly": """SELECT event_type AS entity, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h,
        round(sum(value), 4) AS value, count(*) AS n FROM events GROUP BY 1, 2""",
    "sites": """SELECT n_nationkey AS site, n_regionkey AS region,
        CAST(36.0 + (n_nationkey % 5) * 1.5 AS DOUBLE) AS lat,
        CAST(-9.0 + (n_nationkey // 5) * 2.5 + (n_nationkey % 3) * 0.2 AS DOUBLE) AS lon FROM nation""",
    "site_orders": """SELECT c_nationkey AS site, CAST(o_orderdate AS DATE) AS d, o_totalprice
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "site_month": """SELECT site, CAST(date_trunc('month', d) AS DATE) AS d, round(sum(o_totalprice), 2) AS value
        FROM site_orders GROUP BY 1, 2""",
    "site_day": "SELECT site, d, round(sum(o_totalprice), 2) AS value FROM site_orders GROUP BY 1, 2",
    "site_year": """SELECT site, CAST(year(d) AS INTEGER) AS year, avg(o_totalprice) AS value,
        count(*) AS n FROM site_orders GROUP BY 1, 2""",
    "leads": """SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS target, l_linenumber AS lead,
        round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2, 3""",
    "variables": """SELECT vec_id AS t, CAST(unnest(range(64)) AS INTEGER) AS var,
        CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings""",
    "pixels": """SELECT vec_id AS scene, label, CAST(unnest(range(64)) // 8 AS INTEGER) AS iy,
        CAST(unnest(range(64)) % 8 AS INTEGER) AS ix, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings""",
    "edges": """SELECT DISTINCT l_suppkey AS src, o_custkey AS dst
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}
_NEEDS = {"site_month": ["site_orders"], "site_day": ["site_orders"], "site_year": ["site_orders"]}


def with_tables(sql: str, tables: str) -> str:
    """Prefix ``sql`` with the definitions of the derived tables it reads."""
    names: list[str] = []
    for name in tables.split():
        for need in [*_NEEDS.get(name, []), name]:
            if need not in names:
                names.append(need)
    if not names:
        return sql.strip()
    heads = ",\n".join(f"{n} AS ({_SQL[n]})" for n in names)
    body = sql.strip()
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head.group(1) or ''}{heads},\n{body[head.end():]}"
    return f"WITH {heads}\n{body}"
