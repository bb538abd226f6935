"""File sources: dated CSV, whitespace tables, market files, parallel arrays, many files.

Every reader takes an explicit schema (no inference pass over the data) and returns a lazy
DataFrame.  Text formats are parsed with built-in expressions on the lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.columns import lookup

# Three-letter season code -> its centre month.
SEASON_CENTRE = {
    "DJF": 1, "JFM": 2, "FMA": 3, "MAM": 4, "AMJ": 5, "MJJ": 6, "JJA": 7, "JAS": 8, "ASO": 9, "SON": 10, "OND": 11, "NDJ": 12,
}


def read_series_csv(spark: SparkSession, path: str, schema: str, comment: str = "#", header: bool = True, sep: str = ",") -> DataFrame:
    """Dated CSV with comment lines; ids stay text through the schema."""
    return spark.read.schema(schema).option("comment", comment).option("header", header).option("sep", sep).option("enforceSchema", True).csv(path)


def parse_whitespace_table(lines: DataFrame) -> DataFrame:
    """``season year total anomaly`` lines -> month end and values; header lines drop out."""
    f = F.split(F.trim("value"), r"\s+")
    month = lookup(F.get(f, F.lit(0)), SEASON_CENTRE)
    year = F.get(f, F.lit(1)).try_cast("int")
    ok = lines.where(month.isNotNull() & year.isNotNull())
    return ok.select(
        F.last_day(F.make_date(year, month, F.lit(1))).alias("month"), F.get(f, F.lit(2)).try_cast("double").alias("total"), F.get(f, F.lit(3)).try_cast("double").alias("anomaly")
    )


def read_whitespace_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_whitespace_table(spark.read.text(path))


def parse_period_table(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows keyed like ``1960M01`` -> month end; text values become numbers or null."""
    ok = df.where(F.col(key).rlike(r"^\d{4}M\d{2}$"))
    day = F.make_date(F.substring(key, 1, 4).cast("int"), F.substring(key, 6, 2).cast("int"), F.lit(1))
    return ok.select(F.last_day(day).alias("month"), *[F.col(v).try_cast("double").alias(v) for v in values])


def parse_market_file(lines: DataFrame, origin: str | None = None) -> DataFrame:
    """``year;month;day;period;_;price;`` lines -> hourly prices.

    Header and trailer lines do not start with a digit; a day with more than 25 periods is
    quarter-hourly and collapses to hours; a decimal comma is accepted.
    """
    f = F.split(F.trim("value"), ";")
    rows = lines.where(F.trim("value").rlike(r"^\d+;") & (F.size(f) >= 6)).select(
        F.make_date(F.get(f, F.lit(0)).cast("int"), F.get(f, F.lit(1)).cast("int"), F.get(f, F.lit(2)).cast("int")).alias("date"),
        F.get(f, F.lit(3)).cast("int").alias("period"),
        F.regexp_replace(F.get(f, F.lit(5)), ",", ".").try_cast("double").alias("price"),
        *([origin] if origin else []),
    )
    per_day = rows.groupBy("date").agg(F.max("period").alias("_top"))
    per_hour = F.when(F.col("_top") > 25, 4).otherwise(1)
    hour = F.floor((F.col("period") - 1) / per_hour).cast("int")
    return rows.join(per_day, "date").groupBy("date", hour.alias("hour")).agg(F.avg("price").alias("price"))


def read_market_files(spark: SparkSession, path: str) -> DataFrame:
    return parse_market_file(spark.read.text(path))


def explode_parallel_arrays(df: DataFrame, arrays: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``{time: [...], v: [...]}`` records -> one row per position."""
    return df.select(*keep, F.inline(F.arrays_zip(*arrays)))


def read_partitioned_files(spark: SparkSession, path: str, schema: str, pattern: str, name: str = "origin") -> DataFrame:
    """Many CSV files at once; the origin is taken from the file name by a regular expression."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_headerless_gz(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Compressed CSV without a header; names and types come from the schema.

    A gzip file is one task, so large archives should hold many files.
    """
    return spark.read.schema(schema).option("header", False).csv(path)


def with_fallback_tier(
    primary: DataFrame, fallback: DataFrame, entity: str, x: str, min_share: float = 0.8, min_entities: int = 10
) -> DataFrame:
    """The real source when enough entities are well covered, else the next tier; ``tier`` says which.

    The choice is a one-row aggregate joined to both sides, so the plan stays lazy.
    """
    share = primary.groupBy(entity).agg((F.count(x) / F.count(F.lit(1))).alias("_s")).where(F.col("_s") >= min_share)
    choice = share.agg((F.count(F.lit(1)) >= min_entities).alias("_use"))
    both = primary.withColumn("tier", F.lit("primary")).unionByName(fallback.withColumn("tier", F.lit("fallback")))
    return both.crossJoin(F.broadcast(choice)).where(F.col("_use") == (F.col("tier") == "primary")).drop("_use")  # a single row


def new_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch whose keys the target does not hold yet."""
    return batch.join(target.select(*keys), list(keys), "left_anti")


def append_new(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Resumable ingest: append only unseen keys to a stored table and return it."""
    target = spark.read.format(fmt).load(path)
    new_rows(target, batch, keys).write.mode("append").format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def station_inventory(spark: SparkSession, stations: DataFrame, inventory: DataFrame, names: DataFrame, where: str) -> DataFrame:
    """Stations with an element over a span inside a box: three-table SQL.

    ``stations(id, lat, lon)``, ``inventory(id, element, first_year, last_year)``, ``names(id, name)``.
    """
    return spark.sql(
        f"""SELECT s.id, min(n.name) AS name, min(s.lat) AS lat, min(s.lon) AS lon, min(i.first_year) AS first_year, max(i.last_year) AS last_year
        FROM {{stations}} s JOIN {{inventory}} i ON i.id = s.id LEFT JOIN {{names}} n ON n.id = s.id
        WHERE {where} GROUP BY s.id""",
        stations=stations, inventory=inventory, names=names,
    )


def with_forcings(df: DataFrame, ts: str, lat: str, lon: str) -> DataFrame:
    """Sine and cosine of position, day of the year and local time, and the insolation."""
    from strandline.functions.columns import sin_solar_elevation

    two_pi = 6.283185307179586
    year = (F.dayofyear(ts) - 1 + F.hour(ts) / 24.0) / 365.25 * two_pi
    local = (F.hour(ts) / 24.0 + F.col(lon) / 360.0) * two_pi
    named: dict[str, Column] = {
        "latitude": F.radians(lat), "longitude": F.radians(lon), "julian_day": year, "local_time": local,
    }
    for n, angle in named.items():
        df = df.withColumn(f"cos_{n}", F.cos(angle)).withColumn(f"sin_{n}", F.sin(angle))
    return df.withColumn("insolation", F.greatest(F.lit(0.0), sin_solar_elevation(lat, lon, ts)))


def cube_to_rows(df: DataFrame, variables: Sequence[str], cells: str = "cell", stacked: str = "data") -> DataFrame:
    """``data[variable][cell]`` arrays per time step -> one row per step and cell, one column per variable."""
    parts = F.arrays_zip(*[F.get(stacked, F.lit(i)).alias(v) for i, v in enumerate(variables)])
    return df.select(*[c for c in df.columns if c != stacked], F.posexplode(parts).alias(cells, "_v")).select(
        *[c for c in df.columns if c != stacked], cells, *[F.col("_v")[v].alias(v) for v in variables]
    )
