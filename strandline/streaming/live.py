"""Streaming forms of three bounded operators.

Each takes a streaming or a bounded DataFrame with an event-time column.  Rows later than
the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def quiet_gap_events(df: DataFrame, keys: Sequence[str], ts: str, x: str, threshold: float, quiet: str, late: str) -> DataFrame:
    """Runs of high rows separated by a quiet gap: one session each, named by its first time.

    A session ends when no high row arrives for ``quiet``; state is one open session per key.
    """
    # quiet rows must move the clock too: a filter that reads the time stays above the watermark
    high_at = F.when(F.col(x) >= threshold, F.col(ts))
    high = df.withWatermark(ts, late).where(high_at.isNotNull())
    return high.groupBy(*keys, F.session_window(ts, quiet).alias("_w")).agg(F.min(ts).alias("event"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).select(*keys, "event", "last", "n")


def windowed_totals(df: DataFrame, keys: Sequence[str], ts: str, aggs: dict[str, Column], size: str, slide: str | None, late: str) -> DataFrame:
    """Tumbling or sliding aggregates, final when the watermark passes the window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.withWatermark(ts, late).groupBy(*keys, w.alias("_w")).agg(*[a.alias(n) for n, a in aggs.items()]).select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *aggs)


def deduplicated(df: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark: state is bounded by the lateness allowed."""
    marked = df.withWatermark(ts, late)
    return marked.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else marked.dropDuplicates(list(keys))


def ingest(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append everything available to a table and stop; a second run starts where this ended."""
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
