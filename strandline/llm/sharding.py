"""Contiguous shards of nearly equal byte size from a global prefix sum."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.storage import cut_lineage


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Position and bytes before each row, counted inside this partition in its order."""
    part, rows, size = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sums = pc.cumulative_sum(b.column("size"), start=size)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), b.column("size"), b.column("text_crc32"),
                pa.array([part] * n, pa.int32()), pa.array(range(rows, rows + n), pa.int64()), pc.subtract(sums, b.column("size")),
            ],
            names=["doc_id", "size", "text_crc32", "part", "pos", "before"],
        )
        rows, size = rows + n, sums[-1].as_py()


def shard_by_bytes(docs: DataFrame, shards: int, *, overhead: int = 8) -> DataFrame:
    """Put each row in one of ``shards`` contiguous runs of the order by ``doc_id``.

    A row weighs its text's UTF-8 bytes (null: none) plus ``overhead``.  Rows are reduced to
    (id, size, checksum) and range-partitioned by id; every partition counts its own rows and bytes, the totals
    (one row per partition) are added up, and a row goes to the shard whose equal share of all
    bytes holds its middle.  So each cut lies within half a row of its target.

    Rows with equal ids (null first) keep the order of the scan, so one id with any number of
    rows is spread over partitions and shards.  An empty table gives no rows; a null text has
    a null checksum; other columns are not looked at.  Returns doc_id, size, text_crc32, shard and
    slot (from 0 without gaps in each shard).
    """
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(overhead)
    slim = docs.select("doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("seen"))
    # The written table fixes ``seen``, and sampling the ranges doesn't read the texts again.
    slim = cut_lineage(slim)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("seen").asc()]
    kind = slim.schema["doc_id"].dataType.simpleString()
    placed = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("seen")
    placed = cut_lineage(placed.mapInArrow(_running, f"doc_id {kind}, size long, text_crc32 long, part int, pos long, before long"))

    totals = placed.groupBy("part").agg(F.count("size").alias("rows"), F.sum("size").alias("bytes")).orderBy("part").collect()  # a row per partition
    offsets, rows, total = [], 0, 0
    for t in totals:
        offsets.append((t["part"], rows, total))
        rows, total = rows + t["rows"], total + t["bytes"]
    offset = spark.createDataFrame(offsets, "part int, rows_before long, bytes_before long")
    at = F.col("bytes_before") + F.col("before")
    placed = placed.join(F.broadcast(offset), "part").select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("pos")).alias("pos"),
        # the row's middle as a share of all bytes; decimals, as shards times bytes may pass a long
        F.floor((at * 2 + F.col("size")).cast("decimal(22,0)") * F.lit(shards) / F.lit(2 * max(total, 1)).cast("decimal(20,0)")).cast("int").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("pos").alias("first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("first")).alias("slot"))
