"""Sinks: tables in a few formats with fixed decimals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", decimals: int | None = None, partition_by: Sequence[str] = (), mode: str = "overwrite", sort_by: Sequence[str] = ()) -> None:
    """Write CSV, JSON or parquet; doubles rounded, rows sorted inside each file."""
    if decimals is not None:
        rounded = {f.name: F.round(f.name, decimals) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
        df = df.withColumns(rounded) if rounded else df
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    out = df.write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if fmt == "csv":
        out = out.option("header", True)
    out.format(fmt).save(path)
