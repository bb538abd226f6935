"""Fixed-size tables over hashed slots, built by tasks and added up by blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import tidy

_BLOCK = 1 << 16


def slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to one row per block: only one block is held at a time."""
    now, total = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

    for b in batches:
        for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
            if block != now:
                if now is not None:
                    yield row()
                now, total = block, np.zeros(_BLOCK, np.uint32)
            total += np.frombuffer(counts, np.uint8)
    if now is not None:
        yield row()


def frequency_levels(docs: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, above: float = 4.0, steps: int = 0) -> np.ndarray:
    """For each of ``2**bits`` slots, how far its count over the whole corpus stands above the mean slot, in powers of two.

    0 up to ``above`` times the mean; with ``steps``, so many levels for each doubling of the count itself.  Each task counts its rows in one byte per slot (up to 255), and
    blocks of slots are added up as they stream by.  The levels only order things, the same for every reader,
    so collisions cost speed and never a result.  The table has a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for b in batches:
            if b.num_rows:
                for h in hashes_of(b):
                    np.add.at(table, slot(h, bits), 1)
        table = np.minimum(table, 255).astype(np.uint8).reshape(-1, _BLOCK)
        for block, row in enumerate(table):
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([row.tobytes()], pa.binary())], names=["block", "counts"])

    rows = docs.mapInArrow(tidy(count), "block int, counts binary").repartition("block").sortWithinPartitions("block").mapInArrow(tidy(_sum_blocks), "block int, counts binary")
    total = np.zeros((1 << bits) // _BLOCK * _BLOCK, np.uint32).reshape(-1, _BLOCK)
    for r in rows.toLocalIterator():
        total[r["block"]] = np.frombuffer(r["counts"], np.uint32)
    flat = total.ravel()
    if steps:
        return np.minimum(np.floor(steps * np.log2(np.maximum(flat, 1))), 63).astype(np.uint8)
    limit = max(float(flat.mean()) * above, 16.0)
    with np.errstate(divide="ignore"):
        return np.where(flat <= limit, 0, np.ceil(np.log2(np.maximum(flat, 1) / limit))).astype(np.uint8)


def slot_bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Boolean table of the slots that a long column's values fall in; at most ``2**bits`` entries whatever the input.

    A filter with false positives: rows that pass must be settled by an exact join.
    """
    cell = F.shiftrightunsigned(F.col(column), 64 - bits)
    shape = _BLOCK.bit_length() - 1

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, None
        for b in batches:
            cells = b.column("cell").to_numpy()
            for block in np.unique(cells >> shape):
                if block != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["block", "bits"])
                    now, table = int(block), np.zeros(_BLOCK, bool)
                table[cells[(cells >> shape) == block] & (_BLOCK - 1)] = True
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["block", "bits"])

    cells = hashes.select(cell.alias("cell")).distinct().withColumn("block", F.shiftright("cell", shape))
    rows = cells.repartition("block").sortWithinPartitions("block").select("cell").mapInArrow(tidy(mark), "block int, bits binary")
    out = np.zeros(((1 << bits) // _BLOCK, _BLOCK), bool)
    for r in rows.toLocalIterator():
        out[r["block"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return out.ravel()
