"""Arrow batches of texts inside tasks: pieces of bounded size, and words as hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def fold(column: str, modulus: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def with_kept(docs: DataFrame, keep: list[str] | None, **columns: Column) -> DataFrame:
    """``columns`` beside ``kept``, a struct of the columns to carry along (doc_id if None), whose names can't clash with them."""
    held = F.struct(*(F.col(f"`{c}`") for c in (keep or ["doc_id"])))
    return docs.select(held.alias("kept"), *(c.alias(n) for n, c in columns.items()))


def kept_schema(rows: DataFrame, added: str) -> StructType:
    """The type of ``kept`` and the fields of a DDL string."""
    return StructType([StructField("kept", rows.schema["kept"].dataType), *_parse_datatype_string(added).fields])


def unpacked(out: DataFrame, keep: list[str] | None) -> DataFrame:
    """doc_id and the results if nothing was asked for; else ``kept`` and the results."""
    return out if keep else out.select("kept.doc_id", *(c for c in out.columns if c != "kept"))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of ``column``; a longer text is a slice of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield b.slice(lo, hi - lo)


def give_back() -> None:
    """Hand freed memory back to the machine at the end of a task, since its worker waits for other stages' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The task function; what it freed goes back to the machine when it has given its last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def raw(b: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [x or b"" for x in b.column(column).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word seen, kept for the next time (up to ``most`` words)."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit word over all of them."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes; none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h + words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
    return mix(h)
