"""Removal of word windows that an earlier document has: super-k-mers in minimiser buckets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import WordHashes, kept_schema, mix, pieces, raw, shingles, tidy, unpacked, with_kept
from strandline.llm.sketch import frequency_levels, slot, slot_bitmap
from strandline.storage import staging_path

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_KEY_SALT = np.uint64(0x5851F42D4C957F2D)


def window_keys(hashes: np.ndarray, levels: np.ndarray, bits: int, window: int, gram: int) -> np.ndarray:
    """Minimiser of each window: its least frequent, then least hashed run of ``gram`` words."""
    span = window - gram + 1
    g = shingles(hashes, gram)
    if len(g) < span:
        return np.empty(0, np.uint64)
    low = (levels[slot(g, bits)].astype(np.uint64) << np.uint64(56)) | (mix(g ^ _KEY_SALT) >> np.uint64(8))
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = span - size
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of equal minimisers."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(keys)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _spread(key: np.ndarray) -> np.ndarray:
    """Keys start with a level; slots need their leading bits mixed."""
    return mix(key)


def _count_windows(window: int, rows_at_once: int = 4000):
    """Task function over rows sorted by key: windows of whole key groups are sorted as rows of word numbers."""

    def settle(packed: list[str], docs: list[int]) -> list[list[dict]]:
        split = [p.split(" ") for p in packed]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int32)
        sizes = np.array([len(x) for x in split])
        windows = sizes - window + 1
        row = np.repeat(np.arange(len(split)), windows)
        start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(np.cumsum(sizes) - sizes, windows)
        view = np.lib.stride_tricks.sliding_window_view(flat, window)[start]
        # equal rows of numbers are equal windows; the sort compares whole rows
        _, group = np.unique(np.ascontiguousarray(view).view([("w", f"V{4 * window}")]).ravel(), return_inverse=True)
        own = np.array(docs, np.int64)[row]
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, own)
        later = least[group] < own
        out: list[list[dict]] = []
        for lo, hi in zip(np.cumsum(windows) - windows, np.cumsum(windows)):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], later[lo:hi].astype(np.int8), [0]])))
            out.append([{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2])])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out(rows):
            found = settle([r[2] for r in rows], [r[3] for r in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array([r[1] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.int64()), pa.array(found, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
                names=["print", "least", "later"],
            )

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", "print", "packed", "least"))):
                if len(rows) >= rows_at_once and r[0] != rows[-1][0]:
                    yield out(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield out(rows)

    return run


def repeated_spans(docs: DataFrame, *, window: int = 50, gram: int = 8, bits: int = 20, bitmap_bits: int = 24) -> DataFrame:
    """``(row, spans)``: per text, the ranges of words covered by windows that a smaller doc_id has too.

    Texts are cut into super-k-mers: runs of windows with one minimiser, as one packed string that goes to the
    minimiser's bucket.  Minimisers that only one document has stay at home (found by an exact count, told
    to the tasks by a bitmap of fixed size whose false positives merely travel).  Equal strings are combined with
    their smallest doc_id on the map side, so copies, however many, arrive as one row; in a bucket, sorting
    the windows finds the smallest doc_id of each.  Minimisers avoid frequent word runs, so a common line doesn't
    gather the windows around it.  ``row`` is a hash of doc_id and text.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"), "text")

    def grams(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        cache = WordHashes()
        for p in pieces(iter([b])):
            for text in raw(p):
                yield shingles(cache.of(text.split()), gram)

    levels = spark.sparkContext.broadcast(frequency_levels(rows.select("text"), grams, bits))  # 2**bits bytes

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in pieces(batches):
            docs, found = b.column("doc_id").to_numpy(), []
            sizes = []
            for text in raw(b):
                k = window_keys(cache.of(text.split()), levels.value, bits, window, gram)
                found.append(np.unique(k[_runs(k)[0]]))
                sizes.append(len(found[-1]))
            yield pa.RecordBatch.from_arrays([_signed(_spread(np.concatenate(found))), pa.array(np.repeat(docs, sizes))], names=["key", "doc_id"])

    # two documents hold a key if the smallest and the largest id differ
    shared = rows.select("doc_id", "text").mapInArrow(tidy(keys), "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    bitmap = spark.sparkContext.broadcast(slot_bitmap(shared, "key", bitmap_bits))  # 2**bitmap_bits bytes

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in pieces(batches, limit=1 << 20):
            cols: list[list] = [[] for _ in range(6)]
            for doc, row, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), raw(b)):
                words = text.split()
                k = window_keys(cache.of(words), levels.value, bits, window, gram)
                starts, sizes = _runs(k)
                if not len(starts):
                    continue
                key = _spread(k[starts])
                hit = bitmap.value[slot(key, bitmap_bits)]
                for s, n, x in zip(starts[hit].tolist(), sizes[hit].tolist(), key[hit].view(np.int64).tolist()):
                    packed = b" ".join(words[s : s + n + window - 1])
                    for c, v in zip(cols, (x, xxhash.xxh3_128_digest(packed), packed, doc, row, s)):
                        c.append(v)
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if k != pa.string() else pa.array(c, pa.binary()).cast(k) for c, k in zip(cols, kinds)], names=["key", "print", "packed", "doc_id", "row", "start"])

    path = staging_path(spark, "superkmers")
    rows.mapInArrow(tidy(cut), "key long, print binary, packed string, doc_id long, row long, start int").write.option("compression", "zstd").parquet(path)
    staged = spark.read.parquet(path)
    distinct = staged.groupBy("key", "print", "packed").agg(F.min("doc_id").alias("least"))
    settled = distinct.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_count_windows(window)), "print binary, least long, later array<struct<lo:int,hi:int>>")
    words = F.size(F.split("packed", " "))
    held = staged.select("print", "doc_id", "row", "start", words.alias("n")).join(settled, "print")
    whole = F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("n")).alias("hi")))
    part = F.transform("later", lambda x: F.struct((F.col("start") + x["lo"]).alias("lo"), (F.col("start") + x["hi"] + (window - 1)).alias("hi")))
    span = F.explode(F.when(F.col("doc_id") > F.col("least"), whole).otherwise(part))
    return held.select("row", span.alias("span")).groupBy("row").agg(F.collect_set("span").alias("spans"))  # no more than the words of one text


def remove_repeats(docs: DataFrame, *, window: int = 50, gram: int = 8, keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """doc_id (or ``kept``, a struct of the columns ``keep``), n_words, n_removed, kept_sha256 and ``text`` without the repeated words.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input.  White space between kept words stays as it is in ``text``; the digest is of the kept words
    joined by one space.  A text without repeats is returned unchanged.

    Null and empty texts have no words; null ids neither remove nor lose words; rows of equal id don't
    count as each other's repeats.  Texts with repeats are joined to their ranges, all others pass without their text.
    """
    spark = docs.sparkSession
    spans = repeated_spans(docs, window=window, gram=gram)
    path = staging_path(spark, "spans")
    spans.write.parquet(path)
    spans = spark.read.parquet(path)
    marks = spark.sparkContext.broadcast(slot_bitmap(spans, "row", 22))  # 2**22 bytes
    schema, names = "n_words long, n_removed long, kept_sha256 string, text string", ["kept", "n_words", "n_removed", "kept_sha256", "text"]

    def digest(words: list[bytes]) -> str:
        return hashlib.sha256(b" ".join(words)).hexdigest()

    def settle(batches: Iterator[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, gone, sha, out = [], [], [], []
            spans = b.column("spans").to_pylist() if final else [None] * b.num_rows
            rows = b.column("row").to_numpy().view(np.uint64)
            wait = np.zeros(b.num_rows, bool) if final else marks.value[slot(rows, 22)]
            done = b.column("kept_sha256").to_pylist() if final else [None] * b.num_rows
            ready = list(zip(b.column("n_words").to_pylist(), b.column("n_removed").to_pylist())) if final else []
            for i, (text, span) in enumerate(zip(raw(b), spans)):
                if wait[i]:
                    values = (None, None, None, text)
                elif done[i] is not None:
                    values = (*ready[i], done[i], text)
                else:
                    words = text.split()
                    covered = np.zeros(len(words) + 1, np.int64)
                    for s in span or ():
                        covered[s["lo"]] += 1
                        covered[s["hi"]] -= 1
                    stays = np.cumsum(covered[:-1]) == 0
                    kept = [w for w, k in zip(words, stays) if k]
                    if len(kept) < len(words) and with_text:
                        at = [m.span() for m in _WORD.finditer(text)]
                        ends = [*(a for a, _ in at[1:]), len(text)]
                        text = b"".join(text[a:e] for (a, _), e, k in zip(at, ends, stays) if k)
                    values = (len(words), len(words) - len(kept), digest(kept), text)
                for c, v in zip((n, gone, sha, out), values):
                    c.append(v)
            empty = b.column("text").is_null().to_pylist()
            text = [None if e or not (with_text or w) else t for t, e, w in zip(out, empty, wait)]
            arrays = [b.column("kept"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays if final else [*arrays, b.column("row")], names=names if final else [*names, "row"])

    rows = with_kept(docs, keep, text=F.col("text"), row=F.xxhash64("doc_id", "text"))
    first = rows.mapInArrow(tidy(lambda x: settle(x, False)), kept_schema(rows, schema + ", row long"))
    done = first.join(spans, "row", "left").mapInArrow(tidy(lambda x: settle(x, True)), kept_schema(rows, schema))
    return unpacked(done if with_text else done.drop("text"), keep)
