"""Benchmark passages in documents: q-gram counts in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import kept_schema, pieces, tidy, unpacked, with_kept

_KEEP = np.array([chr(c).isalnum() for c in range(0x110000)], dtype=bool)


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of a text in lower case, as code points, and the place of each in the text."""
    lower = text.lower()
    if len(lower) != len(text):  # a few capitals become two characters; keep the places right
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(_KEEP[codes])
    return codes[at], at


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` code points, put together from runs of 1, 2, 4, ... of them."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    base, size, part = 0x100000001B3, 1, codes.astype(np.uint64)
    out, have = None, 0
    while True:
        if q & size:
            step = np.uint64(pow(base, size, 1 << 64))
            out = part if out is None else out[: len(codes) - have - size + 1] * step + part[have : len(codes) - size + 1]
            have += size
        if have == q:
            return out * np.uint64(0x9E3779B97F4A7C15)
        part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2


@dataclass
class Index:
    """Sorted q-grams of a block of items with their places, and a bitmap that most other q-grams miss."""

    ids: list
    codes: list[np.ndarray]
    budgets: np.ndarray
    needs: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    q: int

    def hit(self, grams: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.bitmap[(grams >> np.uint64(64 - 22)).astype(np.int64)])


def _gram_size(length: int, budget: int, q: int) -> bool:
    """Whether an item's q-gram bound says anything: more q-grams than its budget can destroy."""
    return length - q + 1 - q * budget > 0


def build(items: list[tuple], q: int, rate: float) -> Index:
    """Budget: ``rate`` edits a character, but no more than leave one q-gram in two beyond the bound's reach."""
    ids, codes, budgets, needs, grams, item, place = [], [], [], [], [], [], []
    for item_id, text in items:
        c, _ = normal(text)
        if len(c) < q:
            continue
        k = min(int(len(c) * rate), (len(c) - q) // q)
        while k and not _gram_size(len(c), k, q):
            k -= 1
        g = qgrams(c, q)
        grams.append(g), item.append(np.full(len(g), len(ids))), place.append(np.arange(len(g)))
        ids.append(item_id), codes.append(c), budgets.append(k), needs.append(len(c) - q + 1 - q * k)
    g = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    order = np.argsort(g, kind="stable")
    bitmap = np.zeros(1 << 22, bool)
    bitmap[(g >> np.uint64(64 - 22)).astype(np.int64)] = True
    flat = lambda x: (np.concatenate(x) if x else np.empty(0, np.int64))[order]
    return Index(ids, codes, np.array(budgets, np.int64), np.array(needs, np.int64), g[order], flat(item), flat(place), bitmap, q)


def regions(index: Index, codes: np.ndarray) -> list[tuple[int, int]]:
    """(item, first diagonal of a band) wherever a band shares enough q-grams with an item.

    A band holds twice as many diagonals as the item's budget plus one and starts at every multiple of that number,
    so the diagonals of any match within the budget lie in one band.  Equal q-grams of an item on one
    diagonal are different places, so counts reach the bound of the lemma.
    """
    if not len(index.needs):
        return []
    g = qgrams(codes, index.q)
    at = index.hit(g)
    if len(at) < index.needs.min():
        return []
    lo, hi = np.searchsorted(index.grams, g[at], "left"), np.searchsorted(index.grams, g[at], "right")
    n = hi - lo
    if n.sum() < index.needs.min():
        return []
    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, at = index.item[rows], np.repeat(at, n)
    enough = (np.bincount(item, minlength=len(index.needs)) >= index.needs)[item]  # on all diagonals together
    if not enough.any():
        return []
    item, at, rows = item[enough], at[enough], rows[enough]
    place = index.place[rows]
    width = index.budgets[item] + 1
    band = (at - place) // width
    # each q-gram of the item counts once in a band: a place met on several diagonals isn't several shared q-grams
    longest, lowest = int(place.max()) + 1, int(band.min()) - 1
    bands = int(band.max()) - lowest + 1
    pair = np.concatenate([item * bands + band - lowest, item * bands + band - 1 - lowest])
    pair = np.unique(pair * longest + np.tile(place, 2)) // longest
    pair, counts = np.unique(pair, return_counts=True)
    found = pair[counts >= index.needs[pair // bands]]
    return [(int(i), int(b) * int(index.budgets[i] + 1)) for i, b in zip(found // bands, found % bands + lowest)]


def align(item: np.ndarray, text: np.ndarray, first: int, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn ``item`` into a stretch of ``text``, on diagonals within the band; None beyond the budget.

    Cell (i, d) holds the edits of the first i characters against a stretch ending before place i + first + d.
    Returns (edits, start, end) with the first best end.
    """
    for lo in range(max(first, 0), min(first + 2 * (budget + 1), len(text) - len(item) + 1)):
        if text[lo] == item[0] and np.array_equal(text[lo : lo + len(item)], item):
            return 0, lo, lo + len(item)  # what the table below would end with
    width = 2 * (budget + 1) + 2 * budget  # the band and the edits around it
    low = first - budget
    big = budget + 1
    d = np.arange(width + 1)
    j = low + d
    cost = np.where((j >= 0) & (j <= len(text)), 0, big)
    start = j.copy()
    for i, c in enumerate(item):
        at = i + low + d  # text place met on the diagonal
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width + 1, bool)
        same[inside] = text[at[inside]] == c
        diagonal = np.where(inside, cost + ~same, big)
        up = np.append(cost[1:], big) + 1  # the item's character has no partner
        new, begin = diagonal, start
        better = up < new
        new, begin = np.where(better, up, new), np.where(better, np.append(start[1:], 0), begin)
        valid = (i + 1 + low + d >= 0) & (i + 1 + low + d <= len(text))
        new = np.where(valid, np.minimum(new, big), big)
        # text characters without partner: a running minimum along the row
        run = np.minimum.accumulate(new - d)
        source = np.maximum.accumulate(np.where(new - d == run, d, 0))
        better = run + d < new
        new, begin = np.where(better, run + d, new), np.where(better, begin[source], begin)
        cost, start = np.minimum(new, big), begin
        if cost.min() > budget:
            return None
    best = int(np.argmin(cost))
    if cost[best] > budget:
        return None
    return int(cost[best]), int(start[best]), int(len(item) + low + best)


def matches(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of each passage in ``text``; of overlapping finds of an item the closest, then the first."""
    codes, places = normal(text)
    if len(codes) < index.q:
        return []
    best = []
    for i, first in regions(index, codes):
        got = align(index.codes[i], codes, first, int(index.budgets[i]))
        if got and got[2] > got[1]:
            best.append((i, got[0], got[1], got[2]))
    out: list[tuple[int, int, int, int]] = []
    for i, edits, lo, hi in sorted(set(best)):
        if all(o[0] != i or hi <= o[1] or o[2] <= lo for o in out):
            out.append((i, lo, hi, edits))
    return sorted((i, int(places[lo]), int(places[hi - 1]) + 1, e) for i, lo, hi, e in out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = 8, rate: float = 0.05, block_chars: int = 4_000_000, keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or ``kept``, a struct of the columns ``keep``) with ``leaks``: (item_id, start, end, edits) for every benchmark passage found.

    Texts are compared by their letters and digits in lower case.  An item of m characters is found
    wherever a stretch of a text is within ``rate`` * m edits of it (and within the largest number for which
    the q-gram bound m - q + 1 - q * k stays positive).  Places count characters of the text as it is.

    The benchmark is the stated query set: it is read in blocks of at most ``block_chars`` characters, each a
    broadcast index of a bounded size, and documents are scanned once per block; nothing is shuffled.
    An item longer than that is a block of its own.
    Items with fewer than ``q`` letters and digits (null and empty ones too) are never found.  A null or
    empty text has no leaks.  Other columns of both tables are not looked at.
    """
    spark = docs.sparkSession
    id_kind = benchmark.schema["item_id"].dataType.simpleString()
    leak = f"array<struct<item_id:{id_kind},start:int,end:int,edits:int>>"

    def scan(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in pieces(batches):
                leaks = []
                for text, before in zip(b.column("text").to_pylist(), b.column("leaks").to_pylist()):
                    found = matches(index, text) if text else []
                    leaks.append((before or []) + [{"item_id": index.ids[i], "start": lo, "end": hi, "edits": e} for i, lo, hi, e in found])
                yield pa.RecordBatch.from_arrays([b.column("kept"), b.column("text"), pa.array(leaks, b.schema.field("leaks").type)], names=["kept", "text", "leaks"])

        return rows.mapInArrow(tidy(run), kept_schema(rows, f"text string, leaks {leak}"))

    out = with_kept(docs, keep, text=F.col("text"), leaks=F.array().cast(leak))
    block, size = [], 0
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator()
    for r in rows:  # one partition of the benchmark at a time
        if block and size + len(r["text"]) > block_chars:
            out, block, size = scan(out, spark.sparkContext.broadcast(build(block, q, rate))), [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        out = scan(out, spark.sparkContext.broadcast(build(block, q, rate)))
    return unpacked(out.drop("text"), keep)
