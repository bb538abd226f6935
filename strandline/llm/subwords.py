"""SentencePiece pieces: lossless encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import give_back, kept_schema, mix, pieces, unpacked, with_kept

MODEL = os.path.join("/opt/tokenizers", "piece_bpe_32k.model")
#: Units that no piece reaches over: a line end, or spaces and what follows them.
_UNIT = re.compile(r"\n| *[^ \n]+| +")
_MASK = (1 << 64) - 1
_NONE = 1 << 40


def unit_keys(units: list[str], key: int) -> np.ndarray:
    """The key of each unit: ``key`` mixed with a hash of its characters."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = mix((codes << np.uint64(32)) + place.astype(np.uint64))
    return mix(np.add.reduceat(terms, np.cumsum(sizes) - sizes) ^ np.uint64(key)) if len(units) else np.empty(0, np.uint64)


def pair_code(i: int, left: int, right: int) -> int:
    """What the key of a skip is mixed with for this pair at this place."""
    return (i * 0x9E3779B97F4A7C15 + left * 0xC2B2AE3D27D4EB4F + right * 0x165667B19E3779F9) & _MASK


class Vocabulary:
    """Pieces of a merge-type model with byte fallback, as plain lists that can be sent to tasks."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [names[i].replace("▁", " ").encode() if plain[i] else b"" for i in range(n)]
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        self.place = {names[i]: i for i in range(n) if plain[i]}
        order = sorted((i for i in range(n) if plain[i]), key=lambda i: (-sp.get_score(i), i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.merge: dict[int, int] = {}
        for name, i in self.place.items():
            for cut in range(1, len(name)):
                left, right = self.place.get(name[:cut]), self.place.get(name[cut:])
                if left is not None and right is not None:
                    self.merge[left << 32 | right] = i
        self.pairs = np.array(sorted(self.merge), np.int64)
        self.made = np.array([self.merge[p] for p in self.pairs.tolist()], np.int64)
        self.made_rank = np.array([self.rank[m] for m in self.made.tolist()], np.int64)
        self.single = np.full(0x110000, -1, np.int32)
        for name, i in self.place.items():
            if len(name) == 1:
                self.single[ord(" " if name == "▁" else name)] = i

    def symbols(self, unit: str) -> list[int]:
        """One id per character; the bytes of those without a piece, and of the space mark itself, negated less one."""
        out = []
        for c in unit:
            i = None if c == "▁" else self.place.get("▁" if c == " " else c)
            if i is None:
                out.extend(-1 - self.byte[b] for b in c.encode("utf-8", "surrogatepass"))
            else:
                out.append(i)
        return out

    def segment(self, unit: str, key: int, skip: int) -> tuple[int, ...]:
        """Merge the best-ranked neighbours first, except those the keyed hash skips (``skip`` of 2**24).  ``key`` is the unit's own."""

        def skipped(i: int, left: int, right: int) -> bool:
            h = ((key ^ pair_code(i, left, right)) * 0xD6E8FEB86659FD93) & _MASK
            return ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & _MASK) >> 40 < skip

        return self.merged(unit, skipped if skip else None)

    def merged(self, unit: str, skipped: Callable[[int, int, int], bool] | None) -> tuple[int, ...]:
        """The agenda of merges; ``skipped`` is asked about each candidate (place, left, right) when its turn comes.

        A skipped candidate leaves the agenda; it may return only as part of a new pair.
        """
        ids = self.symbols(unit)
        n = len(ids)
        if n == 1:
            return (ids[0] if ids[0] >= 0 else -1 - ids[0],)
        merge, rank = self.merge, self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if ids[i] >= 0 and ids[i + 1] >= 0:
                m = merge.get(ids[i] << 32 | ids[i + 1])
                if m is not None:
                    agenda.append((rank[m], i, ids[i], ids[i + 1], m))
        heapq.heapify(agenda)
        dead = None
        while agenda:
            _, i, left, right, m = heapq.heappop(agenda)
            if ids[i] != left:
                continue
            j = after[i]
            if j >= n or ids[j] != right:
                continue
            if skipped and skipped(i, left, right):
                continue
            ids[i], ids[j] = m, dead
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if ids[k] >= 0:
                    new = merge.get(m << 32 | ids[k])
                    if new is not None:
                        heapq.heappush(agenda, (rank[new], i, m, ids[k], new))
            h = before[i]
            if h >= 0 and ids[h] >= 0:
                new = merge.get(ids[h] << 32 | m)
                if new is not None:
                    heapq.heappush(agenda, (rank[new], h, ids[h], m, new))
        return tuple([x if x >= 0 else -1 - x for x in ids if x is not None])

    def _candidates(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, key: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and result of each pair at place ``at`` that exists and isn't skipped."""
        pair = left << 32 | right
        row = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        ok = (self.pairs[row] == pair) & (right >= 0)
        if skip:
            u = lambda x: x.astype(np.uint64)
            h = (key ^ (u(at) * np.uint64(0x9E3779B97F4A7C15) + u(left) * np.uint64(0xC2B2AE3D27D4EB4F) + u(right) * np.uint64(0x165667B19E3779F9))) * np.uint64(0xD6E8FEB86659FD93)
            ok &= ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40) >= skip
        return np.where(ok, self.made_rank[row], _NONE), self.made[row]

    def segment_many(self, units: list[str], key: int | np.ndarray, skip: int) -> list[tuple[int, ...]]:
        """As ``segment`` for each unit; the agendas of short units are worked off side by side.

        ``key`` is an array of the units' own keys, or one that is mixed with each unit's characters.
        """
        out: list = [None] * len(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        symbols = self.single[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        plain = np.minimum.reduceat(symbols, starts) >= 0 if len(units) else np.zeros(0, bool)
        keys = key if isinstance(key, np.ndarray) else unit_keys(units, key)
        for i in np.flatnonzero(~plain | (sizes > 32)):
            out[i] = self.segment(units[i], int(keys[i]), skip)
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 18), (18, 32)):
            rows = np.flatnonzero(plain & (sizes > low) & (sizes <= high))
            if not len(rows):
                continue
            column = np.arange(high)
            inside = column < sizes[rows, None]
            ids = np.where(inside, symbols[np.minimum(starts[rows, None] + column, len(symbols) - 1)], -1)
            place = np.tile(column, (len(rows), 1))
            left, own = sizes[rows].copy(), keys[rows]
            rank, made = self._candidates(ids[:, :-1], ids[:, 1:], place[:, :-1], own[:, None], skip)
            while len(rows):
                best = rank.argmin(1)
                every = np.arange(len(rows))
                live = rank[every, best] < _NONE
                for r, n, x in zip(rows[~live].tolist(), left[~live].tolist(), ids[~live].tolist()):
                    out[r] = tuple(x[:n])
                rows, ids, place, rank, made, left, best, own = (x[live] for x in (rows, ids, place, rank, made, left, best, own))
                if not len(rows):
                    break
                every, left = np.arange(len(rows)), left - 1
                ids[every, best] = made[every, best]
                pairs = np.minimum(column[:-1] + (column[:-1] >= best[:, None]), high - 2)
                rank, made = np.take_along_axis(rank, pairs, 1), np.take_along_axis(made, pairs, 1)
                rank[:, -1] = np.where(best < high - 1, _NONE, rank[:, -1])
                move = np.minimum(column + (column > best[:, None]), high - 1)
                ids, place = np.take_along_axis(ids, move, 1), np.take_along_axis(place, move, 1)
                ids[:, -1] = -1
                for ok, at in ((best > 0, best - 1), (best + 1 < left, best)):
                    e, c = every[ok], at[ok]
                    rank[e, c], made[e, c] = self._candidates(ids[e, c], ids[e, c + 1], place[e, c], own[e], skip)
                e = every[best + 1 >= left]
                rank[e, np.minimum(best[e], high - 2)] = _NONE
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "surrogatepass")


class Encoder:
    """Segments every occurrence of a unit under a key of its own, and keeps the steps of frequent units.

    What is kept doesn't depend on keys: a node is a candidate merge whose turn has come, with a branch for merging and one for
    skipping it; a path ends in the ids.  Each occurrence asks its own key at every node.  Units, and branches after a skip, with
    fewer than ``least`` occurrences in a call are segmented without nodes; the result is the same.
    """

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int, least: int = 6, most: int = 300_000):
        self.v, self.skip, self.seed, self.least, self.most = vocabulary, int(dropout * (1 << 24)), seed, least, most
        self._clear()

    def _clear(self) -> None:
        self.roots: dict[str, int] = {}
        self.nodes = 0
        self.code, self.branch = np.zeros(1 << 14, np.uint64), np.zeros((1 << 14, 2), np.int64)
        # of each node: its unit, the skips on the way as bits, their number
        self.unit: list[str] = []
        self.bits: list[int] = []
        self.depth = array("i")
        self.ends, self.flat = array("q", [0]), array("i")

    def _grow(self, unit: str, bits: int, depth: int) -> int:
        """Nodes of ``unit`` after ``depth`` answers, ``bits``, if nothing is skipped from there on: the first one, or -2 - the place of the ids."""
        codes: list[int] = []

        def skipped(i: int, left: int, right: int) -> bool:
            codes.append(pair_code(i, left, right))
            return len(codes) <= depth and bool(bits >> (len(codes) - 1) & 1)

        self.flat.extend(self.v.merged(unit, skipped))
        to = -1 - len(self.ends)
        self.ends.append(len(self.flat))
        first = self.nodes
        self.nodes += max(len(codes) - depth, 0)
        while self.nodes > len(self.code):
            self.code, self.branch = np.concatenate([self.code, np.zeros_like(self.code)]), np.concatenate([self.branch, np.zeros_like(self.branch)])
        for node in range(first, self.nodes):
            self.code[node], self.branch[node] = codes[depth + node - first], (node + 1 if node + 1 < self.nodes else to, -1)
            self.unit.append(unit), self.bits.append(bits), self.depth.append(depth + node - first)
        return first if first < self.nodes else to

    def _skipped(self, slots: np.ndarray) -> np.ndarray:
        """Where the branches 2 * node + 1 lead; those asked for often enough are grown first."""
        found, counts = np.unique(slots, return_counts=True)
        for slot in found[counts >= self.least].tolist():
            if self.nodes < self.most:
                unit, bits, depth = self.unit[slot >> 1], self.bits[slot >> 1], self.depth[slot >> 1]
                to = self._grow(unit, bits | 1 << depth, depth + 1)
                self.branch[slot >> 1, 1] = to
        return self.branch[slots >> 1, 1]

    def arrays(self, texts: list[str], docs: list) -> list[np.ndarray]:
        """Ids of each text; the key of a unit is made of the seed, its document and its position there (a null document: its text)."""
        if self.nodes >= self.most or len(self.flat) >= 4 * self.most:
            self._clear()
        split = [_UNIT.findall(t) for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        units = list(chain.from_iterable(split))
        seeds = [xxhash.xxh3_64_intdigest(f"{self.seed}/{d}" if d is not None else f"{self.seed}//{xxhash.xxh3_128_hexdigest(t.encode('utf-8', 'surrogatepass'))}") for d, t in zip(docs, texts)]
        position = np.arange(len(units)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = mix(np.repeat(np.array(seeds, np.uint64), sizes) + (position.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        place: dict[str, int] = {}
        index = np.fromiter((place.setdefault(u, len(place)) for u in units), np.int64, len(units))
        counts = np.bincount(index, minlength=len(place)).tolist()
        for u, n in zip(place, counts):
            if n >= self.least and u not in self.roots and self.nodes < self.most:
                self.roots[u] = self._grow(u, 0, 0)
        at = np.fromiter((self.roots.get(u, -1) for u in place), np.int64, len(place))[index]
        active = np.flatnonzero(at >= 0)
        while len(active):
            node = at[active]
            h = (key[active] ^ self.code[node]) * np.uint64(0xD6E8FEB86659FD93)
            out = (((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40) < self.skip).astype(np.int64)
            to = self.branch[node, out]
            lost = np.flatnonzero(to == -1)
            if len(lost):
                to[lost] = self._skipped(2 * node[lost] + 1)
            at[active] = to
            active = active[to >= 0]
        alone = np.flatnonzero(at == -1)
        direct = self.v.segment_many([units[i] for i in alone.tolist()], key[alone], self.skip) if len(alone) else []
        many = np.fromiter(map(len, direct), np.int64, len(direct))
        ends = np.frombuffer(self.ends, np.int64).copy()
        source = np.concatenate([np.frombuffer(self.flat, np.int32), np.fromiter(chain.from_iterable(direct), np.int32, int(many.sum()))])
        del direct
        kept = np.where(at < -1, -2 - at, 0)
        start, length = ends[kept], ends[np.minimum(kept + 1, len(ends) - 1)] - ends[kept]
        start[alone], length[alone] = len(self.flat) + np.cumsum(many) - many, many
        total = np.concatenate([[0], np.cumsum(length)])
        ids = source[np.repeat(start - total[:-1], length) + np.arange(total[-1])]
        cuts = total[np.concatenate([[0], np.cumsum(sizes)])]
        return [ids[lo:hi] for lo, hi in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str], docs: list) -> list[list[int]]:
        """As ``arrays``, in lists."""
        return [x.tolist() for x in self.arrays(texts, docs)]


def load(path: str = MODEL) -> Vocabulary:
    """Read on the driver; tasks get the lists by broadcast."""
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def encode(docs: DataFrame, *, model: str = MODEL, dropout: float = 0.1, seed: int = 1, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id (or ``kept``, a struct of the columns ``keep``), ids, n_chars, n_tokens, ids_crc32 and lossless for each text.

    Each candidate merge of a unit is skipped with probability ``dropout``, by a hash of ``seed``, the document's id (its text if that is
    null), the unit's position there, and the pair's place and both pieces.  So a run repeats exactly, and each occurrence of a word is cut
    on its own, in the same document, in other documents and under other seeds.  Dropout 0 gives the model's own segmentation.

    Spaces stay spaces (no prefix, no collapsing, no normalisation), and characters without a piece become
    bytes, so decoding gives back the text, which ``lossless`` tells of every row.  A null text has null ids and counts
    (lossless is null); an empty one has no tokens, and an empty table gives no rows.  Rows are independent; texts of any length are encoded whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model))  # the size of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value, dropout, seed)
        for b in pieces(batches, limit=1 << 20):
            docs, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            coded = enc.arrays([t or "" for t in texts], docs)
            ids, sizes, chars, crc, same = [], [], [], [], []
            for text, got in zip(texts, coded):
                if text is None:
                    for c in (ids, sizes, chars, crc, same):
                        c.append(None)
                    continue
                ids.append(got if with_ids else got[:0]), sizes.append(len(got)), chars.append(len(text))
                crc.append(zlib.crc32(got.astype("<i4").tobytes())), same.append(enc.v.decode(got.tolist()) == text)
            yield pa.RecordBatch.from_arrays(
                [b.column("kept"), pa.array(ids, pa.list_(pa.int32())), pa.array(chars, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
                names=["kept", "ids", "n_chars", "n_tokens", "ids_crc32", "lossless"],
            )
        del enc
        give_back()

    rows = with_kept(docs, keep, doc_id=F.col("doc_id"), text=F.col("text"))
    out = rows.mapInArrow(run, kept_schema(rows, "ids array<int>, n_chars long, n_tokens long, ids_crc32 long, lossless boolean"))
    return unpacked(out if with_ids else out.drop("ids"), keep)


def decode(tokens: DataFrame, *, model: str = MODEL) -> DataFrame:
    """``tokens`` with ``text`` in place of ``ids``; null ids give a null text.  Bytes that aren't UTF-8 are replaced."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(model))
    keep = [c for c in tokens.columns if c not in ("ids", "text")]
    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = shared.value.text
        for b in batches:
            out = [None if x is None else b"".join(map(text.__getitem__, x)).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, pa.string())], names=[*keep, "text"])

    return tokens.select(*keep, "ids").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ("," if keep else "") + " text string")
