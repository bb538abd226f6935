"""Text scores from a hierarchical Pitman-Yor word model, its seating sampled by Gibbs over Spark buckets."""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from strandline.llm.batches import fold, mix, pieces, raw
from strandline.storage import staging_path

_START, _END = (xxhash.xxh3_64_intdigest(x) >> 16 for x in (b" ", b""))  # no word is blank or empty
_ROW = "kind string, to_bucket int, source string, payload binary"
_SCHEMA = pa.schema([("kind", pa.string()), ("to_bucket", pa.int32()), ("source", pa.string()), ("payload", pa.binary())])
SMALL = 64  # dishes of up to so many customers are seated from tabled Stirling numbers


# --- what travels between tasks -------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; whole numbers take as few bytes as their range needs, bytes of one place together."""
    out = []
    for a in arrays:
        a = np.asarray(a)
        if a.dtype.kind in "iu" and a.size:
            low, high = int(a.min()), int(a.max())
            kind = next(k for k in ("u1", "u2", "u4", "u8") if high < 1 << (8 * int(k[1]))) if low >= 0 else next(k for k in ("i1", "i2", "i4", "i8") if max(high, -low) < 1 << (8 * int(k[1]) - 1))
            a = a.astype(kind)
        out.append((a.dtype.str, a.shape, np.ascontiguousarray(a.reshape(-1)).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()))
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(out))


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, shape, values in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        size = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(values, np.uint8).reshape(size, -1).T).view(kind).reshape(shape)
        out.append(a.astype(np.int64) if a.dtype.kind in "iu" else a)
    return out


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=0)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], [], []), _SCHEMA)], schema=_SCHEMA)


def _groups(table: pa.Table) -> dict[str, list[tuple[str, bytes]]]:
    """(source, payload) pairs of one bucket by kind, in an order that doesn't depend on the shuffle."""
    out = defaultdict(list)
    for kind, source, payload in sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "source", "payload")))):
        out[kind].append((source, payload))
    return out


def _ranges(sizes) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes)
    return list(zip((ends - sizes).tolist(), ends.tolist()))


# --- seating --------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def _stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers: ways to seat n customers at t tables, sizes summed out."""
    out = np.full((SMALL + 1, SMALL + 2), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, SMALL):
        t = np.arange(1, n + 2)
        out[n + 1, 1 : n + 2] = np.logaddexp(out[n, t - 1], out[n, t] + np.log(np.maximum(n - discount * t, 1e-300)))
    return out


def _seat_small(c: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng) -> np.ndarray:
    """Number of tables of each dish given all other tables of its restaurant: one exact blocked Gibbs draw."""
    tables = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    for n, (lo, hi) in enumerate(_ranges(np.bincount(c, minlength=SMALL + 1))):
        for a in range(lo, hi, 1 << 16) if n > 1 else ():
            at = order[a : min(a + (1 << 16), hi)]
            fresh = np.log((strength + discount * (others[at, None] + np.arange(n))) * p[at, None])
            weight = _stirling(discount)[n, 1 : n + 1] + np.cumsum(fresh, axis=1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + (weight < rng.random((len(at), 1)) * weight[:, -1:]).sum(axis=1)
    return tables


def _seat_large(c: np.ndarray, sizes: list | None, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng, moves: int) -> list[np.ndarray]:
    """Table sizes of each dish after ``moves`` of its customers, drawn at random, stood up and took a seat again.

    The plain walk that ``_seat_whole`` is tested against; the model doesn't use it.
    """
    out: list = [None] * len(c)
    fresh = (strength + discount * others) * p
    start = np.minimum(1 + fresh * np.log1p(c / (1 + fresh)), c / 2).astype(np.int64).clip(1) if sizes is None else np.array([len(s) for s in sizes], np.int64)
    order = np.argsort(start, kind="stable")
    lo = 0
    while lo < len(c):
        hi = lo + 1
        while hi < len(c) and (hi - lo + 1) * (start[order[hi]] + moves) < 1 << 21:
            hi += 1
        at, width, row = order[lo:hi], int(start[order[hi - 1]]) + moves, np.arange(hi - lo)
        table = np.zeros((hi - lo, width), np.int64)
        filled = np.arange(width) < start[at, None]
        if sizes is None:  # a first seating of about the expected number of tables
            share = np.where(filled, rng.gamma(1 - discount, size=filled.shape) + 1e-12, 0.0)
            table[:] = filled + rng.multinomial(c[at] - start[at], share / share.sum(axis=1, keepdims=True))
        else:
            table[filled] = np.concatenate([sizes[i] for i in at])
        for _ in range(moves):
            who = (rng.random(hi - lo) * c[at]).astype(np.int64)
            table[row, (np.cumsum(table, axis=1) <= who[:, None]).sum(axis=1)] -= 1
            taken = np.cumsum(np.where(table > 0, table - discount, 0.0), axis=1)
            new = (strength + discount * (others[at] + (table > 0).sum(axis=1))) * p[at]
            where = rng.random(hi - lo) * (new + taken[:, -1])
            seat = np.where(where >= taken[:, -1], np.argmin(table, axis=1), np.minimum((taken <= where[:, None]).sum(axis=1), width - 1))
            table[row, seat] += 1
        for i, k in enumerate(at):
            out[k] = table[i][table[i] > 0]
        lo = hi
    return out


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _log_g(w: np.ndarray, discount: float) -> np.ndarray:
    """log(1 - (1 - exp(-w)) ** discount), whose t-th power generates the ways to fill t tables."""
    return np.log1p(-np.exp(discount * np.log(-np.expm1(-w))))


def _slope(w: np.ndarray, discount: float) -> np.ndarray:
    """Minus the derivative of ``_log_g``: customers a table at the saddle point ``w``; falls from infinity to one."""
    q = -np.expm1(-w)
    return np.exp((discount - 1) * np.log(q) - w + math.log(discount)) / -np.expm1(discount * np.log(q))


def _falls(f, n: int) -> np.ndarray:
    """Where a falling function of w > 0 crosses zero, by halving on a logarithmic scale."""
    low, high = np.full(n, -60.0), np.full(n, 4.0)
    for _ in range(52):
        mid = (low + high) / 2
        up = f(np.exp(mid)) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.exp((low + high) / 2)


def log_ways(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Log of the generalised Stirling number of c customers at t tables, for any c; beside the recurrence up to 400 customers, no further off than 2e-5.

    The coefficient of z ** c in (1 - (1 - z) ** discount) ** t is an integral over z = exp(-w) around zero.  It is taken through its saddle point: along
    a parabola that bends away from the cut of w <= 0, or along the whole period where the saddle is far from it.
    """
    out = np.zeros(len(c))  # as many tables as customers: one way
    todo = np.flatnonzero(t < c)
    for lo in range(0, len(todo), 1 << 12):
        at = todo[lo : lo + (1 << 12)]
        n, k = c[at].astype(float), t[at].astype(float)
        saddle = _falls(lambda x: _slope(x, discount) - n / k, len(at))
        w = np.maximum(saddle, 2 / n)  # few tables of many customers: the integral is decided at about 1 / c, far from the saddle
        peak = n * w + k * _log_g(w, discount)
        far, total = w > 0.15, np.zeros(len(at))
        for part, straight in ((np.flatnonzero(far), True), (np.flatnonzero(~far), False)):
            if not len(part):
                continue
            w0, n0, k0 = w[part, None], n[part, None], k[part, None]
            if straight:
                v, step = (np.arange(128) + 0.5) * (math.pi / 128), math.pi / 128
                z, weight = w0 + 1j * v, np.ones((1, 1))
            else:
                h = 1e-3
                below, mid, above = (-k0 * _slope(w0 * x, discount) for x in (1 - h, 1, 1 + h))
                second, third = (above - below) / (2 * h * w0), (above - 2 * mid + below) / (h * w0) ** 2
                near = w0 > saddle[part, None]
                sd, bend = np.minimum(1 / np.sqrt(second), w0), np.where(near, 1 / (3 * w0), -third / (6 * second))
                v, step = (np.arange(80) + 0.5) * 0.16, 0.16 * sd
                y = v * sd
                z, weight = w0 + 1j * y - bend * y * y, 1 + 2j * bend * y  # dw / i dy
            value = np.exp(n0 * z + k0 * _log_g(z, discount) - peak[part, None]) * weight
            total[part] = (value.real.sum(axis=1, keepdims=True) * step)[:, 0] / math.pi
        out[at] = peak + np.log(np.maximum(total, 1e-300)) + _lgamma(n + 1) - _lgamma(k + 1) - k * math.log(discount)
    return out


def _seat_whole(c: np.ndarray, tables: np.ndarray | None, others: np.ndarray, p: np.ndarray, discount: float, strength: float, rng, draws: int) -> np.ndarray:
    """Number of tables of each dish of any size, all of its customers seated anew ``draws`` times.

    Each draw proposes a whole seating from a logistic law around the most likely number of tables and is taken or not by the exact
    ratio (Metropolis-Hastings), so its law is that of ``_seat_small``.  The work of a dish doesn't depend on its customers.
    """
    if not len(c):
        return np.zeros(0, np.int64)
    a, n = strength / discount + others, c.astype(float)
    tables_at = lambda w: np.minimum(n / _slope(w, discount), n)
    pull = lambda w: np.log(p) + _log_g(w, discount) + np.log1p(a / tables_at(w))
    w = _falls(pull, len(c))
    centre = np.clip(tables_at(w), 1, n)
    step = np.where(tables_at(w * 1.01) > tables_at(w * 0.99), (tables_at(w * 1.01) - tables_at(w * 0.99)) / np.maximum(pull(w * 0.99) - pull(w * 1.01), 1e-12), 0.25)
    scale = 0.62 * np.sqrt(np.clip(step, 0.05, n * n)) + 0.1
    edge = lambda x: 1 / (1 + np.exp(-np.clip((x - centre) / scale, -500, 500)))
    low, high = edge(0.5), edge(n + 0.5)
    share = lambda t: np.log(np.maximum(edge(t + 0.5) - edge(t - 0.5), 1e-300))
    level = lambda t: log_ways(c, t, discount) + t * np.log(discount * p) + _lgamma(a + t) - share(t)

    def propose() -> np.ndarray:
        u = low + rng.random(len(c)) * (high - low)
        return np.clip(np.rint(centre + scale * (np.log(np.maximum(u, 1e-300)) - np.log1p(-np.minimum(u, 1 - 1e-16)))), 1, n).astype(np.int64)

    now = np.clip(np.rint(centre), 1, n).astype(np.int64) if tables is None else tables
    now_level = level(now)
    for _ in range(draws):
        new = propose()
        new_level = level(new)
        taken = np.log(rng.random(len(c))) < new_level - now_level
        now, now_level = np.where(taken, new, now), np.where(taken, new_level, now_level)
    return now


def seat(c, before, others, p, discount, strength, rng, draws) -> np.ndarray:
    """Tables per dish after one sweep over all customers; ``before`` has those of the last sweep, if any."""
    tables, large = np.ones(len(c), np.int64), np.flatnonzero(c > SMALL)
    small = np.flatnonzero((c > 1) & (c <= SMALL))
    tables[small] = _seat_small(c[small], others[small], p[small], discount, strength, rng)
    tables[large] = _seat_whole(c[large], None if before is None else before[large], others[large], p[large], discount, strength, rng, draws)
    return tables


def _discount(once: float, twice: float) -> float:
    return min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)


# --- blocks of texts ------------------------------------------------------------------------------------------------


class _Plan:
    """Which bucket holds a word and which a pair; contexts with a large share are dealt by the next word as well."""

    def __init__(self, buckets: int, heavy: dict[int, int]):
        self.buckets = buckets
        self.heavy = np.array(sorted(heavy), np.int64)
        self.parts = np.array([heavy[int(h)] for h in self.heavy], np.uint64)

    def of_words(self, words: np.ndarray) -> np.ndarray:
        """Numbers are hashes, so equal ranges of them are equal shares, and sorted words are in bucket order."""
        return ((words >> 16) * self.buckets) >> 32

    def of_pairs(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        home = self.of_words(context)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, context), len(self.heavy) - 1)
            hot = np.flatnonzero(self.heavy[at] == context)
            home[hot] = (home[hot] + (mix(word[hot].astype(np.uint64)) % self.parts[at[hot]]).astype(np.int64)) % self.buckets
        return home


class _Codes(dict):
    """Numbers words in the order of their first use and keeps their 48-bit hashes."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word) >> 16)
        return code


class _Block:
    """The distinct words of some texts by number, and their distinct pairs in order of (bucket, context, word).

    ``runs`` tokens end each pair, in the texts ``owner``, which follow each other pair by pair.
    """

    def __init__(self, b: pa.RecordBatch, plan: _Plan):
        texts, codes = raw(b), _Codes()
        parts, self.n_tokens = [], np.zeros(b.num_rows, np.int64)
        for i, text in enumerate(texts):
            words = [b" ", *text.lower().split(), b""]
            parts.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
            self.n_tokens[i] = len(words) - 1
        self.held = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        self.name = xxhash.xxh3_128_hexdigest(pickle.dumps((texts, b.column("doc_id").to_pylist())))
        self.words, place = np.unique(np.array(codes.hashes, np.int64), return_inverse=True)
        self.word_sizes = np.bincount(plan.of_words(self.words), minlength=plan.buckets)
        code, n, n_words = place[np.concatenate(parts)], b.num_rows, len(self.words)
        is_word = np.ones(len(code), bool)
        is_word[np.cumsum(self.n_tokens + 1) - (self.n_tokens + 1)] = False
        at = np.flatnonzero(is_word)
        key = (code[at - 1] * n_words + code[at]) * n + np.repeat(np.arange(n), self.n_tokens)
        key.sort()
        pair, owner = key // n, key % n
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        pair, runs = pair[starts], np.diff(starts, append=len(key))
        context, word = pair // n_words, pair % n_words
        home = plan.of_pairs(self.words[context], self.words[word])
        if (np.diff(home) < 0).any():
            order = np.argsort(home, kind="stable")
            ends = np.cumsum(runs[order])
            owner = owner[np.repeat(starts[order] - (ends - runs[order]), runs[order]) + np.arange(len(owner))]
            context, word, runs = context[order], word[order], runs[order]
        self.context, self.word, self.owner, self.runs = context, word, owner, runs
        self.pair_sizes = np.bincount(home, minlength=plan.buckets)
        self.count = np.bincount(np.repeat(np.arange(len(runs)), runs), weights=~self.held[owner], minlength=len(runs)).astype(np.int64)


def _asked(plan: _Plan, limit: int):
    """Task function: texts to the pairs (with their counts in learned texts) and words that each bucket is to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=limit):
            x, rows = _Block(b, plan), []
            for k, (lo, hi) in enumerate(_ranges(x.word_sizes)):
                if hi > lo:
                    rows.append(("words", k, x.name, pack(_steps(x.words[lo:hi]))))
            for k, (lo, hi) in enumerate(_ranges(x.pair_sizes)):
                if hi > lo:
                    context, word = x.context[lo:hi], x.word[lo:hi]
                    new = np.diff(context, prepend=-1) > 0
                    used = np.zeros(len(x.words), bool)
                    used[word] = True
                    place = np.cumsum(used) - 1
                    rows.append(("pairs", k, x.name, pack(_steps(x.words[context[new]]), new, _steps(x.words[used]), place[word], x.count[lo:hi])))
            yield from _rows(rows).to_batches()

    return run


def _texts(plan: _Plan, limit: int):
    """Task function: texts to one row per block with what scoring needs besides the buckets' answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=limit):
            x = _Block(b, plan)
            ids = pickle.dumps(b.column("doc_id").to_pylist())
            yield from _rows([("texts", 0, x.name, pickle.dumps((ids, pack(x.held, x.n_tokens, x.owner, x.runs, _steps(x.context), x.word))))]).to_batches()

    return run


# --- buckets of pairs and of words ----------------------------------------------------------------------------------


def _send(kind: str, plan: _Plan, bucket: int, words: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Rows that take sorted words and their columns to the words' buckets."""
    sizes = np.bincount(plan.of_words(words), minlength=plan.buckets)
    return [(kind, k, f"{bucket:09d}", pack(_steps(words[lo:hi]), *(c[lo:hi] for c in columns))) for k, (lo, hi) in enumerate(_ranges(sizes)) if hi > lo]


def _merge(plan: _Plan):
    """Group function: the asked pairs of a bucket are added up.  Gives the state of its pairs seen more than once, the
    counts to answer each block with, and for the words' buckets how many customers and pairs each word has on either side."""

    def run(key, table):
        got = _groups(table)
        rows = [("words", key[0].as_py(), s, p) for s, p in got["words"]]
        if not got["pairs"]:
            return _rows(rows)
        parts = [unpack(p) for _, p in got["pairs"]]
        context, c_at = np.unique(np.concatenate([np.cumsum(x[0])[np.cumsum(x[1]) - 1] for x in parts]), return_inverse=True)
        word, w_at = np.unique(np.concatenate([np.cumsum(x[2])[x[3]] for x in parts]), return_inverse=True)
        pairs, index = np.unique(c_at * len(word) + w_at, return_inverse=True)
        count = np.bincount(index, weights=np.concatenate([x[4] for x in parts]), minlength=len(pairs)).astype(np.int64)
        c_at, w_at = pairs // len(word), pairs % len(word)
        many = np.flatnonzero(count > 1)
        place = np.zeros(len(pairs), np.int64)
        place[many] = np.arange(len(many))
        bucket = key[0].as_py()
        for (source, _), (lo, hi) in zip(got["pairs"], _ranges([len(x[4]) for x in parts])):
            c = count[index[lo:hi]]
            rows.append(("counts", bucket, source, pack(c, place[index[lo:hi]][c > 1])))
        ends = np.unique(np.concatenate([context[c_at[many]], word[w_at[many]]]))
        rows.append(("state", bucket, "", pickle.dumps((pack(_steps(ends), np.searchsorted(ends, context[c_at[many]]), np.searchsorted(ends, word[w_at[many]]), count[many]), None))))
        seen = count > 0
        every = np.unique(np.concatenate([context[c_at[seen]], word[w_at[seen]]]))
        left, right = np.searchsorted(every, context[c_at[seen]]), np.searchsorted(every, word[w_at[seen]])
        sums = [np.bincount(i, weights=w, minlength=len(every)).astype(np.int64) for i, w in ((left, count[seen]), (left, None), (right, count[seen]), (right, None))]
        rows += _send("first", plan, bucket, every, *sums)
        asks = np.isin(every, ends)
        rows += _send("extra", plan, bucket, every[asks], *[np.zeros((asks.sum(), 1), np.int64)] * 2)
        return _rows(rows)

    return run


def _seat_root(plan: _Plan, chains: int, totals: dict, strength: float, draws: int, turn: int):
    """Group function of a words' bucket: adds the tables of the pairs' buckets to the customers of the shared parent,
    seats them, and answers each asking bucket with customers, tables, and the tables of a word's own restaurant."""

    def run(key, table):
        got, bucket = _groups(table), key[0].as_py()
        if got["root"]:
            words, base = unpack(got["root"][0][1])[:2]
            words = np.cumsum(words)
        else:
            parts = [unpack(p) for _, p in got["first"]]
            words, index = np.unique(np.concatenate([np.cumsum(x[0]) for x in parts]), return_inverse=True)
            base = np.stack([np.bincount(index, weights=np.concatenate([x[j] for x in parts]), minlength=len(words)).astype(np.int64) for j in range(1, 5)], axis=1)
        own, customers = np.repeat(base[:, 1:2], chains, axis=1), np.repeat(base[:, 3:4], chains, axis=1)
        extras = [(source, unpack(p)) for source, p in got["extra"]]
        for _, (steps, left, right) in extras:
            at = np.searchsorted(words, np.cumsum(steps))
            own[at], customers[at] = own[at] + left, customers[at] + right
        rng = np.random.default_rng([bucket, turn])
        known = customers[:, 0] > 0  # the words of learned texts; START is only a context
        tables = np.zeros_like(customers)
        n_words = totals["words"] or int(known.sum()) * plan.buckets  # the first seating has only its own share to go by
        base_p = np.full(int(known.sum()), 1.0 / (n_words + 1))
        for s in range(chains):
            others = np.full(len(base_p), totals["tables"][s] if totals["tables"] else n_words, np.float64)
            tables[known, s] = seat(customers[known, s], None, np.maximum(others - 1, 0), base_p, totals["discount"], strength, rng, draws)
        rows = [("root", bucket, "", pack(_steps(words), base, own, customers, tables))]
        once, twice = (int((customers[:, 0] == k).sum()) for k in (1, 2))
        sums = (int(known.sum()), int(base[:, 2].sum()), once, twice, customers.sum(axis=0).tolist(), tables.sum(axis=0).tolist())
        rows.append(("sums", bucket, "", pickle.dumps(sums)))
        for source, (steps, _, _) in extras:
            at = np.searchsorted(words, np.cumsum(steps))
            rows.append(("prior", int(source), f"{bucket:09d}", pack(steps, base[at, 0], own[at], customers[at], tables[at])))
        return _rows(rows)

    return run


def _parent(customers: np.ndarray, tables: np.ndarray, totals: dict, strength: float) -> np.ndarray:
    """Predictive probability of words in the shared parent restaurant, a column for each chain."""
    new = (strength + totals["discount"] * np.array(totals["tables"])) / (totals["words"] + 1)
    return (customers - totals["discount"] * tables + new) / (strength + np.array(totals["customers"]))


def _seat_pairs(plan: _Plan, chains: int, totals: dict, discount: float, strength: float, draws: int, turn: int):
    """Group function of a pairs' bucket: one Gibbs sweep over its context restaurants for each chain."""

    def run(key, table):
        got, bucket = _groups(table), key[0].as_py()
        rows = []
        for _, payload in got["state"]:
            fixed, seats = pickle.loads(payload)
            steps, left, right, count = unpack(fixed)
            ends = np.cumsum(steps)
            answers = [unpack(p) for _, p in got["prior"]]
            tables = unpack(seats)[0] if seats else None
            after = np.ones((len(count), chains), np.int64)
            if len(ends):
                words = np.concatenate([np.cumsum(x[0]) for x in answers])
                order = np.argsort(words)  # each word is in one bucket, so these are ``ends``
                own, customers, seated = (np.concatenate([x[j] for x in answers])[order] for j in (2, 3, 4))
                p = _parent(customers, seated, totals, strength)
                rng = np.random.default_rng([bucket, turn, 1])
                for s in range(chains):
                    others = own[left, s] - (tables[:, s] if tables is not None else 1)
                    after[:, s] = seat(count, tables[:, s] if tables is not None else None, others.astype(np.float64), p[right, s], discount, strength, rng, draws)
            rows.append(("state", bucket, "", pickle.dumps((fixed, pack(after)))))
            sums = [np.stack([np.bincount(i, weights=after[:, s] - 1, minlength=len(ends)) for s in range(chains)], axis=1).astype(np.int64) for i in (left, right)]
            rows += _send("extra", plan, bucket, ends, *sums)
        return _rows(rows)

    return run


def _answer(chains: int):
    """Group function of a bucket: what each block asked for, in the order it asked in."""

    def run(key, table):
        got, bucket = _groups(table), key[0].as_py()
        rows = []
        if got["words"]:
            none = [np.zeros(0, np.int64), np.zeros((0, 4), np.int64), *[np.zeros((0, chains), np.int64)] * 3]
            words, *values = unpack(got["root"][0][1]) if got["root"] else none
            words = np.append(np.cumsum(words), -1)  # a word of no learned text is the last
            values = [np.concatenate([x, np.zeros((1, x.shape[1]), np.int64)]) for x in values]
            for source, payload in got["words"]:
                asked = np.cumsum(unpack(payload)[0])
                at = np.searchsorted(words[:-1], asked)
                at = np.where(words[at] == asked, at, len(words) - 1)
                rows.append(("a_words", bucket, source, pack(*(v[at] for v in values))))
        for source, payload in got["counts"]:
            count, place = unpack(payload)
            tables = unpack(pickle.loads(got["state"][0][1])[1])[0]
            rows.append(("a_pairs", bucket, source, pack(count, tables[place])))
        return _rows(rows)

    return run


def _score(totals: dict, discount: float, strength: float, columns: pa.Schema):
    """Group function of a block: looks up each pair's averaged probability and adds up each text."""

    def run(key, table):
        got = defaultdict(dict)
        for kind, k, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "to_bucket", "payload"))):
            got[kind].setdefault(k, []).append(payload)
        answers = {kind: [unpack(got[kind][k][0]) for k in sorted(got[kind])] for kind in ("a_words", "a_pairs")}
        base, own, customers, tables = (np.concatenate([x[j] for x in answers["a_words"]]) for j in range(4))
        count = np.concatenate([x[0] for x in answers["a_pairs"]])
        chains = len(totals["tables"])
        seated = np.ones((len(count), chains), np.int64)
        seated[count > 1] = np.concatenate([x[1] for x in answers["a_pairs"]])
        out = []
        for payload in got["texts"][0]:
            ids, arrays = pickle.loads(payload)
            held, n_tokens, owner, runs, context, word = unpack(arrays)
            context = np.cumsum(context)
            if len(context) != len(count):
                raise ValueError("the texts changed between two readings")
            p, at = np.zeros(len(count)), (base[context, 0], base[word, 2])
            parents = _parent(customers, tables, totals, strength)
            for s in range(chains):
                parent = parents[word, s]
                taken = np.where(count > 0, count - discount * seated[:, s], 0.0)
                inside = (taken + (strength + discount * own[context, s]) * parent) / (strength + at[0])
                p += np.where(at[0] > 0, inside, parent) / chains
            log_p = np.log10(p)
            base_p = np.log10((at[1] + 1) / (totals["tokens"] + totals["words"] + 1))
            add = lambda x: np.bincount(owner, weights=np.repeat(x, runs), minlength=len(n_tokens))
            known = add((at[1] > 0).astype(np.float64)).astype(np.int64)
            values = [pickle.loads(ids), held.astype(bool), n_tokens, known, [totals["tokens"]] * len(n_tokens), add(base_p), add(log_p)]
            out.append(pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(values, columns)], schema=columns))
        return pa.concat_tables(out)

    return run


def score_texts(
    docs: DataFrame, *, folds: int = 7, held: int = 2, chains: int = 3, rounds: int = 2, strength: float = 1.0, draws: int = 1, bucket_chars: int = 16 << 20, block_bytes: int = 10 << 20
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every text.

    The model learns from the rows outside fold ``held``.  Each preceding word (or the start of a text) has a Chinese restaurant
    whose customers are the words after it; the first customer of each table is a customer of the one
    parent restaurant that all contexts share, whose own parent is uniform over the known words and one unknown word.  Seating is sampled by
    Gibbs in ``chains`` independent chains of ``rounds`` sweeps over both levels; given the parent's seating of the last sweep, context restaurants are independent, so their buckets are swept
    side by side.  Every dish is drawn with all of its customers (table sizes summed out by Stirling numbers): of up to 64 customers from their table, larger
    ones by ``draws`` whole proposals a sweep, taken or not by the exact ratio.  A pair seen once has one table.  Predictive probabilities are averaged over the chains before the logarithm.  The
    discounts come from the counts of ones and twos.

    All data take part: every distinct pair of words is counted.  Tasks turn blocks of texts into packed sorted numbers (48-bit hashes of words)
    for buckets of pairs and of words, whose number grows with the corpus; contexts that hold a large share
    of a small sample are dealt over several buckets, which only balances them.  The driver gets sums of fixed size.

    Null and empty texts have one token, the end.  Rows with a null id are scored, not learned from; repeated rows count again and
    score alike; a very long text is a block of its own.  An empty table gives no rows; with nothing to learn from, all words are unknown.  Other columns
    are not looked at.  The rows must come in the same order whenever ``docs`` is read (as files do), else an error is raised.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(True)).alias("held_out"), "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_chars))
    plan = _Plan(buckets, _heavy_contexts(rows, buckets))
    asked = rows.mapInArrow(_asked(plan, block_bytes), _ROW)
    first = _staged(asked.groupBy("to_bucket").applyInArrow(_merge(plan), _ROW), "pairs")
    state, extra = first.where("kind = 'state'"), first.where("kind = 'extra'")
    parts = first.where("kind = 'first'")
    totals = {"words": 0, "tables": None, "discount": 0.5}
    leaf = 0.5
    for turn in range(rounds + 1):
        root = _staged(parts.unionByName(extra).groupBy("to_bucket").applyInArrow(_seat_root(plan, chains, totals, strength, draws, turn), _ROW), f"root-{turn}")
        sums = [pickle.loads(r["payload"]) for r in root.where("kind = 'sums'").select("payload").collect()]  # a few numbers for each bucket
        once, twice = (sum(s[k] for s in sums) for k in (2, 3))
        before, totals = totals, {
            "words": sum(s[0] for s in sums), "tokens": sum(s[1] for s in sums), "discount": totals["discount"],
            "customers": np.sum([s[4] for s in sums], axis=0).tolist() if sums else [0] * chains, "tables": np.sum([s[5] for s in sums], axis=0).tolist() if sums else [0] * chains,
        }
        parts = root.where("kind = 'root'")
        if turn == rounds:
            break
        if not before["words"]:
            leaf = _leaf_discount(first)
        swept = state.unionByName(root.where("kind = 'prior'")).groupBy("to_bucket").applyInArrow(_seat_pairs(plan, chains, totals, leaf, strength, draws, turn), _ROW)
        totals = totals | {"discount": _discount(once, twice)}
        swept = _staged(swept, f"seats-{turn}")
        state, extra = swept.where("kind = 'state'"), swept.where("kind = 'extra'")
    asks = first.where("kind IN ('words', 'counts')")
    answers = asks.unionByName(parts).unionByName(state).groupBy("to_bucket").applyInArrow(_answer(chains), _ROW)
    out = StructType([docs.select("doc_id").schema[0], *_parse_datatype_string("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    columns = spark.createDataFrame([], StructType([StructField(f.name, f.dataType) for f in out])).toArrow().schema
    return rows.mapInArrow(_texts(plan, block_bytes), _ROW).unionByName(answers).groupBy("source").applyInArrow(_score(totals, leaf, strength, columns), out)


def _staged(rows: DataFrame, name: str) -> DataFrame:
    path = staging_path(rows.sparkSession, name)
    rows.write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(_ROW).parquet(path)


def _heavy_contexts(rows: DataFrame, buckets: int, modulus: int = 64) -> dict[int, int]:
    """Words with a large share of a sample of the texts, and over how many buckets to deal their pairs.  Results don't depend on it."""
    words = rows.where(F.pmod(F.xxhash64("text"), F.lit(modulus)) == 0).select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word"))
    counts = words.groupBy("word").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    if buckets == 1 or not total:
        return {}
    most = counts.where(F.col("count") > total / (2 * buckets)).collect()  # fewer than twice the buckets
    return {xxhash.xxh3_64_intdigest(r["word"].encode()) >> 16: math.ceil(2 * buckets * r["count"] / total) for r in most}


def _leaf_discount(first: DataFrame) -> float:
    """Discount of the context restaurants from the pairs seen once and twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = 0
        for b in batches:
            for kind, payload in zip(b.column("kind").to_pylist(), b.column("payload").to_pylist()):
                if kind == "first":
                    once += int(unpack(payload)[2].sum())
                else:
                    count = unpack(pickle.loads(payload)[0])[3]
                    once, twice = once - len(count), twice + int((count == 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([once]), pa.array([twice])], names=["once", "twice"])

    got = first.where("kind IN ('first', 'state')").mapInArrow(run, "once long, twice long").agg(F.sum("once"), F.sum("twice")).first()
    return _discount(got[0] or 0, got[1] or 0)
