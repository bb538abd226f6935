"""Toxicity: a convolutional text classifier on hashed word embeddings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.llm.batches import fold, pieces
from strandline.llm.pitman_yor import pack, unpack
from strandline.llm.sketch import slot, slot_bitmap
from strandline.storage import staged

_STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_/\\…«»“”„’"
#: Hashed pieces of a word: itself and its beginnings of these lengths.
_STARTS = (4, 5, 6)
PIECES = 1 + len(_STARTS)
WIDTHS = (1, 2, 3)
#: Buckets whose sums are added in one place, and steps of the logit that thresholds tell apart.
BLOCK = 1 << 14
STEPS = 256


def word_ids(word: str, buckets: int) -> list[int]:
    w = word.lower().strip(_STRIP)
    parts = [w, *(f"{w[:n]}\x00{n}" if len(w) > n else f"{w}\x00" for n in _STARTS)]
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) % buckets for p in parts]


@dataclass
class TextCnn:
    """Embeddings, one filter bank per width, a linear output, a language guess and the thresholds."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    offset: float
    languages: list[str] = field(default_factory=list)
    tongue: np.ndarray | None = None
    cuts: np.ndarray | None = None

    def pooled(self, x: np.ndarray, sizes: np.ndarray):
        """Largest response of each filter in each text, and where; ``x`` has two zero rows after each text."""
        dim = x.shape[1]
        pads = len(WIDTHS) - 1
        ends = np.cumsum(sizes + pads)
        values, places = [], []
        for k, w, b in zip(WIDTHS, self.filters, self.bias):
            n = len(x) - k + 1
            response = sum(x[j : j + n] @ w[j * dim : (j + 1) * dim] for j in range(k)) + b if n > 0 else np.zeros((0, len(b)), np.float32)
            best, at = np.zeros((len(sizes), len(b)), np.float32), np.full((len(sizes), len(b)), -1)
            for d, (size, end) in enumerate(zip(sizes, ends)):
                if size:
                    lo = end - size - pads
                    part = response[lo : lo + size]
                    top = part.argmax(0)
                    value = part[top, np.arange(len(b))]
                    best[d] = np.maximum(value, 0)
                    at[d] = np.where(value > 0, lo + top, -1)
            values.append(best)
            places.append(at)
        return np.concatenate(values, 1), places

    def logits(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.pooled(x, sizes)[0] @ self.out + self.offset


def _padded(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``rows`` with two zero rows after each text."""
    pads = len(WIDTHS) - 1
    out = np.zeros((len(rows) + pads * len(sizes), rows.shape[1]), np.float32)
    out[np.arange(len(rows)) + pads * np.repeat(np.arange(len(sizes)), sizes)] = rows
    return out


def _first_net(seen: np.ndarray, tongue: np.ndarray, rows: np.ndarray, languages: list[str], dim: int = 8, per_width: int = 8, seed: int = 11) -> TextCnn:
    """The net before training, from the number of texts of each kind (``seen``) and language (``tongue``) that have a bucket.

    The first embedding dimension starts at the log odds of a bucket between toxic and other texts, so that
    the width-1 filters begin with a signal; everything is trained from there.
    """
    rng = np.random.default_rng(seed)
    buckets = seen.shape[1]
    n0, n1 = np.maximum(rows, 1)
    embed = rng.normal(0, 0.05, (buckets, dim)).astype(np.float32)
    embed[:, 0] = 0.5 * (np.log((seen[1] + 2) / n1) - np.log((seen[0] + 2 * n0 / n1) / n0))  # two more toxic texts, and as many others as their share
    embed[(seen.sum(0) == 0), 0] = 0.0
    net = TextCnn(embed, [rng.normal(0, 0.3 / np.sqrt(k), (k * dim, per_width)).astype(np.float32) for k in WIDTHS], [np.full(per_width, -0.1, np.float32) for _ in WIDTHS], np.full(per_width * len(WIDTHS), 0.1, np.float32), -1.0, languages)
    for k, w in zip(WIDTHS, net.filters):
        w[::dim] = np.abs(w[::dim]) + 0.5 / k
    share = np.log((tongue.T + 0.05) / (tongue.T + 0.05).sum(0))
    net.tongue = (share - share.mean(1, keepdims=True)).astype(np.float32)
    return net


@dataclass
class _State:
    """The net and the sums of squared gradients of its parts, which set the steps."""

    net: TextCnn
    embed_squares: np.ndarray
    squares: list[np.ndarray]

    def parts(self) -> list[np.ndarray]:
        """All but the embeddings."""
        return [*self.net.filters, *self.net.bias, self.net.out, np.array([self.net.offset])]

    def put(self, parts: list[np.ndarray]) -> None:
        k = len(WIDTHS)
        small = [x.astype(np.float32) for x in parts[:-1]]
        self.net.filters, self.net.bias, self.net.out, self.net.offset = small[:k], small[k : 2 * k], small[2 * k], float(parts[-1][0])


def _train(state: _State, shard: _Shard, balance: np.ndarray, rng: np.random.Generator, rate: float = 0.05, batch_size: int = 48) -> _State:
    """One pass over the learned texts of a shard by mini-batches with adaptive steps."""
    old = state.net
    net = TextCnn(old.embed.copy(), old.filters, old.bias, old.out, old.offset)
    state = _State(net, state.embed_squares.copy(), [x.copy() for x in state.squares])
    dim, pads = net.embed.shape[1], len(WIDTHS) - 1
    order = rng.permutation(np.flatnonzero(~shard.held))
    for lo in range(0, len(order), batch_size):
        batch = order[lo : lo + batch_size]
        sizes, flat = shard.sizes[batch], shard.words[np.concatenate([shard.codes_of(i) for i in batch])]
        x = _padded(net.embed[flat].sum(1), sizes)
        h, places = net.pooled(x, sizes)
        z = h @ net.out + net.offset
        toxic = shard.toxic[batch]
        g = balance[toxic] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / len(batch)
        gh = np.outer(g, net.out)
        dx, gws, gbs = np.zeros((len(x), dim), np.float32), [], []
        for i, (k, w) in enumerate(zip(WIDTHS, net.filters)):
            width = w.shape[1]
            d, f = np.nonzero(places[i] >= 0)
            at, v = places[i][d, f], gh[:, i * width : (i + 1) * width][d, f].astype(np.float32)
            gw, gb = np.zeros((width, k * dim), np.float32), np.zeros(width, np.float32)
            np.add.at(gw, f, v[:, None] * x[at[:, None] + np.arange(k)].reshape(len(at), k * dim))
            np.add.at(gb, f, v)
            for j in range(k):
                np.add.at(dx, at + j, v[:, None] * w[j * dim : (j + 1) * dim, f].T)
            gws.append(gw.T), gbs.append(gb)
        moved = []
        for n, (part, grad) in enumerate(zip(state.parts(), [*gws, *gbs, h.T @ g, np.array([g.sum()])])):
            state.squares[n] = state.squares[n] + grad * grad
            moved.append(part - rate * grad / np.sqrt(state.squares[n]))
        state.put(moved)
        place = np.arange(len(flat)) + pads * np.repeat(np.arange(len(sizes)), sizes)
        rows = np.flatnonzero(dx[place].any(axis=1))
        if len(rows):
            touched, inverse = np.unique(flat[rows], return_inverse=True)
            total = np.zeros((len(touched), dim), np.float32)
            np.add.at(total, inverse.reshape(len(rows), -1), dx[place[rows]][:, None, :])
            state.embed_squares[touched] += total * total
            net.embed[touched] -= rate * total / np.sqrt(state.embed_squares[touched])
    return state


def _best_cut(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float | None:
    """The cut with the best weighted F1, in the middle of the gap it lies in."""
    if not len(z) or y.sum() == 0:
        return None
    order = np.argsort(-z, kind="stable")
    z, y, w = z[order], y[order], w[order]
    hit, miss = np.cumsum(w * y), np.cumsum(w * (1 - y))
    f1 = 2 * hit / (hit + miss + (w * y).sum())
    f1[:-1][z[1:] == z[:-1]] = -1
    best = int(np.argmax(f1))
    return float((z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best] - 1)


def _cuts(counts: list[tuple[int, int, int, int]], languages: int, least: int = 15) -> np.ndarray:
    """A threshold per guessed language from (language, toxic, step, texts), and the common one where a language has under ``least`` toxic texts."""
    lang, toxic, step, n = np.array(sorted(counts), np.int64).reshape(-1, 4).T
    z = (step + 0.5) / STEPS
    common = _best_cut(z, toxic, n)
    cuts = np.full(max(languages, 1), 0.0 if common is None else common)
    for i in range(languages):
        own = lang == i
        if (n * toxic)[own].sum() >= least:
            cuts[i] = _best_cut(z[own], toxic[own], n[own])
    return cuts


class _Shard:
    """Labelled texts as numbers of the distinct words in them, with the hashed pieces of each word; a quarter is held back for the thresholds."""

    def __init__(self, payload: bytes):
        self.words, self.codes, self.sizes, self.toxic, self.lang, held = unpack(payload)
        self.held, self.ends = held.astype(bool), np.cumsum(self.sizes)

    def codes_of(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] - self.sizes[i] : self.ends[i]]

    @staticmethod
    def rows(texts: list[tuple[str, str, int]], buckets: int) -> tuple[list[str], bytes]:
        """From (text, language, kind): the languages (number -1: none) and the payload; the order of rows comes from what they hold."""
        got = sorted((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")), toxic, lang, t) for t, lang, toxic in texts)
        places: dict[str, int] = {}
        codes = [np.array([places.setdefault(w, len(places)) for w in t.split()], np.int64) for *_, t in got]
        languages = sorted({x[2] for x in got} - {""})
        words = np.array([word_ids(w, buckets) for w in places], np.int64).reshape(-1, PIECES)
        number = {x: i for i, x in enumerate(languages)} | {"": -1}
        return languages, pack(words, np.concatenate([np.zeros(0, np.int64), *codes]), np.array([len(c) for c in codes], np.int64), np.array([x[1] for x in got], np.int64), np.array([number[x[2]] for x in got], np.int64), np.array([x[0] % 4 == 3 for x in got], np.int8))


def _per_shard(fn, schema: str):
    """Task function over (langs, payload) of shards; ``fn`` gives rows from the task's shards, one after the other."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    arrow = pa.schema([(n, kinds[k]) for n, k in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = ((x, _Shard(p)) for b in batches for x, p in zip(b.column("langs").to_pylist(), b.column("payload").to_pylist()))
        for rows in fn(shards):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

    return run


def _added(key, table):
    """Group function: sums of the arrays of equal place, by position in the first array if there is one."""
    payloads = sorted(table.column("payload").to_pylist())  # whatever the order in which they arrived
    if key[0].as_py() < 0:
        total = None
        for p in payloads:
            arrays = unpack(p)
            total = arrays if total is None else [a + b for a, b in zip(total, arrays)]
        out = pack(*total)
    else:
        sums: dict = {}
        for p in payloads:
            at, *arrays = unpack(p)
            for n, x in enumerate(arrays):
                held = sums.setdefault(n, np.zeros((BLOCK, *x.shape[1:]), x.dtype))
                held[at] += x
        used = np.flatnonzero(sums[0].reshape(BLOCK, -1).any(axis=1))
        out = pack(used, *(sums[n][used] for n in range(len(sums))))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "payload": pa.array([out], pa.binary())})


def _blocks(at: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """Sorted positions and their values, cut into blocks of positions that are added up side by side."""
    cuts = np.searchsorted(at, np.arange(0, (at[-1] if len(at) else 0) + BLOCK + 1, BLOCK))
    return [(k, pack(at[lo:hi] - k * BLOCK, *(x[lo:hi] for x in arrays))) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]


def _sum_of(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """The added blocks, at most one for each ``BLOCK`` buckets, on the driver."""
    got = rows.groupBy("block").applyInArrow(_added, "block int, payload binary").collect()
    return {r["block"]: unpack(bytes(r["payload"])) for r in got}


def fit(shards: DataFrame, *, buckets: int, epochs: int = 6, seed: int = 11) -> TextCnn | None:
    """Train on every labelled text of ``shards`` but a quarter, which sets the thresholds; None without texts of both kinds.

    Counts are sums over all shards.  In each epoch every shard goes through all of its texts from the same net, in its own task, and the
    changes are averaged by texts: those of a bucket over the shards that changed it.  The driver gets sums for each bucket, whose size is fixed.
    """
    spark = shards.sparkSession
    languages = sorted(r["lang"] for r in shards.select(F.explode("langs").alias("lang")).distinct().collect())
    number = {x: i for i, x in enumerate(languages)}

    def count(found):
        sums, rows = np.zeros((buckets, 2 + len(languages)), np.int64), np.zeros(4, np.int64)
        for langs, s in found:
            own = np.array([2 + number[x] for x in langs], np.int64)
            rows += np.bincount(s.toxic + 2 * s.held, minlength=4)
            for i in np.flatnonzero(~s.held):
                ids = np.unique(s.words[np.unique(s.codes_of(i))])
                sums[ids, s.toxic[i]] += 1
                if s.lang[i] >= 0:
                    sums[ids, own[s.lang[i]]] += 1
        used = np.flatnonzero(sums.any(axis=1))
        yield [(-1, pack(rows)), *_blocks(used, sums[used])]

    got = _sum_of(shards.mapInArrow(_per_shard(count, "block int, payload binary"), "block int, payload binary"))
    rows = got.pop(-1)[0] if -1 in got else np.zeros(4, np.int64)
    kinds = rows[:2] + rows[2:]
    if not kinds.all():
        return None
    sums = np.zeros((2 + len(languages), buckets), np.float32)
    for k, (at, values) in got.items():
        sums[:, at + k * BLOCK] = values.T
    net = _first_net(sums[:2], sums[2:], rows[:2], languages, seed=seed)
    state = _State(net, np.full(net.embed.shape, 1e-3, np.float32), [])
    state.squares = [np.full(x.shape, 1e-3) for x in state.parts()]
    balance = kinds.sum() / (2 * kinds)
    for epoch in range(epochs):
        shared = spark.sparkContext.broadcast(state)

        def train(found, shared=shared, epoch=epoch):
            for _, s in found:
                n = int((~s.held).sum())
                if n:
                    old = shared.value
                    new = _train(old, s, balance, np.random.default_rng([seed, epoch, n, int(s.codes.sum())]))
                    at = np.flatnonzero((new.embed_squares != old.embed_squares).any(axis=1))
                    blocks = _blocks(at, np.full(len(at), n, np.float64), n * (new.net.embed[at] - old.net.embed[at]), n * (new.embed_squares[at] - old.embed_squares[at]))
                    yield [(-1, pack(np.array([n]), *(n * x.astype(float) for x in [*new.parts(), *new.squares]))), *blocks]

        got = _sum_of(shards.mapInArrow(_per_shard(train, "block int, payload binary"), "block int, payload binary"))
        if -1 in got:  # else all texts are held back
            n, *small = got.pop(-1)
            small = [x / n[0] for x in small]
            state.put(small[: len(small) // 2])
            state.squares = small[len(small) // 2 :]
        for k, (at, n, change, squares) in got.items():
            net.embed[at + k * BLOCK] += change / n[:, None].astype(np.float32)
            state.embed_squares[at + k * BLOCK] += squares / n[:, None].astype(np.float32)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(net)

    def held_back(found):
        net = shared.value
        for _, s in found:
            texts = np.flatnonzero(s.held)
            out: Counter = Counter()
            for lo in range(0, len(texts), 64):
                some = texts[lo : lo + 64]
                sizes, parts = s.sizes[some], [s.words[s.codes_of(i)] for i in some]
                z = net.logits(_padded(net.embed[np.concatenate(parts)].sum(1), sizes), sizes)
                lang = [int(net.tongue[x].sum((0, 1)).argmax()) if len(x) and languages else 0 for x in parts]
                out.update(zip(lang, s.toxic[some].tolist(), np.floor(np.clip(z, -40, 40) * STEPS).astype(int).tolist()))
            yield [(*k, n) for k, n in out.items()]

    counts = shards.mapInArrow(_per_shard(held_back, "lang int, toxic int, step int, n long"), "lang int, toxic int, step int, n long").groupBy("lang", "toxic", "step").agg(F.sum("n").alias("n"))
    net.cuts = _cuts([tuple(r) for r in counts.collect()], len(languages))  # at most 80 * STEPS steps of a language and kind
    shared.unpersist()
    return net


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, buckets: int = 1 << 18, threshold: float = 0.3, shard_rows: int = 4096, shard_chars: int = 32 << 20) -> DataFrame:
    """Score every row of ``docs`` for toxicity.

    The net learns from the whole texts of all labelled rows outside fold ``held``, dealt by hash into shards of about ``shard_rows`` (see ``fit``).
    Scoring reads whole texts of any length.  The threshold of the guessed language is mapped to ``threshold``.  A null or empty text has no words and gets the
    net's score of that; rows with a null id are scored only; without labels of both kinds the score is 0.
    Returns doc_id, held_out, score and predicted.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang", F.coalesce(fold("doc_id", folds) == held, F.lit(True)).alias("held_out"))
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.coalesce(fold("doc_id", folds) != held, F.lit(False))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    labelled = known.count()
    net = None
    if labelled:
        n = max(labelled // shard_rows, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // shard_chars, 1)
        marks = spark.sparkContext.broadcast(slot_bitmap(known.select(F.xxhash64("doc_id").alias("id")), "id", 24))

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(marks.value[slot(b.column("mark").to_numpy().view(np.uint64), 24)])).drop_columns("mark")

        def coded(key, texts, kinds):
            toxic: dict = {}
            for d, y in zip(kinds.column("doc_id").to_pylist(), kinds.column("toxic").to_pylist()):
                toxic.setdefault(d, []).append(y)
            found = zip(*(texts.column(c).to_pylist() for c in ("doc_id", "text", "lang")))
            langs, payload = _Shard.rows([(t or "", lang or "", y) for d, t, lang in found for y in toxic.get(d, ())], buckets)
            return pa.table({"langs": pa.array([langs], pa.list_(pa.string())), "payload": pa.array([payload], pa.binary())})

        shard = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")
        texts = rows.where("NOT held_out").select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("mark"))  # false marks find no label below
        texts = texts.mapInArrow(marked, StructType(texts.select("doc_id", "text", "lang").schema.fields)).withColumn("shard", shard)
        known = known.withColumn("doc_id", F.col("doc_id").cast(texts.schema["doc_id"].dataType)).withColumn("shard", shard)
        shards = texts.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(coded, "langs array<string>, payload binary")
        net = fit(staged(shards, "toxic-shards"), buckets=buckets)
    shared = spark.sparkContext.broadcast(net)  # buckets x dim floats
    kind = rows.schema["doc_id"].dataType.simpleString()
    shift = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, places = shared.value, {}
        dim = net.embed.shape[1] if net else 1
        table = np.zeros((0, dim + (len(net.languages) if net else 0)), np.float32)
        for b in pieces(batches, limit=1 << 20):
            if net is None:
                score = np.zeros(b.num_rows)
            else:
                split = [(x or "").split() for x in b.column("text").to_pylist()]
                if len(places) > 300_000:
                    places, table = {}, table[:0]
                words = [w for x in split for w in x]
                new = [w for w in dict.fromkeys(words) if w not in places]
                if new:
                    ids = np.array([word_ids(w, buckets) for w in new])
                    places.update(zip(new, range(len(places), len(places) + len(new))))
                    table = np.concatenate([table, np.concatenate([net.embed[ids].sum(1), net.tongue[ids].sum(1)], 1)])
                at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                sizes = np.array([len(x) for x in split])
                z = net.logits(_padded(table[at, :dim], sizes), sizes)
                cut = np.zeros(len(sizes))
                ends = np.cumsum(sizes)
                for i, (n, end) in enumerate(zip(sizes, ends)):
                    lang = int(table[at[end - n : end], dim:].sum(0).argmax()) if n and net.languages else 0
                    cut[i] = net.cuts[lang]
                score = 1 / (1 + np.exp(-np.clip(z - cut + shift, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
