"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import WordHashes, fold, kept_schema, pieces, raw, shingles, tidy, unpacked, with_kept

_SYMBOLS = frozenset(b"#*$%&|<>{}[]\\^~=+_")
#: Traits of one word, averaged over a text.
_TRAITS = 9
WIDTH = _TRAITS + 6


def _traits(word: bytes) -> tuple[float, ...]:
    w = word.decode("utf-8", "replace")
    letters = sum(map(str.isalpha, w))
    return (
        min(len(w), 40) / 10.0,
        float(letters > 1 and w.isupper()),
        float(any(c in _SYMBOLS for c in word)),
        float(word.endswith(b"!!")),
        float(not any(map(str.isalnum, w))),
        float(any(map(str.isdigit, w))),
        float(w[:1].isupper()),
        float(b"://" in word or b"@" in word),
        1.0 - letters / len(w),
    )


class _Traits:
    """Traits of the words seen, up to ``most`` of them, in one growing table."""

    def __init__(self, most: int):
        self.most, self.places, self.table = most, {}, np.zeros((0, _TRAITS), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.places) > self.most:
            self.places, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.places]
        if new:
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            self.table = np.concatenate([self.table, np.array([_traits(w) for w in new], np.float32)])
        return self.table[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]


def _describe(words: list[bytes], traits: np.ndarray, hashes: np.ndarray, lines: int) -> np.ndarray:
    n = len(words)
    if not n:
        return np.zeros(WIDTH)
    three = shingles(hashes, 3)
    again = 0.0
    if len(three):
        _, inverse, counts = np.unique(three, return_inverse=True, return_counts=True)
        again = float((counts[inverse] > 1).mean())
    some = max(1, n // 200)  # distinct words in runs of about 200, so that length doesn't matter
    spans = np.array_split(hashes, some)
    distinct = float(np.mean([len(np.unique(s)) / len(s) for s in spans]))
    return np.concatenate([traits.mean(0), [np.log1p(n) / 5, np.log1p(lines / n), distinct, float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0, again, float(traits[:, 0].std())]])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches, and a row of features for each whole text."""
    cache, table = WordHashes(), _Traits(300_000)
    for b in pieces(batches, limit=1 << 20):
        texts = raw(b)
        split = [t.split() for t in texts]
        words = [w for x in split for w in x]
        traits, hashes, at, out = table.of(words), cache.of(words), 0, []
        for text, x in zip(texts, split):
            out.append(_describe(x, traits[at : at + len(x)], hashes[at : at + len(x)], text.count(b"\n") + 1))
            at += len(x)
        yield b, np.stack(out)


@dataclass
class Net:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores neither was trained on.

    Above any cut, the unlabelled hold at least the positives' share times the prior; the cut whose upper
    confidence bound of that ratio is lowest gives the estimate.
    """
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(positive)) + np.sqrt(np.log(4 / delta) / 2 / len(unlabelled))
    best = int(np.argmin((u + slack) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / p[best], 0.05, 0.95))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, *, hidden: int = 24, epochs: int = 60, rate: float = 0.01, seed: int = 7) -> Net:
    """Minimise the non-negative risk (``prior`` given), or plain logistic loss of positive against unlabelled."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    net = Net(mean, scale, rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), 0.0, prior or 0.5)
    moments = [[0.0, 0.0] for _ in range(4)]
    step, size = 0, 512
    for _ in range(epochs):
        mixed = rng.permutation(len(unlabelled))
        for at in range(0, len(mixed), size):
            u = unlabelled[mixed[at : at + size]]
            p = positive[rng.integers(0, len(positive), len(u))]
            x = np.clip((np.concatenate([p, u]) - mean) / scale, -8, 8)
            h = np.tanh(x @ net.w1 + net.b1)
            z = h @ net.w2 + net.b2
            n = len(p)
            s = _sigmoid(z)
            if prior is None:
                g = np.concatenate([(s[:n] - 1), s[n:]]) / n
            else:
                slope = s * (1 - s) / n  # of the sigmoid loss
                rest = s[n:].mean() - prior * s[:n].mean()
                if rest >= 0:
                    g = np.concatenate([-2 * prior * slope[:n], slope[n:]])
                else:  # the negative part may not fall below zero: step back from it
                    g = np.concatenate([prior * slope[:n], -slope[n:]])
            gh = np.outer(g, net.w2) * (1 - h * h)
            step += 1
            for i, (name, grad) in enumerate((("w1", x.T @ gh + 1e-4 * net.w1), ("b1", gh.sum(0)), ("w2", h.T @ g + 1e-4 * net.w2), ("b2", g.sum()))):
                m = moments[i]
                m[0] = 0.9 * m[0] + 0.1 * grad
                m[1] = 0.999 * m[1] + 0.001 * grad * grad
                setattr(net, name, getattr(net, name) - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
    return net


def train(positive: np.ndarray, unlabelled: np.ndarray) -> Net | None:
    """Estimate the class prior on one half of the rows, then fit on all of them; None without rows."""
    if not len(positive) or not len(unlabelled):
        return None
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.permutation(positive), rng.permutation(unlabelled)
    if len(positive) >= 4 and len(unlabelled) >= 4:
        side = _fit(positive[::2], unlabelled[::2], None, epochs=20)
        prior = estimate_prior(side.logits(positive[1::2]), side.logits(unlabelled[1::2]))
    else:
        prior = 0.5
    return _fit(positive, unlabelled, prior)


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1, positives: int = 6000, unlabelled: int = 12000, keep: list[str] | None = None) -> DataFrame:
    """Score every row of ``docs`` for quality.

    Trusted positives are documents labelled ``quality = 1`` outside fold ``held``, at most ``positives`` of them
    by hash; the unlabelled are at most ``unlabelled`` of all documents outside that fold.  Negative labels are not
    used.  Both samples leave the executors as rows of 15 numbers; the net is fitted on the driver.  Nothing but
    ids and labels is shuffled.

    A null text is an empty one and gets the score of no words; rows with a null id are scored and not learned from;
    without positives the score is 0.5 everywhere.  Repeated labels of a document count once.  Returns doc_id (or ``kept``, a struct
    of the columns ``keep``), held_out, score (of the text only) and predicted (1 from 0.5).
    """
    spark = docs.sparkSession
    outside = F.coalesce(fold("doc_id", folds) != held, F.lit(False))

    def pick(ids: DataFrame, most: int) -> DataFrame:
        return ids.where(outside).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    chosen = pick(labels.where("quality = 1"), positives).withColumn("trusted", F.lit(1)).unionByName(pick(docs, unlabelled).withColumn("trusted", F.lit(0)))
    chosen = chosen.groupBy("doc_id").agg(F.max("trusted").alias("trusted"), F.min("trusted").alias("mixed"))  # at most the two bounds together

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _features(batches):
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("trusted"), b.column("mixed"), lists], names=["trusted", "mixed", "features"])

    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "trusted", "mixed").mapInArrow(tidy(sample), "trusted int, mixed int, features array<double>").toArrow()
    x = np.array(got.column("features").to_pylist(), float).reshape(-1, WIDTH)
    trusted, mixed = got.column("trusted").to_numpy(), got.column("mixed").to_numpy()
    order = np.lexsort(x.T)  # whatever the order in which rows arrived
    x, trusted, mixed = x[order], trusted[order], mixed[order]
    shared = spark.sparkContext.broadcast(train(x[trusted == 1], x[mixed == 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b, x in _features(batches):
            score = _sigmoid(4 * net.logits(x)) if net else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("kept"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["kept", "held_out", "score", "predicted"])

    rows = with_kept(docs, keep, held_out=~outside, text=F.col("text"))
    return unpacked(rows.mapInArrow(tidy(run), kept_schema(rows, "held_out boolean, score double, predicted int")), keep)
