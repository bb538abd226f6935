"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import fold, mix, pieces
from strandline.storage import staging_path

_SPACE = 32
#: Odd multipliers, one for each distance from the predicted character.
_STEP = [np.uint64(x) for x in mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)]
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


@dataclass
class CharModels:
    """Per order: sorted hashes with log probabilities, and sorted history hashes with log back-off weights, a column per language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    histories: list[tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    bits: int


def _events(tokens: list[str], order: int):
    """What the models predict in ``tokens``: letters, and the end of each run of letters.

    Gives the running sums of each order's hash at every event, the length of its history
    (inside the word, its leading space included), and the token it belongs to.
    """
    text = " " + " ".join(tokens) + " "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    token = np.cumsum(codes == _SPACE) - 1
    letter = _LETTER[codes]
    codes = np.where(letter, codes, _SPACE)
    event = letter.copy()
    event[1:] |= letter[:-1]
    at = np.flatnonzero(event)
    gap = np.where(letter, 0, np.arange(len(codes)))
    last = np.maximum.accumulate(gap)  # the latest space at or before each place
    history = np.minimum(at - last[at - 1], order - 1)
    values = (codes + 1).astype(np.uint64)
    sums, h = [], np.zeros(len(at), np.uint64)
    for k in range(order):
        h = h + values[np.maximum(at - k, 0)] * _STEP[k]
        sums.append(h)
    past, h = [np.zeros(len(at), np.uint64)], np.zeros(len(at), np.uint64)
    for k in range(order - 1):
        h = h + values[np.maximum(at - 1 - k, 0)] * _STEP[k]
        past.append(h)
    leads = [codes[np.maximum(at - k, 0)] == _SPACE for k in range(order)]
    owner = np.where(letter[at], token[at], token[at - 1])
    return sums, past, leads, history, owner


def _folded(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    return (mix(h + _STEP[8 + k]) >> np.uint64(64 - bits)).astype(np.int64)


_COUNTS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("gram", pa.int64()), ("past", pa.int64()), ("rest", pa.int64()), ("lead", pa.bool_()), ("n", pa.int64())])


def _counts(order: int, bits: int, most_words: int = 300_000):
    """Task function: (lang, text) rows to (lang, k, gram, past, rest, lead, n)."""

    def flush(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            sums, past, leads, history, owner = _events(list(c), order)
            weight = np.fromiter(c.values(), np.int64, len(c))[owner]
            for k in range(1, order + 1):
                ok = history >= k - 1
                frame = pd.DataFrame(
                    {
                        "gram": _folded(sums[k - 1][ok], k, bits), "past": _folded(past[k - 1][ok], k, bits),
                        "rest": _folded(sums[k - 2][ok], k - 1, bits) if k > 1 else 0,
                        "lead": leads[k - 1][ok] if k > 1 else False, "n": weight[ok],
                    }
                )
                frame = frame.groupby(["gram", "past", "rest", "lead"], as_index=False)["n"].sum()
                frame.insert(0, "k", k)
                frame.insert(0, "lang", lang)
                yield pa.RecordBatch.from_pandas(frame, _COUNTS, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for b in pieces(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                counts[lang].update(text.lower().split())
            if sum(map(len, counts.values())) > most_words:
                yield from flush(counts)
                counts.clear()
        yield from flush(counts)

    return run


def fit(docs: DataFrame, *, order: int = 5, bits: int = 18) -> CharModels:
    """Interpolated Kneser-Ney models of the languages in ``lang``.

    Every row counts: tasks count the n-grams of their own rows, Spark adds them up, and the sums
    (at most ``2**bits`` hashes per language and order, whatever the corpus) give the models.
    Orders below the highest use the number of distinct left neighbours, except for runs that start
    a word, which have none.  A word is a run of letters; histories don't reach over its start.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    counts = known.mapInArrow(_counts(order, bits), "lang string, k int, gram long, past long, rest long, lead boolean, n long")
    rows = counts.groupBy("lang", "k", "gram", "past", "rest", "lead").agg(F.sum("n").alias("n"))
    table = rows.toArrow().to_pandas()
    languages = sorted(table["lang"].unique())
    columns = {lang: i for i, lang in enumerate(languages)}
    wide = [(np.unique(table.loc[table.k == k, "gram"].to_numpy()), np.unique(table.loc[table.k == k, "past"].to_numpy())) for k in range(1, order + 1)]
    models = CharModels(
        languages,
        [(g, np.full((len(g), len(languages)), np.nan, np.float32)) for g, _ in wide],
        [(p, np.zeros((len(p), len(languages)), np.float32)) for _, p in wide],
        np.zeros(len(languages), np.float32),
        bits,
    )
    for lang, own in table.groupby("lang"):
        i, lower = columns[lang], None
        by_order = {k: x for k, x in own.groupby("k")}
        for k in range(1, order + 1):
            x = by_order.get(k)
            if x is None:
                break
            x = x.copy()
            if k < order and k + 1 in by_order:
                left = by_order[k + 1].groupby("rest").size()
                x["n"] = np.where(x["lead"], x["n"], np.maximum(x["gram"].map(left).fillna(0), 1))
            x = x.groupby(["gram", "past", "rest"], as_index=False)["n"].sum()
            once, twice = (x["n"] == 1).sum(), (x["n"] == 2).sum()
            discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
            by_past = x.groupby("past")["n"].agg(["sum", "size"])
            back = discount * by_past["size"] / by_past["sum"]
            share = (x["n"] - discount).clip(lower=0) / x["past"].map(by_past["sum"])
            if lower is None:
                uniform = 1.0 / (len(x) + 256)
                models.floor[i] = np.log(back.iloc[0] * uniform)
                p = share + back.iloc[0] * uniform
            else:
                p = share + x["past"].map(back) * x["rest"].map(lower).fillna(np.exp(models.floor[i]))
            lower = p.groupby(x["gram"]).sum().clip(upper=1.0)
            hashes, logs = models.grams[k - 1]
            logs[np.searchsorted(hashes, lower.index), i] = np.log(lower)
            hashes, logs = models.histories[k - 1]
            logs[np.searchsorted(hashes, back.index), i] = np.log(back)
    return models


def _find(hashes: np.ndarray, values: np.ndarray, wanted: np.ndarray, absent: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(hashes, wanted), max(len(hashes) - 1, 0))
    if not len(hashes):
        return np.full((len(wanted), values.shape[1]), absent, np.float32)
    return np.where((hashes[at] == wanted)[:, None], values[at], np.float32(absent))


def token_scores(models: CharModels, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each token under each language, and its number of events."""
    order, width = len(models.grams), len(models.languages)
    out, lengths = np.zeros((len(tokens), width)), np.zeros(len(tokens), np.int64)
    sums, past, _, history, owner = _events(tokens, order)
    if not len(owner):
        return out, lengths
    key = mix(np.stack(sums)[history, np.arange(len(owner))] + _STEP[15] * history.astype(np.uint64))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    done, weight = np.full((len(first), width), np.nan, np.float32), np.zeros((len(first), width), np.float32)
    for k in range(order, 0, -1):
        rows = np.flatnonzero(history[first] >= k - 1)
        at = first[rows]
        p = _find(*models.grams[k - 1], _folded(sums[k - 1][at], k, models.bits), np.nan)
        new = np.isnan(done[rows]) & ~np.isnan(p)
        done[rows] = np.where(new, p + weight[rows], done[rows])
        if k > 1:
            back = _find(*models.histories[k - 1], _folded(past[k - 1][at], k, models.bits), 0.0)
            weight[rows] += np.where(np.isnan(done[rows]), back, 0)
    done = np.where(np.isnan(done), models.floor + weight, done)
    np.add.at(lengths, owner, 1)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    out[owner[starts]] = np.add.reduceat(done[inverse], starts, axis=0)
    return out, lengths


def _scores(models, most_words: int = 300_000):
    """Task function: adds the cross-entropies of each text to its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = models.value, {}
        table, sizes = np.zeros((0, len(m.languages))), np.zeros(0, np.int64)
        for b in pieces(batches):
            split = [(x or "").lower().split() for x in b.column("text").to_pylist()]
            if len(seen) > most_words:
                seen, table, sizes = {}, table[:0], sizes[:0]
            new = list({w for words in split for w in words if w not in seen})
            if new:
                seen.update(zip(new, range(len(seen), len(seen) + len(new))))
                scores, lengths = token_scores(m, new)
                table, sizes = np.concatenate([table, scores]), np.concatenate([sizes, lengths])
            lang, score, entropy = [], [], []
            for words in split:
                rows = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
                n = int(sizes[rows].sum())
                if not n or not m.languages:
                    lang.append("und"), score.append(0.0), entropy.append(None)
                    continue
                h = -table[rows].sum(0) / n
                best = int(np.argmin(h))
                lang.append(m.languages[best])
                score.append(float(1 / np.exp(-12 * (h - h[best])).sum()))
                entropy.append(float(h[best]))
            kept = [b.column(x) for x in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score", "entropy"],
            )

    return run


def classify(docs: DataFrame, models: CharModels) -> DataFrame:
    """Language of each row of (doc_id, held_out, text): the lowest length-normalised cross-entropy.

    A null text or one without letters is ``und`` with score 0.  Ties go to the first language in
    alphabetical order.  ``score`` sets the best entropy against the others'.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by languages, orders and bits
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        _scores(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, entropy double"
    )


def identify(docs: DataFrame, *, folds: int = 5, held: int = 0) -> DataFrame:
    """Learn from the rows outside fold ``held`` and classify all rows.

    The rejection limit of a language is the mean plus four standard deviations of the entropy of all its own
    learned rows that get it; fewer than 20 give no limit.
    Rows with a null id are classified, not learned from.  Columns besides doc_id, text and lang are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", "lang", F.coalesce(fold("doc_id", folds) == held, F.lit(True)).alias("held_out"))
    models = fit(rows.where("NOT held_out"))
    path = staging_path(spark, "entropies")
    classify(rows.select(F.struct("doc_id", "lang").alias("doc_id"), "held_out", "text"), models).write.parquet(path)
    scored = spark.read.parquet(path)
    stats = scored.where("NOT held_out AND doc_id.lang = lang_pred").groupBy("lang_pred").agg(F.avg("entropy").alias("m"), F.stddev("entropy").alias("s"), F.count("entropy").alias("n"))
    limits = [F.when(F.col("lang_pred") == r["lang_pred"], r["m"] + 4 * r["s"]) for r in stats.where("n >= 20").collect()]  # a row for each language
    rejected = F.coalesce(F.col("entropy") > F.coalesce(*limits, F.lit(float("inf"))), F.lit(True))
    return scored.select("doc_id.doc_id", "held_out", "lang_pred", "score", "entropy", rejected.alias("rejected"))
