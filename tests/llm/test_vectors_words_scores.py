"""Whitening, spelling variants and language-model scores against plain versions, with awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from strandline.llm import pitman_yor, spelling, whitening

VECTORS = "vec_id long, embedding array<float>, n int, component string, x string, `a.b` int"
TEXTS = "doc_id long, text string, n_tokens string, key int, word string, kind int, `a.b` string"


def _vectors():
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((5, 5))
    good = [(i, [float(v) for v in row]) for i, row in enumerate((rng.standard_normal((40, 5)) @ mix).astype(np.float32))]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [1.0, float("inf"), 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    return good + [(None, good[0][1]), good[1], (107, good[2][1])] + [(200 + i, good[3][1]) for i in range(50)], bad


def test_whitening_is_exact(spark):
    good, bad = _vectors()
    rows = spark.createDataFrame([(i, v, 1, "c", "x", 2) for i, v in good + bad], VECTORS).repartition(4)
    out = whitening.whiten(rows, components=4).toPandas()
    x = {i: tuple(math.floor(64 * c) + 1_000_000 for c in v) for i, v in good}
    fit = sorted(set(x.values()))
    n, dim = len(fit), 5
    s = [sum(v[j] for v in fit) for j in range(dim)]
    cov = [[sum((Fraction(v[i]) - Fraction(s[i], n)) * (Fraction(v[j]) - Fraction(s[j], n)) for v in fit) / n for j in range(dim)] for i in range(dim)]
    v = np.array([[float(c) for c in r] for r in cov])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert len(out) == 4 * len(good) and (out.n == n).all() and out.identity_error.max() < 1e-12
    for r in out.dropna().itertuples():
        k, own = r.component - 1, x[r.vec_id]
        assert int(r.deviation) == sum((n * a - b) ** 2 for a, b in zip(own, s))
        want = (np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(own, s)]) @ u[:, k]) / math.sqrt(e[k])
        assert abs(abs(r.whitened) - abs(want)) < 1e-9 and abs(r.explained - e[k] / e.sum()) < 1e-12
    signs = out[out.vec_id.isin([3, 220])].groupby("component").whitened.nunique()
    assert (signs == 1).all(), "copies get one value"


def test_whitening_of_little(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(empty).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "", "", 0)] * 3, VECTORS)).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 for r in one)
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0], 1, "", "", 0) for i in range(9)], VECTORS)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-12


def test_refinement_separates_clusters():
    rng = np.random.default_rng(5)
    for values in (np.linspace(1, 50, 24), np.r_[np.full(8, 3.0), np.full(8, 3.0 + 1e-7), np.arange(4, 12)], np.r_[1.0, np.zeros(23)]):
        q = np.linalg.qr(rng.standard_normal((24, 24)))[0].astype(np.longdouble)
        for _ in range(3):
            q = q + q @ (np.eye(24) - q.T @ q) / 2
        a = (q * values.astype(np.longdouble)) @ q.T
        a = (a + a.T) / 2
        start = np.linalg.eigh(a.astype(np.float32))[1]
        w, x = whitening.refine(a, start)
        assert np.abs(a @ x - x * w).max() < 1e-15 and np.abs(x.T @ x - np.eye(24)).max() < 1e-15
        assert np.abs(np.sort(w) - np.sort(values)).max() < 1e-14
    y = rng.integers(-(2**45), 2**45, (5000, 3))
    assert (whitening.exact_gram(y) == y.astype(object).T @ y.astype(object)).all()


def _one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _spelling(rows, least_n, modulus=199):
    c = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % modulus == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    c = {w: n for w, n in c.items() if len(w) >= 6 and n >= least_n}
    near = {w: [v for v in c if v != w and _one_apart(v, w)] for w in c}
    form = {}
    for w in c:
        best = min(near[w], key=lambda v: (-c[v], v), default=None)
        if best is not None and c[best] >= 5 * c[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), n, len(near[w]), c[form[w]] if w in form else None) for w, n in c.items())


@pytest.mark.parametrize("most", [64, 1])
def test_spelling_variants(spark, most):
    rng = random.Random(8)
    words = ["".join(rng.choice("abÀé") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["prefixprefix" + a + b for a in "abcdefgh" for b in ("", "x", "yz")] + ["a" * 40, "a" * 41, "a" * 39 + "b"]
    # chains: each word is one edit from the next and five times as frequent
    chain = [("chainabcdef"[: 11 - k], 5 ** (k + 1)) for k in range(4)]
    texts = [(i, " ".join(rng.choice(words).title() for _ in range(200))) for i in range(30)]
    texts += [(100 + k, f"{w}; " * n) for k, (w, n) in enumerate(chain)]
    texts += [(500, None), (501, ""), (None, "nowhere " * 7), (502, "Repeated×÷ words " * 20000), (503, "x" * 100_000)] + [texts[0]] * 3
    df = spark.createDataFrame([(i, t, "n", 1, "w", 2, "s") for i, t in texts], TEXTS).repartition(3)
    got = Counter(map(tuple, spelling.spelling_groups(df, most=most, drop_modulus=7).collect()))
    assert got == _spelling(texts, 5, 7)
    assert spelling.spelling_groups(spark.createDataFrame([], TEXTS)).count() == 0


def test_a_common_prefix_is_not_listed_as_pairs(spark):
    rng = random.Random(9)
    words = sorted({"commonprefix" + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)})
    got = {tuple(sorted(r)) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    mates = defaultdict(list)
    for w in words:
        for k in range(12, 18):
            mates[w[:k] + "*" + w[k + 1 :]].append(w)
    assert got == {(a, b) for g in mates.values() for a in g for b in g if a < b}


def test_seating_draws_from_its_distribution():
    rng = np.random.default_rng(0)
    d, strength, p, others, c = 0.6, 1.0, 0.02, 10.0, 6

    def ways(n, t):
        if n == 1:
            return float(t == 1)
        return (ways(n - 1, t - 1) if t > 1 else 0.0) + ((n - 1 - d * t) * ways(n - 1, t) if t < n else 0.0)

    want = np.array([ways(c, t) * np.prod([(strength + d * (others + k)) * p for k in range(t)]) for t in range(1, c + 1)])
    m = 20000
    small = pitman_yor._seat_small(np.full(m, c), np.full(m, others), np.full(m, p), d, strength, rng)
    large = None
    for _ in range(25):
        large = pitman_yor._seat_large(np.full(m, c), large, np.full(m, others), np.full(m, p), d, strength, rng, 4)
    assert all(s.sum() == c and (s > 0).all() for s in large)
    for tables in (small, np.array([len(s) for s in large])):
        assert np.abs(np.bincount(tables, minlength=c + 1)[1:] / m - want / want.sum()).max() < 0.015


def test_large_dishes_are_seated_whole():
    """After one sweep the tables of 400 customers follow their law, though they began far from it."""
    rng, strength, m, c = np.random.default_rng(1), 1.0, 4000, 400
    for d, others, p in ((0.6, 50.0, 0.3), (0.75, 2000.0, 0.1), (0.5, 3.0, 1e-4), (0.9, 30.0, 0.9)):
        ways = np.full((c + 1, c + 2), -np.inf)
        ways[1, 1] = 0.0
        for n in range(1, c):
            t = np.arange(1, n + 2)
            ways[n + 1, 1 : n + 2] = np.logaddexp(ways[n, t - 1], ways[n, t] + np.log(np.maximum(n - d * t, 1e-300)))
        t = np.arange(1, c + 1)
        assert np.abs(pitman_yor.log_ways(np.full(c, c), t, d) - ways[c, 1 : c + 1]).max() < 1e-4
        want = ways[c, 1 : c + 1] + np.cumsum(np.log((strength + d * (others + t - 1)) * p))
        want = np.exp(want - want.max())
        want /= want.sum()
        far = np.full(m, int(min(c, 2 + 2 * (want * t).sum())))
        tables = pitman_yor.seat(np.full(m, c), far, np.full(m, others), np.full(m, p), d, strength, rng, 6)
        assert abs(tables.mean() - (want * t).sum()) < 0.05 * (want * t).sum()
        assert 0.5 * np.abs(np.bincount(tables, minlength=c + 1)[1:] / m - want).sum() < 0.1
    huge = pitman_yor.log_ways(np.array([10**4, 10**8]), np.array([1, 1]), 0.75)
    assert np.allclose(huge, [math.lgamma(n - 0.75) - math.lgamma(0.25) for n in (10**4, 10**8)], rtol=1e-9), "closed form of one table"


def _texts():
    rng = random.Random(4)
    follow = {w: [f"w{rng.randrange(60)}" for _ in range(3)] for w in (f"w{k}" for k in range(60))}
    rows = []
    for i in range(150):
        w, out = "w0", []
        for _ in range(60):
            w = rng.choice(follow[w])
            out.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(out)))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n\x0b "), (None, rows[0][1]), (None, None), rows[3], (1003, "neverseen É words"), (1004, "w1 " * 30000)]


@pytest.mark.parametrize("sizes", [{}, {"bucket_chars": 5000, "block_bytes": 4000}])
def test_scores(spark, sizes):
    rows = _texts()
    df = spark.createDataFrame([(i, t, "n", 1, "w", 2, "s") for i, t in rows], TEXTS).coalesce(2)
    out = pitman_yor.score_texts(df, **sizes).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    key = lambda i, t: (i if i is not None else -1, held(i), len(tokens(t)), sum(w in count for w in tokens(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
    assert Counter((r[0] if r[0] is not None else -1, *r[1:5], round(r[5], 6)) for r in out) == Counter(key(i, t) for i, t in rows)
    learned = [r for r in out if r["held_out"] and r["n_tokens"] == 61]
    assert learned and all(r["score"] > r["base_score"] * 0.75 for r in learned), "contexts tell the next word"
    assert all(r["score"] < 0 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (0, None) and r["n_tokens"] == 61}) == 1, "equal texts score alike"


def test_texts_of_one_word_share_less_than_one(spark):
    """All texts of at most one word (known, or the unknown one) are disjoint outcomes, so their probabilities add up to less than one."""
    rows = [(i, t) for i, t in _texts() if t and i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    vocabulary = sorted({w for _, t in rows for w in t.lower().split()})
    asks = [(None, w) for w in [*vocabulary, "unknownword"]] + [(None, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "n", 1, "w", 2, "s") for i, t in rows + asks], TEXTS).coalesce(1)
    ends = {}
    for r in pitman_yor.score_texts(df).collect():
        if r["doc_id"] is None:
            ends.setdefault(r["n_tokens"], []).append(r["score"])
    empty = ends[1][0]
    # P(word after start) * P(end after word), and P(end after start)
    total = sum(10**s for s in ends[2]) + 10**empty
    assert len(ends[2]) == len(vocabulary) + 1 and 0 < total < 1


def test_scores_of_nothing(spark):
    empty = spark.createDataFrame([], TEXTS)
    assert pitman_yor.score_texts(empty).count() == 0
    unknown = pitman_yor.score_texts(spark.createDataFrame([(None, "a b", "", 1, "", 1, "")], TEXTS)).collect()
    assert unknown[0]["n_known"] == 0 and unknown[0]["score"] == unknown[0]["base_score"] == 0 and unknown[0]["train_tokens"] == 0
