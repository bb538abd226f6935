"""Corpus operators against brute force, round trips and held-out accuracy, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from strandline.llm import decontamination, extraction, language_id, quality_classifier, quality_rules, sharding, shingle_join, substrings, subwords, toxicity

SF = "/root/testdata/sf0.01"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept long, n_words string, leaks int, `a.b` string, key int, spans string"


def _prose(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{rng.randrange(pool)}" + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


def awkward() -> list[tuple]:
    """Null, empty, blank and very long texts, null ids and hosts, copies, near copies, repeated rows."""
    rng = random.Random(5)
    base = [_prose(rng, n) for n in (3, 4, 49, 50, 51, 60, 120, 300)]
    near = base[7].split(" ")
    near[150] = "changed"
    texts = [None, "", " \t\n\r\x0b\x0c ", "a", "A b", "a B", *base, base[7], base[7], " ".join(near), base[6] + " tail", "lead " + base[6], "x " * 30000, base[7] * 40, "  ▁ é漢🎉\x1c", "same line\nsame line\nSame  line\n\n" * 30]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"h{i % 2}") for i, t in enumerate(texts)]
    rows += [(None, base[7], "en", "h0"), (None, None, None, None), (7, rows[7][1], "en", "h1"), rows[8], rows[8], (9, "another text of one id", None, "h1")]
    return [(i, t, lang, src, None if t is None else len(t), "r", 1, "w", 2, "d", 3, "s") for i, t, lang, src in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return SPLIT.findall(text or "")


def test_sharding(spark, docs, empty):
    out = sharding.shard_by_bytes(docs, 4).toPandas()
    rows = awkward()
    assert len(out) == len(rows) and sharding.shard_by_bytes(empty, 4).count() == 0
    want = Counter((r[0], len((r[1] or "").encode()) + 8) for r in rows)
    assert Counter((None if pd.isna(i) else int(i), s) for i, s in zip(out.doc_id, out["size"])) == want
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    crc = {r[0]: zlib.crc32(r[1].encode()) for r in rows if r[0] is not None and r[0] > 9 and r[1] is not None}
    assert all(crc[i] == c for i, c in zip(out.doc_id, out.text_crc32) if i in crc)
    out = out.sort_values(["shard", "slot"])
    assert out.doc_id.dropna().is_monotonic_increasing
    total, before = out["size"].sum(), out["size"].cumsum() - out["size"]
    assert ((before * 2 + out["size"]) * 4 // (2 * total) == out["shard"]).all()
    hot = spark.range(2000).selectExpr("7L AS doc_id", "'abc' AS text")
    sizes = sharding.shard_by_bytes(hot, 8).groupBy("shard").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1


def _rules(rows, limit, share):
    """Brute force of the rules; a document is a distinct (id, host, text)."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"))
    held, hosts = defaultdict(set), defaultdict(set)
    lines = lambda t: [x for x in (t or "").split("\n") if words(x)]
    for i, t, src in rows:
        hosts[src].add((i, t))
        for x in lines(t):
            held[src, norm(x)].add((i, t))
    out = []
    for i, t, src in rows:
        w = words(t)
        where = defaultdict(list)
        for k in range(len(w) - 2):
            where[tuple(w[k : k + 3])].append(k)
        again = {k + d for v in where.values() if len(v) > 1 for k in v for d in range(3)}
        gone = sum(len(words(x)) for x in lines(t) if len(held[src, norm(x)]) >= limit and len(held[src, norm(x)]) > share * len(hosts[src]))
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        out.append((i, len(w), sum(map(len, w)), symbols, len(lines(t)) - len(set(lines(t))), len(again), gone, failed, not failed and 2 * gone <= len(w)))
    return Counter(out)


def test_quality_rules(docs, empty):
    rows = [(r[0], r[1], r[3]) for r in awkward()]
    for limit, share in ((2, 0.1), (3, 0.3)):
        got = quality_rules.quality_rules(docs, min_docs=limit, host_share=share).collect()
        assert Counter(map(tuple, got)) == _rules(rows, limit, share)
    assert quality_rules.quality_rules(empty).count() == 0
    clean = {r["doc_id"]: r["clean_text"] for r in quality_rules.quality_rules(docs, min_docs=2, host_share=0.0, keep_text=True).collect()}
    assert clean[0] == "" and "same line" in clean[len(awkward()) - 7]


def test_language(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.identify(table).toPandas().merge(table.select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and out.score.between(0, 1).all()
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert got[0]["lang_pred"] == "und" and got[1]["lang_pred"] == "und" and got[2]["score"] == 0
    assert {r["lang_pred"] for r in got.values()} == {"und", "en"}
    assert language_id.identify(empty).count() == 0


def test_a_rare_language_has_a_rejection_limit(spark):
    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choices(letters, weights=range(1, 40, 5)[: len(letters)], k=6)) for _ in range(40))
    rows = [(i, text("abcdefgh"), "en") for i in range(4000)] + [(4000 + i, text("stuvwxyz"), "xx") for i in range(30)]
    rows += [(None, " ".join("".join(rng.choices("stuv", k=9)) for _ in range(40)), None)]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("lang_pred = 'xx'").collect()
    assert len(out) == 31 and [r["rejected"] for r in out if r["doc_id"] is None] == [True]


def test_language_models_are_distributions(spark):
    """After any history, the learned characters and the floor for others add up to about one."""
    text = " ".join(random.Random(1).choices(["abba", "baba", "aab", "bab", "abc"], k=400))
    models = language_id.fit(spark.createDataFrame([(text, "x")], "text string, lang string"), order=3, bits=18)
    for start in ("", "a", "ab"):
        total = 0.0
        for c in "abc":
            with_c, _ = language_id.token_scores(models, [start + c])
            # the end of the word is predicted too: take it off again
            end, _ = language_id.token_scores(models, [start + c + c])
            total += np.exp(_prefix(models, start + c) - (_prefix(models, start) if start else 0.0))
            assert np.isfinite(with_c).all() and np.isfinite(end).all()
        total += 0.0 if not start else np.exp(language_id.token_scores(models, [start])[0][0, 0] - _prefix(models, start))
        assert 0.9 < total <= 1.001


def _prefix(models, word):
    """Log probability of the letters of a word, without its end."""
    sums, past, _, history, _ = language_id._events([word], len(models.grams))
    total = 0.0
    for i in range(len(word)):
        weight = 0.0
        for k in range(min(history[i] + 1, len(models.grams)), 0, -1):
            p = language_id._find(*models.grams[k - 1], language_id._folded(sums[k - 1][i : i + 1], k, models.bits), np.nan)[0, 0]
            if not np.isnan(p):
                break
            if k > 1:
                weight += language_id._find(*models.histories[k - 1], language_id._folded(past[k - 1][i : i + 1], k, models.bits), 0.0)[0, 0]
        total += weight + (models.floor[0] if np.isnan(p) else p)
    return total


def _auc(score, y):
    rank = score.rank()
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


def test_toxicity(spark, docs, empty):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = toxicity.classify(table, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[out.held_out]
    assert _auc(held.score, held.toxic) > 0.7 and ((out.score >= 0.3) == (out.predicted == 1)).all()
    odd = spark.createDataFrame([(i, 1, i % 2) for i in (3, 4, 6, 7, 8, 9)] + [(None, 1, 1), (8, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, odd).toPandas()
    assert len(got) == len(awkward()) and got.score.between(0, 1).all()
    assert set(toxicity.classify(docs, odd.limit(0)).toPandas().score) == {0.0}
    assert toxicity.classify(empty, odd).count() == 0


def test_quality_classifier(spark, docs, empty):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_classifier.classify(table, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[out.held_out]
    assert _auc(held.score, held.quality) > 0.95 and (held.predicted == held.quality).mean() > 0.95
    odd = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, 1), (999, 1)], "doc_id long, quality int")
    got = quality_classifier.classify(docs, odd, keep=docs.columns).select("kept.*", "score").toPandas()
    assert len(got) == len(awkward()) and got.score.between(0, 1).all() and "a.b" in got
    assert set(quality_classifier.classify(docs, odd.limit(0)).toPandas().score) == {0.5}
    assert quality_classifier.classify(empty, odd).count() == 0


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(0)
    positive, other = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    for prior in (0.3, 0.6, 0.85):
        mixed = np.where(rng.random(4000) < prior, rng.permutation(positive)[:4000], other)
        assert abs(quality_classifier.estimate_prior(rng.normal(2, 1, 4000), mixed) - prior) < 0.08


def _distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
        row = new
    return min(row)


def test_passages_within_the_edit_budget():
    rng, seen = random.Random(3), Counter()
    for _ in range(150):
        item = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(50, 90)))
        copy = list(item)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([["z"], [], [copy[k], "y"]])
        text = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 50))) + "".join(copy) + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 50)))
        index = decontamination.build([(1, item)], 4, 0.08)
        budget, edits = int(index.budgets[0]), _distance(item, text)
        got = decontamination.matches(index, text)
        assert bool(got) == (edits <= budget)
        assert not got or min(x[3] for x in got) == edits
        seen[bool(got)] += 1
    assert min(seen.values()) > 10


def test_leaks(spark, docs, empty):
    item = "The quick brown fox jumps over the lazy dog while seven wizards bake 12 pies at noon."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (1, item)], "item_id long, text string")
    rows = [(1, f"Intro. {item.upper()} end"), (2, item.replace(" ", "\n")), (3, "nothing"), (4, None), (5, ""), (6, item[:40]), (7, item.replace("lazy", "lzay") + item)]
    table = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, leaks int")
    got = {r["doc_id"]: r["leaks"] for r in decontamination.find_leaks(table, bench).collect()}
    assert [len(got[i]) for i in range(1, 8)] == [1, 1, 0, 0, 0, 0, 2]
    lo, hi = got[1][0]["start"], got[1][0]["end"]
    assert rows[0][1][lo:hi] == item.upper()[:-1]
    small = {r["doc_id"]: r["leaks"] for r in decontamination.find_leaks(table, bench, block_chars=10).collect()}
    assert small == got
    assert decontamination.find_leaks(empty, bench).count() == 0
    out = decontamination.find_leaks(docs, bench.limit(0), keep=docs.columns)
    assert out.select("kept.*").columns == docs.columns and out.count() == len(awkward())


def _components(rows, percent=85):
    """Smallest id reachable; a node is an id with all its texts."""
    sets = []
    for i, t in rows:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((i, frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


def test_jaccard_join(spark, docs, empty):
    rows = [(r[0], r[1]) for r in awkward()]
    got = shingle_join.near_duplicates(docs).collect()
    assert Counter(map(tuple, got)) == _components(rows)
    assert shingle_join.near_duplicates(empty).count() == 0


def test_jaccard_join_of_chains_and_hubs(spark):
    """Copies that drift by single words, groups around one text, and a line that all share."""
    rng, rows = random.Random(9), []
    for _ in range(6):
        text = _prose(rng, rng.randint(20, 90)).split(" ")
        for _ in range(9):
            rows.append((len(rows), "common line that every text has\n" + " ".join(text)))
            text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
    rng.shuffle(rows)
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = _components(rows)
    assert Counter(map(tuple, got)) == want and 6 < len({r[2] for r in want}) < 50


def test_hubs_over_batch_borders():
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"token": np.sort(rng.integers(0, 12, 40)), "row": rng.permutation(40), "n": rng.integers(50, 70, 40)})
    rows["component"] = rows["row"] % 7
    many = rows[rows.token.map(rows.token.value_counts()) > 1]
    want: Counter = Counter()
    for _, g in rows.groupby("token"):
        for k, x in enumerate(g.itertuples()):
            for h in list(g.itertuples())[: min(k, 3)]:
                if h.component != x.component and min(h.n, x.n) * 100 >= max(h.n, x.n) * 85:
                    want[h.row, x.row, h.n, x.n] += 1
    for size in (1, 2, 3, 7, 40):
        batches = [pa.RecordBatch.from_pandas(rows.iloc[i : i + size], preserve_index=False) for i in range(0, 40, size)]
        out = [(r["token"], r["row"]) for b in shingle_join._repeated(iter(batches)) for r in b.to_pylist()]
        assert sorted(out) == sorted(zip(many.token, many.row))
        got: Counter = Counter()
        for b in shingle_join._hub_pairs(3, 85)(iter(batches)):
            for r in b.to_pylist():
                got[r["a"], r["b"], r["na"], r["nb"]] += r["c"]
        assert got == want and want


def test_rows_of_the_first_rounds_follow_the_bands():
    """Sets that share many shingles meet once a band and hub, not once a shingle; sets that share a part by chance hardly meet."""
    rng = np.random.default_rng(21)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1))
    base, other = draw(300), draw(300)
    near = [np.unique(np.concatenate([rng.choice(base, len(base) - 8, replace=False), draw(8)])) for _ in range(60)]
    far = [np.unique(np.concatenate([rng.choice(other, 40, replace=False), draw(260)])) for _ in range(60)]
    bands = np.stack([shingle_join.set_bands(s, 8) for s in near + far])
    assert len(np.unique(bands)) > 60 * 8 and np.array_equal(bands[0], shingle_join.set_bands(near[0], 8))
    rows = pd.DataFrame({"token": bands.ravel(), "row": np.repeat(np.arange(120), 8), "n": 300, "component": np.repeat(np.arange(120), 8)}).sort_values(["token", "row"])
    out = [r for b in shingle_join._hub_pairs(2, 85)(iter([pa.RecordBatch.from_pandas(rows, preserve_index=False)])) for r in b.to_pylist()]
    assert sum(r["c"] for r in out) <= 60 * 8 * 2 and {r["b"] for r in out} >= set(range(5, 60)) and max(r["b"] for r in out) < 60
    assert len(shingle_join.set_bands(draw(1), 4)) == 4


def test_hub_rounds_make_no_row_for_each_common_shingle(spark, monkeypatch):
    """Copies that share most of their shingles meet a few times each; before, they met at every shingle of their prefixes."""
    rng, rows, task, made = random.Random(31), [], shingle_join._hub_pairs, spark.sparkContext.accumulator(0)
    for _ in range(3):
        text = _prose(rng, 400).split(" ")
        for _ in range(40):
            own = list(text)
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))

    def counted(*args):
        def run(batches):
            for b in task(*args)(batches):
                made.add(sum(b.column("c").to_pylist()))
                yield b

        return run

    monkeypatch.setattr(shingle_join, "_hub_pairs", counted)
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hubs=2)
    assert got.select("component_id").distinct().count() == 3
    assert 0 < made.value <= 2 * 4 * len(rows), made.value


def test_pairs_meet_where_both_have_the_need_left():
    """Many variants of one text, hardly any linked: no link is lost, and most pairs that only share frequent shingles are left out."""
    rng, sets = np.random.default_rng(11), []
    for i in range(60):
        base = np.arange(150)[rng.random(150) < rng.choice([0.96, 0.98, 1.0])]
        sets.append(np.concatenate([base, 1000 + 100 * i + np.arange(rng.choice([3, 14, 16, 18]))]))
    count = Counter(int(x) for s in sets for x in s)
    place = {x: i for i, x in enumerate(sorted(count, key=lambda x: (count[x], x)))}
    ranked = [np.sort([place[int(x)] for x in s]) for s in sets]
    held = Counter(int(x) for s in ranked for x in s[: len(s) - -(-85 * len(s) // 100) + 1])
    rows = []
    for i, s in enumerate(ranked):
        prefix = [int(x) for x in s[: len(s) - -(-85 * len(s) // 100) + 1] if held[int(x)] > 1]
        rows += [(x, i, len(s), i, len(prefix) - k) for k, x in enumerate(prefix)]
    table = pd.DataFrame(sorted(rows), columns=["token", "row", "n", "component", "rem"])
    pairs = lambda t: {(min(r["a"], r["b"]), max(r["a"], r["b"])) for b in shingle_join._hub_pairs(60, 85)(iter([pa.RecordBatch.from_pandas(t, preserve_index=False)])) for r in b.to_pylist()}
    linked = {(i, j) for j in range(60) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    every, met = pairs(table.drop(columns="rem")), pairs(table)
    assert linked and linked <= met <= every and 2 * len(met) < len(every)


def test_jaccard_join_of_variants_that_hardly_link(spark):
    """One text in many variants below the limit, some of them linked, and rows that come twice."""
    rng, rows = random.Random(12), []
    text = _prose(rng, 150).split(" ")
    for i in range(70):
        own = list(text)
        for _ in range(rng.choice([1, 3, 4, 5, 6])):
            own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += rows[:5]
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), hubs=1, rounds=1, hub_chunk=8).collect()
    want = _components(rows)
    assert Counter(map(tuple, got)) == want and 3 < len({r[2] for r in want}) < 70


def test_prefix_tree_walk():
    rng = np.random.default_rng(8)
    for block in (1, 3, 64):
        own = np.sort(rng.choice(200, 60, replace=False))
        partners = []
        for _ in range(60):
            keep = own[rng.random(60) < rng.choice([0.8, 0.95, 1.0])]
            partners.append(np.union1d(keep, rng.choice(200, rng.integers(0, 6))))
        order = sorted(range(60), key=lambda i: partners[i].tolist())
        rows = [{"a": 1, "chunk": 0, "b": None, "tokens": own}] + [{"a": 1, "chunk": 0, "b": i, "tokens": partners[i]} for i in order]
        kind = pa.schema([("a", pa.int64()), ("chunk", pa.int32()), ("b", pa.int64()), ("tokens", pa.list_(pa.int64()))])
        batches = [pa.RecordBatch.from_pylist(rows[i : i + 7], kind) for i in range(0, 61, 7)]
        got = {r["b"] for b in shingle_join._walk(85, block)(iter(batches)) for r in b.to_pylist()}
        want = {i for i, p in enumerate(partners) if 100 * len(np.intersect1d(own, p)) >= 85 * len(np.union1d(own, p))}
        assert got == want and want


def test_probes_of_component_trees():
    rng = np.random.default_rng(6)
    base = np.sort(rng.choice(400, 80, replace=False))
    vary = lambda p: np.union1d(base[rng.random(80) < p], rng.choice(400, rng.integers(0, 6)))
    rows, want = [], {}
    for tree in range(6):
        members = [(100 * tree + i, vary(0.93)) for i in range(12)]
        probes = [(1000 + 100 * tree + i, vary(rng.choice([0.8, 0.92, 1.0]))) for i in range(12)]
        for probe, group in ((False, members), (True, probes)):
            rows += [{"tree": tree, "chunk": 0, "salt": 0, "probe": probe, "row": r, "tokens": x} for r, x in sorted(group, key=lambda y: y[1].tolist())]
        for r, x in probes:
            want[r] = {m for m, y in members if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))}
    kind = pa.schema([("tree", pa.int64()), ("chunk", pa.int64()), ("salt", pa.int64()), ("probe", pa.bool_()), ("row", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    for block in (2, 64):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + 9], kind) for i in range(0, len(rows), 9)]
        got = {r["a"]: r["b"] for b in shingle_join._probe(85, block)(iter(batches)) for r in b.to_pylist()}
        assert set(got) == {r for r, m in want.items() if m} and all(b in want[a] for a, b in got.items())
    assert 10 < len(got) < len(want)


def test_probes_need_no_more_than_a_partner_of_any_size(spark):
    percent, rows = 85, []
    need = lambda a, b: max(1, -(-(a + b) * percent // (100 + percent)) - max(-(-a * percent // 100), -(-b * percent // 100)) + 1)
    for n in (1, 2, 7, 30, 50, 100, 150):
        sizes = range(-(-n * percent // 100), n * 100 // percent + 1)
        rows += [(n, low, high, min(need(n, m) for m in range(low, high + 1))) for low in sizes for high in range(low, sizes[-1] + 1)]
    got = spark.createDataFrame(rows, "n int, low int, high int, least int").withColumn("got", shingle_join._least_needed(F.col("n"), F.col("low"), F.col("high"), percent))
    assert got.where("got > least").count() == 0 and got.where("got < least - 1").count() == 0
    assert (100, 94, 107, 5) in rows and need(100, 107) == need(100, 94) == 6


def test_extraction(spark):
    page = (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
        "<header><div class='logo'>Site</div></header><nav><ul><li><a href='/a'>One</a></li></ul></nav><div class=\"cookie-notice\">We use cookies on this site</div>"
        "<article><h1>A title &amp; more</h1><p>First&nbsp;paragraph\n of <b>the  text<br>here</p><p>x</p><div class='ad'>Buy now</div><form><label>Mail</label></form>"
        "<!-- note > --><section id='comments'><p>Nice post, thanks a lot for all of it!</p></section></article><aside>Side bar text</aside><footer>&copy; me</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<<p <a<"), (5, "u", "<article><p>" + "word " * 50000 + "</p>"), (6, "u", "<!-- open"), (7, "u", "<p>1 &lt; 2 and a plain page of many words that nothing frames</p>")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in extraction.extract(table).collect()}
    assert got[1]["text"] == "A title & more\nFirst paragraph of the text here\nx"
    assert got[2]["text"] == "" and got[3]["n_chars"] == 0 and got[6]["text"] == ""
    assert got[5]["n_chars"] == 50000 * 5 - 1 and got[7]["text"].startswith("1 < 2")
    assert extraction.extract(table.limit(0)).count() == 0


def test_extraction_of_the_pages(spark):
    """The pages hold paragraphs of an article between frames."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_tree_fits_its_table():
    x, y = (np.array([r[i] for r in extraction.LABELLED], float) for i in (0, 1))
    assert (extraction.decide(extraction.default_tree(), x) == y).mean() > 0.95


def test_subwords_are_lossless_and_varied(spark, docs, empty):
    out = subwords.encode(docs, keep=docs.columns)
    rows = out.select("kept.*", "ids", "lossless", "n_tokens").collect()
    assert all(r["lossless"] if r["text"] is not None else r["ids"] is None and r["n_tokens"] is None for r in rows)
    back = subwords.decode(out.select("kept.doc_id", F.col("kept.text").alias("want"), "ids"))
    assert all(r["text"] == r["want"] for r in back.collect())
    codes = lambda df, **k: Counter((r["doc_id"], r["ids_crc32"]) for r in subwords.encode(df, **k).collect())
    assert codes(docs) == codes(docs.repartition(2))
    assert (codes(docs) - codes(docs, seed=2)).total() > 8
    assert subwords.encode(empty).count() == 0


def test_every_occurrence_of_a_word_is_cut_on_its_own():
    vocabulary, word = subwords.load(), " international"
    cuts = lambda ids: {tuple(ids[i]) for i in range(len(ids))}
    got = {n: cuts(subwords.Encoder(vocabulary, 0.1, 1).encode([word] * n, list(range(n)))) for n in (40, 400, 4000)}
    assert 4 < len(got[40]) < len(got[400]) < len(got[4000])
    inside = subwords.Encoder(vocabulary, 0.1, 1).encode([word * 400], [3])[0]
    assert inside != inside[: len(inside) // 400] * 400
    # kept nodes change nothing
    rng = random.Random(3)
    texts = ["".join(rng.choices([word, " the", " Straße", " 漢字", "\n", " x" * 30, " unbelievable"], k=60)) for _ in range(50)] + [""]
    one, two = (subwords.Encoder(vocabulary, 0.2, 5, least, most) for least, most in ((1, 300_000), (1 << 40, 9)))
    assert one.encode(texts[:25], list(range(25))) + one.encode(texts[25:], list(range(25, 51))) == two.encode(texts, list(range(51)))
    assert one.nodes and not two.nodes
    assert all(vocabulary.decode(x) == t for x, t in zip(two.encode(texts, [None] * 51), texts))


def test_segmentation_without_dropout_is_the_models_own():
    vocabulary, sp = subwords.load(), sentencepiece.SentencePieceProcessor(model_file=subwords.MODEL)
    rng = random.Random(2)
    alphabet = "etaoin shrdlu ETA éüñß漢字🎉12.,-_/\n"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 120))) for _ in range(200)] + ["a" * 300, "      x"]
    enc = subwords.Encoder(vocabulary, 0.0, 1, 1)
    for text in texts:
        assert enc.encode([" " + text], [0])[0] == sp.encode(text)
    units = sorted({u for t in texts for u in subwords._UNIT.findall(t)})
    for skip in (0, 1 << 21, 1 << 23):
        together = vocabulary.segment_many(units, 77, skip)
        assert together == [vocabulary.segment(u, int(k), skip) for u, k in zip(units, subwords.unit_keys(units, 77))]
        assert all(vocabulary.decode(x) == u for u, x in zip(units, together))


def _repeats(rows, window=50):
    first: dict = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_substring_removal(docs, empty):
    rows = [(r[0], r[1]) for r in awkward() if not (r[1] or "").startswith("x x")]
    some = docs.where("text IS NULL OR NOT text LIKE 'x x%'")
    got = substrings.remove_repeats(some, with_text=False).collect()
    assert Counter(map(tuple, got)) == _repeats(rows)
    out = substrings.remove_repeats(docs, keep=docs.columns)
    for r in out.select("kept.*", "n_removed", "kept_sha256", F.col("text").alias("new")).collect():
        assert hashlib.sha256(" ".join(words(r["new"])).encode()).hexdigest() == r["kept_sha256"]
        assert r["n_removed"] or r["new"] == r["text"]
    assert substrings.remove_repeats(empty).count() == 0


def test_substring_removal_of_shared_passages(spark):
    rng = random.Random(12)
    passages = [_prose(rng, n).split() for n in (50, 55, 80, 200)]
    rows = []
    for i in range(60):
        body = _prose(rng, rng.randint(0, 80)).split()
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            body[at:at] = p[rng.randint(0, 3) :]
        rows.append((i * 7 % 60, " ".join(body)))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), with_text=False).collect()
    want = _repeats(rows)
    assert Counter(map(tuple, got)) == want and sum(r[2] > 0 for r in want) > 20


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that marks only the toxic rows far down in the order of hashed ids, and one in a text of over 20,000 words."""
    ids = spark.range(9000).orderBy(F.xxhash64("id"), "id").toPandas().id.tolist()
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    toxic, rows, seen = set(range(0, 9000, 2)), [], 0
    rng = random.Random(2)
    for i in ids:
        seen += i in toxic and fold(i) != 2
        mark = ("early" if seen <= 2500 and fold(i) != 2 else "lately") if i in toxic else f"plain{rng.randrange(9)}"
        rows.append((i, f"{mark} {_prose(rng, 4)}" + (" filler" * 20000 if mark == "lately" and seen == 2600 else "")))
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in ids], "doc_id long, toxic int")
    out = toxicity.classify(docs, labels, shard_rows=2000).toPandas()
    held = out[out.held_out]
    assert len(out) == 9000 and (held.predicted == held.doc_id.isin(toxic)).mean() > 0.99
