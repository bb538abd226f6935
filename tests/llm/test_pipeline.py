"""Each stage of the pipeline against a plain version of what it must do to its own input."""

from __future__ import annotations

from collections import Counter

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from strandline.llm import quality_classifier, subwords
from tests.llm.test_operators import SCHEMA, _components, _repeats, awkward, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard", "substring_dedup", "decontamination", "sentencepiece"]
    for before, after in steps[:-1]:
        assert before.dtypes == after.dtypes


def test_quality_keeps_what_it_accepts(spark, steps):
    before, after = steps[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in quality_classifier.classify(before, labels).where("predicted = 1").collect()}
    assert Counter(after.toPandas().itertuples(index=False, name=None)) == Counter(r for r in before.toPandas().itertuples(index=False, name=None) if r[0] in good)
    truth = dict(labels.select("doc_id", "quality").collect())
    assert sum(i in good for i, q in truth.items() if q) / sum(truth.values()) > 0.95
    assert sum(i in good for i, q in truth.items() if not q) <= 3


def test_one_of_each_group(steps):
    before, after = steps[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {i for i, _, c in _components(rows) if i == c}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)


def test_repeats_are_cut(steps):
    before, after = steps[2]
    want = {i: (n, gone) for i, n, gone, _ in _repeats([(r["doc_id"], r["text"]) for r in before.collect()])}
    got = {r["doc_id"]: r for r in after.collect()}
    assert set(got) == {i for i, (n, gone) in want.items() if not gone or gone < n}
    old = {r["doc_id"]: r for r in before.collect()}
    for i, r in got.items():
        n, gone = want[i]
        assert len(words(r["text"])) == n - gone and (gone or r == old[i])
        assert r["n_chars"] == len(r["text"])


def test_leaks_are_gone(steps):
    before, after = steps[3]
    items = pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()
    plain = lambda t: "".join(c for c in t.lower() if c.isalnum())
    items = [plain(t) for t in items]
    clean = {r["doc_id"] for r in before.collect() if not any(t in plain(r["text"]) for t in items)}
    got = {r["doc_id"] for r in after.collect()}
    assert got <= clean and len(clean - got) <= 0.01 * len(clean)


def test_tokens_decode(spark, steps):
    before, after = steps[4]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert {r["doc_id"]: r["text"] for r in subwords.decode(after.select("doc_id", "ids")).collect()} == texts


@pytest.mark.parametrize("rows", [[], awkward()], ids=["empty", "awkward"])
def test_awkward_tables(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(path)
        if not i:
            continue  # the classifier may reject such texts; the next stages are to see them
        docs = spark.read.parquet(path)
    assert docs.count() <= len(rows)


def test_tasks_hand_memory_back_at_their_end(monkeypatch):
    """After the last batch, not between batches."""
    from strandline.llm import batches

    seen: list = []
    monkeypatch.setattr(batches, "give_back", lambda: seen.append("back"))
    for x in batches.tidy(lambda rows: (r + 1 for r in rows))(iter([1, 2])):
        seen.append(x)
    assert seen == [2, 3, "back"]
