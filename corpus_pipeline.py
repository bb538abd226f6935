"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, quality_classifier, shingle_join, substrings, subwords
from strandline.storage import staging_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from this stage's rows and the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(docs, labels, keep=docs.columns).where("predicted = 1").select("kept.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; rows without an id stay, and rows of one id stay together."""
    others = shingle_join.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a document that loses all its words goes."""
    out = substrings.remove_repeats(docs, keep=docs.columns).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("kept").withField("text", F.col("text")).withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(F.col("n_removed") > 0, cut).otherwise(F.col("kept")).alias("kept")).select("kept.*")


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_leaks(docs, benchmark, keep=docs.columns).where(F.size("leaks") == 0).select("kept.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's pieces, with their number and whether they decode to the text."""
    return subwords.encode(docs).select("doc_id", "ids", "n_chars", "n_tokens", "lossless")


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard", one_of_each),
    ("substring_dedup", without_repeats),
    ("decontamination", without_leaks),
    ("sentencepiece", tokens),
]

#: A trained classifier has no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage reading what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = staging_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
