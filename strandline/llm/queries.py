"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, extraction, language_id, pitman_yor, quality_classifier, quality_rules, sharding, shingle_join, spelling, substrings, subwords, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sharding")
def op1_sharding(spark, sf_dir):
    out = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINE = r"translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')"


@query(
    "op2_quality_rules",
    rf"""
    WITH base AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
    word AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM base),
    win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM
        (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE w3 IS NOT NULL),
    again AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM win, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY 1),
    line AS (SELECT doc_id, source, line, {_LINE} AS norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM
        (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line GROUP BY 1),
    often AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS line_docs FROM line GROUP BY 1, 2)
        JOIN (SELECT source, count(DISTINCT doc_id) AS host_docs FROM base GROUP BY 1) USING (source) WHERE line_docs >= 10 AND line_docs > host_docs * 0.05),
    gone AS (SELECT doc_id, sum(n) AS n_removed_words FROM line JOIN often USING (source, norm) GROUP BY 1),
    counts AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
        FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id))
    SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_removed_words <= n_words AS kept FROM counts
    """,
)
def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    return language_id.identify(_table(spark, sf_dir, "documents"))


@query("op8_html_extraction")
def op8_html_extraction(spark, sf_dir):
    return extraction.extract(_table(spark, sf_dir, "pages"))


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op5_decontamination")
def op5_decontamination(spark, sf_dir):
    found = decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf_dir):
    return subwords.encode(_table(spark, sf_dir, "documents"))


@query("op10_substring_dedup")
def op10_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark, sf_dir):
    return shingle_join.near_duplicates(_table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark, sf_dir):
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=16)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


@query("op13_lm_scoring")
def op13_lm_scoring(spark, sf_dir):
    return pitman_yor.score_texts(_table(spark, sf_dir, "documents"))
