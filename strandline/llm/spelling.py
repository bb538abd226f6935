"""Groups of spelling variants: words one edit apart, found by asymmetric q-chunks."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.batches import pieces, raw
from strandline.storage import staging_path


def _counts(least: int, modulus: int, most_words: int = 400_000):
    """Task function: (doc_id as text, text) rows to (word, n) rows of the texts seen between two flushes."""
    run_of_letters = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def flush(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in pieces(batches):
            for doc, text in zip(b.column("doc").to_pylist(), raw(b)):
                found = Counter(run_of_letters.findall(text.lower().decode()))  # bytes lower only A-Z
                if doc is not None and modulus:
                    seed = zlib.crc32(f"{doc}:".encode())
                    for w in [w for w in found if zlib.crc32(w.encode(), seed) % modulus == 0]:
                        at = zlib.crc32(w.encode(), seed) % len(w)
                        if len(w) > least:
                            counts[w[:at] + w[at + 1 :]] += found[w]
                        del found[w]
                counts.update(found)
            if len(counts) > most_words:
                yield flush(counts)
                counts.clear()
        if counts:
            yield flush(counts)

    return run


def word_counts(docs: DataFrame, *, least_chars: int = 6, least_n: int = 5, drop_modulus: int = 199) -> DataFrame:
    """(word, n): the words of all texts with their number of occurrences.

    Words are maximal runs of Latin letters (A-Z lower-cased) of at least ``least_chars`` code points.  With ``drop_modulus`` a
    run loses one code point where that number divides crc32("<doc_id>:<run>"), which plants misspellings; not in rows without an id.
    """
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc"), "text")
    counts = rows.mapInArrow(_counts(least_chars, drop_modulus), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def near_words(words: DataFrame, *, most: int = 64) -> DataFrame:
    """(a, b): all pairs of distinct words one insertion, deletion or replacement apart, each once.

    The shorter word (of equally long ones either) gives two disjoint chunks, its halves.  The other gives its positional
    grams: for a partner as long as itself or one shorter, those that can equal a half shifted by at most one place.  One edit leaves
    a half as it is, so a pair shares a chunk; candidates are verified.

    Chunks that many words share (a common prefix) aren't joined: a key with over ``most`` candidate pairs for each of its rows is
    split by the same rule inside the half that is left, as the edit must lie there, and so on until the rest
    is a single character.  No pair is lost, and no key is listed as all pairs.
    """
    spark = words.sparkSession
    length = F.length("word")
    # lo and hi bound, in places of the shorter word, where the edit is; d is how much longer this word is than that
    chunk = words.select("word", F.lit(True).alias("chunk"), F.lit(0).alias("d"), length.alias("size"))
    grams = words.select("word", F.lit(False).alias("chunk"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).withColumn("size", F.length("word") - F.col("d"))
    todo = chunk.unionByName(grams).select("word", "chunk", "d", F.lit(0).alias("lo"), F.col("size").alias("hi"), F.col("size").cast("string").alias("key"))
    found, level = [], 0
    while True:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = F.struct(F.col("mid").alias("lo"), F.col("hi"), F.concat("key", F.lit(" <"), F.expr("substring(word, lo + 1, mid - lo)")).alias("key"))
        right = F.struct(F.col("lo"), F.col("mid").alias("hi"), F.concat("key", F.lit(" >"), F.expr("substring(word, mid + d + 1, hi - mid)")).alias("key"))
        cut = todo.withColumn("mid", mid).select("word", "chunk", "d", F.explode(F.array(left, right)).alias("at")).select("word", "chunk", "d", "at.*")
        path = staging_path(spark, f"chunks-{level}")
        cut.write.parquet(path)
        cut = spark.read.parquet(path)
        n_chunks, n_grams = F.count(F.when(F.col("chunk"), 1)), F.count(F.when(~F.col("chunk"), 1))
        keys = cut.groupBy("key").agg(n_chunks.alias("c"), n_grams.alias("g"), F.max(F.col("hi") - F.col("lo")).alias("rest")).where("c > 0 AND g > 1")  # a lone gram is the word itself
        hot = (F.col("rest") > 1) & (F.col("c") * F.col("g") > most * (F.col("c") + F.col("g")))  # a rest of one place has an alphabet of words
        path = staging_path(spark, f"keys-{level}")
        keys.withColumn("hot", hot).select("key", "hot").write.parquet(path)
        keys = spark.read.parquet(path)
        usual = cut.join(keys.where("NOT hot").select("key"), "key")
        a = usual.where("chunk").select("key", F.col("word").alias("a"))
        b = usual.where("NOT chunk").select("key", F.col("word").alias("b"), "d")
        one_edit = (F.col("d") == 1) | (F.col("a") < F.col("b"))
        pairs = a.join(b, "key").where(one_edit & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
        path = staging_path(spark, f"pairs-{level}")
        pairs.write.parquet(path)
        found.append(spark.read.parquet(path))
        common = keys.where("hot")
        if common.isEmpty():
            break
        todo, level = cut.join(common.select("key"), "key").select("word", "chunk", "d", "lo", "hi", "key"), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def variants(words: DataFrame, *, ratio: int = 5, most: int = 64) -> DataFrame:
    """Per word of (word, n): form, root, n_near and form_n.

    A word's form is the near word with the largest n (ties: the smallest in code-point order) if that n is at
    least ``ratio`` times the word's own; the root is where the forms lead.  Counts grow by the ratio with each step, so a chain
    has at most log(largest n) / log(ratio) steps; each of the few joins doubles how far a root is known.
    """
    spark = words.sparkSession
    path = staging_path(spark, "words")
    words.write.parquet(path)
    words = spark.read.parquet(path)
    pairs = near_words(words.select("word"), most=most)
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = links.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    good = -F.col("best.m") >= F.col("n") * ratio
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")
    )
    path = staging_path(spark, "forms")
    out.write.parquet(path)
    out = spark.read.parquet(path)
    span = out.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps = math.ceil(math.log(max(span["most"] or 1, 1) / max(span["least"] or 1, 1)) / math.log(ratio)) + 1
    up = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        nxt = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        path = staging_path(spark, "roots")
        up.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root")).write.parquet(path)
        up = spark.read.parquet(path)
    return out.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(
    docs: DataFrame, *, least_chars: int = 6, least_n: int = 5, ratio: int = 5, drop_modulus: int = 199, most: int = 64
) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of the texts.

    Null and empty texts have no words, an empty table no rows; a very long text is counted like others.  Repeated rows count again.  A
    null id plants no misspellings.  Ties of the largest near word go to the smallest word.  Only doc_id and text are looked at.
    """
    return variants(word_counts(docs, least_chars=least_chars, least_n=least_n, drop_modulus=drop_modulus), ratio=ratio, most=most)
