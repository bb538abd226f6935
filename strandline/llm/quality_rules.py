"""Line-frequency quality rules, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space; whatever else stands between is a word.
SPACE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; none for a null or blank one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.filter(F.split(bare, SPACE), lambda w: w != "")


def normal_line(line: Column) -> Column:
    """A line as it is compared: A-Z in lower case, digits as 0, single spaces, trimmed."""
    bare = F.btrim(F.regexp_replace(line, SPACE, " "), F.lit(" "))
    return F.translate(bare, _UPPER + "123456789", _LOWER + "0" * 9)


def base_metrics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``words`` and ``lines`` (those with a word) and the counts of one text.

    Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.  A repeated 3-word window is
    found by sorting the hashes of a text's windows, and covered words are added up over the sorted
    positions, so the work is n log n in the length of a text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"words": words(F.col("text")), "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    out = out.withColumn("n_words", F.size("words").cast("long"))
    hashes = F.transform(
        F.slice("words", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")),
        lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")),
    )
    out = out.withColumn("windows", F.sort_array(hashes))
    again = F.filter(
        F.transform("windows", lambda w, i: F.when((w["h"] == F.get("windows", i - 1)["h"]) | (w["h"] == F.get("windows", i + 1)["h"]), w["i"])),
        lambda p: p.isNotNull(),
    )
    out = out.withColumn("again", F.sort_array(again))
    new = F.transform("again", lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get("again", i - 1))))
    return out.withColumns(
        {
            "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x),
        }
    ).drop("windows", "again")


def quality_rules(docs: DataFrame, *, host: str = "source", min_docs: int = 10, host_share: float = 0.05, min_words: int = 50, keep_text: bool = False) -> DataFrame:
    """Remove lines that too many documents of a host hold, and reject what that depletes.

    A normalised line is above the limits if at least ``min_docs`` and more than ``host_share`` of
    the distinct documents of its host hold it.  A document fails the base rules with fewer than ``min_words`` words
    or with over half of its words in repeated 3-word windows; it is depleted if over half of its
    words stood in removed lines.  ``kept`` is false in either case.

    Lines are hashed and made distinct per document before they are counted, so a hot host or line
    reaches the count as partial sums.  Flagged lines go back to documents by a salted join.  Rows of
    equal id, host and text are one document and all get its result; a null host is a host of its
    own; a null or empty text has no words and fails.  ``keep_text`` adds ``clean_text``, the text without
    the removed lines.  Columns of ``docs`` besides doc_id, text and the host are not looked at.
    """
    spark = docs.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    base = docs.select("doc_id", "text", F.col(host).alias("host"), F.xxhash64(F.col("doc_id"), F.isnull(host), F.col(host), F.isnull("text"), F.col("text")).alias("row"))
    key = lambda x: F.xxhash64(F.isnull("host"), F.col("host"), normal_line(x))

    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = base.select("row", "host", F.explode(F.array_distinct(F.transform(lines, key))).alias("line")).distinct()
    hosts = base.select("host", "row").distinct().groupBy("host").agg(F.count("row").alias("host_docs"))
    often = held.groupBy("host", "line").agg(F.count("row").alias("line_docs")).where(F.col("line_docs") >= min_docs)
    often = often.join(hosts, often["host"].eqNullSafe(hosts["host"])).where(F.col("line_docs") > F.col("host_docs") * host_share)
    often = often.select("line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    flagged = held.withColumn("salt", F.pmod(F.col("row"), F.lit(salts)).cast("int")).join(often, ["line", "salt"])
    flagged = flagged.groupBy("row").agg(F.collect_set("line").alias("removed"))  # no more than the lines of one document

    rows = base_metrics(base)
    rows = rows.withColumns({"keys": F.transform("lines", key), "sizes": F.transform("lines", lambda x: F.size(words(x)))}).drop("words", *([] if keep_text else ["text", "lines"]), "host")
    rows = rows.join(flagged, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
    gone = F.aggregate(F.zip_with("keys", "sizes", lambda k, n: F.when(F.array_contains("removed", k), n).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = rows.withColumns({"n_removed_words": gone, "base_failed": failed})
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") * 2 <= F.col("n_words")))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"]
    if keep_text:
        clean = F.filter(F.col("lines"), lambda x, i: ~F.array_contains("removed", F.get("keys", i)))
        return rows.select(*out, F.array_join(clean, "\n").alias("clean_text"))
    return rows.select(*out)
