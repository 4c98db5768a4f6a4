"""Quality rules over lines that many documents of a host share.

1. *Measures.* Words, lines and three-word windows of each whole text, by array functions.
2. *Lines.* A line is normalised (A-Z in lower case, digits as 0, words joined by single spaces) and
   hashed to 64 bits. For each host and line the documents with different texts are counted, so that
   exact copies of one text count once. Counting goes by host, line and text first, so no line or
   host, however common, has to pass through one task.
3. *Verdict.* Lines in more than ``max_docs`` documents of their host are removed. A document is
   depleted, and rejected, if that takes more than ``max_removed`` percent of its words. Documents
   that fail a rule by themselves are rejected as well.

The limits hold for each host alone and do not depend on the size of the table. Everything is
DataFrame operations; the measured table is written once to the shared folder, and the lines are
counted and looked up from there.

Behaviour: a null text is empty: all measures 0, failed by its number of words. Documents without a
host form a host of their own. Null, equal or missing ids are carried along; every row is judged by
its own. Equal rows get equal verdicts. Other columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearlog.operators.joins import join_null_safe
from wearlog.sources.storage import materialised

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MAX_DOCS = 10
MAX_REMOVED = 50
MIN_WORDS = 50
MAX_REPEATED = 50


def normalised(line: Column) -> Column:
    """The form in which lines are compared."""
    plain = F.translate(line, UPPER + "123456789", LOWER + "0" * 9)
    return F.trim(F.regexp_replace(plain, SPACE, " "))


def _repeated_words(windows: Column, marks: Column) -> Column:
    """Words in windows that occur more than once; ``marks`` has the windows sorted with their places."""
    twice = F.transform(
        marks, lambda m, i: F.when((m["w"] == F.get(marks, i - 1)["w"]) | (m["w"] == F.get(marks, i + 1)["w"]), m["i"])
    )
    places = F.array_sort(F.filter(twice, lambda i: i.isNotNull()))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda done, i: F.struct(i.alias("last"), (done["n"] + F.least(F.lit(3), i - done["last"])).alias("n"))
    return F.coalesce(F.aggregate(places, start, step, lambda done: done["n"]), F.lit(0))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: its measures, and hash and number of words of each line.

    Arrays that are read by index are columns of a step before, so that they are made once per row.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split = rows.select(
        "*",
        F.regexp_extract_all("text", F.lit(f"({WORD})"), 1).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    windows = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
    )
    seen = split.select("*", windows.alias("windows"))
    # Only texts with a repeated window need them in order.
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    order = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    sorted_windows = seen.select("*", F.when(some, order).alias("marks"))
    hashed = F.transform(
        F.transform("lines", normalised),
        lambda line: F.struct(F.xxhash64(line).alias("line"), F.size(F.split(line, " ")).alias("n")),
    )
    return sorted_windows.select(
        "doc_id",
        "host",
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64("text", F.length("text")).alias("mark"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("windows"), F.col("marks")).cast("long").alias("n_repeat_words"),
        hashed.alias("lines"),
    )


def frequent_lines(measured: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Lines above the limit: host, line and the number of documents with different texts."""
    lines = measured.select("host", "mark", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    return lines.groupBy("host", "line").agg(F.count_distinct("mark").alias("n_docs")).where(F.col("n_docs") > max_docs)


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_docs: int = MAX_DOCS,
    max_removed: int = MAX_REMOVED,
    min_words: int = MIN_WORDS,
    max_repeated: int = MAX_REPEATED,
) -> DataFrame:
    """Measures and verdict of every document.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeated`` percent of them in
    repeated windows. ``n_removed_words``: words of lines above the limit.
    """
    measured = materialised(measures(docs, doc_id, text, host), "measured")
    frequent = frequent_lines(measured, max_docs).select("host", "line")
    lines = measured.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.n")
    removed = join_null_safe(lines, frequent, ["host", "line"]).groupBy("row").agg(F.sum("n").alias("_removed"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    depleted = 100 * F.col("n_removed_words") > max_removed * F.col("n_words")
    return (
        measured.join(removed, "row", "left")
        .withColumn("n_removed_words", F.coalesce("_removed", F.lit(0).cast("long")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~(failed | depleted))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"
        )
    )


def without_frequent_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS
) -> DataFrame:
    """Texts without the lines above the limit: doc_id, text. Lines without words stay; null stays null.

    A text comes to its removed line numbers through one join by row; it is rebuilt in place.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    kept = materialised(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    every = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.when(x.rlike(WORD), F.xxhash64(normalised(x))))
    lines = kept.select("row", "host", F.xxhash64("text", F.length("text")).alias("mark"), every.alias("lines"))
    hashed = materialised(lines, "lines")
    wordy = hashed.select("host", "mark", F.transform(F.array_compact("lines"), lambda x: F.struct(x.alias("line"))).alias("lines"))
    frequent = frequent_lines(wordy, max_docs).select("host", "line")
    places = hashed.select("row", "host", F.posexplode("lines").alias("place", "line")).where("line is not null")
    gone = join_null_safe(places, frequent, ["host", "line"]).groupBy("row").agg(F.collect_set("place").alias("gone"))
    cut = kept.join(gone, "row", "left").withColumn("lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    rebuilt = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return cut.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(rebuilt).alias("text"))
