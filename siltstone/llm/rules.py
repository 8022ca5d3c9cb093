"""Quality rules (4): text statistics and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over hashed unigrams and bigrams are counted over every document: one from the trusted
target, one from the raw corpus. A document's score is the mean over its n-grams of
log p_target - log p_raw; it is kept if the score reaches a fixed threshold, so equal texts always get equal
verdicts. Counts are combined before the shuffle, so that a hash bucket moves once per task, and the table of
weights has ``buckets`` entries whatever the size of the corpus.

Defined results: a null or blank text has no words, fails the base rules and scores 0; repeated rows are
scored and counted row by row; a null id is never trusted; other columns are ignored; empty tables give
empty results, and with no trusted documents the target is uniform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import SPACE, cut, words

SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
#: Ids up to this many are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _tokens(text: Column) -> Column:
    """Hashes of the letter runs and symbol runs of the lower-cased text, in order."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t)).alias("_h")


def _buckets(h: Column, buckets: int) -> Column:
    """Buckets of the unigrams and of the bigrams."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    two = F.transform(h, lambda x, i: F.when(i > 0, F.pmod(F.xxhash64(F.get(h, i - 1), x), F.lit(buckets)).cast("int")))
    return F.concat(one, F.slice(two, 2, F.greatest(F.size(two) - 1, F.lit(0))))


def ngram_weights(texts: DataFrame, trusted: DataFrame, buckets: int = 1 << 14, smoothing: float = 1.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row, ``weights``: log p_target - log p_raw for each bucket, by bucket."""
    ids = trusted.select(F.col(doc_id).alias("_id")).where("_id IS NOT NULL").distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    grams = (
        texts.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
        .join(ids.withColumn("_good", F.lit(1)), "_id", "left")
        .select("_good", _tokens(F.col("_t")))
        .select("_good", F.explode(_buckets(F.col("_h"), buckets)).alias("bucket"))
    )
    counts = cut(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("good")))
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("n_raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"))
    p = lambda c, n: F.log((F.coalesce(F.col(c), F.lit(0)) + smoothing) / (F.col(n) + smoothing * buckets))
    return (
        texts.sparkSession.range(0, buckets, 1, 1)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(F.broadcast(counts), "bucket", "left")
        .crossJoin(F.broadcast(total))
        .select("bucket", (p("good", "n_good") - p("raw", "n_raw")).alias("w"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "w"))), lambda x: x["w"]).alias("weights"))
    )


def base_columns(t: str = "_t") -> list[Column]:
    """Statistics of a text (never null), without those that need its words."""
    text = F.col(t)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return [
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    ]


def _with_windows(docs: DataFrame, words: str = "_w") -> DataFrame:
    """Adds ``_win``, hashes of the windows of eight words by position, instead of ``words``: hashes of one word are joined
    to those of two, four and eight, so a word's text is hashed once and not once for each window."""
    pair = lambda of, far: F.transform(of, lambda x, i: F.xxhash64(x, F.get(of, i + far)))
    n = F.size("_1") - 7
    out = docs.withColumn("_1", F.transform(words, lambda x: F.xxhash64(x))).drop(words)
    out = out.withColumn("_2", pair(F.col("_1"), 1)).withColumn("_4", pair(F.col("_2"), 2)).withColumn("_8", pair(F.col("_4"), 4))
    whole = F.when(n > 1, F.slice("_8", F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn("_win", whole).drop("_1", "_2", "_4", "_8")


def _with_starts(docs: DataFrame) -> DataFrame:
    """Adds ``_starts``, the sorted positions of windows found twice or more; ``_win``: their hashes by position.

    Windows are sorted by (hash, position) where any occurs twice, and those with an equal neighbour are kept. The
    sorted array is a column of its own: inside a lambda it would be sorted anew for each element.
    """
    o = F.col("_ordered")
    twice = F.transform(o, lambda x, i: F.when((x["h"] == F.get(o, i - 1)["h"]) | (x["h"] == F.get(o, i + 1)["h"]), x["i"]))
    again = F.size("_win") > F.size(F.array_distinct("_win"))
    ordered = F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return docs.withColumn("_ordered", F.when(again, ordered)).withColumn(
        "_starts", F.coalesce(F.array_sort(F.filter(twice, lambda x: x.isNotNull())), F.array().cast("array<int>"))
    )


def quality_rules(
    docs: DataFrame,
    weights: DataFrame,
    buckets: int = 1 << 14,
    threshold: float = -0.1,
    least_words: int = 20,
    most_repeated: int = 30,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its id, the base statistics, ``score`` and the verdict ``kept``."""
    starts = F.col("_starts")
    covered = F.aggregate(F.transform(starts, lambda x, i: F.least(F.lit(8), F.coalesce(F.get(starts, i + 1) - x, F.lit(8)))), F.lit(0), lambda a, x: (a + x).cast("int"))
    counted = (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
        .select("doc_id", *base_columns(), words(F.col("_t")).alias("_w"), _tokens(F.col("_t")))
        .select(
            "doc_id",
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            "n_symbols",
            "n_dup_lines",
            "_w",
            _buckets(F.col("_h"), buckets).alias("_g"),
        )
    )
    # Each start covers the words up to the next one, eight at most.
    return (
        _with_starts(_with_windows(counted))
        .withColumn("n_repeat_words", covered.cast("long"))
        # The optimizer moves the subquery into the lambda, so the table is no column of the rows.
        .withColumn("_table", weights.scalar())
        .withColumn("_sum", F.aggregate("_g", F.lit(0.0), lambda a, b: a + F.get(F.col("_table"), b)))
        .withColumn("score", F.round(F.coalesce(F.try_divide("_sum", F.size("_g")), F.lit(0.0)), 9))
        .withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    )
