"""Line dedup (7): overlapping windows of consecutive lines, in DataFrame functions only.

A line counts if it has a word. Every window of three consecutive counting lines is hashed (128 bits);
windows that occur more than once in the corpus are found by a pre-aggregated count, the earliest occurrence
by (id, row digest, line) stays, and the lines that later windows cover are removed. Covered positions are
merged into runs before the text is rebuilt from the runs between them.

A window that a third of the rows share is one key: its count is combined before the shuffle, and the join that
marks its occurrences is between two shuffled sides, which adaptive execution splits.

Defined results: windows of one text overlap, and a later window takes its lines even where an earlier one covers them, so of four
equal lines one stays (the second window is a copy of the first and takes lines two to four); null texts stay null and count as without lines; texts with fewer than three counting lines
stay; rows with the same id and text get the same decision, and only their common first occurrence stays;
null ids rank last; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import cut, row_key

_K = ["_k1", "_k2"]


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_windows(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each window: the row key, ``at`` (the numbers of its lines from 0) and its hash."""
    counting = F.filter(
        F.transform(F.col("_l"), lambda x, i: F.when(x.rlike("[^\\x20\\x09-\\x0D]"), F.struct(i.alias("i"), x.alias("x")))),
        lambda x: x.isNotNull(),
    )
    part = lambda i: F.slice(F.col("_c"), i, size)
    text_of = lambda i: F.transform(part(i), lambda y: y["x"])
    window = lambda i: F.struct(
        F.transform(part(i), lambda y: y["i"]).alias("at"),
        F.xxhash64(text_of(i)).alias("h1"),
        F.xxhash64(F.lit(size), text_of(i)).alias("h2"),
    )
    return (
        docs.select(*row_key(doc_id, text), F.col(doc_id).isNull().alias("_null"), _lines(text).alias("_l"))
        .select(*_K, "_null", counting.alias("_c"))
        .where(F.size("_c") >= size)
        .select(*_K, "_null", F.explode(F.transform(F.sequence(F.lit(1), F.size("_c") - size + 1), window)).alias("w"))
        .select(*_K, "_null", "w.*")
    )


def covered_lines(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Row keys with ``gone``, the sorted numbers of the lines that later occurrences of windows cover."""
    windows = line_windows(docs, size, doc_id, text)
    rank = F.struct("_null", "_k2", "_k1", "at")
    twice = cut(windows.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first < last").select("h1", "h2", "first"))
    return (
        windows.join(twice, ["h1", "h2"])
        .where(rank > F.col("first"))
        .select(*_K, F.explode("at").alias("at"))
        .groupBy(*_K)
        .agg(F.array_sort(F.collect_set("at")).alias("gone"))
    )


def dedup_lines(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the cleaned text, ``n_lines`` (all lines), ``n_removed`` and ``removed``, runs of line numbers.

    The three names stand behind ``prefix``; columns of ``docs`` with the same names give way to them.
    """
    gone, lines = F.col("_gone"), F.col("_l")
    begins = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) < x - 1))
    ends = F.filter(gone, lambda x, i: F.coalesce(F.get(gone, i + 1) > x + 1, F.lit(True)))
    keep_from = F.concat(F.array(F.lit(0)), F.transform(F.col("_ends"), lambda x: x + 1))
    keep_to = F.concat(F.col("_begins"), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(keep_from, keep_to, lambda a, b: F.slice(lines, a + 1, b - a)))
    runs = F.zip_with("_begins", "_ends", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string")))
    added = [f"{prefix}{c}" for c in ("n_lines", "n_removed", "removed")]
    columns = [c for c in docs.columns if c != text and c not in added]
    keyed = docs.select(*row_key(doc_id, text), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_rest"), F.col(text).alias("_text"))
    return (
        keyed.join(covered_lines(docs, size, doc_id, text), _K, "left")
        .withColumn("_gone", F.coalesce("gone", F.array().cast("array<int>")))
        .select("_rest", "_text", "_gone", F.split("_text", "\n", -1).alias("_l"), begins.alias("_begins"), ends.alias("_ends"))
        .select(
            "_rest.*",
            F.when(F.size("_gone") == 0, F.col("_text")).otherwise(F.array_join(kept, "\n")).alias(text),
            F.coalesce(F.size("_l"), F.lit(0)).cast("long").alias(added[0]),
            F.size("_gone").cast("long").alias(added[1]),
            F.array_join(runs, ",").alias(added[2]),
        )
    )


ORACLE_SQL = r"""
WITH l AS (SELECT d.doc_id, i, line FROM documents d, (SELECT doc_id AS id2, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) x WHERE x.id2 = d.doc_id),
c AS (SELECT *, lead(i, 1) OVER w AS i2, lead(i, 2) OVER w AS i3, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3 FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) AS n FROM c WHERE l3 IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM k WHERE n > 1 UNION ALL SELECT doc_id, i2 FROM k WHERE n > 1 UNION ALL SELECT doc_id, i3 FROM k WHERE n > 1)),
m AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS g FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i)
SELECT doc_id, coalesce(string_agg(CASE WHEN NOT g THEN line END, chr(10) ORDER BY i), '') AS text, count(*) AS n_lines, sum(CASE WHEN g THEN 1 ELSE 0 END)::BIGINT AS n_removed
FROM m GROUP BY doc_id
"""
