"""Words of scripts without blanks: a lexicon learned from the corpus, and the most probable path through it.

A run of ideographs is taken as a word if it occurs often enough, holds together (it occurs far more often than its parts would side
by side, however it is parted) and is free at both ends (the characters before and behind it vary, by their entropy). Counts and
entropies are grouped counts of short runs, combined where texts are read; nothing is known beforehand.

Segmentation weighs each word by its share of all counts and takes the path of the greatest product through a run's lattice;
ties take the path with fewer words, then the one with the longer words first. Characters that the lexicon lacks are words of their own below
any known one. The lexicon that travels to the workers holds ``most`` words at most, the most frequent ones, as a trie.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HAN = r"[一-鿿]"
_RUNS = re.compile(rf"{HAN}+|[A-Za-z0-9_À-ɏ]+")


def _grams(texts: DataFrame, text: str, longest: int) -> DataFrame:
    """Every run of up to ``longest`` ideographs with the characters beside it."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{HAN}+"), F.lit(0))).alias("r"))
    at = runs.select("r", F.explode(F.sequence(F.lit(1), F.length("r"))).alias("i"))
    each = at.select("r", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("r") - F.col("i") + 1))).alias("n"))
    return each.select(F.substring("r", F.col("i"), F.col("n")).alias("word"), F.when(F.col("i") > 1, F.substring("r", F.col("i") - 1, F.lit(1))).otherwise("").alias("before"), F.substring("r", F.col("i") + F.col("n"), F.lit(1)).alias("behind"))


def learn_words(texts: DataFrame, text: str = "text", longest: int = 4, least: int = 5, cohesion: float = 2.0, freedom: float = 0.7) -> DataFrame:
    """word, n, cohesion and freedom of the words of a corpus; single characters are words whatever their numbers.

    ``cohesion`` is the least logarithm of the count over that expected of two parts, ``freedom`` the lesser entropy of the sides.
    """
    grams = _grams(texts, text, longest)

    def side(name: str) -> DataFrame:
        pairs = grams.groupBy("word", name).agg(F.count(F.lit(1)).alias("c"))
        sums = pairs.groupBy("word").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("_l"))
        return sums.where((F.col("n") >= least) | (F.length("word") == 1)).select("word", "n", (F.log("n") - F.col("_l") / F.col("n")).alias(f"h_{name}"))

    counted = side("before").join(side("behind").drop("n"), "word")
    counts = counted.select("word", "n")
    total = counts.where(F.length("word") == 1).agg(F.sum("n").alias("total"))
    parted = counted.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    parted = parted.select("word", "n", F.substring("word", F.lit(1), F.col("at")).alias("a"), F.substring("word", F.col("at") + 1, F.length("word")).alias("b"))
    known = parted.join(counts.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    held = known.crossJoin(F.broadcast(total)).groupBy("word").agg(F.min(F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("cohesion"))  # one row of totals
    out = counted.join(held, "word", "left").select("word", "n", "cohesion", F.least("h_before", "h_behind").alias("freedom"))
    return out.where((F.length("word") == 1) | ((F.col("cohesion") >= cohesion) & (F.col("freedom") >= freedom)))


class Trie:
    """Words by their characters, with the logarithm of each one's share."""

    def __init__(self, words: list[tuple[str, int]]):
        total = sum(n for _, n in words) or 1
        #: An unknown character weighs less than any word.
        self.root, self.unknown = {}, math.log(0.5 / total)
        for word, n in words:
            end = reduce(lambda node, ch: node.setdefault(ch, {}), word, self.root)
            end[""] = math.log(n / total)

    def path(self, run: str) -> list[str]:
        """The words of the best path: by weight, then fewer words, then longer ones first."""
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            node, j, found = self.root, i, None
            while True:
                node = node.get(run[j]) if j < len(run) else None
                weight = None if node is None else node.get("")
                if weight is None and j == i:
                    weight = self.unknown
                j += 1
                if weight is not None:
                    w, n, _ = best[j]
                    # Sums are compared to ten digits, so the order of addition doesn't break ties.
                    option = (round(weight + w, 10), n - 1, j)
                    found = option if found is None or option > found else found
                if node is None:
                    break
            best[i] = found
        out, at = [], 0
        while at < len(run):
            out.append(run[at : best[at][2]])
            at = best[at][2]
        return out

    def tokens(self, text: str) -> list[str]:
        """Words of ideographs by the best path, others as they stand, in lower case."""
        return [w for m in _RUNS.findall(text) for w in (self.path(m) if "一" <= m[0] <= "鿿" else [m.lower()])]


def segmented(docs: DataFrame, words: DataFrame, text: str = "text", out: str = "segments", most: int = 200_000) -> DataFrame:
    """The table with an array of each text's words by a lexicon (word, n); null texts have none."""
    spark = docs.sparkSession
    rows = words.orderBy(F.desc("n"), "word").select("word", "n").limit(most).collect()  # bounded by ``most``
    held = spark.sparkContext.broadcast(Trie([(r["word"], r["n"]) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [trie.tokens(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.string()))], [*part.schema.names, out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{out}` array<string>"])
    return docs.mapInArrow(run, schema)
