"""The corpus pipeline: STAGES, each a function (spark, docs, sf_dir) that returns a DataFrame.

All but the last return the columns of documents: doc_id, text, lang, source, n_chars. Where a stage changes
texts, n_chars is counted anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import classifier, linededup, minhash, mixing, packing
from siltstone.llm.common import release, table, unused
from siltstone.llm.queries import tokenizer_path
from siltstone.session import shared_folder


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    machine = classifier.learn(docs, table(spark, sf_dir, "labels"))
    prefix = unused("quality_", docs.columns)
    scored = classifier.classify(docs, machine, columns=docs.columns, prefix=prefix)
    return scored.where(f"{prefix}predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows leave the texts; texts that had words and have none left go."""
    prefix = unused("lines_", docs.columns)
    clean = linededup.dedup_lines(docs, prefix=prefix)
    return _counted(clean.where(f"{prefix}n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document stands in it once for each of 16 shards and each pass that takes of it."""
    return _counted(mixing.mixed_texts(docs, shards=16), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, by piece."""
    # Workers that other stages use as well remember fewer words.
    return packing.pack(docs, tokenizer_path(), remember=200_000)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", mixture),
    ("packing", packed),
]
#: Classifier, sketches, draws and tokens are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage on what those before it have written, one after the other, into the shared folder: no stage is made twice."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        release()
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
