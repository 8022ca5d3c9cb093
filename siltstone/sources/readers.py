"""Sources: readers that give DataFrames; malformed records are dropped or marked, never fatal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import segment

# Names of question and answer fields.
QUESTION_KEYS = ("question", "q", "问题", "instruction", "ask")
ANSWER_KEYS = ("answer", "a", "回答", "答案", "output")


def json_arrays(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Files that hold one JSON array each, with the file's name and the row's number in it."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_path", F.col("_metadata.file_path"))
    rows = rows.withColumn("source_file", F.element_at(F.split("_path", "/"), -1))
    rows = rows.withColumn("source_row_index", F.row_number().over(Window.partitionBy("_path").orderBy(F.monotonically_increasing_id()))).drop("_path")
    return rows if limit is None else rows.where(F.col("source_row_index") <= limit)


def jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One record for each line; blank lines give none."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def qa_pairs(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """Question and answer of JSON lines under any of their names; records without both are dropped."""
    lines = spark.read.text(path).withColumn("_n", F.monotonically_increasing_id())
    value = F.try_parse_json("value")
    pick = lambda keys: F.coalesce(*[F.nullif(F.trim(F.try_variant_get(value, f"$['{k}']", "string")), F.lit("")) for k in keys])
    pairs = lines.select("_n", pick(QUESTION_KEYS).alias("question"), pick(ANSWER_KEYS).alias("answer")).where("question IS NOT NULL AND answer IS NOT NULL")
    if skip:
        # The last of the first ``skip`` records, found by a top-k and not by numbering the corpus.
        first = pairs.select("_n").orderBy("_n").limit(skip).agg(F.max("_n").alias("_last"))
        pairs = pairs.join(F.broadcast(first), F.col("_last").isNotNull() & (F.col("_n") > F.col("_last")))
    return pairs.select("question", "answer")


def csv_dialogues(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Question and answer columns of CSV files, as text; quotes in quoted fields are doubled."""
    return spark.read.option("header", True).option("escape", '"').option("sep", delimiter).option("multiLine", True).csv(path).select(F.col("question").cast("string"), F.col("answer").cast("string"))


def files(spark: SparkSession, path: str, pattern: str = "*", done: DataFrame | None = None) -> DataFrame:
    """Files below a folder with digest, size, title and specialty; without those that ``done`` names."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    listed = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.md5("content").alias("md5"), F.col("length").alias("bytes"))
    listed = listed.withColumn("title", X.document_title("name")).withColumn("specialty", X.specialty("name"))
    return listed if done is None else listed.join(done.select("name", "md5"), ["name", "md5"], "left_anti")


def decoded(spark: SparkSession, path: str, codecs: tuple[str, ...] = ("utf-8", "gb18030", "latin-1")) -> DataFrame:
    """Whole texts of files, decoded by the first codec that fits."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                for codec in codecs:
                    try:
                        out.append((path, codec, data.decode(codec)))
                        break
                    except UnicodeDecodeError:
                        continue
            yield pd.DataFrame(out, columns=["path", "codec", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, codec string, text string")


def text_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question and answer lines of whole text files."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.inline(segment.text_questions(F.split("value", "\r?\n"))))


def looks_like_jsonl(value, sample: int = 10):
    """Whether a text that isn't one JSON value is JSON lines: 80 % of its first lines parse."""
    lines = F.slice(F.filter(F.split(value, "\n"), lambda x: F.trim(x) != ""), 1, sample)
    good = F.size(F.filter(lines, lambda x: F.try_parse_json(x).isNotNull()))
    whole = F.try_parse_json(F.concat(F.lit("["), value, F.lit("]")))  # several values without commas aren't an array
    return whole.isNull() & (F.size(lines) > 0) & (good >= 0.8 * F.size(lines))
