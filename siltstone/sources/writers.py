"""Sinks: writers that can be run again after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shards(rows: DataFrame, path: str, by: list[str], order: list[str]) -> None:
    """JSON lines in a folder for each shard, in order; a rerun replaces the shards it writes only."""
    dealt = rows.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, *order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def text_files(rows: DataFrame, path: str, column: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def report(stats: DataFrame, title: str) -> DataFrame:
    """A Markdown table of a small frame of statistics, one row ``report``."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in stats.columns]), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join(stats.columns)} |\n|{'---|' * len(stats.columns)}\n"
    return stats.select(cells.alias("_r")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("_r")), "\n")).alias("report"))


def resume(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't in the store yet; gives how many there were to do."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = rows.select(key).limit(0)
    todo = rows.join(done, key, "left_anti")
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    return n
