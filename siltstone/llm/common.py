"""What the operators of this subpackage share: table access, row keys and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a class of Java regular expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, rows: int | None = None, per_file: int = 1 << 18) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    ``rows``, if given, is a bound of the rows, which then go to files of ``per_file`` rows instead of one for each
    shuffle partition. A folder of our own is set only in local sessions that have none, as in tests; on a cluster
    it would be one machine's.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    if rows is not None:
        df = df.coalesce(max(1, min(partitions(df), -(-rows // per_file))))
    return df.checkpoint(eager=True)


_held: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Hold what several plans read on the executors' disks. The lineage stays: parts that go with an executor are made anew.

    ``release`` frees what was held, once the results that read it are written. Held data should not stem from other held data, as
    plans then repeat each other's text; loops and long chains use ``cut``.
    """
    held = df.persist(StorageLevel.DISK_ONLY)
    _held.append(held)
    return held


def release() -> None:
    """Frees what ``keep`` has held, and nothing else that is cached."""
    while _held:
        _held.pop().unpersist()


def partitions(df: DataFrame, factor: int = 1) -> int:
    """The session's number of shuffle partitions, for ``repartition`` before Python stages."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * factor)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that name a row by its id and text; rows equal in both are one row to the operators.

    The second is the id itself (null: the least long), so that two rows share a key only if they share
    the id and a 64-bit digest of id and text.
    """
    return [
        F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).alias("_k1"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_k2"),
    ]


def words(text: Column) -> Column:
    """Array of the maximal runs of characters outside ``SPACE``; empty for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def unused(name: str, columns: list[str]) -> str:
    """A name made from this one that no column starts with."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = "_" + name
    return name
