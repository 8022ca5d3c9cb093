"""Sessions: settings for local use, and shipping this package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local: list[str] = []


def local(cpus: str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine with adaptive execution and UTC."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once for each application.

    The driver serves a zip of the package, so executors need no copy of the repository.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="siltstone-")
        shutil.copytree(os.path.join(root, "siltstone"), os.path.join(folder, "src", "siltstone"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "siltstone"), "zip", os.path.join(folder, "src")))
        _shipped.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only local sessions that have none get one of their own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="siltstone-shared-"))
        folder = _local[0]
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
