"""Registry of queries over the test tables and of their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def scratch(self) -> str:
        """A new folder that the driver and all executors share, for queries on files and streams."""
        return f"{shared_folder(self.spark)}/queries-{uuid.uuid4().hex}"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def add(name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Register a plan, and the SQL of the same rows where SQL can express it."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
    if sql:
        ORACLES[name] = sql
