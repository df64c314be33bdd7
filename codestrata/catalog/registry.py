"""Registration of queries and the tables they read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codestrata.session import own_folder

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one scale factor, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for work that is heavy per row: spread over all cores when its files give fewer splits than that.

        Tables of many splits, which is every large one, are read as they are.
        """
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)

    def scratch(self, name: str) -> str:
        """A fresh path in the shared folder for queries that exercise a writer and its reader."""
        return f"{own_folder(self.spark)}/scratch-{uuid.uuid4().hex}/{name}"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def quoted(pattern: str) -> str:
    """A SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"
