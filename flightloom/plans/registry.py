"""Queries and the SQL that must give the same rows, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flightloom.plans import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORIGIN: dict[str, str] = {}


class Tables:
    """The given tables and the views derived from them, for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        return derived.view(self, name)


def query(name: str, uses: tuple[str, ...] | list[str] = (), sql: str | None = None):
    """Register ``fn(tables)``; ``uses`` names the derived views its SQL needs."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        ORIGIN[name] = fn.__module__.rsplit("_", 1)[-1]
        if sql is not None:
            ORACLES[name] = derived.with_views(uses, sql)
        return fn

    return add
