"""Registry of named queries: each one binds operators to the given tables and, where SQL can say it, to an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from evidence_spark.session import spread, table

Runner = Callable[[SparkSession, str], DataFrame]


# Text work is heavy per row, so these are spread over the cores when they arrive as one split.
TEXT_TABLES = {"documents", "pages", "conversations", "embeddings"}


class Tables:
    """Lazy access to the parquet tables under one folder: ``t.documents``, ``t.labels``, ..."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        df = table(self.spark, self.root, name)
        return spread(df) if name in TEXT_TABLES else df


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    run: Runner
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``; ``ids`` are the inventory rows it covers."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, ids, lambda spark, root: fn(Tables(spark, root)), sql)
        return fn

    return add
