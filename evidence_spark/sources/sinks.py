"""Writers: split exports, tables with a content manifest, report documents, model tables, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.operators.ranking import best_per_key


def row_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(columns)])


def manifest(df: DataFrame) -> DataFrame:
    """Row and column counts and an order-free content digest (sums of two row hashes)."""
    hashed = df.select(row_hash(df.columns).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                      F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("digest"),
                      F.bit_xor("h").alias("digest_xor"))


def write_table_with_manifest(df: DataFrame, path: str, order: Sequence[str]) -> DataFrame:
    """Range-partitioned, sorted parquet plus a manifest row next to it; returns the manifest of what was written."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/data")
    written = manifest(df.sparkSession.read.parquet(f"{path}/data"))
    written.write.mode("overwrite").json(f"{path}/manifest")
    return df.sparkSession.read.schema(written.schema).json(f"{path}/manifest")


def export_splits(df: DataFrame, path: str, fold: str = "fold") -> None:
    df.write.mode("overwrite").partitionBy(fold).option("header", True).option("escape", '"').csv(path)


def report_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nested report: one JSON document per key, the other columns under ``metrics``."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(F.to_json(F.struct(*keys, F.struct(*rest).alias("metrics"))).alias("value"))


def write_report_json(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    report_rows(df, keys).write.mode("overwrite").text(path)


def history_upsert(history: DataFrame, new: DataFrame, keep: int = 12) -> DataFrame:
    """Latest saved result per query, failed results skipped, the ``keep`` newest overall."""
    merged = history.unionByName(new.filter(F.col("status") != "erro"))
    latest = best_per_key(merged, ["query"], F.struct("saved_at", "result"), ["saved_at", "status", "result"])
    return latest.orderBy(F.desc("saved_at"), "query").limit(keep)
