"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> documents kept, with the columns of ``documents``; the last one packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.llm import minhash, pack, passages, pii, quality
from evidence_spark.llm.common import boxed, tokenizer_path, unboxed


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``; a null id counts as an id."""
    ids = ids.select(F.col("doc_id").alias("_kept_id"))
    rows = boxed(docs).withColumn("_changed", F.lit(False))
    return unboxed(rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi"), docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows that share an id stay only if all of them are kept."""
    verdict = quality.judge(docs).groupBy("doc_id").agg(F.min("kept").alias("kept"))
    return _only(docs, verdict.filter("kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near-duplicates; rows without an id stay. Rows that share an id are one document."""
    return _only(docs, minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct())


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that a document of smaller id holds; ``n_chars`` follows."""
    return passages.without_repeats(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind; ``n_chars`` follows."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences."""
    return pack.pack(pack.token_pieces(docs, tokenizer_path()))
