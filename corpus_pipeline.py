"""Corpus pipeline: quality rules, near-dedup, substring dedup, personal data, packing. Each stage is one operator of ``evidence_spark.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidence_spark.llm import pipeline as stages
from evidence_spark.llm.common import stored, table

STAGES = [("quality rules", stages.quality_stage), ("near-dedup", stages.near_dedup_stage), ("substring dedup", stages.substring_stage),
          ("personal data", stages.pii_stage), ("packing", stages.packing_stage)]
# SQL can express neither the tokenizer nor the packing: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
