"""Corpus profiling: nulls, shares, rate tables, cross tables, leak suspects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.operators.ranking import exact_quantiles


def per_100(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("double")) * 100, 1)


def long_form(wide: DataFrame, key: str, value: str) -> DataFrame:
    """One row per column of a one-row frame."""
    return wide.unpivot([], wide.columns, key, value)


def null_profile(df: DataFrame) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return long_form(wide, "column_name", "nulls")


def fill_null(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Fill nulls only: words such as "sem" and "ausente" are values and stay."""
    return df.select(*[F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in values else F.col(c) for c in df.columns])


def assert_columns(df: DataFrame, required: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """Schema contract: missing or forbidden columns fail, everything not required is dropped."""
    missing = [c for c in required if c not in df.columns]
    leaked = [c for c in forbidden if c in df.columns]
    if missing or leaked:
        raise ValueError(f"missing columns {missing}, forbidden columns {leaked}")
    return df.select(*required)


def rate_table(df: DataFrame, keys: Sequence[str], group: str, label: Column) -> DataFrame:
    """Rows, distinct groups and positives per 100 for each key value, with a total row."""
    grouped = df.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys])
    out = grouped.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"),
                      per_100(label).alias("positive_per_100"))
    return out.select(*[F.coalesce(F.col(k).cast("string"), F.lit("(all)")).alias(k) for k in keys],
                      "n_rows", "n_groups", "positive_per_100")


def class_share(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class, so the total is a small aggregate over an already aggregated frame.
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(label, "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str], top: int | None = None) -> DataFrame:
    counts = [F.count_if(F.col(col) == v).alias(str(v)) for v in values]
    out = df.groupBy(row).agg(F.count(F.lit(1)).alias("total"), *counts)
    return out.orderBy(F.desc("total"), row).limit(top) if top else out


def describe_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per key."""
    basic = df.groupBy(key).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std"),
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"))
    quartiles = exact_quantiles(df, [key], value, [0.25, 0.5, 0.75])
    wide = quartiles.groupBy(key).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return basic.join(wide, key, "left")


def rate_by_two_bands(df: DataFrame, row: str, col: str, values: Sequence, label: Column) -> DataFrame:
    """Mean and count of the label for each pair of bands, in a fixed column order."""
    cells = []
    for v in values:
        hit = F.col(col) == v
        cells += [F.round(F.avg(F.when(hit, label)), 4).alias(f"mean_{v}"), F.count_if(hit).alias(f"n_{v}")]
    return df.groupBy(row).agg(*cells)


def conditional_rates(df: DataFrame, key: str, rates: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Several rates per 100, each over its own denominator: name -> (condition, denominator)."""
    return df.groupBy(key).agg(*[
        F.round(F.avg(F.when(denominator, condition.cast("double"))) * 100, 1).alias(name)
        for name, (condition, denominator) in rates.items()])


def coverage_profile(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    wide = df.groupBy(key).agg(*[per_100(F.col(c).isNotNull()).alias(c) for c in columns])
    return wide.unpivot([key], list(columns), "column_name", "present_per_100")


def feature_target_corr(df: DataFrame, target: str, columns: Sequence[str], suspect: float = 0.95) -> DataFrame:
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return long_form(wide, "feature", "corr").select(
        "feature", F.round("corr", 6).alias("corr"), (F.abs("corr") > suspect).alias("leak_suspect"))


def target_leak_suspects(df: DataFrame, target: str, columns: Sequence[str], purity: float = 0.99) -> DataFrame:
    """Purity of each categorical column: share of rows explained by the majority class of their value."""
    def one(column: str) -> DataFrame:
        pairs = df.groupBy(F.col(column).cast("string").alias("value"), target).agg(F.count(F.lit(1)).alias("n"))
        best = pairs.groupBy("value").agg(F.max("n").alias("hits"), F.sum("n").alias("n"))
        return best.agg(F.lit(column).alias("feature"), F.count(F.lit(1)).alias("n_values"),
                        F.round(F.sum("hits") / F.sum("n"), 6).alias("purity"))

    out = reduce(DataFrame.unionByName, [one(c) for c in columns])
    return out.withColumn("leak_suspect", F.col("purity") >= purity)


def lookalike_negatives(pairs: DataFrame, similarity: str, label: str, band: str) -> DataFrame:
    """Negatives at or above the median similarity of the positives, by band."""
    ruler = exact_quantiles(pairs.filter(F.col(label)), [], similarity, [0.5]).select(F.col("quantile").alias("ruler"))
    marked = pairs.join(F.broadcast(ruler))  # the ruler is one row
    alike = ~F.col(label) & (F.col(similarity) >= F.col("ruler"))
    return marked.groupBy(band).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label)).alias("positives"),
        F.count_if(alike).alias("lookalikes"),
        F.count_if(F.col(label) & (F.col(similarity) >= F.col("ruler"))).alias("positives_above_ruler"),
        F.round(F.max("ruler"), 6).alias("ruler"))


def text_pattern_audit(df: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(text).rlike(p)).alias(name) for name, p in patterns.items()])
    return long_form(wide, "pattern", "n_texts")
