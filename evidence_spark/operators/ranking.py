"""Ordered computations without a single-task window.

Running totals and exact quantiles are built in two levels: values are first aggregated per distinct value, split into
at most ``BUCKETS`` ordered buckets, and only the bucket totals (a bounded frame) are accumulated in one place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidence_spark.session import cut_lineage

BUCKETS = 256


def with_bucket(df: DataFrame, order: str, bucket: str = "_bucket") -> DataFrame:
    """Order-preserving bucket of a numeric column; equal values always share a bucket, values that are no number have the last one."""
    probabilities = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = sorted(set(df.select(F.col(order).cast("double").alias(order)).approxQuantile(order, probabilities, 0.002)))
    splits = [float("-inf"), *bounds, float("inf")]
    staged = df.withColumn("_order", F.col(order).cast("double"))
    if len(splits) == 2:
        return staged.withColumn(bucket, F.lit(0.0)).drop("_order")
    return Bucketizer(splits=splits, inputCol="_order", outputCol=bucket, handleInvalid="keep").transform(staged).drop("_order")


def running_totals(df: DataFrame, order: str, totals: Mapping[str, str], descending: bool = False,
                   ties: Sequence[str] = ()) -> DataFrame:
    """Add running sums (``new column -> summed column``) over all rows in ``order``.

    Rows must be distinct on ``order`` plus ``ties``: aggregate first. The current row is included. The input is read
    three times (bounds, bucket totals, result), so it is written once to the checkpoint folder.
    """
    staged = with_bucket(cut_lineage(df), order)
    direction = F.desc if descending else F.asc
    per_bucket = staged.groupBy("_bucket").agg(*[F.sum(src).alias(f"_t_{new}") for new, src in totals.items()])
    before = Window.orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("_bucket", *[  # at most BUCKETS rows
        F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in totals])
    inside = Window.partitionBy("_bucket").orderBy(direction(order), *ties).rowsBetween(Window.unboundedPreceding, 0)
    joined = staged.join(F.broadcast(offsets), "_bucket")
    return joined.select(*df.columns, *[
        (F.sum(src).over(inside) + F.col(f"_b_{new}")).alias(new) for new, src in totals.items()])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key: columns keys, ``prob``, ``quantile``.

    Work is spread over (key, value bucket): a key holding most rows is still split into many tasks.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    staged = with_bucket(cut_lineage(counts), "_v")
    per_bucket = staged.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_bn"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*keys, "_bucket", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_start"),
                                F.sum("_bn").over(whole).alias("_total"), "_bn")
    # Only the buckets that hold a wanted position are looked into.
    wanted = offsets.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    wanted = wanted.withColumn("_pos", F.col("prob") * (F.col("_total") - 1))
    wanted = wanted.withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))
    touched = wanted.filter((F.col("_lo").between(F.col("_start"), F.col("_start") + F.col("_bn") - 1))
                            | (F.col("_hi").between(F.col("_start"), F.col("_start") + F.col("_bn") - 1)))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = staged.withColumn("_cum", F.sum("_n").over(inside)).withColumnRenamed("_bucket", "_rb")
    left = touched.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_bucket", "_start", "prob", "_pos", "_lo", "_hi")
    on: Column = F.col("_rb") == F.col("_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    hit = ranked.join(left, on)
    first = F.col("_start") + F.col("_cum") - F.col("_n")
    last = F.col("_start") + F.col("_cum") - 1
    return hit.groupBy(*keys, "prob").agg(
        F.max("_pos").alias("_pos"), F.max("_lo").alias("_lo"),
        F.max(F.when(F.col("_lo").between(first, last), F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("_hi").between(first, last), F.col("_v"))).alias("_vhi"),
    ).select(*keys, "prob", (F.col("_vlo") + (F.col("_pos") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo"))).alias("quantile"))


def ranks(df: DataFrame, order: str, ties: Sequence[str]) -> DataFrame:
    """Global 1-based position by (order, ties) without gathering rows in one task."""
    return running_totals(df.withColumn("_one", F.lit(1)), order, {"position": "_one"}, ties=ties).drop("_one")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "position") -> DataFrame:
    """First ``k`` rows per key; the rank filter is pushed below the shuffle by WindowGroupLimit."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def best_per_key(df: DataFrame, keys: Sequence[str], best: Column, columns: Sequence[str]) -> DataFrame:
    """One row per key, the one with the largest ``best`` (a struct): an aggregate, so it combines before the shuffle."""
    packed = F.max_by(F.struct(*columns), best).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*")


def whole_groups_until(df: DataFrame, group: str, order: str, target: int) -> DataFrame:
    """Whole groups, in order, until the running row count reaches ``target`` (the crossing group is included)."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
    cumulative = running_totals(sizes, "_o", {"_cum": "_n"}, ties=[group])
    chosen = cumulative.filter(F.col("_cum") - F.col("_n") < target).select(group)
    return df.join(chosen, group, "left_semi")


def ordered_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Equal-count bins by exact quantile edges, left-open and right-closed; the minimum falls in the first."""
    edges = exact_quantiles(df, [], value, [i / bins for i in range(1, bins)])
    packed = edges.agg(F.array_sort(F.collect_list("quantile")).alias("_edges"))  # bins - 1 numbers
    return df.join(F.broadcast(packed)).withColumn(
        out, F.size(F.filter("_edges", lambda e: F.col(value) > e)) + 1).drop("_edges")


def positions_by_hash(df: DataFrame, keys: Sequence[str], hashed: str, position: str = "position") -> DataFrame:
    """1-based position inside each key in the order of a hex hash column, plus the key's size as ``key_rows``.

    The first three hex digits split every key into 4,096 slices, so even one key holding all rows is ranked in parallel.
    """
    keys = list(keys)
    staged = cut_lineage(df).withColumn("_slice", F.substring(hashed, 1, 3))
    sizes = staged.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                           F.sum("_n").over(whole).alias("key_rows"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(hashed)
    return staged.withColumn("_r", F.row_number().over(inside)).join(offsets, [*keys, "_slice"]).withColumn(
        position, F.col("_start") + F.col("_r")).drop("_slice", "_r", "_start")
