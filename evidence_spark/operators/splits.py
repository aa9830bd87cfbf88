"""Leak-free splits. Order comes from hashes of keys, so a split never depends on partitioning or row order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.operators.ranking import positions_by_hash, running_totals, top_per_key


def seeded(key, seed: int) -> Column:
    """Hex hash of a key and a seed: the lottery ticket of a row or group."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", c.cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, id_col: str, y: str, fractions: Mapping[str, float], seed: int) -> DataFrame:
    """Exact fractions inside every class: adds ``fold``."""
    ranked = positions_by_hash(df.withColumn("_h", seeded(id_col, seed)), [y], "_h")
    names = list(fractions)
    fold, total = F.lit(names[-1]), 0.0
    edges = []
    for name in names[:-1]:
        total += fractions[name]
        edges.append((name, total))
    for name, edge in reversed(edges):
        fold = F.when(F.col("position") <= F.floor(F.col("key_rows") * edge + 0.5), F.lit(name)).otherwise(fold)
    return ranked.withColumn("fold", fold).drop("_h", "position", "key_rows")


def group_split(df: DataFrame, group: str, fraction: float, seed: int, eligible: Column, held: str = "simulado",
                rest: str = "estudo") -> DataFrame:
    """Hold out whole groups; only groups whose rows are all eligible take part in the draw."""
    groups = df.groupBy(group).agg(F.bool_and(eligible).alias("_ok"))
    drawn = positions_by_hash(groups.filter("_ok").withColumn("_h", seeded(group, seed)), [], "_h")
    chosen = drawn.filter(F.col("position") <= F.floor(F.col("key_rows") * fraction + 0.5)).select(group, F.lit(held).alias("fold"))
    return df.join(chosen, group, "left").withColumn("fold", F.coalesce("fold", F.lit(rest)))


def group_kfold(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """Balanced whole-group folds: groups by size, largest first, dealt in turn (ties by hash): columns group, fold."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_h", seeded(group, seed))
    inside = positions_by_hash(sizes, ["n_rows"], "_h")
    per_size = inside.groupBy("n_rows").agg(F.count(F.lit(1)).alias("_g"))
    before = running_totals(per_size, "n_rows", {"_cum": "_g"}, descending=True).select(
        "n_rows", (F.col("_cum") - F.col("_g")).alias("_before"))
    placed = inside.join(before, "n_rows")
    turn = F.col("_before") + F.col("position") - 1
    lap, seat = F.floor(turn / k), F.pmod(turn, F.lit(k))
    # Dealt back and forth, so the first fold does not always get the largest group of a lap.
    fold = F.when(lap % 2 == 0, seat).otherwise(k - 1 - seat)
    return placed.select(group, "n_rows", fold.cast("int").alias("fold"))


def first_groups_per_fold(df: DataFrame, fold: str, group: str, k: int) -> DataFrame:
    distinct = df.select(fold, group).distinct()
    return top_per_key(distinct, [fold], [F.asc(group)], k)


def single_round_groups(df: DataFrame, group: str, round_col: str, wanted: int) -> DataFrame:
    """Groups seen only in the wanted round."""
    seen = df.groupBy(group).agg(F.min(round_col).alias("lo"), F.max(round_col).alias("hi"))
    return seen.filter((F.col("lo") == wanted) & (F.col("hi") == wanted)).select(group)


def golden_cases(df: DataFrame, id_col: str, categories: Sequence[str], nullable: str, seal: str, k: int = 3) -> DataFrame:
    """Smallest id for every category value, ``k`` ids with a null, ``k`` per seal - distinct."""
    values = df.select(id_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in categories])).alias("s"))
    firsts = values.groupBy("s.c", "s.v").agg(F.min(id_col).alias(id_col)).select(id_col)
    nulls = df.filter(F.col(nullable).isNull()).select(id_col).orderBy(id_col).limit(k)
    seals = top_per_key(df.select(id_col, seal), [seal], [F.asc(id_col)], k).select(id_col)
    return firsts.union(nulls).union(seals).distinct()


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    return df.withColumn("_h", seeded(id_col, seed)).orderBy("_h").limit(n).drop("_h")


def stratified_sample(df: DataFrame, key: str, id_col: str, n: int, seed: int) -> DataFrame:
    """Fixed number of rows per class; the rank limit is pushed below the shuffle."""
    return top_per_key(df.withColumn("_h", seeded(id_col, seed)), [key], [F.asc("_h")], n).drop("_h", "position")


def source_holdout(df: DataFrame, source: str, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test): sources in ``held`` are never trained on."""
    return df.join(held, source, "left_anti"), df.join(held, source, "left_semi")


def time_holdout(df: DataFrame, year: str, train: Sequence[int], test: Sequence[int]) -> DataFrame:
    fold = F.when(F.col(year).isin(list(train)), "train").when(F.col(year).isin(list(test)), "test")
    return df.withColumn("fold", fold).filter(F.col("fold").isNotNull())
