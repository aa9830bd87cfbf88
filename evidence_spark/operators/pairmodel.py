"""Pair features, exported recipes and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions.numbers import sigmoid
from evidence_spark.operators.ranking import exact_quantiles

# --- fixed values: three-number recipe -------------------------------------------------------------------------------------
PAIR_MEANS = {"cosine": 0.5623891750147286, "overlap": 0.27772204014006235, "text_score": 0.5384060415562084}
PAIR_STDS = {"cosine": 0.2583979207440838, "overlap": 0.2149050612814223, "text_score": 0.4562862134997896}
PAIR_WEIGHTS = {"cosine": 0.8188883495449529, "overlap": 0.6377980487241676, "text_score": 0.8917558194280873}
PAIR_INTERCEPT = -0.3153206821967418


@dataclass
class Recipe:
    """A linear decider as plain numbers: what a model exports and what scoring needs."""

    intercept: float
    numbers: dict[str, tuple[float, float, float]]  # name -> (mean, std, weight)
    age: tuple[str, float, float, float, float] | None = None  # column, median of log, mean, std, weight
    flags: dict[str, float] = field(default_factory=dict)
    categories: dict[str, dict[str, float]] = field(default_factory=dict)
    cut: float = 0.5


# --- fixed values: full recipe ------------------------------------------------------------------------------------------------
FULL_RECIPE = Recipe(
    intercept=-1.7945753066404861,
    numbers={"cosine": (0.359454167499254, 0.23271782055543946, 1.2944645273062543),
             "overlap": (0.1331388748147952, 0.14578395884037437, 0.04964694882866302),
             "text_score": (0.1867890023558184, 0.3409866053117063, 0.8910955910422195)},
    age=("age_days", 3.332204510175204, 3.253782157805912, 2.050382985139997, -0.7483955239366021),
    flags={"has_age": 0.19185573361959513, "compared": -0.015216847179162198, "title_cut": 0.11486780867338946},
    categories={
        "who": {"mesmo": 0.16749322392465332, "nao_sabe": -0.016655180815462394, "outro": -0.13201723894154474, "sem": -0.021066615932193528},
        "action": {"diferente": 0.06803756055688051, "equivale": 0.31952521159230235, "nao_sabe": -0.3687419679815368, "sem": -0.021066615932193528},
        "subject": {"diferente": -0.2433858628651283, "em_comum": 0.28009170832701363, "ia_equivalente": -0.017885041294239384, "sem": -0.021066615932193528},
        "when_": {"antes": -0.4424097567692444, "compativel": 0.22933340870991095, "materia_sem_data": 0.16809128943756507, "sem": 0.042739246857221275},
        "provider": {"ausente": 0.3615700236023273, "bing_news": 0.1802383443820278, "bing_web": -0.39878138784378714, "google_news": 0.001872964613171377,
                     "wikipedia": -0.14714575651828551},
        "claim_type": {"acontecimento": -0.4567716339983784, "acontecimento_recente": 0.4144622278559006, "ausente": -0.058176547133326366,
                       "contagem": 0.3882660886587717, "opiniao": -0.02619057397694566, "previsao": -0.15807271644422324, "quantidade_periodo": -0.10576265672634545}},
    cut=0.874239)


def pair_score(cosine: Column, overlap: Column, text_score: Column) -> Column:
    z = F.lit(PAIR_INTERCEPT)
    for name, c in (("cosine", cosine), ("overlap", overlap), ("text_score", text_score)):
        z = z + PAIR_WEIGHTS[name] * (c - PAIR_MEANS[name]) / PAIR_STDS[name]
    return sigmoid(z)


def log_age(days: Column) -> Column:
    """log(1 + days) with negative days as zero; an unknown age stays null (greatest alone would hide it)."""
    return F.when(days.isNotNull(), F.log1p(F.greatest(days.cast("double"), F.lit(0.0))))


def recipe_score(recipe: Recipe) -> Column:
    """Score column from the recipe alone; unknown categories add nothing."""
    z = F.lit(recipe.intercept)
    for name, (mean, std, weight) in recipe.numbers.items():
        z = z + weight * (F.col(name) - mean) / std
    if recipe.age:
        column, median, mean, std, weight = recipe.age
        z = z + weight * (F.coalesce(log_age(F.col(column)), F.lit(median)) - mean) / std
    for name, weight in recipe.flags.items():
        z = z + weight * F.col(name).cast("double")
    for name, weights in recipe.categories.items():
        table = F.create_map(*[v for k, w in weights.items() for v in (F.lit(k), F.lit(w))])
        z = z + F.coalesce(F.element_at(table, F.col(name)), F.lit(0.0))
    return sigmoid(z)


def score_pairs(pairs: DataFrame, recipe: Recipe = FULL_RECIPE) -> DataFrame:
    scored = pairs.withColumn("score", recipe_score(recipe))
    return scored.withColumn("shown", F.col("score") >= recipe.cut)


@dataclass
class Preprocessor:
    """What the training part taught: population mean and deviation, exact median of the log age, category values."""

    numbers: dict[str, tuple[float, float]]
    age: tuple[str, float, float, float]
    flags: list[str]
    categories: dict[str, list[str]]

    @property
    def features(self) -> list[str]:
        hot = [f"{c}={v}" for c, values in self.categories.items() for v in values]
        return [*self.numbers, self.age[0], *self.flags, *hot]

    def transform(self, df: DataFrame, keep: Sequence[str], interaction: tuple[str, str] | None = None) -> DataFrame:
        """Exactly the listed features plus ``keep``; every other column is dropped."""
        out = {n: (F.col(n) - m) / s for n, (m, s) in self.numbers.items()}
        column, median, mean, std = self.age
        out[column] = (F.coalesce(log_age(F.col(column)), F.lit(median)) - mean) / std
        out |= {f: F.col(f).cast("double") for f in self.flags}
        out |= {f"{c}={v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, values in self.categories.items() for v in values}
        if interaction:
            out[f"{interaction[0]}_x_{interaction[1]}"] = out[interaction[0]] * out[interaction[1]]
        return df.select(*keep, *[c.alias(n) for n, c in out.items()])


MAX_CATEGORY_VALUES = 1000


def fit_preprocessor(train: DataFrame, numbers: Sequence[str], age: str, flags: Sequence[str], categories: Sequence[str]) -> Preprocessor:
    """Learn from the training part only. What comes to the driver is one row of numbers and the category values."""
    median = exact_quantiles(train.select(log_age(F.col(age)).alias("_a")), [], "_a", [0.5]).first()["quantile"]
    filled = F.coalesce(log_age(F.col(age)), F.lit(median))
    one = train.agg(*[f for n in numbers for f in (F.avg(n).alias(f"m_{n}"), F.stddev_pop(n).alias(f"s_{n}"))],
                    F.avg(filled).alias("m_age"), F.stddev_pop(filled).alias("s_age")).first()
    values = {}
    for c in categories:
        found = [r[0] for r in train.select(c).distinct().limit(MAX_CATEGORY_VALUES + 1).collect() if r[0] is not None]
        if len(found) > MAX_CATEGORY_VALUES:
            raise ValueError(f"{c} has more than {MAX_CATEGORY_VALUES} values: not a category")
        values[c] = sorted(found)
    scale = lambda v: v if v else 1.0
    return Preprocessor({n: (one[f"m_{n}"], scale(one[f"s_{n}"])) for n in numbers}, (age, median, one["m_age"], scale(one["s_age"])),
                        list(flags), values)


def population_shift(features: DataFrame, names: Sequence[str], fold: str) -> DataFrame:
    wide = features.groupBy(fold).agg(*[F.avg(F.col(f"`{n}`")).alias(n) for n in names])
    return wide.unpivot([fold], [f"`{n}`" for n in names] if any("=" in n for n in names) else list(names), "feature", "mean")


def parity_check(a: DataFrame, b: DataFrame, key: str, score: str, cut: float, tolerance: float) -> DataFrame:
    """Largest difference of two scorers of the same rows and decisions flipped."""
    both = a.select(key, F.col(score).alias("_a")).join(b.select(key, F.col(score).alias("_b")), key, "full_outer")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(gap), 12).alias("max_difference"),
                    F.count_if((F.col("_a") >= cut) != (F.col("_b") >= cut)).alias("flipped"),
                    F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
                    (F.coalesce(F.max(gap), F.lit(0.0)) <= tolerance).alias("within_tolerance"))


def fingerprint(df: DataFrame, key: str, score: str) -> DataFrame:
    """Order-free digest of rounded scores."""
    h = F.xxhash64(F.col(key).cast("string"), F.format_string("%.6f", F.round(score, 6)))
    return df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("digest"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest_sum"))


def external_scores(df: DataFrame, score: Callable[[pd.DataFrame], pd.Series], column: str = "text_score") -> DataFrame:
    """Plug an outside encoder: Arrow batches in, one score column out."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{column}` double"

    def batches(frames):
        for frame in frames:
            yield frame.assign(**{column: score(frame).astype("float64")})

    return df.mapInPandas(batches, schema)
