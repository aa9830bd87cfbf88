"""Training on MLlib: text and pair models, leak audits, bake-off, out-of-fold scores, grid search, sealed evaluation."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes)
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark.functions import text as X
from evidence_spark.operators import evaluation as E
from evidence_spark.operators.pairmodel import fingerprint
from evidence_spark.operators.splits import seeded
from evidence_spark.session import cut_lineage


def balanced_weights(df: DataFrame, y: str, sample_weight: str | None = None) -> DataFrame:
    """Adds ``weight`` = n / (classes * n_class), times the row's own weight."""
    sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("_c"))
    totals = sizes.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    table = sizes.join(F.broadcast(totals)).select(F.col(y), (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("_w"))  # one row per class
    own = F.col(sample_weight) if sample_weight else F.lit(1.0)
    return df.join(F.broadcast(table), y).withColumn("weight", F.col("_w") * own).drop("_w")


def logistic(c: float, total_weight: float, features: str = "features", label: str = "label") -> LogisticRegression:
    """Ridge logistic regression with the inverse-strength convention: regParam = 1 / (C * sum of weights)."""
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=1.0 / (c * total_weight),
                              elasticNetParam=0.0, standardization=False, maxIter=100)


TEXT_MODELS: Mapping[str, Callable] = {
    "logreg": lambda: LogisticRegression(weightCol="weight", regParam=0.01, maxIter=15),
    "linear_svm": lambda: LinearSVC(weightCol="weight", regParam=0.01, maxIter=15),
    "multinomial_nb": lambda: NaiveBayes(weightCol="weight", modelType="multinomial"),
}


def weighted_terms(counts: DataFrame, tf: str, out: str) -> ElementwiseProduct:
    """Term counts times ln((n + 1) / (df + 1)) + 1, with n and df from ``counts``; the library's own idf lacks the + 1."""
    idf = IDF(inputCol=tf, outputCol=out).fit(counts.select(tf)).idf.toArray() + 1.0
    return ElementwiseProduct(inputCol=tf, outputCol=out, scalingVec=Vectors.dense(idf))


def train_text(train: DataFrame, kind: str, min_df: float = 2.0, max_features: int = 30_000):
    """``train`` has words (array), label (double), weight."""
    vocabulary = CountVectorizer(inputCol="words", outputCol="tf", minDF=min_df, vocabSize=max_features).fit(train)
    counts = vocabulary.transform(train)
    weights = weighted_terms(counts, "tf", "features")
    return PipelineModel(stages=[vocabulary, weights, TEXT_MODELS[kind]().fit(weights.transform(counts))])


def word_char_features(df: DataFrame, train, max_words: int = 30_000, max_chars: int = 50_000) -> DataFrame:
    """Word 1-2 grams beside character 3-5 grams as one vector; the vocabulary comes from the training rows.

    The gram arrays feed both fitting passes and the transform, so they are written once.
    """
    grams = cut_lineage(df.withColumn("wgrams", F.concat("words", X.ngrams(F.col("words"), 2))).withColumn(
        "cgrams", F.flatten(F.transform("words", lambda w: X.char_ngrams(w)))))
    stages = [CountVectorizer(inputCol="wgrams", outputCol="wtf", minDF=2.0, vocabSize=max_words),
              CountVectorizer(inputCol="cgrams", outputCol="ctf", minDF=2.0, vocabSize=max_chars)]
    counts = Pipeline(stages=stages).fit(grams.filter(train)).transform(grams)
    seen = counts.filter(train)
    for weights in (weighted_terms(seen, "wtf", "wx"), weighted_terms(seen, "ctf", "cx")):
        counts = weights.transform(counts)
    ready = VectorAssembler(inputCols=["wx", "cx"], outputCol="features").transform(counts)
    return cut_lineage(ready.select(*[c for c in df.columns if c != "words"], "features"))


def accuracy(scored: DataFrame, label: str = "label") -> DataFrame:
    return E.accuracy_summary(scored, label, "prediction")


def leak_audit(df: DataFrame, column_sets: Mapping[str, Sequence[str]], label: str, test: str, margin: float = 0.1) -> DataFrame:
    """One small model per column set against the majority floor: a set far above the floor leaks the answer."""
    rows = []
    for name, columns in column_sets.items():
        assembled = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(df.na.fill(0.0))
        model = LogisticRegression(labelCol=label, maxIter=30).fit(assembled.filter(~F.col(test)))
        rows.append(E.accuracy_summary(model.transform(assembled.filter(test)), label, "prediction").withColumn("feature_set", F.lit(name)))
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("leak_suspect", F.col("accuracy") > F.col("majority_baseline") + margin)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    quoted = [f"`{n}`" for n in features]
    plain = df.select(*[c for c in df.columns if c not in features], F.array(*[F.col(q).cast("double") for q in quoted]).alias("_x"))
    from pyspark.ml.functions import array_to_vector
    return plain.withColumn("features", array_to_vector("_x")).drop("_x")


def probability(scored: DataFrame, column: str = "score") -> DataFrame:
    return scored.withColumn(column, vector_to_array("probability")[1])


def out_of_fold(df: DataFrame, folds: Sequence[int], fold: str, fit: Callable[[DataFrame], object], key: str) -> DataFrame:
    """Score of every row by a model that never saw its group."""
    parts = [probability(fit(df.filter(F.col(fold) != k)).transform(df.filter(F.col(fold) == k))).select(key, "score") for k in folds]
    return reduce(DataFrame.unionByName, parts)


def shuffled_labels(df: DataFrame, y: str, key: str, seed: int) -> DataFrame:
    """Labels dealt again by hash order: same class counts, no relation to the features.

    A label goes to the row whose rank by one hash equals its rank by another; ranks are computed in parallel slices.
    """
    from evidence_spark.operators.ranking import positions_by_hash

    rows = positions_by_hash(df.withColumn("_h", seeded(key, seed)), [], "_h", "_p").drop("_h", "key_rows", y)
    deals = positions_by_hash(df.select(y, seeded(key, seed + 1).alias("_h")), [], "_h", "_p").select("_p", y)
    return rows.join(deals, "_p").drop("_p")


def bake_off(study: DataFrame, held: DataFrame, candidates: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]], y: str, floor: float,
             ruler: str, gain: float = 0.01) -> DataFrame:
    """Each candidate (fit-and-score function) measured at the same precision floor, with its verdict against the ruler."""
    rows = [E.threshold_at_precision(fn(study, held), y, "score", floor).withColumn("candidate", F.lit(name)) for name, fn in candidates.items()]
    table = cut_lineage(reduce(DataFrame.unionByName, rows))
    base = table.filter(F.col("candidate") == ruler).select(F.coalesce("recall", F.lit(0.0)).alias("ruler_recall"))
    gap = F.coalesce("recall", F.lit(0.0)) - F.col("ruler_recall")
    verdict = F.when(F.col("candidate") == ruler, "ruler").when(gap > gain, "win").when(gap < -gain, "lose").otherwise("tie")
    return table.join(F.broadcast(base)).withColumn("verdict", verdict).drop("ruler_recall")


def pick_config(grid: DataFrame, factory: Sequence, columns: Sequence[str], measure: str, tolerance: float = 0.1) -> DataFrame:
    """Keep the factory setting unless another gains more than ``tolerance``; among the tied, the strongest regularisation."""
    best = grid.agg(F.max(measure).alias("_best"))
    tied = grid.join(F.broadcast(best)).filter(F.col(measure) >= F.col("_best") - tolerance).drop("_best")
    is_factory = reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(columns, factory)])
    return tied.withColumn("factory", is_factory).orderBy(F.desc("factory"), *columns).limit(1)


def train_gbt(df: DataFrame, label: str = "label"):
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=20, maxDepth=3, seed=7).fit(df)


def export_linear(spark: SparkSession, names: Sequence[str], coefficients: Sequence[float], idf: Sequence[float] | None = None) -> DataFrame:
    """Model weights as a table: (term, idf, coef). The vocabulary size is a training parameter, hence bounded."""
    rows = [(n, float(idf[i]) if idf is not None else 1.0, float(coefficients[i])) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "term string, idf double, coef double")


def top_terms(model: DataFrame, k: int = 30) -> DataFrame:
    low = model.orderBy("coef", "term").limit(k).withColumn("side", F.lit("negative"))
    return low.unionByName(model.orderBy(F.desc("coef"), "term").limit(k).withColumn("side", F.lit("positive")))


def sealed_evaluation(ledger_path: str, test: DataFrame, key: str, y: str, pred: str, score: str) -> DataFrame:
    """Open the sealed set once. The first call measures and appends to the ledger; later calls return the stored result,
    and a different set or different predictions fail."""
    spark = test.sparkSession
    mark = fingerprint(test, key, score).first()
    schema = "digest string, n bigint, touches int, result string"
    try:
        stored = spark.read.schema(schema).json(ledger_path).limit(2).collect()
    except Exception as error:  # no ledger yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = []
    if stored:
        if stored[0]["digest"] != str(mark["digest"]) or stored[0]["n"] != mark["n"]:
            raise ValueError("the sealed set or its predictions changed since it was opened")
    else:
        pr = E.precision_recall(F.col(y), F.col(pred))
        result = test.agg(F.round(pr["precision"], 6).alias("precision"), F.round(pr["recall"], 6).alias("recall")).first().asDict()
        entry = [(str(mark["digest"]), mark["n"], 1, json.dumps(result))]
        spark.createDataFrame(entry, schema).coalesce(1).write.mode("append").json(ledger_path)
    return spark.read.schema(schema).json(ledger_path)
