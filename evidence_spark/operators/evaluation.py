"""Evaluation of deciders over labelled pairs.

Frames hold one row per pair with a boolean label ``y``, boolean decisions and double scores. Every measure is a grouped
count, so it combines before the shuffle; curves run over distinct scores, not rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.operators.ranking import exact_quantiles, running_totals


def n_if(condition: Column) -> Column:
    return F.count_if(condition)


def ratio(top: Column, bottom: Column) -> Column:
    """Ratio whose denominator never falls under one."""
    return top / F.greatest(bottom, F.lit(1))


def confusion_matrix(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    yes, shown = F.col(y), F.col(pred)
    counts = df.groupBy(*keys).agg(n_if(yes & shown).alias("tp"), n_if(~yes & shown).alias("fp"),
                                   n_if(yes & ~shown).alias("fn"), n_if(~yes & ~shown).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select("*", *[F.round(100 * F.col(c) / total, 2).alias(f"{c}_per_100") for c in ("tp", "fp", "fn", "tn")])


def precision_recall(y: Column, pred: Column) -> dict[str, Column]:
    return {"precision": ratio(n_if(y & pred), n_if(pred)), "recall": ratio(n_if(y & pred), n_if(y))}


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class plus macro and weighted rows; undefined values are zero."""
    counts = df.groupBy(F.col(y).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))  # classes squared rows
    side = lambda cls, support, shown, hits: F.struct(
        cls.alias("class"), support.cast("long").alias("support"), shown.cast("long").alias("shown"), hits.cast("long").alias("hits"))
    t, p, n, zero = F.col("t"), F.col("p"), F.col("n"), F.lit(0)
    sides = counts.select(F.inline(F.array(
        side(t, n, zero, F.when(t == p, n).otherwise(zero)), side(p, zero, n, zero))))
    per = sides.groupBy("class").agg(F.sum("support").alias("support"), F.sum("shown").alias("shown"), F.sum("hits").alias("hits"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = safe(F.col("hits"), F.col("shown")), safe(F.col("hits"), F.col("support"))
    per = per.withColumn("precision", p).withColumn("recall", r)
    per = per.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    rounded = lambda d, how: d.agg(F.lit(how).alias("class"), F.sum("support").alias("support"), *[
        F.round(F.avg(n) if how == "macro avg" else F.sum(F.col(n) * F.col("support")) / F.sum("support"), 6).alias(n) for n in names])
    rows = per.select("class", "support", *[F.round(n, 6).alias(n) for n in names])
    return rows.unionByName(rounded(per, "macro avg")).unionByName(rounded(per, "weighted avg"))


def accuracy_summary(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Accuracy against the floor of always answering the majority class."""
    hits = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"), n_if(F.col(y) == F.col(pred)).alias("ok"))
    return hits.agg(F.round(F.sum("ok") / F.sum("n"), 6).alias("accuracy"),
                    F.round(F.max("n") / F.sum("n"), 6).alias("majority_baseline"), F.sum("n").alias("n"))


def slice_metrics(df: DataFrame, y: str, deciders: Sequence[str], dims: Sequence[str], small: int = 10) -> DataFrame:
    """One row per (dimension, value): size, positives, and each decider's shown, recall per 10 and precision."""
    rows = df.select(y, *deciders, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("s"))
    measures = []
    for d in deciders:
        pr = precision_recall(F.col(y), F.col(d))
        measures += [n_if(F.col(d)).alias(f"{d}_shown"), F.round(10 * pr["recall"], 2).alias(f"{d}_recall_per_10"),
                     F.round(pr["precision"], 3).alias(f"{d}_precision")]
    out = rows.groupBy("s.dimension", "s.value").agg(F.count(F.lit(1)).alias("n"), n_if(F.col(y)).alias("positives"), *measures)
    return out.withColumn("small_sample", F.col("positives") < small)


def worst_best_slice(slices: DataFrame, measure: str) -> DataFrame:
    """Lowest and highest slice per dimension; ties go to the smaller (worst) or larger (best) value name."""
    key = F.struct(measure, "value")
    return slices.groupBy("dimension").agg(
        F.min_by("value", key).alias("worst"), F.min(measure).alias("worst_measure"),
        F.max_by("value", key).alias("best"), F.max(measure).alias("best_measure"))


def accuracy_by(df: DataFrame, key: str, y: str, pred: str) -> DataFrame:
    return df.groupBy(key).agg(F.round(F.avg((F.col(y) == F.col(pred)).cast("int")), 6).alias("accuracy"),
                               F.count(F.lit(1)).alias("n"))


def calibration_table(df: DataFrame, y: str, score: str, bins: int = 10, minimum: int = 5) -> DataFrame:
    bin_of = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    out = df.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_score"),
                                              F.round(F.avg(F.col(y).cast("int")), 6).alias("positive_share"))
    return out.filter(F.col("n") >= minimum)


def wilson_interval(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    den = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    low = F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), centre - half), 3))
    high = F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), centre + half), 3))
    return low, high


def agreement(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), min_kappa: float = 0.60, min_agree: float = 85.0) -> DataFrame:
    """Cohen's kappa and agreement per 100 of two judges, with their gates."""
    cells = df.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    total = cells.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("agreed"))
    side = lambda c, out: cells.groupBy(*keys, F.col(c).alias("_c")).agg(F.sum("_n").alias(out))
    joined = side("_a", "_na").join(side("_b", "_nb"), [*keys, "_c"])
    chance = joined.groupBy(*keys).agg(F.sum(F.col("_na") * F.col("_nb")).alias("_prod"))
    both = total.join(chance, list(keys)) if keys else total.join(F.broadcast(chance))  # one row each
    po, pe = F.col("agreed") / F.col("n"), F.col("_prod") / (F.col("n") * F.col("n"))
    kappa = F.when(pe < 1, (po - pe) / (1 - pe))
    out = both.select(*keys, "n", "agreed", F.round(100 * po, 1).alias("agree_per_100"), F.round(kappa, 4).alias("kappa"))
    return out.withColumn("passes", (F.col("kappa") >= min_kappa) & (F.col("agree_per_100") >= min_agree))


def overlap_of_deciders(df: DataFrame, y: str, rule: str, model: str) -> DataFrame:
    """Who finds what: only the rule, only the model, both; shared mistakes; union and veto."""
    yes, r, m = F.col(y), F.col(rule), F.col(model)
    return df.agg(
        n_if(yes & r & ~m).alias("only_rule"), n_if(yes & m & ~r).alias("only_model"), n_if(yes & r & m).alias("both"),
        n_if(~yes & r).alias("rule_fp"), n_if(~yes & m).alias("model_fp"), n_if(~yes & r & m).alias("shared_fp"),
        n_if(yes & (r | m)).alias("union_tp"), n_if(~yes & (r | m)).alias("union_fp"),
        n_if(yes & r & m).alias("veto_tp"), n_if(~yes & r & m).alias("veto_fp"))


def promotion_table(df: DataFrame, y: str, rule: str, score: str, cuts: Sequence[float]) -> DataFrame:
    """For each cut: pairs the rule left out that the score promotes, right and wrong; and low-score warnings on shown ones."""
    rows = df.select(y, rule, score, F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut"))
    up = ~F.col(rule) & (F.col(score) >= F.col("cut"))
    warn = F.col(rule) & (F.col(score) < F.col("cut"))
    out = rows.groupBy("cut").agg(
        n_if(up).alias("promoted"), n_if(up & F.col(y)).alias("promoted_right"), n_if(up & ~F.col(y)).alias("promoted_wrong"),
        n_if(warn).alias("warned"), n_if(warn & ~F.col(y)).alias("warned_rule_wrong"))
    return out


def pr_curve(df: DataFrame, y: str, score: str) -> DataFrame:
    """One point per distinct score (ties together): cut, counts, precision, recall."""
    per_score = df.groupBy(F.col(score).alias("cut")).agg(
        F.count(F.lit(1)).alias("_n"), n_if(F.col(y)).alias("_pos"))
    curve = running_totals(per_score, "cut", {"shown": "_n", "tp": "_pos"}, descending=True)
    total = per_score.agg(F.sum("_pos").alias("positives"), F.sum("_n").alias("n_rows"))
    return curve.join(F.broadcast(total)).select(  # total is one row
        "cut", "shown", "tp", (F.col("shown") - F.col("tp")).alias("fp"), "positives", "n_rows", F.col("_pos").alias("tp_here"),
        (F.col("tp") / F.greatest(F.col("shown"), F.lit(1))).alias("precision"),
        (F.col("tp") / F.greatest(F.col("positives"), F.lit(1))).alias("recall"))


def average_precision(df: DataFrame, y: str, score: str) -> DataFrame:
    """Sum of recall steps times precision; each distinct score adds its own positives, so no second ordering is needed."""
    curve = pr_curve(df, y, score)
    return curve.agg(F.round(F.sum(F.col("tp_here") / F.greatest(F.col("positives"), F.lit(1)) * F.col("precision")), 6)
                     .alias("average_precision"), F.max("positives").alias("positives"))


def threshold_at_precision(df: DataFrame, y: str, score: str, floor: float) -> DataFrame:
    """Loosest cut whose precision reaches the floor."""
    ok = pr_curve(df, y, score).filter(F.col("precision") >= floor)
    return ok.agg(F.min("cut").alias("cut"), F.round(F.min_by("precision", "cut"), 6).alias("precision"),
                  F.round(F.min_by("recall", "cut"), 6).alias("recall"), F.min_by("shown", "cut").alias("shown"))


def threshold_for_fp_budget(df: DataFrame, y: str, base: str, score: str, alpha: float) -> DataFrame:
    """Smallest cut such that the false-positive rate of (base or score >= cut) stays within ``alpha``."""
    yes, shown = F.col(y), F.col(base)
    per_score = df.groupBy(F.col(score).alias("cut")).agg(n_if(~yes & ~shown).alias("_fp"), n_if(yes & ~shown).alias("_tp"))
    curve = running_totals(per_score, "cut", {"fp": "_fp", "tp": "_tp"}, descending=True)
    fixed = df.agg(n_if(~yes).alias("negatives"), n_if(~yes & shown).alias("base_fp"), n_if(yes & shown).alias("base_tp"),
                   n_if(yes).alias("positives"))
    ok = curve.join(F.broadcast(fixed)).withColumn("fp_rate", (F.col("base_fp") + F.col("fp")) / F.greatest("negatives", F.lit(1)))
    ok = ok.withColumn("recall", (F.col("base_tp") + F.col("tp")) / F.greatest("positives", F.lit(1))).filter(F.col("fp_rate") <= alpha)
    return ok.agg(F.min("cut").alias("cut"), F.round(F.min_by("fp_rate", "cut"), 6).alias("fp_rate"),
                  F.round(F.min_by("recall", "cut"), 6).alias("recall"))


def best_accuracy_threshold(df: DataFrame, y: str, score: str) -> DataFrame:
    """Cut with the highest accuracy (the higher cut wins ties)."""
    curve = pr_curve(df, y, score)
    right = F.col("tp") + (F.col("n_rows") - F.col("positives") - F.col("fp"))
    scored = curve.select("cut", (right / F.col("n_rows")).alias("accuracy"), "fp", (F.col("positives") - F.col("tp")).alias("fn"))
    best = F.struct("accuracy", "cut")
    return scored.agg(F.max_by("cut", best).alias("cut"), F.round(F.max("accuracy"), 6).alias("accuracy"),
                      F.max_by("fp", best).alias("accepted_by_mistake"), F.max_by("fn", best).alias("lost"))


def errors_at_best_accuracy(df: DataFrame, y: str, score: str, key: str) -> DataFrame:
    """The rows that the cut of ``best_accuracy_threshold`` decides wrongly: key, score, error (accepted_by_mistake or lost).

    The cut is one broadcast row; the lists are as long as they are, spread over the partitions of ``df``.
    """
    cut = F.broadcast(best_accuracy_threshold(df, y, score).select("cut"))
    accepted, true = F.col(score) >= F.col("cut"), F.col(y)
    error = F.when(accepted & ~true, "accepted_by_mistake").when(~accepted & true, "lost")
    return df.join(cut).select(key, score, error.alias("error")).filter("error is not null")


def hybrid_decider(df: DataFrame, y: str, compared: str, rule: str, score: str, floor: float) -> DataFrame:
    """Rule where it compared, score elsewhere, with the loosest cut at which the whole still reaches the floor."""
    yes = F.col(y)
    fixed = df.agg(n_if(F.col(compared) & F.col(rule)).alias("rule_shown"), n_if(F.col(compared) & F.col(rule) & yes).alias("rule_tp"),
                   n_if(yes).alias("positives"))
    rest = df.filter(~F.col(compared)).groupBy(F.col(score).alias("cut")).agg(F.count(F.lit(1)).alias("_n"), n_if(yes).alias("_pos"))
    curve = running_totals(rest, "cut", {"shown": "_n", "tp": "_pos"}, descending=True).join(F.broadcast(fixed))
    tp, shown = F.col("tp") + F.col("rule_tp"), F.col("shown") + F.col("rule_shown")
    curve = curve.select("cut", (tp / F.greatest(shown, F.lit(1))).alias("precision"),
                         (tp / F.greatest("positives", F.lit(1))).alias("recall")).filter(F.col("precision") >= floor)
    return curve.agg(F.min("cut").alias("cut"), F.round(F.min_by("precision", "cut"), 6).alias("precision"),
                     F.round(F.min_by("recall", "cut"), 6).alias("recall"))


def decision_crosstab(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), n_if(F.col(y)).alias("positives"),
                                F.round(100 * F.avg(F.col(y).cast("int")), 1).alias("positive_per_100"))


def worst_errors(df: DataFrame, y: str, pred: str, score: str, key: str, k: int = 15) -> DataFrame:
    """Highest-score mistakes and lowest-score misses; ties by id."""
    fp = df.filter(F.col(pred) & ~F.col(y)).orderBy(F.desc(score), key).limit(k).withColumn("kind", F.lit("shown_by_mistake"))
    fn = df.filter(~F.col(pred) & F.col(y)).orderBy(score, key).limit(k).withColumn("kind", F.lit("missed"))
    return fp.unionByName(fn).select("kind", key, score)


def bootstrap_weights(groups: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """Poisson(1) resampling weight of every group in every replicate, from a hash: the same on any partitioning."""
    reps = groups.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.pmod(F.xxhash64(F.col(group), F.col("rep"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cumulative, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        total += p
        cumulative.append(total)
        p /= k + 1
    weight = reduce(lambda acc, c: acc + (u >= c).cast("int"), cumulative, F.lit(0))
    return reps.withColumn("w", weight)


def cluster_bootstrap_diff(df: DataFrame, y: str, a: str, b: str, group: str, replicates: int = 2000, seed: int = 20261008,
                           keys: Sequence[str] = ()) -> DataFrame:
    """Recall of ``a`` minus recall of ``b`` with a 95 % interval from resampling whole groups.

    Rows are first reduced to three counts per group, so the replicate join grows with groups, not rows.
    """
    yes = F.col(y)
    per_group = df.groupBy(*keys, group).agg(
        n_if(yes).alias("pos"), n_if(yes & F.col(a)).alias("ta"), n_if(yes & F.col(b)).alias("tb"))
    observed = per_group.groupBy(*keys).agg(
        ((F.sum("ta") - F.sum("tb")) / F.greatest(F.sum("pos"), F.lit(1))).alias("diff"), F.count(F.lit(1)).alias("n_groups"))
    weighted = bootstrap_weights(per_group, group, replicates, seed)
    reps = weighted.groupBy(*keys, "rep").agg(
        (F.sum((F.col("ta") - F.col("tb")) * F.col("w")) / F.greatest(F.sum(F.col("pos") * F.col("w")), F.lit(1))).alias("d"))
    # ``replicates`` values per key, a fixed number.
    bounds = reps.groupBy(*keys).agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    joined = observed.join(bounds, list(keys)) if keys else observed.join(F.broadcast(bounds))
    return joined.select(*keys, "n_groups", F.round("diff", 6).alias("diff"), F.round(F.col("q")[0], 6).alias("low"),
                         F.round(F.col("q")[1], 6).alias("high"))


def contract(df: DataFrame, y: str, model: str, rule: str, group: str, replicates: int = 2000, points: float = 3.0) -> DataFrame:
    """The two promises: recall gain whose interval lies above zero, precision at most ``points`` under the rule."""
    gain = cluster_bootstrap_diff(df, y, model, rule, group, replicates)
    m, r = precision_recall(F.col(y), F.col(model)), precision_recall(F.col(y), F.col(rule))
    both = df.agg(F.round(m["precision"], 6).alias("model_precision"), F.round(r["precision"], 6).alias("rule_precision"))
    out = gain.join(F.broadcast(both))
    return out.withColumn("recall_kept", F.col("low") > 0).withColumn(
        "precision_kept", F.col("model_precision") >= F.col("rule_precision") - points / 100)


def scoreboard(df: DataFrame, y: str, deciders: Mapping[str, str | None], ruler: str, group: str, replicates: int = 2000) -> DataFrame:
    """One row per decider (decision column -> score column or None): recall, precision, average precision, gain."""
    rows = []
    for decision, score in deciders.items():
        pr = precision_recall(F.col(y), F.col(decision))
        base = df.agg(F.lit(decision).alias("decider"), F.round(10 * pr["recall"], 2).alias("recall_per_10"),
                      F.round(pr["precision"], 3).alias("precision"))
        ap = average_precision(df, y, score).select("average_precision") if score else base.select(
            F.lit(None).cast("double").alias("average_precision"))
        gain = cluster_bootstrap_diff(df, y, decision, ruler, group, replicates).select("diff", "low", "high")
        rows.append(base.join(F.broadcast(ap)).join(F.broadcast(gain)))  # one row each
    return reduce(DataFrame.unionByName, rows)


def median_score(df: DataFrame, score: str) -> DataFrame:
    return exact_quantiles(df, [], score, [0.5])
