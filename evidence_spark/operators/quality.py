"""Label and reading quality checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions import numbers as N
from evidence_spark.functions import text as X


def headline_number_audit(df: DataFrame, key: str, head: str, body: str, min_body: int = 80) -> DataFrame:
    """Numbers of the head that the body does not repeat: near (a doubled digit lost, or one digit away), year, or missing. Row-local work.

    A year is near only to a number it gives by a doubled digit: other years differ from it by a digit without any slip. A
    number with a unit (the word after it) is near only to numbers that the body gives with the same unit.
    """
    rows = df.filter(F.length(body) >= min_body).select(
        key, N.numbers_in(head).alias("heads"), N.numbers_in(body).alias("known"), N.numbers_with_unit(head).alias("asked"), N.numbers_with_unit(body).alias("said"))
    rows = rows.select(key, "known", "asked", "said", F.explode(F.array_except("heads", "known")).alias("number"))
    unit = F.substring_index(F.get(F.filter("asked", lambda a: F.startswith(a, F.concat("number", F.lit(" ")))), F.lit(0)), " ", -1)
    alike = F.filter("known", lambda k: F.col("unit").isNull() | F.array_contains("said", F.concat_ws(" ", k, F.col("unit"))))
    rows = rows.withColumn("unit", unit).select(key, "number", alike.alias("known"))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    near = F.filter("known", lambda k: (F.length(digits(F.col("number"))) >= 3)
                    & (F.levenshtein(digits(k), digits(F.col("number"))) == 1))
    slip = F.exists("known", lambda k: doubled_digit_slip(digits(F.col("number")), digits(k)) | doubled_digit_slip(digits(k), digits(F.col("number"))))
    out = rows.select(key, "number", F.size(near).alias("n_near"), slip.alias("slip"))
    verdict = (F.when(F.col("slip"), F.lit("near")).when(F.col("number").rlike("^(19|20)[0-9]{2}$"), F.lit("year"))
               .when(F.col("n_near") > 0, F.lit("near")).otherwise(F.lit("missing")))
    return out.select(key, "number", verdict.alias("verdict"), "n_near")


def doubled_digit_slip(raw: Column, cand: Column) -> Column:
    """Reading slip of one repeated digit: dropping one of a doubled digit of ``raw`` gives ``cand``."""
    at = F.sequence(F.lit(1), F.greatest(F.length(raw) - 1, F.lit(1)))
    doubled = F.exists(at, lambda i: (F.substr(raw, i, F.lit(1)) == F.substr(raw, i + 1, F.lit(1))) & (
        F.concat(F.substr(raw, F.lit(1), i), F.substr(raw, i + 2, F.length(raw))) == cand))
    return (F.length(raw) == F.length(cand) + 1) & doubled


def majority_vote(df: DataFrame, item: str, reading: str, order: str) -> DataFrame:
    """Keep the first reading unless another is seen at least twice and in more than half of the readings."""
    counts = df.groupBy(item, reading).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    per_item = counts.groupBy(item).agg(
        F.min_by(reading, F.struct("first", reading)).alias("original"), F.sum("n").alias("total"), F.max(F.struct("n", reading)).alias("top"))
    wins = (F.col("top.n") >= 2) & (F.col("top.n") * 2 > F.col("total"))
    kept = F.when(wins, F.col(f"top.{reading}")).otherwise(F.col("original"))
    return per_item.select(item, kept.alias("kept"), (kept != F.col("original")).alias("changed"))


def measure_eligibility(df: DataFrame, key: str, y: str, excluded: Sequence[str], slice_flag: str) -> DataFrame:
    """Rows seen by judges or synthetic stay in training and leave every measure."""
    ok = reduce(lambda a, b: a & b, [~F.col(c) for c in excluded])
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("measured"),
                               F.count_if(ok & F.col(y)).alias("measured_positives"),
                               F.count_if(ok & F.col(slice_flag)).alias("old_source_positives"))


def rejudge_score(df: DataFrame, old: str, new: str, human: str, gate: float = 0.7) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    o, n, h = F.col(old), F.col(new), F.col(human)
    return df.agg(F.round(share(o != n), 6).alias("flipped"), F.round(share(o == n), 6).alias("agree"),
                  F.round(share(n == h), 6).alias("human_agrees"), (share(n == h) >= gate).alias("passes"))


def capture_scores(df: DataFrame, observed: str, required: str, forbidden: Sequence[str], kept: Column) -> DataFrame:
    """Per case: focus kept, required words missing, forbidden words leaked; totals by kept."""
    missing = F.size(F.array_except(required, observed))
    leaked = F.size(F.array_intersect(F.col(observed), X.words_array(forbidden)))
    rows = df.select(kept.alias("kept"), missing.alias("missing"), leaked.alias("leaked"))
    return rows.groupBy("kept").agg(
        F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"), F.sum("leaked").alias("leaked"),
        F.count_if(F.col("kept") & (F.col("missing") == 0) & (F.col("leaked") == 0)).alias("passed"))
