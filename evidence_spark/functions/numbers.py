"""Number expressions: keys, values, tolerance and interval arithmetic, score stretching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidence_spark.functions.text import NUMBER, _col


def number_key(raw) -> Column:
    """Digits with thousands dots removed: ``R$ 1.500,00`` becomes ``1500,00``."""
    digits = F.regexp_replace(_col(raw), "[^0-9.,]", "")
    return F.regexp_replace(F.regexp_replace(digits, r"\.(?=[0-9]{3}([^0-9]|$))", ""), r"^[.,]+|[.,]+$", "")


def numbers_in(c) -> Column:
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(f"({NUMBER})"), F.lit(1))
    return F.array_distinct(F.transform(found, number_key))


def numbers_with_unit(c) -> Column:
    """``number unit`` for each number a word follows: its key and the word in lower case."""
    found = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(rf"({NUMBER}\s+\p{{L}}+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda m: F.concat_ws(" ", number_key(m), F.lower(F.regexp_extract(m, r"(\p{L}+)$", 1)))))


def to_double(raw) -> Column:
    """``1.234,5`` and ``1,234`` style numbers as doubles."""
    c = _col(raw)
    plain = F.when(c.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"), F.translate(F.replace(c, F.lit("."), F.lit("")), ",", "."))
    plain = plain.when(c.rlike("^[0-9]{1,3}(,[0-9]{3})+$") & (F.length(c) > 5), F.replace(c, F.lit(","), F.lit("")))
    return plain.otherwise(F.translate(c, ",", ".")).try_cast("double")


def rounded(c, digits: int) -> Column:
    """Half away from zero on the binary value, as SQL engines round doubles; Spark's ``round`` goes by the decimal spelling."""
    return F.round(_col(c) * 10.0 ** digits) / 10.0 ** digits


def interval(value: Column, comparator: Column) -> Column:
    """Closed numeric interval a quantity stands for; large plain values carry half a percent of rounding."""
    infinity = F.lit(float("inf"))
    low = (F.when(comparator == "approx", value * 0.9).when(comparator == "min", value)
           .when(comparator == "min_excl", value * 1.0000001 + 1e-9).when(comparator.isin("max", "max_excl"), F.lit(0.0))
           .when(value >= 1000, value * 0.995).otherwise(value))
    high = (F.when(comparator == "approx", value * 1.1).when(comparator.isin("min", "min_excl"), infinity)
            .when(comparator == "max", value).when(comparator == "max_excl", value * 0.9999999)
            .when(value >= 1000, value * 1.005).otherwise(value))
    return F.struct(low.alias("low"), high.alias("high"))


def compatible(a: Column, b: Column) -> Column:
    return (a["low"] <= b["high"]) & (b["low"] <= a["high"])


def same_value(a: Column, b: Column) -> Column:
    """Equal within half a percent of the larger magnitude."""
    return F.abs(a - b) <= 0.005 * F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def distinct_values(values: Column) -> Column:
    """Ascending values kept only when they differ from the last kept one (the tolerance is not transitive)."""
    return F.aggregate(
        F.array_sort(values), F.array().cast("array<double>"),
        lambda kept, v: F.when((F.size(kept) == 0) | ~same_value(F.element_at(kept, -1), v),
                               F.concat(kept, F.array(v))).otherwise(kept))


def logit(score) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), _col(score)))
    return F.ln(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
