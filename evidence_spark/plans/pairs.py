"""Scored pairs derived from the given tables, shared by the evaluation queries.

One row per labelled document: label from ``toxic``, a rule decision and a density score read from the whole text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evidence_spark.functions import numbers as N
from evidence_spark.functions import text as X
from evidence_spark.plans import sqltext as S


def pairs(t):
    symbols = F.regexp_count("text", F.lit(r"[^\p{L}\p{N} \t\n\f\r]")).cast("double")
    words = X.word_count("text").cast("double")
    # A text with nothing to count has no number for a score, as in SQL; dividing by zero would end the query.
    density = F.when(symbols + words > 0, symbols / (symbols + words)).when(symbols + words == 0, F.lit(float("nan")))
    frame = t.documents.join(t.labels, "doc_id").select(
        F.col("doc_id").alias("pair_id"), F.col("source").alias("grp"), "lang", (F.col("toxic") == 1).alias("y"),
        F.col("quality"), N.rounded(density, 4).alias("score"), words.alias("n_words"))
    frame = frame.withColumn("rule", (F.col("quality") == 0) | (F.col("n_words") < 60))
    frame = frame.withColumn("model", F.col("score") >= 0.2).withColumn("compared", F.col("pair_id") % 3 == 0)
    return frame.withColumn("size_band", F.when(F.col("n_words") < 60, "short").when(F.col("n_words") < 300, "medium")
                            .otherwise("long"))


PAIRS = f"""(select *, score >= 0.2 as model, pair_id % 3 = 0 as compared,
  case when n_words < 60 then 'short' when n_words < 300 then 'medium' else 'long' end as size_band,
  (quality = 0 or n_words < 60) as rule from (
  select pair_id, grp, lang, y, quality, n_words, round(symbols/(symbols+n_words),4) as score from (
  select doc_id as pair_id, source as grp, lang, toxic = 1 as y, quality,
    len({S.split_words('text')})::double as n_words,
    length(regexp_replace(text,'[\\p{{L}}\\p{{N}}\\s]','','g'))::double as symbols
  from documents join labels using (doc_id))))"""
