"""Token and sentence tables, and the window-like token operators.

Neighbourhoods are taken inside the row's token array, so a document never has to be gathered from a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions import numbers as N
from evidence_spark.functions import text as X


def sentence_table(df: DataFrame, key: str, text: str, marks: str = ".!?", minimum: int = 1) -> DataFrame:
    return df.select(key, F.posexplode(X.sentences(text, marks, minimum)).alias("sent", "sentence"))


def token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per word: sentence number, position, literal, normalised form, stem, capital and sentence-start flags."""
    sents = sentence_table(df, key, text)
    words = sents.select(key, "sent", F.posexplode(X.literal_words("sentence")).alias("pos", "token"))
    return words.withColumn("norm", X.norm("token")).withColumn("stem", X.stem(F.replace("norm", F.lit(" "), F.lit("")))).withColumn(
        "is_cap", F.col("token").rlike(r"^\p{Lu}")).withColumn("sent_start", F.col("pos") == 0)


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Words, capitals, words that start a sentence, distinct normalised forms and stems per key; keys without words are left out.

    Counted inside the row: no word crosses a sentence, each distinct word is folded once and each distinct form stemmed once, all of a
    text in one call, and only a text's distinct forms are shuffled, since a key may have several rows.
    """
    mark = "\u0002"
    started = F.size(F.filter(X.sentences(text), lambda s: s.rlike(r"[\p{L}\p{N}_]")))
    words = df.select(key, X.literal_words(text).alias("w"), started.alias("starts")).filter(F.size("w") > 0)
    caps = F.regexp_count(F.array_join("w", mark), F.lit(rf"(?:^|{mark})\p{{Lu}}"))
    # A word holds no dot or comma: its form is its folded runs of letters and digits.
    plain = F.regexp_replace(X.fold(F.array_join(F.array_distinct("w"), mark)), f"[^a-z0-9{mark}]+", " ")
    forms = words.select(key, "starts", F.size("w").alias("n"), caps.alias("caps"), F.array_distinct(F.transform(F.split(plain, mark), X.trim)).alias("forms"))
    whole = forms.groupBy(key).agg(F.sum("n").alias("n_tokens"), F.sum("caps").alias("n_caps"), F.sum("starts").alias("n_starts"),
                                   F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"))
    stems = F.regexp_replace(F.replace(F.array_join("forms", "\n"), F.lit(" "), F.lit("")), f"(?m){X.STEM}", "$1")
    stems = F.array_distinct(F.transform(F.split(stems, "\n"), lambda w: F.substring(w, 1, 6)))
    return whole.select(key, "n_tokens", "n_caps", "n_starts", F.size("forms").cast("long").alias("n_forms"), F.size(stems).cast("long").alias("n_stems"))


def neighbourhood(words: Column, hit, before: int, after: int) -> Column:
    """Words within ``before``/``after`` positions of the words that satisfy ``hit``."""
    positions = F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    near = lambda i: F.slice(words, F.greatest(i - before, F.lit(0)) + 1,
                             F.least(i + after, F.size(words) - 1) - F.greatest(i - before, F.lit(0)) + 1)
    return F.flatten(F.transform(positions, near))


def negated_near(words: Column, negations: Iterable[str], targets: Column, reach: int = 4) -> Column:
    """A negation word at most ``reach`` words before one of the target stems; with no targets, any negation."""
    neg = X.words_array(negations)
    followers = F.transform(words, lambda w, i: F.when(
        F.array_contains(neg, w), F.transform(F.slice(words, i + 2, reach), X.stem)))
    found = F.exists(followers, lambda f: F.coalesce(F.arrays_overlap(f, targets), F.lit(False)))
    return F.when(F.size(targets) == 0, F.arrays_overlap(words, neg)).otherwise(found)


def words_before(words: Column, position: Column, reach: int) -> Column:
    start = F.greatest(position - reach, F.lit(0))
    return F.slice(words, start + 1, position - start)


def comparator_before(words: Column, position: Column, table: Sequence[tuple[str, str]], reach: int = 3) -> Column:
    """Comparator named by the phrase that ends right before the number ("mais de" -> min_excl), else "eq"."""
    phrase = F.concat(F.lit(" "), F.array_join(words_before(words, position, reach), " "))
    out = None
    for text, name in table:
        hit = phrase.endswith(" " + text)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("eq"))


def number_mentions(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(N.numbers_in(text)).alias("number"))


def vocabulary_stats(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """Term frequency and document frequency; counted inside the document first, so a common word costs one row per
    document before the shuffle combines it further."""
    per_doc = df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def prune_vocabulary(vocab: DataFrame, n_docs: DataFrame, min_df: int = 1, max_df: float = 1.0,
                     max_features: int | None = None) -> DataFrame:
    """Drop rare and too common terms; keep the most frequent ones (ties by term)."""
    kept = vocab.join(F.broadcast(n_docs)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs")))
    kept = kept.select("term", "tf", "df")
    return kept.orderBy(F.desc("tf"), "term").limit(max_features) if max_features else kept


def rank_terms(df: DataFrame, key: str, main: Column, rest: Column, banned: Iterable[str], k: int = 6) -> DataFrame:
    """Terms by stem: weight 2 in the main sentence and 1 elsewhere, ties by first position."""
    stop = X.words_array(banned)
    usable = lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9,]+$")
    both = F.concat(
        F.transform(main, lambda w, i: F.struct(w.alias("w"), F.lit(2).alias("weight"), i.alias("pos"))),
        F.transform(rest, lambda w, i: F.struct(w.alias("w"), F.lit(1).alias("weight"), (i + 1_000_000).alias("pos"))))
    rows = df.select(key, F.explode(both).alias("t")).select(key, "t.*").filter(usable(F.col("w")))
    # The whole claim is one row, so (key, stem) groups are small; the rank filter limits before the shuffle.
    scored = rows.groupBy(key, X.stem("w").alias("stem")).agg(
        F.sum("weight").alias("score"), F.min("pos").alias("first"), F.min_by("w", "pos").alias("term"))
    from evidence_spark.operators.ranking import top_per_key
    return top_per_key(scored, [key], [F.desc("score"), F.asc("first")], k)


def repeated_topics(df: DataFrame, key: str, title: Column, body: Column, stop: Iterable[str], minimum: int = 2) -> DataFrame:
    """Topic keys that are in the title or repeated in the text."""
    words = lambda c: F.transform(X.content_tokens(X.tokens(c), stop), X.topic_key)
    counts = df.select(key, F.explode(words(body)).alias("topic")).groupBy(key, "topic").agg(F.count(F.lit(1)).alias("n"))
    titles = df.select(key, F.explode(F.array_distinct(F.transform(X.tokens(title), X.topic_key))).alias("topic"))
    return counts.filter(F.col("n") >= minimum).select(key, "topic").union(titles).distinct()
