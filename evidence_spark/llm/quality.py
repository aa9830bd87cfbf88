"""Quality rules with distribution divergence.

Each document becomes two histograms: its characters by class, and its words over the common words of its language (plus
"other"). A language's reference is the mean of the histograms of all documents with that ``lang``, each scaled to one so
that long or loud documents weigh no more than others. A document fails when the Jensen-Shannon distances (base 2, square
root, 0 to 1) of its histograms to the reference are beyond a pair of limits: one of them far off, or both fairly far. A
histogram of a text shorter than its guard is too thin to tell and counts as distance 0.

At scale: one pass makes a fixed number of counts per document, inside the task; the references are one map-side combined
sum of bounded width, and the verdict is arithmetic on the counts. Texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import WordHashes, column_bytes, shingle_hashes, stored, word_hashes

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
CHAR_GUARD = 200  # word characters
WORD_GUARD = 60  # words
# (characters, words): a document fails beyond both numbers of a pair. Set where labelled good documents end.
LIMITS = ((0.30, 0.0), (0.0, 0.345), (0.18, 0.29))
SYMBOLS = b"#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "stop", "symbol", "other", "wide"]
# Frequent words by language.
COMMON = {
    "en": "the of and to in a is that for it as was with be on not he by are this at from or his have an they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec ou".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le".split(),
}
COLUMNS = ("doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
           "n_repeat_words bigint, chars array<double>, commons array<double>")


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.intp)
    table[ord("a"):ord("z") + 1] = CLASSES.index("lower")
    table[ord("A"):ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0"):ord("9") + 1] = CLASSES.index("digit")
    table[list(b".,;:!?'\"()-")] = CLASSES.index("stop")
    table[list(SYMBOLS)] = CLASSES.index("symbol")
    table[0xC0:] = CLASSES.index("wide")  # lead bytes: one per character beyond ASCII
    return table


def _shape(data: bytes, lang: str | None, cache: WordHashes, classes: np.ndarray, common: dict) -> tuple:
    words = data.split()
    n = len(words)
    raw = np.frombuffer(data, np.uint8)
    counts = np.bincount(raw, minlength=256)
    blanks = int(counts[9:14].sum() + counts[32])
    continuation = int(counts[0x80:0xC0].sum())
    by_class = np.bincount(classes, weights=counts.astype(float), minlength=len(CLASSES))
    by_class[CLASSES.index("other")] -= blanks + continuation
    lines, repeated = set(), 0
    if b"\n" in data:
        for line in data.split(b"\n"):
            if line in lines:
                repeated += bool(line.split())
            else:
                lines.add(line)
    again = 0
    if n > WINDOW:
        windows = shingle_hashes(word_hashes(words, cache), WINDOW)
        _, back, seen = np.unique(windows, return_inverse=True, return_counts=True)
        many = (seen[back] > 1).astype(np.int32)
        if many.any():  # a word counts once, however many repeated windows hold it
            cover = np.cumsum(np.concatenate([many, np.zeros(WINDOW - 1, np.int32)])
                              - np.concatenate([np.zeros(WINDOW, np.int32), many])[:n])
            again = int((cover > 0).sum())
    known = common.get(lang)
    if known is None:
        shares: list[float] = []
    else:
        tally = np.zeros(len(known) + 1)
        for w in words:
            tally[known.get(w.lower().strip(b".,;:!?"), len(known))] += 1
        shares = (tally / max(n, 1)).tolist()
    total = by_class.sum()
    return (n, len(raw) - continuation - blanks, int(counts[list(SYMBOLS)].sum()), repeated, again,
            (by_class / max(total, 1)).tolist(), shares)


def document_shapes(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every whole text; a null text has none (all zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, classes = WordHashes(), _class_table()
        common = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON.items()}
        kinds = [pa.int64()] * 5 + [pa.list_(pa.float64())] * 2
        for batch in batches:
            shapes = [_shape(t or b"", lang, cache, classes, common) for t, lang in zip(column_bytes(batch.column(2)), batch.column(1).to_pylist())]
            columns = list(zip(*shapes)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "commons"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, COLUMNS)


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that each sum to one: square root of the divergence in bits."""
    def side(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: side(a, (a + b) / 2) + side(b, (a + b) / 2))
    return F.when(q.isNotNull(), F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0))))


def language_references(shapes: DataFrame) -> dict[str, dict[str, list[float]]]:
    """Mean histograms of each known language over all its documents that are past the guards; at most one row per language."""
    def mean(column: str, width: int, enough: Column) -> Column:
        return F.array(*[F.avg(F.when(enough, F.get(F.col(column), F.lit(i)))) for i in range(width)])

    widths = {lang: len(words) + 1 for lang, words in COMMON.items()}
    rows = (shapes.filter(F.col("lang").isin(list(COMMON))).groupBy("lang").agg(
        mean("chars", len(CLASSES), F.col("word_chars") >= CHAR_GUARD).alias("chars"),
        mean("commons", max(widths.values()), F.col("n_words") >= WORD_GUARD).alias("commons"))).collect()
    return {r["lang"]: {"chars": r["chars"], "commons": r["commons"][:widths[r["lang"]]]} for r in rows}


def _lookup(references: dict, kind: str) -> Column:
    out = F.lit(None).cast("array<double>")
    for lang, reference in references.items():
        if None not in reference[kind]:
            out = F.when(F.col("lang") == lang, F.array(*[F.lit(float(x)) for x in reference[kind]])).otherwise(out)
    return out


def judge(docs: DataFrame, limits: tuple[tuple[float, float], ...] = LIMITS) -> DataFrame:
    """doc_id, the counts, ``base_failed``, both distances and ``kept`` for every row.

    A text under a guard, or in a language without a reference (null included), has a null distance and is kept unless
    ``base_failed``. Rows that repeat an id are judged each on its own; other columns are ignored.
    """
    shapes = stored(document_shapes(docs), "shapes")
    references = language_references(shapes)
    judged = (shapes.withColumn("char_distance", F.when(F.col("word_chars") >= CHAR_GUARD, divergence(F.col("chars"), _lookup(references, "chars"))))
              .withColumn("word_distance", F.when(F.col("n_words") >= WORD_GUARD, divergence(F.col("commons"), _lookup(references, "commons")))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    zero = F.lit(0.0)
    chars, words = F.coalesce("char_distance", zero), F.coalesce("word_distance", zero)
    far = F.lit(False)
    for char_limit, word_limit in limits:
        far = far | ((chars >= char_limit) & (words >= word_limit))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                         (~failed & ~far).alias("kept"), "char_distance", "word_distance")
