"""Which of many names stand in which texts: runs of words are looked up as 64-bit hashes where the text is; no pair of a name and a text is made first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions import text as X
from evidence_spark.session import kept

# Names that every task looks up at once; more are looked up in several passes over the texts.
NAMES = 1_000_000
SLICE = 1_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def _opened(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, word) of a column of hashed words."""
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return row, lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the words times falling powers of STEP, and its rising powers: any run's hash is one difference, whatever its length."""
    falling = np.full(len(words), pow(int(STEP), -1, 1 << 64), np.uint64)
    rising = np.full(len(words), STEP, np.uint64)
    falling[:1] = rising[:1] = 1
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(falling))]), np.cumprod(rising)


def _run(sums: tuple[np.ndarray, np.ndarray], at: np.ndarray, size: int) -> np.ndarray:
    """One hash for the ``size`` words from each position on."""
    return (sums[0][at + size] - sums[0][at]) * sums[1][at]


def _runs_table(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """First words, hashes of the first two, and for each length the ordered hashes of the lists with the place of their list."""
    row, words = _opened(lists)
    sizes = np.bincount(row, minlength=len(lists))
    starts, sums = np.cumsum(sizes) - sizes, _sums(words)
    tables = []
    for size in np.unique(sizes[sizes > 0]):
        of = np.flatnonzero(sizes == size)
        h = _run(sums, starts[of], int(size))
        order = np.argsort(h, kind="stable")
        tables.append((int(size), h[order], of[order]))
    return np.unique(words[starts[sizes > 0]]), np.unique(_run(sums, starts[sizes > 1], 2)), tables


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _found(row: np.ndarray, words: np.ndarray, first: np.ndarray, second: np.ndarray, tables: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, place of the list) of each list that stands in a row as a run of its words."""
    rows, places, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], _sums(words)
    one = np.flatnonzero(_among(words, first))
    more = one[one + 2 <= len(words)]
    more = more[_among(_run(sums, more, 2), second)]
    for size, h, of in tables:
        at = one if size == 1 else more[more + size <= len(words)]
        at = at[row[at] == row[at + size - 1]]
        own = _run(sums, at, size)
        low, high = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
        many = high - low
        rows.append(np.repeat(row[at], many))
        places.append(of[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
    return np.concatenate(rows), np.concatenate(places)


def texts_with_names(texts: DataFrame, key: str, words: Column, names: DataFrame, name: str, connectors: Sequence[str]) -> DataFrame:
    """(name, n_texts): distinct keys of the texts that hold a name, for each name (normalised, distinct) that some text holds.

    A name stands in a text as it is, or as its words of three letters or more in order, connectors left out of both; a name with one such
    word stands where that word does, one without any stands nowhere.
    """
    link = X.words_array(connectors)
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    main = F.filter(F.split(name, " "), lambda w: (F.length(w) >= 3) & ~F.array_contains(link, w))
    asked = kept(names.select(F.col(name).alias("name"), F.xxhash64(name).alias("id"), hashed(F.split(name, " ")).alias("whole"), hashed(main).alias("main"))
                 .filter(F.size("main") > 0), "names")
    repeated = kept(texts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key, F.lit(True).alias("again")), "repeated")
    rows = texts.select(key, hashed(words).alias("w"))
    rows = rows.withColumn("again", F.lit(False)) if repeated.isEmpty() else rows.join(repeated, key, "left").withColumn("again", F.coalesce("again", F.lit(False)))
    passes = max(1, -(-asked.count() // NAMES))
    spark, kind = texts.sparkSession, dict(texts.dtypes)[key]
    links = spark.range(1).select(hashed(link)).first()[0] if connectors else []
    links = np.sort(np.array(links, np.int64).view(np.uint64))

    def counted(part: DataFrame) -> DataFrame:
        got = part.select("id", "whole", "main").toArrow().combine_chunks()
        if not got.num_rows:
            return spark.createDataFrame([], f"id bigint, {key} {kind}, n bigint")
        whole, main = got.column("whole").combine_chunks(), got.column("main").combine_chunks()
        one = pc.equal(pc.list_value_length(main), 1)
        blank = pa.array([None] * got.num_rows, whole.type)
        shared = spark.sparkContext.broadcast((got.column("id").to_numpy(), _runs_table(pc.if_else(one, blank, whole)), _runs_table(main)))

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, as_is, bare = shared.value
            for batch in batches:
                total = np.zeros(len(ids), np.int64)
                again = batch.column(2).to_numpy(zero_copy_only=False)
                own_name, own_row = [], []
                for begin in range(0, len(batch), SLICE):
                    row, own = _opened(batch.column(1).slice(begin, SLICE))
                    free = ~np.isin(own, links)
                    found = [_found(row, own, *as_is), _found(row[free], own[free], *bare)]
                    pairs = np.unique(np.concatenate([r * len(ids) + p for r, p in found]))
                    rows_of, names_of = pairs // len(ids) + begin, pairs % len(ids)
                    twice = again[rows_of]
                    total += np.bincount(names_of[~twice], minlength=len(ids))
                    own_name.append(names_of[twice])
                    own_row.append(rows_of[twice])
                some = np.flatnonzero(total)
                names_of, rows_of = np.concatenate(own_name), np.concatenate(own_row)
                keys = batch.column(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[some], ids[names_of]])), pa.concat_arrays([pa.nulls(len(some), keys.type), keys.take(pa.array(rows_of))]),
                     pa.array(np.concatenate([total[some], np.zeros(len(names_of), np.int64)]))], names=["id", key, "n"])

        return rows.select(key, "w", "again").mapInArrow(met, f"id bigint, {key} {kind}, n bigint")

    parts = [counted(asked.filter(F.pmod("id", F.lit(passes)) == i)) for i in range(passes)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    totals = every.groupBy("id").agg((F.sum("n") + F.countDistinct(key)).alias("n_texts"))
    return totals.join(asked.select("id", "name"), "id").select("name", "n_texts")
