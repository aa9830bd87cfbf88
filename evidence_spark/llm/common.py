"""Shared helpers: table access, scratch tables, word splitting and word hashing inside tasks."""

from __future__ import annotations

import os

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import evidence_spark.llm
from evidence_spark.session import scratch_path

# Tasks carry this folder's functions with them: executors need no copy of the package.
cloudpickle.register_pickle_by_value(evidence_spark.llm)

# Words of the contracts are `[^\x20\x09-\x0D]+`; bytes.split() cuts at exactly these six ASCII characters.
WORD_SQL = r"[^\x20\x09-\x0D]+"
MAX_CACHED_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, so that no name of theirs can meet one of ours."""
    others = [docs[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_none")).alias("_box"))


def unboxed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order from a boxed frame; ``n_chars``, if there, follows the text where ``_changed`` says so."""
    def column(name: str):
        if name in ("doc_id", "text"):
            return F.col(name).cast(docs.schema[name].dataType).alias(name)
        own = F.col("_box").getField(name)
        if name == "n_chars":
            own = F.when(F.col("_changed"), F.char_length("text").cast(docs.schema[name].dataType)).otherwise(own)
        return own.alias(name)

    return rows.select(*[column(c) for c in docs.columns])


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for frames that no later job reads."""
    for df in frames:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        release(frames[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets the cleaner remove shuffle files of finished jobs: it does so once the driver's collector has found their frames dead."""
    spark._jvm.System.gc()


class WordHashes(dict):
    """64-bit hash of each word seen; emptied when full, so memory is bounded and values never depend on it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64 (arithmetic wraps)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` words, in order; fewer words than that give one hash of the whole sequence."""
    if len(words) == 0:
        return words
    n = max(1, len(words) - width + 1)
    out = np.full(n, np.uint64(min(width, len(words))))
    for k in range(min(width, len(words))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
    return out


def column_bytes(column) -> list:
    """UTF-8 bytes of an Arrow string column, null as None."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
