"""Extendible hashing: shards of documents that each fit a byte limit. DataFrame functions only.

A row's key is 60 bits of md5 over its id and text. The directory is indexed by the first bits of the key; a bucket over
the limit splits on its next bit, and only it. The bytes of all buckets of one stretch of bits come from one map-side
combined sum over key prefixes, so the splits of a stretch are decided at once from a table of about ``FINE`` cells per
shard; rows of cells that are still too heavy (a very long document among others) go on to the next stretch of bits.

Only (id, key, bytes) moves, never the texts. Hash prefixes spread any source or language evenly; rows that are equal in
id and text have equal keys, which no bit can part, so they are counted and dealt by their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import stored

BITS = 60
FINE = 16  # directory cells per expected shard in the first stretch
STRETCH = 8  # further bits per stretch
BYTE_LIMIT = 1 << 20


def key_bits(doc_id: Column, text: Column) -> Column:
    """60 bits of md5, the same in any engine; a null id or text counts as empty."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(bits: Column | str, width: int) -> Column:
    return F.shiftright(F.col(bits) if isinstance(bits, str) else bits, BITS - width)


def _leaves(rows: DataFrame, start: int, stop: int, limit: int) -> DataFrame:
    """(cell, depth, open): for every cell of ``stop`` bits the smallest depth at which its bucket fits, or ``open``.

    A bucket fits when it holds at most ``limit`` bytes, or one row. Buckets above ``start`` bits did not fit.
    """
    cells = rows.groupBy(_prefix("bits", stop).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
    spread = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(stop))))
    bucket = F.expr(f"shiftright(cell, {stop} - depth)")
    weights = spread.groupBy("depth", bucket.alias("bucket")).agg(F.sum("n_bytes").alias("b"), F.sum("n").alias("n"))
    fits = weights.filter((F.col("b") <= limit) | (F.col("n") == 1)).select("depth", "bucket")
    found = spread.withColumn("bucket", bucket).select("cell", "depth", "bucket").join(fits, ["depth", "bucket"], "left_semi")
    return (cells.select("cell").join(found.groupBy("cell").agg(F.min("depth").alias("depth")), "cell", "left")
            .select("cell", F.coalesce("depth", F.lit(stop)).cast("int").alias("depth"), F.col("depth").isNull().alias("open")))


def assign(docs: DataFrame, limit: int = BYTE_LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8 of the text; null 0), depth, bucket (the first ``depth`` bits) and part for every row.

    (depth, bucket, part) is a shard of at most ``limit`` bytes; a single longer document has a shard of its own. ``part``
    is 0 except where one key holds more rows than fit. Empty input gives no shard.
    """
    text = F.col("text").cast("string")
    rows = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
                              key_bits(F.col("doc_id"), text).alias("bits")), "keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    width = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit) * FINE))))
    start, placed = 0, None
    while True:
        directory = _leaves(rows, start, width, limit)
        told = stored(rows.join(directory, _prefix("bits", width) == F.col("cell")), "placed")
        done = told if width == BITS else told.filter("NOT open")
        done = done.select("doc_id", "n_bytes", "depth", _leaf("bits", "depth").alias("bucket"), "bits", "open")
        placed = done if placed is None else placed.unionByName(done)
        if width == BITS:
            break
        rows = told.filter("open").select("doc_id", "n_bytes", "bits")
        if rows.isEmpty():
            break
        start, width = width, min(BITS, width + STRETCH)
    fine = placed.filter("NOT open").select("doc_id", "n_bytes", "depth", "bucket", F.lit(0).cast("bigint").alias("part"))
    # Equal keys: equal rows are one row with a count, numbered without gathering them.
    equal = placed.filter("open").groupBy("doc_id", "n_bytes", "depth", "bucket").agg(F.count("*").alias("n"))
    room = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    dealt = equal.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).withColumn("part", F.floor(F.col("i") / room))
    return fine.unionByName(dealt.select("doc_id", "n_bytes", "depth", "bucket", F.col("part").cast("bigint")))


def _leaf(bits: str, depth: str) -> Column:
    return F.expr(f"shiftright({bits}, {BITS} - {depth})")


def write_shards(docs: DataFrame, path: str, limit: int = BYTE_LIMIT) -> None:
    """Writes the rows of ``docs`` under ``path``, a folder per shard. Ids must be unique; a column called shard is replaced."""
    where = assign(docs, limit).select("doc_id", F.concat_ws("-", "depth", "bucket", "part").alias("shard"))
    docs.drop("shard").join(where, "doc_id").repartition("shard").write.partitionBy("shard").parquet(path)
