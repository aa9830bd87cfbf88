"""Near-duplicate documents: MinHash with tensored banding, links confirmed on the full shingle sets.

Tensored banding: two collections of m half-keys, each made of t min-hashes. Every pair (i, j) of half-keys is a table
key, so m^2 tables of 2t hashes cost 2mt min-hashes instead of 2tm^2. Two sets of similarity s meet in a table unless one
collection misses altogether: with m = 11 a pair at 0.85 is met with probability (1 - (1 - 0.85^4)^11)^2 = 0.9994 under t = 4, and a
pair at 0.80 with (1 - (1 - 0.80^3)^11)^2 = 0.9993 under t = 3.

Steps, and what keeps each one bounded:

1. Texts become set size, fingerprint of the set and 2mt min-hashes where they lie. Equal sets collapse to their smallest
   id before anything else (map-side combined), so exact copies cost nothing later.
2. Table keys of the remaining sets; keys held by one set go. Only (key, id) moves.
3. Stars: in each bucket the member that shares most keys with others over all tables (the centre of a family of edited
   copies, usually its source) is compared with the rest: as many pairs as members, never all pairs.
4. Signatures screen the pairs (four standard deviations under the threshold), full sets decide. Components.
5. What is left open: members of one bucket in different components. They meet again grouped by half-key, in blocks of at
   most ``block`` members, with their sets; each pair is judged once, in the task, and only links come out. So no link is
   lost when the centre was not close enough to two members that are close to each other. Pairs inside one component are
   never formed.

Sets are 64-bit hashes of shingles: an equality of two different shingles has a chance of about 2^-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidence_spark.llm.common import WordHashes, column_bytes, mix, shingle_hashes, stored, word_hashes
from evidence_spark.llm.graph import components


@dataclass(frozen=True)
class Settings:
    """``percent``: linked when 100 * intersection >= percent * union."""

    shingle: int = 5
    percent: int = 80
    halves: int = 11  # m; at most 16
    width: int = 3  # t
    block: int = 1024

    @property
    def hashes(self) -> int:
        return 2 * self.halves * self.width

    @property
    def screen(self) -> float:
        """Equal min-hashes that a pair at the threshold reaches but for four standard deviations."""
        p = self.percent / 100
        return self.hashes * p - 4 * (self.hashes * p * (1 - p)) ** 0.5


def shingle_set(data: bytes, width: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text with A-Z lower-cased; empty without words."""
    return np.unique(shingle_hashes(word_hashes(data.lower().split(), cache), width))


def min_hashes(hashes: np.ndarray, count: int) -> np.ndarray:
    """``count`` 32-bit minima of a set under fixed multiply-and-add hash functions."""
    seeds = np.random.default_rng(20240229).integers(1, 2**63, (2, count), dtype=np.uint64)
    multiply, add = seeds[0] * np.uint64(2) + np.uint64(1), seeds[1]
    least = np.full(count, np.uint64(2**64 - 1))
    for begin in range(0, len(hashes), 2048):
        part = hashes[begin:begin + 2048]
        np.minimum(least, (part[None, :] * multiply[:, None] + add[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def half_keys(signatures: np.ndarray, halves: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both collections of half-keys, shape (rows, halves) each."""
    parts = signatures.reshape(len(signatures), 2 * halves, width).astype(np.uint64)
    out = np.broadcast_to(np.arange(2 * halves, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out[:, :halves], out[:, halves:]


def _signatures(column: pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, count)


def document_signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n_shingles, print, sig) of every row; a text without words has size 0 and neither print nor signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sizes, prints, sigs = [], [], []
            for data in column_bytes(batch.column(1)):
                hashes = shingle_set(data or b"", s.shingle, cache)
                sizes.append(len(hashes))
                prints.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                sigs.append(min_hashes(hashes, s.hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())],
                                             names=["doc_id", "n_shingles", "print", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, print binary, sig binary")


def shingle_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """(id, items): the full sets as sorted 64-bit hashes. Of rows that share an id, ``print`` tells them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            items = [shingle_set(t or b"", s.shingle, cache).tobytes() for t in column_bytes(batch.column(1))]
            prints = [xxhash.xxh3_128_digest(x) for x in items]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(items, pa.binary())], names=["id", "print", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "id bigint, print binary, items binary")


def table_keys(sets: DataFrame, s: Settings) -> DataFrame:
    """(key, id), m^2 rows a set. The low four bits of a key are the number of its first half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = half_keys(_signatures(batch.column(1), s.hashes), s.halves, s.width)
            keys = mix(a[:, :, None] * np.uint64(0xD6E8FEB86659FD93) + b[:, None, :])
            first = np.arange(s.halves, dtype=np.uint64)[None, :, None]
            keys = ((keys & ~np.uint64(15)) | first).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), s.halves ** 2))], names=["key", "id"])

    return sets.select("id", "sig").mapInArrow(run, "key bigint, id bigint")


def _screened(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough to be near the threshold."""
    least = s.screen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_signatures(batch.column(2), s.hashes) == _signatures(batch.column(3), s.hashes)).sum(1)
            yield batch.select([0, 1]).filter(pa.array(same >= least))

    sig = lambda name: sets.select(F.col("id").alias(name), F.col("sig").alias(f"sig_{name}"))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= s.percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda name: items.select(F.col("id").alias(name), F.col("items").alias(f"items_{name}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "items_a", "items_b").mapInArrow(run, "a bigint, b bigint")


def _block_links(s: Settings):
    """Links between members of one half-key block that have different roots; each pair only under its first shared half."""
    least = s.screen

    def solve(rows: pa.Table) -> pa.Table:
        ids, roots = rows.column("id").to_numpy(), rows.column("root").to_numpy()
        side = rows.column("part").to_numpy() == rows.column("low")[0].as_py()
        one_block = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        this = rows.column("half")[0].as_py()
        sigs = _signatures(rows.column("sig").combine_chunks(), s.hashes)
        a, b = half_keys(sigs, s.halves, s.width)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("items").combine_chunks()]
        sizes = np.array([len(x) for x in sets])
        found: tuple[list, list] = ([], [])
        for i in np.flatnonzero(side):
            ok = (roots != roots[i]) & (ids > ids[i] if one_block else ~side)
            ok &= 100 * np.minimum(sizes, sizes[i]) >= s.percent * np.maximum(sizes, sizes[i])
            j = np.flatnonzero(ok)
            if not len(j):
                continue
            shared = a[j] == a[i]
            j = j[(shared.argmax(1) == this) & shared[:, this] & (b[j] == b[i]).any(1) & ((sigs[j] == sigs[i]).sum(1) >= least)]
            if not len(j):
                continue
            bounds = np.concatenate([[0], np.cumsum(sizes[j])[:-1]])
            others = np.concatenate([sets[k] for k in j])
            at = np.minimum(np.searchsorted(sets[i], others), sizes[i] - 1)
            both = np.add.reduceat((sets[i][at] == others).astype(np.int64), bounds)
            j = j[100 * both >= s.percent * (sizes[i] + sizes[j] - both)]
            found[0].extend(np.minimum(ids[i], ids[j]))
            found[1].extend(np.maximum(ids[i], ids[j]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return solve


def _open_links(live: DataFrame, roots: DataFrame, sets: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """Links between sets that share a table key but are in different components so far."""
    marked = live.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    split = marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    half = F.col("key").bitwiseAND(F.lit(15)).cast("int")
    open_rows = marked.join(split, "key", "left_semi").select("id", "root", half.alias("half")).distinct()

    def first_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, _ = half_keys(_signatures(batch.column(3), s.hashes), s.halves, s.width)
                own = a[np.arange(len(a)), batch.column(2).to_numpy()].view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own)], names=["id", "root", "half", "value"])

    valued = stored(open_rows.join(sets.select("id", "sig"), "id").select("id", "root", "half", "sig")
                    .mapInArrow(first_halves, "id bigint, root bigint, half int, value bigint"), "open")
    blocks = valued.groupBy("half", "value").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / s.block).cast("int"))
    parted = valued.join(blocks, ["half", "value"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Each unordered pair of blocks is one group; a block of b goes to b groups.
    paired = (parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")))
    full = paired.join(sets.select("id", "sig"), "id").join(items.select("id", "items"), "id")
    return (full.select("half", "value", "low", "high", "part", "id", "root", "sig", "items")
            .groupBy("half", "value", "low", "high").applyInArrow(_block_links(s), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (it is its own component) per row.

    A null or wordless text has size 0 and is linked with nothing. Rows that share an id are one document: their links
    add up. A row without id is linked with nothing, has a null component and is kept. Only doc_id and text are read.
    """
    s = settings
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = stored(document_signatures(docs, s), "signatures")
    usable = facts.filter("print IS NOT NULL AND doc_id IS NOT NULL")
    sets = stored(usable.groupBy("print").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "sets")
    members = facts.join(sets.select("print", "id"), "print", "left").select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("id"))
    # Sets that met under one id (several texts with that id) are one node, and so are linked.
    twins = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z")
    same_id = members.join(twins, "doc_id").select("a", F.col("id").alias("b")).filter("a <> b")

    held = F.count("*").over(W.partitionBy("key"))
    live = stored(table_keys(sets, s).withColumn("held", held).filter("held > 1"), "live")
    degree = live.groupBy("id").agg(F.sum("held").alias("degree"))
    centre = live.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", -F.col("id"))).getField("col2").alias("minus"))
    stars = live.join(centre, "key").select(F.col("id").alias("a"), (-F.col("minus")).alias("b")).filter("a <> b").distinct()
    wanted = live.select("id").distinct()
    needed = sets.join(wanted, "id", "left_semi").select("print", "id")
    texts = docs.join(needed.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    items = stored(shingle_sets(texts, s).join(needed, ["id", "print"]).select("id", "items").dropDuplicates(["id"]), "items")
    links = stored(_confirmed(_screened(stars, sets, s), items, s).union(same_id), "star-links")
    roots = components(links)
    more = stored(_open_links(live, roots, sets, items, s), "open-links")
    if not more.isEmpty():
        roots = components(links.union(more))
    named = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
