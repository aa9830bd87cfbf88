"""Language-model scoring with a Brown class-based bigram model.

Words fall into classes by exchange: a word moves to the class under whose transition counts its neighbours, left and right, are
likeliest, its own occurrences taken out of the class it is in. A token then has the probability of its class after the
class before it, times the share of the word in its class, interpolated with smoothed single-word probabilities.

1. Texts become chunks: sorted distinct word hashes and a code per token. All later passes read these.
2. Vocabulary: counts of the training words, by buckets of the hash.
3. The number of classes is the cube root of the vocabulary. The most frequent words start as a class each; the rest are open.
4. Context counts: for every word how often each class stands left and right of it. On such a table ``INNER`` exchange rounds
   run: all words move at once, then class counts are summed anew. ``OUTER`` times contexts are counted, each time by the classes
   found so far. Words seen once stay in the open class, which stands for unseen ones too (their mass is that of words
   seen once, as Good and Turing have it).
5. Transition counts of the last classes, and the scores.

At scale: no word list goes to the driver or to every task; only classes (their starting words, and matrices of classes by
classes) do, and they grow with the cube root of the vocabulary. Words meet their counts and classes in buckets of about
``BUCKET`` words, in numpy, as slices of sorted hashes: a chunk asks once for each of its words, so the most frequent word has as
many entries in its bucket as there are chunks, at most a few hundred bytes each. Long texts are cut into several chunks
that carry the token before them. Counts add up before they move.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import WordHashes, column_bytes, discard, stored, word_hashes

FOLDS, HELD_OUT = 5, 1
CHUNK = 1_000_000  # tokens
GROUP = {"parquet.block.size": str(16 << 20)}  # rows are large: few of them in a writer's memory
BUCKET = 1 << 17  # words of a bucket, as asked for by all chunks
OUTER, INNER = 2, 2
WEIGHT = 0.9  # of the class model; the rest are single words
SMOOTHING = 1.0  # pseudo-count of a class's transitions, spread as classes are
BLOCK = 8192
END_CLASS, OPEN_CLASS = 0, 1
END = np.uint64(0xEF46DB3751D8E999)  # xxh64 of the empty string: no word has it
OUTPUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
KNOWN = np.dtype([("c", "<u2"), ("n", "<i8")])


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes by byte planes, compressed."""
    planes = np.ascontiguousarray(codes.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_codes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def document_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of whole texts: distinct words, training counts, codes (the first is the token before) and the documents or parts inside."""
    kind = ("task string, chunk string, n_words int, words binary, counts binary, codes binary, "
            "ordinals array<int>, ids array<bigint>, held array<boolean>, lengths array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task = WordHashes(), uuid.uuid4().hex
        parts: list[np.ndarray] = []
        about: list[tuple] = []
        before, held, made, ordinal = END, 0, 0, 0

        def chunk() -> pa.RecordBatch:
            nonlocal made
            flat = np.concatenate([np.array([before], np.uint64), *parts])
            words, codes = np.unique(flat, return_inverse=True)
            ordinals, ids, out, lengths = zip(*about)
            learnt = codes[1:][np.repeat(~np.array(out, bool), lengths)]
            counts = np.bincount(learnt, minlength=len(words)).astype("<i8")
            made += 1
            row = [task, f"{task}-{made}", len(words), words.astype("<u8").tobytes(), counts.tobytes(), pack_codes(codes), list(ordinals), list(ids), list(out), list(lengths)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in kind.split(", ")])

        for batch in batches:
            for doc_id, out, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column_bytes(batch.column(2))):
                tokens = np.concatenate([word_hashes((data or b"").lower().split(), cache), np.array([END], np.uint64)])
                for begin in range(0, len(tokens), CHUNK):
                    part = tokens[begin:begin + CHUNK]
                    if held and held + len(part) > CHUNK:
                        yield chunk()
                        parts, about, held = [], [], 0
                        before = tokens[begin - 1] if begin else END
                    parts.append(part)
                    about.append((ordinal, doc_id, out, len(part)))
                    held += len(part)
                ordinal += 1
        if held:
            yield chunk()

    text = F.col("text").cast("string")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit(""))) % FOLDS
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold == HELD_OUT).alias("held"), text.alias("text")).mapInArrow(run, kind)


def _u64(data) -> np.ndarray:
    return np.frombuffer(data.as_buffer() if isinstance(data, pa.Scalar) else data, "<u8")


def _slices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first, past) of the non-empty buckets of sorted ``words``."""
    bucket = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(words) else np.zeros(0, np.int64)
    return bucket[first], first, np.concatenate([first[1:], [len(words)]]).astype(np.int64)


def _by_bucket(rows: DataFrame, merge: Callable[[list[list[bytes]]], list[bytes]], kind: str) -> DataFrame:
    """One row (bucket, ...) of binaries per bucket; ``merge`` joins several rows into one and may be applied again."""
    dealt, names = rows.repartition("bucket").sortWithinPartitions("bucket"), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *(pa.array([x], pa.binary()) for x in merge(held))], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != last:
                    if held:
                        yield done()
                    last, held, size = row[0], [], 0
                held.append(list(row[1:]))
                size += sum(map(len, row[1:]))
                if size > 64 << 20 and len(held) > 8:  # streams of any length, in bounded memory
                    held = [merge(held)]
                    size = sum(map(len, held[0])) // 2
        if held:
            yield done()

    return dealt.mapInArrow(run, kind)


def vocabulary(chunks: DataFrame, bits: int) -> DataFrame:
    """(bucket, words, counts): sorted hashes of the training words and how often each stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1)):
                words, counts = _u64(words), np.frombuffer(counts.as_buffer(), "<i8")
                words, counts = words[counts > 0], counts[counts > 0]
                bucket, first, past = _slices(words, bits)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([words[a:b].tobytes() for a, b in zip(first, past)], pa.binary()),
                                                  pa.array([counts[a:b].tobytes() for a, b in zip(first, past)], pa.binary())], names=["bucket", "words", "counts"])

    def merge(rows: list[list[bytes]]) -> list[bytes]:
        words, back = np.unique(np.concatenate([_u64(r[0]) for r in rows]), return_inverse=True)
        total = np.zeros(len(words), "<i8")
        np.add.at(total, back, np.concatenate([np.frombuffer(r[1], "<i8") for r in rows]))
        return [words.tobytes(), total.tobytes()]

    kind = "bucket int, words binary, counts binary"
    return _by_bucket(chunks.select("words", "counts").mapInArrow(run, kind), merge, kind)


def frequent_words(vocab: DataFrame, n: int) -> list[int]:
    """Hashes of the ``n`` most frequent words but the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1)):
                words, counts = _u64(words), np.frombuffer(counts.as_buffer(), "<i8")
                best = np.lexsort((words, -counts))[:n + 1]
                best = best[words[best] != END]
                yield pa.RecordBatch.from_arrays([pa.array(words[best].astype(np.int64)), pa.array(counts[best])], names=["word", "n"])

    rows = vocab.select("words", "counts").mapInArrow(run, "word bigint, n bigint").orderBy(F.desc("n"), "word").limit(n).collect()
    return [r["word"] & (2 ** 64 - 1) for r in rows]


def _bigrams(codes: np.ndarray, held, lengths) -> tuple[np.ndarray, np.ndarray]:
    """Codes (left, right) of the neighbours whose right one is a training token."""
    learnt = np.repeat(~np.array(held, bool), lengths)
    return codes[:-1][learnt], codes[1:][learnt]


def contexts(chunks: DataFrame, classes_of: Callable, n_classes: int, bits: int, columns: list[str]) -> DataFrame:
    """(bucket, words, was, sizes, places, counts): class and context counts of the words seen twice or more.

    Place d is the class left of the word, ``n_classes`` + d the class right of it. ``classes_of(words, row)`` gives the classes of
    a chunk's words from the further ``columns``.
    """
    names = ["bucket", "words", "was", "sizes", "places", "counts"]
    kind = "bucket int, words binary, was binary, sizes binary, places binary, counts binary"

    def row(words, was, owner, place, count) -> list[bytes]:
        sizes = np.bincount(owner, minlength=len(words))
        return [words.astype("<u8").tobytes(), was.astype("<u2").tobytes(), sizes.astype("<u4").tobytes(), place.astype("<u2").tobytes(), count.astype("<u4" if count.max(initial=0) < 2 ** 32 else "<u8").tobytes()]

    def parsed(parts: list[bytes]) -> tuple:
        words, was, sizes, places = _u64(parts[0]), np.frombuffer(parts[1], "<u2"), np.frombuffer(parts[2], "<u4"), np.frombuffer(parts[3], "<u2")
        return words, was, sizes, places, np.frombuffer(parts[4], "<u4" if len(parts[4]) == 4 * len(places) else "<u8")

    def summed(owner: np.ndarray, place: np.ndarray, count: np.ndarray | None) -> tuple:
        key = owner.astype(np.int64) * (2 * n_classes) + place
        if count is None:
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            total = np.diff(np.concatenate([first, [len(key)]]))
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            total = np.add.reduceat(count[order].astype(np.int64), first) if len(key) else np.zeros(0, np.int64)
        return key[first] // (2 * n_classes), key[first] % (2 * n_classes), total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, codes = _u64(batch.column(0)[i]), unpack_codes(batch.column(1)[i].as_py())
                was = classes_of(words, [batch.column(4 + j)[i].as_py() for j in range(len(columns))])
                left, right = _bigrams(codes, batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                own, before = words[right] != END, words[left] != END
                owner, place, count = summed(np.concatenate([right[own], left[before]]), np.concatenate([was[left[own]].astype(np.int64), was[right[before]].astype(np.int64) + n_classes]), None)
                bucket, first, past = _slices(words, bits)
                cuts = np.searchsorted(owner, np.concatenate([first, [len(words)]]))
                rows = []
                for k, (a, b) in enumerate(zip(first, past)):
                    mine = slice(cuts[k], cuts[k + 1])
                    used, index = np.unique(owner[mine], return_inverse=True)
                    rows.append([int(bucket[k]), *row(words[used], was[used], index, place[mine], count[mine])])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 0 else pa.binary()) for j, c in enumerate(zip(*rows))], names=names)

    def merge(rows: list[list[bytes]]) -> list[bytes]:
        words, was, sizes, places, counts = (np.concatenate(x) for x in zip(*map(parsed, rows)))
        distinct, first, back = np.unique(words, return_index=True, return_inverse=True)
        return row(distinct, was[first], *summed(np.repeat(back, sizes), places, counts))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only words whose left contexts are two or more: each occurrence has one."""
        for batch in batches:
            for i in range(batch.num_rows):
                words, was, sizes, places, counts = parsed([batch.column(j)[i].as_py() for j in range(1, 6)])
                owner = np.repeat(np.arange(len(words)), sizes)
                n = np.bincount(owner, weights=np.where(places < n_classes, counts, 0), minlength=len(words))
                keep = n >= 2
                place = np.cumsum(keep) - 1
                mine = keep[owner]
                rest = row(words[keep], was[keep], place[owner[mine]], places[mine], counts[mine])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x], pa.binary()) for x in rest)], names=names)

    found = chunks.select("words", "codes", "held", "lengths", *columns).mapInArrow(run, kind)
    return _by_bucket(found, merge, kind).mapInArrow(kept, kind)


def best_classes(f: np.ndarray, was: np.ndarray, profile: np.ndarray) -> np.ndarray:
    """The class for each row of context counts ``f``: the one whose counts make these contexts likeliest, own counts removed.

    ``profile``: contexts of each class, left and right. Only classes with tokens, beyond the fixed ones, can be chosen.
    """
    half = profile.shape[1] // 2
    share = np.concatenate([x / max(x.sum(), 1) for x in (profile[:, :half].sum(0), profile[:, half:].sum(0))]) + 1e-9
    size = profile[:, :half].sum(1)
    logs = np.log(profile + SMOOTHING * share) - np.log(size + SMOOTHING)[:, None]
    value = f @ logs.T.astype(np.float32)
    own = profile[was] - f
    left = own[:, :half].sum(1)
    value[np.arange(len(f)), was] = (f * (np.log(np.maximum(own, 0) + SMOOTHING * share) - np.log(np.maximum(left, 0) + SMOOTHING)[:, None])).sum(1)
    value[:, [END_CLASS, OPEN_CLASS]] = -np.inf
    value[:, size == 0] = -np.inf
    return np.where(np.isfinite(value).any(1), value.argmax(1), was)


def _moved(batch: pa.RecordBatch, i: int, n_classes: int, profiles: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words, contexts, class) of the words of a row, in blocks, after the rounds that ``profiles`` stand for."""
    data = [batch.column(j)[i].as_py() for j in range(5)]
    words, was, sizes, places = _u64(data[0]), np.frombuffer(data[1], "<u2").astype(np.int64), np.frombuffer(data[2], "<u4"), np.frombuffer(data[3], "<u2")
    counts = np.frombuffer(data[4], "<u4" if len(data[4]) == 4 * len(places) else "<u8")
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    for begin in range(0, len(words), BLOCK):
        end = min(begin + BLOCK, len(words))
        f = np.zeros((end - begin, 2 * n_classes), np.float32)
        mine = slice(ends[begin], ends[end])
        f[np.repeat(np.arange(end - begin), sizes[begin:end]), places[mine]] = counts[mine]
        own = was[begin:end]
        for profile in profiles:
            own = best_classes(f, own, profile)
        yield words[begin:end], f, own


def _total(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Sum of one matrix per task: matrices are cut by rows, the cuts summed in tasks, and the one sum comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = make(batches).astype("<f8")
        held = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([total[i].tobytes() for i in held], pa.binary())], names=["bucket", "line"])

    def merge(lines: list[list[bytes]]) -> list[bytes]:
        return [np.sum([np.frombuffer(x[0], "<f8") for x in lines], axis=0).tobytes()]

    out = np.zeros(shape)
    for r in _by_bucket(rows.mapInArrow(run, "bucket int, line binary"), merge, "bucket int, line binary").collect():
        out[r["bucket"]] = np.frombuffer(r["line"], "<f8")
    return out


def exchange(features: DataFrame, n_classes: int, rounds: int) -> DataFrame:
    """(bucket, words, values): the class of each word after ``rounds`` rounds over one table of contexts."""
    rows = features.select("words", "was", "sizes", "places", "counts", "bucket")
    profiles: list[np.ndarray] = []
    for _ in range(rounds):
        known = list(profiles)

        def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((n_classes, 2 * n_classes))
            for batch in batches:
                for i in range(batch.num_rows):
                    for _, f, own in _moved(batch, i, n_classes, known):
                        order = np.argsort(own, kind="stable")
                        first = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
                        total[own[order][first]] += np.add.reduceat(f[order], first, axis=0, dtype=np.float64)
            return total

        profiles.append(_total(rows, make, (n_classes, 2 * n_classes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [(words, own) for words, _, own in _moved(batch, i, n_classes, profiles)]
                words = np.concatenate([np.zeros(0, "<u8"), *(x[0] for x in found)])
                own = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])
                yield pa.RecordBatch.from_arrays([batch.column(5).slice(i, 1), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([own.astype("<u2").tobytes()], pa.binary())],
                                                 names=["bucket", "words", "values"])

    return rows.mapInArrow(run, "bucket int, words binary, values binary")


def delivered(chunks: DataFrame, known: DataFrame, dtype: np.dtype, default, bits: int) -> DataFrame:
    """``chunks`` with ``values``, one of ``dtype`` for each of its words, from the rows (bucket, words, values) of ``known``."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words in zip(batch.column(0), batch.column(1)):
                words = _u64(words)
                bucket, first, past = _slices(words, bits)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([chunk.as_py()] * len(first), pa.string()), pa.array(first, pa.int32()),
                                                  pa.array([words[a:b].tobytes() for a, b in zip(first, past)], pa.binary()), pa.array([None] * len(first), pa.binary())],
                                                 names=["bucket", "chunk", "first", "words", "values"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, words, values = None, np.zeros(0, "<u8"), np.zeros(0, dtype)
        for batch in batches:
            out: list[tuple] = []
            for b, chunk, first, asked, told in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk is None:
                    bucket, words, values = b, _u64(asked), np.frombuffer(told, dtype)
                    continue
                asked = _u64(asked)
                if bucket == b and len(words):
                    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                    found = np.where(words[at] == asked, values[at], np.full(len(asked), default, dtype))
                else:
                    found = np.full(len(asked), default, dtype)
                out.append((chunk, first, found.tobytes()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.binary()))], names=["chunk", "first", "told"])

    asks = chunks.select("chunk", "words").mapInArrow(ask, "bucket int, chunk string, first int, words binary, values binary")
    tables = known.select("bucket", F.lit(None).cast("string").alias("chunk"), F.lit(0).alias("first"), "words", "values")
    dealt = asks.unionByName(tables).repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    told = dealt.mapInArrow(answer, "chunk string, first int, told binary").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("first", "told"))).alias("told"))
    return chunks.join(told, "chunk").withColumn("values", F.col("told.told")).drop("told")  # a chunk has one slice a bucket


def _values(parts: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype)


def _with_classes(vocab: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, words, values) of the whole vocabulary: class and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, words, counts, some, own in zip(*(c.to_pylist() for c in batch.columns)):
                words = _u64(words)
                values = np.zeros(len(words), KNOWN)
                values["n"], values["c"] = np.frombuffer(counts, "<i8"), OPEN_CLASS
                if some:
                    values["c"][np.searchsorted(words, _u64(some))] = np.frombuffer(own, "<u2")
                values["c"][words == END] = END_CLASS
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([words.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["bucket", "words", "values"])

    both = vocab.join(classes.select("bucket", F.col("words").alias("some"), F.col("values").alias("own")), "bucket", "left")
    return both.select("bucket", "words", "counts", "some", "own").mapInArrow(run, "bucket int, words binary, values binary")


def transitions(coded: DataFrame, n_classes: int) -> np.ndarray:
    """Training tokens of class d after one of class c."""

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(n_classes * n_classes)
        for batch in batches:
            for i in range(batch.num_rows):
                own = _values(batch.column(3)[i].as_py(), KNOWN)["c"].astype(np.int64)
                left, right = _bigrams(unpack_codes(batch.column(0)[i].as_py()), batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
                total += np.bincount(own[left] * n_classes + own[right], minlength=len(total))
        return total.reshape(n_classes, n_classes)

    return _total(coded.select("codes", "held", "lengths", "values"), make, (n_classes, n_classes))


def base_probability(count, n: int, v: int):
    return (count + 0.5) / (n + 0.5 * (v + 1))


class ClassModel:
    """Token probabilities from class transition counts."""

    def __init__(self, counts: np.ndarray, n: int, v: int, weight: float = WEIGHT):
        self.n, self.v, self.weight = n, v, weight if n else 0.0
        self.size = counts.sum(0)  # tokens of a class
        share = self.size / max(n, 1)
        self.after = (counts + SMOOTHING * share[None, :]) / (counts.sum(1) + SMOOTHING)[:, None]

    def emission(self, c: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of each word in its class. Half of the open class is for words never seen."""
        seen = count / np.maximum(self.size[c], 1)
        half = 0.5 if self.size[OPEN_CLASS] else 0.0
        return np.where(c == OPEN_CLASS, np.where(count > 0, half * seen, 1 - half), seen)


def score_chunks(coded: DataFrame, model: ClassModel) -> DataFrame:
    kind = "task string, ordinal int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, known = unpack_codes(batch.column(1)[i].as_py()), _values(batch.column(6)[i].as_py(), KNOWN)
                c, count = known["c"].astype(np.int64), known["n"]
                lengths = np.array(batch.column(5)[i].as_py(), np.int64)
                left, right = codes[:-1], codes[1:]
                base, emission = base_probability(count, model.n, model.v), model.emission(c, count)
                own = np.log10(model.weight * model.after[c[left], c[right]] * emission[right] + (1 - model.weight) * base[right])
                first = np.cumsum(lengths) - lengths
                add = lambda x: np.add.reduceat(x, first)
                m = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * m, pa.string()), pa.array(batch.column(2)[i].as_py(), pa.int32()), pa.array(batch.column(3)[i].as_py(), pa.int64()),
                     pa.array(batch.column(4)[i].as_py(), pa.bool_()), pa.array(lengths), pa.array(add((count > 0)[right].astype(np.int64))), pa.array(add(np.log10(base)[right])), pa.array(add(own))],
                    names=[x.split()[0] for x in kind.split(", ")])

    return coded.select("task", "codes", "ordinals", "ids", "held", "lengths", "values").mapInArrow(run, kind)


def scores(docs: DataFrame, outer: int = OUTER, inner: int = INNER, weight: float = WEIGHT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (of the class model) of every row.

    A null or empty text is its end alone. A null id counts as the empty string in the fold rule. Rows that repeat an id are rows of
    their own; other columns are ignored. Without training texts both scores are those of one unseen word for every
    token. Equal words are told by 64-bit hashes.
    """
    spark = docs.sparkSession
    chunks = stored(document_chunks(docs), "chunks", **GROUP)
    asked = chunks.agg(F.sum(F.col("n_words").cast("bigint")).alias("n")).first()["n"] or 0
    bits = max(0, int(np.ceil(np.log2(max(asked, 1) / BUCKET))))
    vocab = stored(vocabulary(chunks, bits), "vocabulary", **GROUP)
    v, n = _size(vocab)
    n_classes = max(4, round(v ** (1 / 3)))
    start = np.array(frequent_words(vocab, n_classes - 2), np.uint64)
    order = np.argsort(start)
    start, number = start[order], (order + 2).astype(np.int64)

    def starting(words: np.ndarray, _) -> np.ndarray:
        out = np.full(len(words), OPEN_CLASS, np.int64)
        if len(start):
            at = np.minimum(np.searchsorted(start, words), len(start) - 1)
            out = np.where(start[at] == words, number[at], out)
        out[words == END] = END_CLASS
        return out

    def current(words: np.ndarray, row: list) -> np.ndarray:
        out = _values(row[0], "<u2").astype(np.int64)
        out[words == END] = END_CLASS
        return out

    frame, classes_of, columns = chunks, starting, []
    classes = None
    for turn in range(outer):
        if turn:
            frame, classes_of, columns = delivered(chunks, classes, np.dtype("<u2"), OPEN_CLASS, bits), current, ["values"]
        features = stored(contexts(frame, classes_of, n_classes, bits, columns), f"contexts{turn}", **GROUP)
        if classes is not None:
            discard(classes)
        classes = stored(exchange(features, n_classes, inner), f"classes{turn}", **GROUP)
        discard(features)
    coded = stored(delivered(chunks, _with_classes(vocab, classes), KNOWN, np.array((OPEN_CLASS, 0), KNOWN), bits).drop("words", "counts"), "coded", **GROUP)
    discard(chunks, vocab, classes)
    model = ClassModel(transitions(coded, n_classes), n, v, weight)
    parts = score_chunks(coded, model)
    whole = parts.groupBy("task", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score",
                        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _size(vocab: DataFrame) -> tuple[int, int]:
    """Distinct training words and training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = n = 0
        for batch in batches:
            for counts in batch.column(0):
                counts = np.frombuffer(counts.as_buffer(), "<i8")
                v, n = v + len(counts), n + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()), pa.array([n], pa.int64())], names=["v", "n"])

    row = vocab.select("counts").mapInArrow(run, "v bigint, n bigint").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    return row["v"] or 0, row["n"] or 0
