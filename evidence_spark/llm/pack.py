"""Sum-of-squares packing of token sequences.

Every document becomes pieces of at most ``capacity`` tokens; a bin is one training sequence. Sum-of-squares rule: with
N(g) the number of open bins whose gap is g, put a piece where the sum of N(g)^2 over 0 < g < capacity becomes smallest;
ties take the smallest gap left, then an open bin before a new one. Pieces come largest first.

At scale: token counts are made where the texts lie; only (id, piece, length) rows move. They are dealt by hash into
groups of about ``group_rows`` pieces (more if they are very short), each packed in its own task with an array of gap counts. The bins of a group that
are not full enough are opened again, and their pieces dealt into fewer groups, until one group is left or nothing is
open; so the waste of many small groups does not remain. No group grows with the input.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import stored

CAPACITY = 4096
GROUP_ROWS = 2048
GROUP_BINS = 64
FULL = 0.999
ROUNDS = 3
MAX_CACHED_CHUNKS = 500_000
JOINED = 500
AT_ONCE = 100_000  # chunks of a group of documents looked up together
STOPS = ".,;:!?#*$%&"
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
# str.split() also cuts at these, which are no white space to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
_BLANKS = re.compile(r"[\t\n\r ]+")


def blank_free(text: str) -> list[str]:
    """Chunks between white space. The tokenizer drops white space and never joins over it, so chunks are encoded alone."""
    if any(c in text for c in SEPARATORS):
        return [c for c in _BLANKS.split(text) if c]
    return text.split()


class ChunkIds:
    """Little-endian uint32 ids of blank-free chunks, by the given tokenizer; emptied when full.

    A word of letters is one unit to the tokenizer, and so is a run of ``STOPS`` behind it: new words are encoded ``JOINED``
    at a time, in lower case, and cut at the tokens that end a word. Any other chunk, and any batch whose word ends do not
    add up, is encoded chunk by chunk.
    """

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {}

    def _alone(self, chunks: list[str]) -> list[bytes]:
        return [np.array(code.ids, "<u4").tobytes() for code in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for begin in range(0, len(words), JOINED):
            part = words[begin:begin + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                data, at = ids.tobytes(), 0
                for word, cut in zip(part, cuts.tolist()):
                    self.words[word] = data[at:4 * cut]
                    at = 4 * cut
            else:
                self.words.update(zip(part, self._alone(part)))

    def fill(self, chunks: set[str]) -> None:
        """Makes ``known`` hold every chunk."""
        new = list(chunks.difference(self.known))
        if len(self.known) + len(new) > MAX_CACHED_CHUNKS:
            self.known.clear()
            new = list(chunks)
        odd = []
        # A capital sigma has two lower-case forms, and characters that NFC changes may not stay letters.
        everything = " ".join(new)
        if "Σ" in everything or not is_normalized("NFC", everything):
            odd = [c for c in new if "Σ" in c or not is_normalized("NFC", c)]
            new = list(set(new).difference(odd))
        lower = [c.rstrip(STOPS).lower() for c in new]
        wanted = set(lower)
        if len(self.words) + len(wanted) > MAX_CACHED_CHUNKS:
            self.words.clear()
        self._learn([w for w in wanted.difference(self.words) if w.isalpha()])
        find, known, stops = self.words.get, self.known, self.stops
        for chunk, word in zip(new, lower):  # letters keep their number in lower case, so what is left over are stops
            ids = find(word)
            if ids is None:
                odd.append(chunk)
            elif len(word) == len(chunk):
                known[chunk] = ids
            else:
                stop = chunk[len(word):]
                if stop not in stops:
                    stops[stop] = self._alone([stop])[0]
                known[chunk] = ids + stops[stop]
        if len(stops) > MAX_CACHED_CHUNKS:
            stops.clear()
        for begin in range(0, len(odd), 10_000):
            part = odd[begin:begin + 10_000]
            known.update(zip(part, self._alone(part)))


def token_bytes(texts: Iterable[str], ids: ChunkIds, end_id: int) -> Iterator[bytes]:
    """For each text its ids, whole, and then ``end_id``, as little-endian unsigned 32-bit words."""
    end = np.array([end_id], "<u4").tobytes()

    def encoded(group: list[list[str]]) -> Iterator[bytes]:
        ids.fill(set().union(*group))
        find = ids.known.__getitem__
        for chunks in group:
            yield b"".join(map(find, chunks)) + end

    group, held = [], 0
    for text in texts:
        chunks = blank_free(text)
        group.append(chunks)
        held += len(chunks)
        if held >= AT_ONCE:
            yield from encoded(group)
            group, held = [], 0
    yield from encoded(group)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document; a null text is empty and gives one piece of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ChunkIds(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            texts = (t or "" for t in batch.column(1).to_pylist())
            for doc_id, data in zip(batch.column(0).to_pylist(), token_bytes(texts, ids, end_id)):
                for piece, begin in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[begin:begin + 4 * capacity]
                    rows.append((doc_id, piece, begin // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number and place in it of each length (in the order given), and what each bin holds."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)  # N(g); N(0) and N(capacity) stay 0
    bins, places, held = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        # A bin of gap g >= size turns into one of gap g - size: N(g)^2 + N(g-size)^2 changes by 2 (N(g-size) - N(g) + 1);
        # filled to the end: 1 - 2 N(g). A new bin adds 2 N(capacity-size) + 1.
        change = 2 * (count[:capacity - size] - count[size:capacity]) + 2
        if len(change):
            change[0] = 1 - 2 * count[size]
            change[count[size:capacity] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(change) else 0
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        if len(change) and change[best] != np.iinfo(np.int64).max and change[best] <= fresh:
            gap = best + size
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(held)
            held.append(0)
        bins[i], places[i] = b, held[b]
        held[b] += size
        left = gap - size
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, places, np.array(held, np.int64)


def _packer(capacity: int, base: int, stride: int, full: float, last: bool):
    def solve(rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy().astype(np.int64)
        if lengths.min() < 1 or lengths.max() > capacity:
            raise ValueError(f"lengths must be 1 to {capacity}")
        bins, places, held = sum_of_squares(lengths, capacity)
        first = base + rows.column("_group")[0].as_py() * stride
        rows = rows.drop_columns(["_group"])
        for name, values in (("sequence_id", first + bins), ("offset", places), ("_done", last | (held[bins] >= full * capacity))):
            rows = rows.append_column(name, pa.array(values))
        return rows

    return solve


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, full: float = FULL, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``length`` (1 to ``capacity``); other columns pass through.

    Repeated rows are packed each on its own. Columns called sequence_id, offset, _salt, _group or _done are replaced. Empty input gives an empty result. Lengths outside the range raise.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset", "_salt", "_group", "_done")
    columns = [F.col(c) for c in pieces.columns]
    waiting = stored(pieces.withColumn("_salt", F.xxhash64(*columns, F.monotonically_increasing_id())), "pieces")
    placed = None
    base = 0
    shown = pieces.columns + ["sequence_id", "offset"]
    for level in range(rounds):
        n, tokens = waiting.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if n == 0 and placed is not None:
            break
        # A group of very short pieces must still fill many bins: at most GROUP_BINS * capacity rows then.
        groups = max(1, min(-(-n // group_rows), tokens // (GROUP_BINS * capacity)))
        last = level == rounds - 1 or groups == 1
        stride = 1 << 32  # more bins than any group can open, so that ids of groups never meet

        dealt = waiting.withColumn("_group", F.pmod(F.xxhash64("_salt", F.lit(level)), F.lit(groups)))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in waiting.schema.fields)
        out = stored(dealt.groupBy("_group").applyInArrow(_packer(capacity, base, stride, full, last), f"{fields}, sequence_id bigint, offset bigint, _done boolean"), f"packed{level}")
        done = out.filter("_done").select(*shown)
        placed = done if placed is None else placed.unionByName(done)
        if last:
            break
        base += groups * stride
        waiting = out.filter("NOT _done").select(*pieces.columns, "_salt")
    return placed if placed is not None else spark.createDataFrame([], pieces.schema)
