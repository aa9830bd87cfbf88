"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

Text falls into units (blanks and what follows them) over which no piece reaches, and these are cut where no piece
holds the two characters side by side. New units of one length advance
together: at each end position the hashes of the last 1 to 16 characters are looked up in the sorted hashes of all pieces,
and the maximum of the summed scores over the admissible ones stores piece and backpointer. Of a unigram model every piece is
admissible, and equal sums go to the shorter last piece.

The vocabulary at hand is a BPE one (``merges``). Its own encoding is not the path of the highest summed score but the result of
merging best pairs first, so a piece is admissible here only if merging would leave it beside the piece before it; then
the path is unique and equals the library's ids. Whether two pieces may stand side by side is read off the merge trees:
along the right edge of the left tree and the left edge of the right tree, no pair that stood side by side at some time
formed a piece better than the merges that consumed them. Runs of blanks have equal scores, which rank no merges, so
units with two or more are merged step by step from a heap, in n log n.

At scale: encoding is work inside rows. The model file is read on the driver and goes out with the task (half a megabyte);
the caches of units and of pairs are bounded, and so is what advances together (units times length).
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import mix

MAX_UNITS = 800_000
PAIR_BITS, PIECE_BITS = 20, 20  # slots of the table of known pairs, and of the filter before the search for a piece
AT_ONCE = 500_000  # units of a group of documents looked up together
BATCH = 200_000  # characters of units of one length that advance together
BLANK = "▁"
_UNIT = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.iinfo(np.int64).max
BPE = 2  # model type


def load_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, type) of a model file, type 1 normal, 2 unknown, 3 control, 6 byte; and whether it encodes by merges (BPE)."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == BPE


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    return load_model(path)[0]


class Pieces:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, rows: list[tuple[str, float, int]], merges: bool = True):
        self.merges = merges
        self.text = [r[0] for r in rows]
        self.id_of = {t: i for i, (t, _, kind) in enumerate(rows) if kind == 1}
        self.rank = {t: -rows[i][1] for t, i in self.id_of.items()}
        self.byte_ids = [0] * 256
        for i, (t, _, kind) in enumerate(rows):
            if kind == 6:
                self.byte_ids[int(t[1:-1], 16)] = i
        self.bytes_of = [b"" if kind == 3 else " ⁇ ".encode() if kind == 2 else bytes([int(t[1:-1], 16)]) if kind == 6 else t.replace(BLANK, " ").encode()
                         for t, _, kind in rows]
        self.unknown = len(rows)  # a character that is no piece
        self.longest = max(map(len, self.id_of))
        # What a character that is no piece costs: more than any piece.
        self.score = np.array([r[1] for r in rows] + [min((r[1] for r in rows if r[2] == 1), default=0.0) - 10.0])
        # Neighbouring characters found inside a piece. Nothing merges over any other pair, so units are cut there.
        self.touching = np.array(sorted({ord(t[i]) << 21 | ord(t[i + 1]) for t in self.id_of for i in range(len(t) - 1)}), np.int64)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE)]))
        hashes = np.array([self._hash(t) for t in self.id_of], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(self.id_of.values()), np.int64)[order]
        self.filter = np.zeros(1 << PIECE_BITS, bool)
        self.filter[(hashes & np.uint64((1 << PIECE_BITS) - 1)).astype(np.int64)] = True
        self.units: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.pair_codes = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_beside = np.zeros(1 << PAIR_BITS, bool)
        self.edges: dict[int, tuple] = {}

    @staticmethod
    def _probe(h, size: int):
        return mix(h ^ np.uint64(size << 56))

    def _hash(self, text: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for code in map(ord, text):
            h = h * _BASE + np.uint64(code + 1)
        return self._probe(h, len(text))[0]

    def merged(self, unit: str) -> list[str]:
        """Best pair first, leftmost of equals, until no pair forms a piece."""
        parts: list[str | None] = list(unit)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in self.rank:
                    heap.append((self.rank[both], i, both))

        for i in range(len(parts)):
            offer(i)
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue
            gone = after[i]
            parts[i], parts[gone], after[i] = both, None, after[gone]
            if after[i] < len(parts):
                before[after[i]] = i
            for j in (before[i], i):
                size = len(heap)
                offer(j)
                if len(heap) > size:
                    heapq.heappush(heap, heap.pop())
        return [p for p in parts if p is not None]

    def _tree(self, piece: int) -> tuple[bool, list, list]:
        """Whether a piece merges to itself, and its left and right edge: (text, rank of the merge that consumes it), first to last."""
        if piece not in self.edges:
            parts, left, right = list(self.text[piece]), [], []  # at most ``longest`` characters
            while len(parts) > 1:
                best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
                if best is None:
                    break
                rank, i = best
                if i == 0:
                    left.append((parts[0], rank))
                if i == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            left.append((parts[0], NEVER))
            right.append((parts[-1], NEVER))
            self.edges[piece] = (len(parts) == 1, left, right)
        return self.edges[piece]

    def beside(self, a: int, b: int) -> bool:
        """Whether merging keeps piece ``b`` right of piece ``a``."""
        if a == self.unknown or b == self.unknown:
            return b == self.unknown or self._tree(b)[0]
        whole, left, _ = self._tree(b)
        right = self._tree(a)[2]
        if not whole:
            return False
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = right[i], left[j]
            joined = self.rank.get(x + y)
            # Of equal ranks the leftmost goes first: inside a, then across, then inside b.
            if joined is not None and joined < x_end and joined <= y_end:
                return False
            if x_end == NEVER and y_end == NEVER:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def _allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        codes = before * (self.unknown + 1) + piece
        slots = (mix(codes.astype(np.uint64)) & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int64)
        out = self.pair_beside[slots]
        new = np.flatnonzero(self.pair_codes[slots] != codes)
        if len(new):
            distinct, back = np.unique(codes[new], return_inverse=True)
            found = np.array([self.beside(*divmod(c, self.unknown + 1)) for c in distinct.tolist()], bool)[back]
            out[new] = found
            self.pair_codes[slots[new]], self.pair_beside[slots[new]] = codes[new], found
        return out

    def viterbi(self, units: list[str]) -> list[bytes]:
        """Ids (little-endian uint32) of units that have one length."""
        n, size = len(units), len(units[0])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(n, size).T.astype(np.uint64)
        prefix = np.zeros((size + 1, n), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * _BASE + (codes[i] + np.uint64(1))
        last, back, best = np.full((size + 1, n), -1, np.int64), np.zeros((size + 1, n), np.int64), np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        low = np.uint64((1 << PIECE_BITS) - 1)
        for end in range(1, size + 1):
            tries: list[tuple] = []
            for length in range(1, min(self.longest, end) + 1):
                keys = self._probe(prefix[end] - prefix[end - length] * self.powers[length], length)
                rows = np.flatnonzero(self.filter[(keys & low).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.hashes, keys[rows]), len(self.hashes) - 1)
                hit = self.hashes[at] == keys[rows]
                rows, piece = rows[hit], self.ids[at[hit]]
                if length == 1 and len(rows) < n:  # a character that is no piece
                    whole = np.full(n, self.unknown)
                    whole[rows] = piece
                    rows, piece = np.arange(n), whole
                if len(rows):
                    before = last[end - length, rows] if end > length else np.full(len(rows), self.unknown)
                    tries.append((rows, before, piece, np.full(len(rows), length)))
            rows, before, piece, length = (np.concatenate(x) for x in zip(*tries))
            value = best[end - length, rows] + self.score[piece]
            if self.merges:
                value = np.where(self._allowed(before, piece), value, -np.inf)
            np.maximum.at(best[end], rows, value)
            wins = np.flatnonzero((value == best[end, rows]) & (value > -np.inf))[::-1]  # of equals the shortest is written last
            last[end, rows[wins]], back[end, rows[wins]] = piece[wins], length[wins]
        if (last[1:] < 0).any():
            raise ValueError("a unit has no path")
        # Walk the backpointers of all units together.
        out = np.zeros((size, n), np.int64)
        used, at = np.zeros(n, np.int64), np.full(n, size)
        while (at > 0).any():
            live = np.flatnonzero(at > 0)
            out[used[live], live] = last[at[live], live]
            at[live] -= back[at[live], live]
            used[live] += 1
        found = []
        for i, unit in enumerate(units):
            ids = out[:used[i], i][::-1]
            if (ids == self.unknown).any():
                place, full = 0, []
                for piece in ids.tolist():
                    width = 1 if piece == self.unknown else len(self.text[piece])
                    full += [self.byte_ids[x] for x in unit[place].encode()] if piece == self.unknown else [piece]
                    place += width
                ids = np.array(full)
            found.append(ids.astype("<u4").tobytes())
        return found

    def _cut(self, units: list[str]) -> list[list[str]]:
        """Units cut where no piece holds two neighbouring characters."""
        flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(u) for u in units])
        pairs = (flat[:-1] << 21) | flat[1:]
        at = np.minimum(np.searchsorted(self.touching, pairs), len(self.touching) - 1)
        apart = self.touching[at] != pairs
        apart[ends[:-1] - 1] = False
        places = np.flatnonzero(apart) + 1
        owner = np.searchsorted(ends, places, side="right")
        out = [[u] for u in units]
        starts = ends - np.array([len(u) for u in units])
        for i, first, past in zip(*np.unique(owner, return_index=True), np.append(np.unique(owner, return_index=True)[1][1:], len(owner))):
            cuts = [0, *(places[first:past] - starts[i]).tolist(), len(units[i])]
            out[i] = [units[i][a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def learn(self, units: set[str]) -> None:
        """Makes ``units`` hold the ids of every unit."""
        new = units.difference(self.units)
        if len(self.units) + len(new) > MAX_UNITS:
            self.units.clear()
            new = units
        if not new:
            return
        cut = list(zip(new, self._cut(list(new))))
        wanted = {part for _, parts in cut for part in parts}
        if len(self.parts) + len(wanted) > MAX_UNITS:
            self.parts.clear()
        by_size: dict[int, list[str]] = {}
        for part in wanted.difference(self.parts):
            if self.merges and part.startswith(BLANK * 2):
                ids = [i for x in self.merged(part) for i in ([self.id_of[x]] if x in self.id_of else [self.byte_ids[y] for y in x.encode()])]
                self.parts[part] = np.array(ids, "<u4").tobytes()
            else:
                by_size.setdefault(len(part), []).append(part)
        for size, group in by_size.items():
            step = max(1, BATCH // size)
            for begin in range(0, len(group), step):
                some = group[begin:begin + step]
                self.parts.update(zip(some, self.viterbi(some)))
        find = self.parts.__getitem__
        self.units.update([(unit, find(parts[0]) if len(parts) == 1 else b"".join(map(find, parts))) for unit, parts in cut])

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each whole text, as little-endian uint32."""
        group, held = [], 0

        def encoded() -> Iterator[bytes]:
            self.learn(set().union(*group))
            for units in group:
                yield b"".join(map(self.units.__getitem__, units))

        for text in texts:
            units = _UNIT.findall((" " + text).replace(" ", BLANK)) if text else []
            group.append(units)
            held += len(units)
            if held >= AT_ONCE:
                yield from encoded()
                group, held = [], 0
        yield from encoded()

    def decode(self, ids: bytes) -> str:
        """Text of ids: bytes joined, the blank added before the first word dropped."""
        table = self.bytes_of
        data = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        text = data.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian uint32) of every row; a null or empty text has no ids."""
    rows, merges = load_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(rows, merges)
        for batch in batches:
            ids = list(pieces.encode(t or "" for t in batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids binary")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, n_chars of the decoded text, and whether it is the text again (null counts as empty), per row.

    Only a text that itself holds the blank sign U+2581 comes back changed (as a blank).
    """
    rows, merges = load_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(rows, merges)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = []
            for text, ids in zip(texts, pieces.encode(texts)):
                again = pieces.decode(ids)
                found.append((len(ids) // 4, zlib.crc32(ids), len(again), again == text))
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.bool_()]))],
                                             names=["doc_id", "n_ids", "ids_crc32", "n_chars", "same"])

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, n_chars bigint, same boolean"))
