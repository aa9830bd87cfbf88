"""Whitening by shifted CholeskyQR.

The centred rows A are orthogonalised in passes. A pass adds up the Gram matrix G of Q = A / R (rows divided by the triangular
factors found so far, each by a triangular solve, never by an inverse), factors it as L L^T and composes R <- L^T R. The first
pass factors G + sI, so that an ill-conditioned A cannot break it; later ones need a shift only where G is singular. When Q^T Q
is the identity to rounding, R holds all that whitening needs: its singular values are those of A, its right singular
vectors the components. Forming the covariance and decomposing that would lose half of the digits.

Values are centred as integers, (n x - S) / n, so their offset costs no digits either.

At scale: a pass reads the rows where they are and sends one ``dims x dims`` matrix per task; these are summed per entry in Spark.
The driver holds matrices of that size only. No row moves before the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import stored

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
MAX_PASSES = 6
ORTHOGONAL = 1e-12
RANK = 1e-12  # singular values below this share of the largest are rounding
BLOCK = 4096
ROUNDING = np.finfo(float).eps / 2
OUTPUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integer_rows(vectors: DataFrame, scale: int, offset: int, id_column: str, vector_column: str) -> DataFrame:
    """Rows (vec_id, v array<bigint>, dims): floor(scale * x) + offset of vectors that are not empty and hold neither null nor non-finite."""
    x = F.transform(F.col(vector_column), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0)).filter(fine)
            .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("bigint") + offset).alias("v"), F.size("x").alias("dims")))


def divided(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows of ``q`` divided by an upper triangular ``r`` from the right, by substitution."""
    out = np.empty_like(q)
    for j in range(r.shape[0]):
        out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def whole_deviations(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """n * x - S of each entry, exactly; as Python integers where a long could overflow."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums))
    kind = np.int64 if most < 2 ** 62 else object
    return x.astype(kind) * n - np.array(sums, kind)


class Centred:
    """Exact deviations and centred double rows of an Arrow list column."""

    def __init__(self, sums: list[int], n: int):
        self.sums, self.n = sums, n

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.sums))
        for begin in range(0, len(flat), BLOCK):
            exact = whole_deviations(flat[begin:begin + BLOCK], self.sums, self.n)
            yield begin, exact, exact.astype(float) / self.n


def _gram(rows: DataFrame, dims: int, values) -> tuple[np.ndarray, np.ndarray]:
    """Sums of v v^T and of v over all rows of ``values(column)``, a task-side function to blocks of doubles; one matrix per task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims))
        for batch in batches:
            for block in values(batch.column(0)):
                total[:dims] += block.T @ block
                total[dims] += block.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])

    parts = rows.select("v").mapInArrow(run, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("total")).collect()
    out = np.zeros((dims + 1) * dims)
    for r in parts:
        out[r["pos"]] = r["total"]
    out = out.reshape(dims + 1, dims)
    return out[:dims], out[dims]


def factors(rows: DataFrame, sums: list[int], n: int) -> list[np.ndarray]:
    """Upper triangular R1, R2, ... whose composition ... R2 R1 is the R of the centred rows."""
    dims, centred = len(sums), Centred(sums, n)
    found: list[np.ndarray] = []
    for turn in range(MAX_PASSES):
        known = list(found)

        def values(column: pa.Array) -> Iterator[np.ndarray]:
            for _, _, q in centred(column):
                for r in known:
                    q = divided(q, r)
                yield q

        gram, _ = _gram(rows, dims, values)
        if turn and np.abs(gram - np.eye(dims)).max() < ORTHOGONAL:
            break
        shift = 11 * (n * dims + dims * (dims + 1)) * ROUNDING * np.linalg.norm(gram, 2)
        for s in ([shift] if turn == 0 else [0.0, shift]):
            try:
                found.append(np.linalg.cholesky(gram + (s or 0.0) * np.eye(dims)).T)
                break
            except np.linalg.LinAlgError:
                if s or not shift:
                    return found
    return found


def components(found: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as rows, their singular values, trace of the covariance). Signs: the entry of largest size is positive."""
    r = found[0]
    for later in found[1:]:
        r = later @ r
    _, s, w = np.linalg.svd(r)
    w = w * np.where(np.take_along_axis(w, np.abs(w).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
    keep = s > RANK * s[0]
    return w[keep], s[keep], float((s ** 2).sum() / n)


def whitened(vectors: DataFrame, limit: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every remaining row and its first ``limit`` components.

    Null or empty vectors and such with null or non-finite entries are left out. Vectors meet those of their own length: if there
    are several lengths, each is a fit list of its own (one fit a length). Directions without variance have no whitened
    values and give no rows, so equal vectors alone give none. Rows that repeat an id, and rows without one, are rows of their own. A
    deviation beyond a long is an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(integer_rows(vectors, scale, offset, id_column, vector_column), "vectors")
    totals: dict[int, tuple[int, dict[int, int]]] = {}
    wide = "decimal(38,0)"
    for r in rows.select("dims", F.posexplode("v")).groupBy("dims", "pos").agg(F.count("*").alias("n"), F.sum(F.col("col").cast(wide)).alias("total")).collect():
        totals.setdefault(r["dims"], (r["n"], {}))[1][r["pos"]] = int(r["total"])
    out = spark.createDataFrame([], OUTPUT)
    for i, dims in enumerate(sorted(totals)):
        n, by_place = totals[dims]
        one = _one_length(rows.filter(F.col("dims") == dims), [by_place[j] for j in range(dims)], n, limit)
        if one is not None:
            out = one if i == 0 else out.unionByName(one)
    return out


def _one_length(rows: DataFrame, sums: list[int], n: int, limit: int) -> DataFrame | None:
    found = factors(rows, sums, n)
    if not found or not any(np.abs(r).max() for r in found):
        return None
    parts, s, trace = components(found, n)
    parts, s = parts[:limit], s[:limit]
    if not len(s):
        return None
    to_white = parts.T * (np.sqrt(n) / s)  # over sqrt(e), with e = s^2 / n
    explained = s ** 2 / n / trace
    centred, width = Centred(sums, n), len(s)

    def values(column: pa.Array) -> Iterator[np.ndarray]:
        for _, _, a in centred(column):
            yield a @ to_white

    gram, mean = _gram(rows, width, values)
    error = float(np.abs(gram / n - np.outer(mean / n, mean / n) - np.eye(width)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, exact, a in centred(batch.column(1)):
                size = len(a)
                own = batch.column(0).slice(begin, size).take(pa.array(np.repeat(np.arange(size), width)))
                if len(exact) and dims_overflow(exact):
                    exact = exact.astype(object)
                square = [int(x) for x in (exact * exact).sum(1)]
                if max(square, default=0) >= 2 ** 63:
                    raise ValueError("a deviation leaves the range of a long")
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), size)), pa.array(np.full(size * width, n, np.int64)), pa.array(np.repeat(np.array(square, np.int64), width)),
                     pa.array((a @ to_white).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * width, error))], names=OUTPUT.replace(",", "").split()[::2])

    return rows.select("vec_id", "v").mapInArrow(run, OUTPUT)


def dims_overflow(exact: np.ndarray) -> bool:
    """Whether a sum of squares of these deviations might not fit a long."""
    most = max(abs(int(exact.max())), abs(int(exact.min())))
    return most * most * exact.shape[1] >= 2 ** 63
