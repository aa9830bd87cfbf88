"""Centroid clustering in exact integers, each vector assigned by an Orchard search.

Every centroid keeps the list of all centroids, nearest first. A vector starts at some centroid and walks down its list: a
nearer one (or an equally near one of smaller number) found on the way becomes the current centroid and its list is walked
from the top; centroids met before are passed over. Beyond twice the current distance no centroid can be nearer, by the
triangle inequality, nor, strictly beyond it, equally near: there the walk ends. All vectors of a batch walk in step.

At scale: a round is one pass over the vectors, which stay where they are. A task adds its vectors up per centroid and sends one row
for each; what is summed is tasks times centroids. The driver holds the centroids and their distances, ``k * (k + dims)`` numbers
with ``k`` a parameter, and nothing that grows with the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import stored

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SALT = "3:"
OUTPUT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def largest(dims: int) -> int:
    """Largest component for which a squared distance surely fits a long."""
    return int((2 ** 61 // max(dims, 1)) ** 0.5)


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """Rows (vec_id, v array<bigint>): floor(scale * x) of every vector with exactly ``dims`` components, none null or non-finite."""
    x = F.transform(F.col(vector_column), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") == dims)).filter(fine)
            .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("bigint")).alias("v")))


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the numbers of all centroids, itself first, and their squared distances, nearest first."""
    apart = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
    np.fill_diagonal(apart, -1)  # before others at the same place
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.maximum(np.take_along_axis(apart, order, 1), 0)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row of ``x`` and the squared distance; of equally near ones the smallest number."""
    n, k = len(x), len(centroids)
    current, place = start.copy(), np.ones(n, np.int64)
    best = ((x - centroids[current]) ** 2).sum(1)
    visited = np.zeros((n, k), bool)
    visited[np.arange(n), current] = True
    live = np.arange(n)
    while True:
        live = live[place[live] < k]
        gap = apart[current[live], place[live]]
        live = live[~((gap > 0) & ((gap - 1) // 4 >= best[live]))]  # gap > 4 * best, without overflow
        if not len(live):
            return current, best
        other = order[current[live], place[live]]
        place[live] += 1
        new = ~visited[live, other]
        rows, other = live[new], other[new]
        visited[rows, other] = True
        distance = ((x[rows] - centroids[other]) ** 2).sum(1)
        closer = (distance < best[rows]) | ((distance == best[rows]) & (other < current[rows]))
        rows = rows[closer]
        current[rows], best[rows], place[rows] = other[closer], distance[closer], 1


class Assigner:
    """Vectors of an Arrow column to (rows, cluster, squared distance)."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        self.order, self.apart = neighbours(self.centroids)
        # The walk starts at the centroid next by the component in which centroids differ most.
        self.axis = int(np.ptp(self.centroids, axis=0).argmax())
        self.by_axis = np.argsort(self.centroids[:, self.axis], kind="stable")

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dims = self.centroids.shape[1]
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        if len(x) and (x.max() > largest(dims) // 2 or x.min() < -largest(dims) // 2):
            raise ValueError(f"a component beyond {largest(dims) // 2}: squared distances could leave the range of a long")
        edges = self.centroids[self.by_axis, self.axis]
        at = np.searchsorted(edges, x[:, self.axis]).clip(0, len(edges) - 1)
        return x, *nearest(x, self.centroids, self.order, self.apart, self.by_axis[at])


def _sums(rows: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, dict[int, int]]]:
    """Per non-empty cluster its size and componentwise sums: one row per centroid and component comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(centroids)
        count = np.zeros(len(centroids), np.int64)
        total = np.zeros_like(assign.centroids)
        for batch in batches:
            x, cluster, _ = assign(batch.column(0))
            count += np.bincount(cluster, minlength=len(count))
            for i in np.unique(cluster):
                total[i] += x[cluster == i].sum(0)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = rows.select("v").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    wide = "decimal(38,0)"
    found = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("n").cast(wide)).alias("n"), F.sum(F.col("col").cast(wide)).alias("total")).collect()
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in found:
        out.setdefault(r["cluster"], (int(r["n"]), {}))[1][r["pos"]] = int(r["total"])
    return out


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT,
             id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors with exactly ``dims`` components, none null or non-finite, as floor(scale * x). Centroids start as the ``k``
    vectors with the smallest sha256 of ``salt`` and id (rows that repeat an id are rows of their own, smaller vector first;
    fewer vectors than ``k`` give fewer centroids). A row without an id is clustered but never a start; if no row has one, nothing
    can be, and no rows come out. A component so large that distances leave a long is an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stored(integer_vectors(vectors, dims, scale, id_column, vector_column), "vectors")
    seeds = rows.filter(F.col("vec_id").isNotNull()).orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), "vec_id", "v").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], OUTPUT)
    centroids = [list(r["v"]) for r in seeds]
    for _ in range(rounds):
        for i, (n, total) in _sums(rows, centroids).items():
            centroids[i] = [total[j] // n for j in range(dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(centroids)
        for batch in batches:
            _, cluster, distance = assign(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = stored(rows.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"), "assigned")
    inertia = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = sum(inertia.values())
    if whole >= 2 ** 63:
        raise ValueError("the inertia leaves the range of a long")
    about = spark.createDataFrame([(i, inertia[i], whole, digest[i]) for i in inertia], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows
