"""Exact top-k inner products by a Voronoi kNN join.

Pivots split data and queries into cells. Summaries per cell (how many, farthest member, distances of the k+1 members
nearest to the pivot) give, for each query cell, a floor under the k-th best score of any of its queries and, for each
data cell, a ceiling over the score any member can reach; a data cell is only visited by query cells whose floor its
ceiling reaches. Cells are solved locally in blocks; the k best per block are merged.

With q in cell P (pivot p, radius u) and x in cell C (pivot c, distance d):  |q.x - p.c| <= |p| d + u |c| + u d.

At scale: the queries, a fiftieth of the rows, are what is copied. Blocks of both sides are bounded (``block_rows``,
``block_queries``): a crowded cell is cut into more blocks. Pivots and summaries, the only things sent to every task, have
at most ``max_pivots`` rows. Work is queries times the cells that the bounds leave, which on vectors without cluster
structure is all of them; no bound is traded for recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidence_spark.llm.common import stored

MAX_PIVOTS = 1024
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 2048
SLACK = 1e-9


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """Rows (vec_id, v array<bigint>, dims): floor(scale * x) per component.

    A null id, a null or empty vector, a null or non-finite component: the row takes no part. Vectors meet only those of
    their own length.
    """
    v = F.col(vector_column)
    x = F.transform(v, lambda c: c.cast("double"))
    usable = F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.filter(usable).select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("x")).filter(fine)
            .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("bigint")).alias("v"), F.size("x").alias("dims")))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``b``, exact: in doubles while every sum stays below 2^53. Products that
    could leave the range of a long are an error."""
    most = (np.abs(a).max(initial=0).astype(float) if a.size else 0.0) * (np.abs(b).max(initial=0).astype(float) if b.size else 0.0) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most >= 2.0 ** 63:
        raise ValueError("scores could leave the range of a long")
    return a @ b.T


def _pivots(rows: DataFrame, n: int, max_pivots: int) -> dict[int, np.ndarray]:
    """At most ``max_pivots`` vectors, about the square root of the row count, picked by hash; by vector length."""
    wanted = int(min(max_pivots, max(1, round(n ** 0.5))))
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(wanted).select("dims", "v").collect()
    out: dict[int, list] = {}
    for row in picked:
        out.setdefault(row["dims"], []).append(row["v"])
    return {d: np.array(v, float) for d, v in out.items()}


def _to_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds the nearest pivot and the distance to it. A length without a pivot has one cell around the origin."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    columns = list(rows.columns)
    where, size = columns.index("v"), columns.index("dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(size).to_numpy(zero_copy_only=False)
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = _matrix(batch.column(where).take(pa.array(own))).astype(float)
                p = pivots.get(int(d), np.zeros((1, d)))
                square = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
                cell[own] = square.argmin(1)
                far[own] = np.sqrt(((x - p[cell[own]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*columns, "cell", "far"])

    return rows.mapInArrow(run, f"{fields}, cell int, far double")


def visits(query_cells: list, data_cells: list, pivots: dict[int, np.ndarray], k: int) -> list[tuple[int, int, int]]:
    """(dims, query cell, data cell) that the bounds leave. Inputs are the summaries: at most one row per pivot each."""
    out = []
    for d in {r["dims"] for r in query_cells}:
        data = [r for r in data_cells if r["dims"] == d]
        p = pivots.get(d, np.zeros((1, d)))
        c = p[[r["cell"] for r in data]]
        c_norm, radius = np.sqrt((c * c).sum(1)), np.array([r["radius"] for r in data])
        near, there = np.zeros((len(data), k + 1)), np.zeros((len(data), k + 1), bool)
        for i, r in enumerate(data):
            near[i, :len(r["near"])] = r["near"]
            there[i, :len(r["near"])] = True
        for q in (r for r in query_cells if r["dims"] == d):
            own, u = p[q["cell"]], q["radius"]
            middle, norm = c @ own, np.sqrt(own @ own)
            ceiling = middle + norm * radius + u * c_norm + u * radius
            floors = np.where(there, middle[:, None] - norm * near - (u * c_norm)[:, None] - u * near, -np.inf).ravel()
            # One of the k+1 may be the query itself.
            floor = np.sort(floors)[::-1][k] if len(floors) > k else -np.inf
            slack = SLACK * (1 + np.abs(ceiling) + (abs(floor) if np.isfinite(floor) else 0))
            out += [(d, q["cell"], r["cell"]) for r, ok in zip(data, ceiling + slack >= floor) if ok]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
          max_pivots: int = MAX_PIVOTS, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` highest integer inner products of each query with every other row.

    Ties go to the smaller ``vec_id``; a query with fewer than ``k`` others gets all of them. Rows that repeat an id are
    rows of their own, and none is a candidate of its own id. ``is_query`` reads ``vec_id``.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_column, vector_column)
    n = rows.count()
    pivots = _pivots(rows, n, max_pivots) if n else {}
    cells = stored(_to_cells(rows, pivots), "cells")
    near = cells.withColumn("_r", F.row_number().over(W.partitionBy("dims", "cell").orderBy("far"))).filter(F.col("_r") <= k + 1)
    near = near.groupBy("dims", "cell").agg(F.collect_list("far").alias("near"))  # k + 1 numbers
    data = cells.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).join(near, ["dims", "cell"])
    queries = cells.filter(is_query)
    asked = queries.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    data_cells, query_cells = data.collect(), asked.collect()
    size = {(r["dims"], r["cell"]): r["n"] for r in data_cells}
    blocks = {key: -(-m // block_rows) for key, m in size.items()}
    sent = {(r["dims"], r["cell"]): r["n"] for r in query_cells}
    arriving: dict[tuple[int, int], int] = {}
    plan = visits(query_cells, data_cells, pivots, k)
    for d, q, c in plan:
        arriving[d, c] = arriving.get((d, c), 0) + sent[d, q]
    parts = {key: -(-m // block_queries) for key, m in arriving.items()}
    route = spark.createDataFrame([(d, q, c, blocks[d, c], parts[d, c]) for d, q, c in plan],
                                  "dims int, q_cell int, d_cell int, blocks int, parts int")
    placed = spark.createDataFrame([(d, c, blocks[d, c], m) for (d, c), m in parts.items()], "dims int, cell int, blocks int, parts int")
    left = (queries.withColumnRenamed("cell", "q_cell").join(route, ["dims", "q_cell"])
            .withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(F.col("dims").alias("q_dims"), F.col("d_cell").alias("q_cell"), F.col("block").alias("q_block"), F.col("part").alias("q_part"),
                    F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
    right = (cells.join(placed, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)))
             .select("dims", "cell", "block", "part", "vec_id", "v"))

    def solve(asks: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
        if not (asks.num_rows and rows.num_rows):
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _matrix(rows.column("v"))[order]
        own, q = asks.column("query_id").to_numpy(), _matrix(asks.column("q"))
        found: tuple[list, list, list] = ([], [], [])
        for begin in range(0, len(own), 256):
            mine = own[begin:begin + 256]
            scores = products(q[begin:begin + 256], x)
            for i, row in enumerate(scores):
                keep = ids != mine[i]
                values, names = row[keep], ids[keep]
                if len(values) > k:
                    least = np.partition(values, len(values) - k)[len(values) - k]
                    better = values >= least
                    values, names = values[better], names[better]
                best = np.argsort(-values, kind="stable")[:k]
                found[0].extend([mine[i]] * len(best))
                found[1].extend(names[best])
                found[2].extend(values[best])
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(kinds.items(), found)})

    keys = ["dims", "cell", "block", "part"]
    local = left.groupBy(*[f"q_{c}" for c in keys]).cogroup(right.groupBy(*keys)).applyInArrow(solve, "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
