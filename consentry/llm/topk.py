"""Exact top-k search: tiled matrix products of queries and shards, a partial selection in each tile, and a tree of merges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from consentry.session import durable

#: Rows and bytes of queries that are broadcast at once; more queries take more scans.
QUERY_BLOCK, QUERY_BYTES = 65_536, 64_000_000
TILE_QUERIES, TILE_ROWS = 1024, 4096
FAN_IN = 16


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of each component as a double, which holds it exactly; null if a component is null or not finite.

    A product beyond a double's range counts as its largest number.
    """
    most = F.lit(1.7976931348623157e308)
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= most))
    wide = lambda x: F.greatest(F.least(x.cast("double") * F.lit(1024.0), most), -most)
    # Beyond 2**53 every double is whole already, and floor would leave a long.
    whole = lambda x: F.when(F.abs(wide(x)) < 2.0**53, F.floor(wide(x)).cast("double")).otherwise(wide(x))
    return F.when(vector.isNotNull() & good, F.transform(vector, whole))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of each length of vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets, sizes, out = offsets - offsets[0], np.diff(offsets.astype(np.int64)), []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[offsets[rows][:, None] + np.arange(size)].reshape(len(rows), size)))
    return out


def _product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: as doubles while every sum stays below 2**53, else in integers of any size."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound < 2**62:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    exact = [np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape) for m in (queries, rows)]
    whole = exact[0] @ exact[1].T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64) if whole.size else np.zeros(whole.shape, np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query number and column of the k best of each row of scores; ids ascend, and a query's own id takes no part."""
    at = np.searchsorted(ids, own)
    repeats = np.searchsorted(ids, own, side="right") - at
    width = scores.shape[1]
    if np.abs(scores).max(initial=0) < 2**62 // (width + 1):  # score and place in one number: no ties
        key = scores * width + np.arange(width - 1, -1, -1)
        lowest = np.iinfo(np.int64).min
        for i in np.flatnonzero(repeats):
            key[i, at[i] : at[i] + repeats[i]] = lowest
        most = min(k, width)
        column = np.argpartition(key, width - most, axis=1)[:, width - most :]
        row = np.repeat(np.arange(len(scores)), most)
        column = column.ravel()
        kept = key[row, column] != lowest
        return row[kept], column[kept]
    rows, columns = [], []
    for i, line in enumerate(scores):
        order = np.lexsort((np.arange(width), ~line))  # ~ reverses integers without overflow
        order = order[(order < at[i]) | (order >= at[i] + repeats[i])][:k]
        rows.append(np.full(len(order), i))
        columns.append(order)
    return np.concatenate(rows), np.concatenate(columns)


class _Search:
    """Scans a partition for one broadcast block of queries and keeps the k best of each query."""

    def __init__(self, queries, k: int):
        self.queries, self.k = queries, k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {m.shape[1]: (ids, m) for ids, m in self.queries.value}
        kept = {size: [np.empty(0, np.int64)] * 3 for size in blocks}  # query number, id, score
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for rows, matrix in _matrix(batch.column("vector")):
                if matrix.shape[1] not in blocks:
                    continue
                order = np.argsort(ids[rows], kind="stable")
                own, matrix = ids[rows][order], matrix[order]
                self._tiles(blocks, kept, own, matrix)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        for size, (number, found, score) in kept.items():
            yield pa.record_batch(
                {
                    "query_id": pa.array(blocks[size][0][number], pa.int64()),
                    "vec_id": pa.array(found, pa.int64()),
                    "score": pa.array(score, pa.int64()),
                    "part": pa.array(np.full(len(found), part), pa.int64()),
                }
            )

    def _tiles(self, blocks, kept, ids, matrix) -> None:
        size = matrix.shape[1]
        wanted, queries = blocks[size]
        found = [kept[size]]
        for i in range(0, len(ids), TILE_ROWS):
            for q in range(0, len(wanted), TILE_QUERIES):
                scores = _product(queries[q : q + TILE_QUERIES], matrix[i : i + TILE_ROWS])
                tile = ids[i : i + TILE_ROWS]
                row, column = _best(scores, tile, wanted[q : q + TILE_QUERIES], self.k)
                found.append([row + q, tile[column], scores[row, column]])
        number, vec, score = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((vec, ~score, number))
        number, vec, score = number[order], vec[order], score[order]
        first = np.searchsorted(number, number)
        top = np.arange(len(number)) - first < self.k
        kept[size] = [number[top], vec[top], score[top]]


def _merged(found: DataFrame, parts: int, k: int) -> DataFrame:
    """A tree of merges: each level merges the lists of FAN_IN parts, so no list grows beyond FAN_IN * k rows."""
    while True:
        parts = math.ceil(parts / FAN_IN)
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN))
        best = Window.partitionBy("query_id", "part").orderBy(F.col("score").desc(), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if parts <= 1:
            return found.select("query_id", "rank", "vec_id", "score")


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each row that ``is_query`` names; ties go to the smaller id.

    Columns ``query_id``, ``rank`` from 1, ``vec_id``, ``score``. Components become floor(1024 * x), of any size. Vectors that
    are null or hold null or non-finite components, and rows without an id, take no part, as query or candidate. Empty vectors
    meet each other with score 0. A query meets only vectors of its own length, and no row of its own id. Rows that repeat an id are candidates
    of their own; as a query such an id counts once, with its smallest vector. Fewer candidates than ``k`` give fewer rows; an empty table gives none. Scores beyond a long are held at
    its ends. Other columns are ignored.

    Queries go out in blocks of about ``query_block`` rows and QUERY_BYTES at most. Each block is one scan of the table, written and
    released before the next one, so that the driver holds one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), quantised(F.col(vector_column)).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    ).where(F.col("id").isNotNull() & F.col("vector").isNotNull())
    candidates = rows.select("id", "vector")
    queries = durable(rows.where("is_query").groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    total, bytes_ = queries.agg(F.count("*"), F.coalesce(F.sum(8 * (F.size("vector") + 1)), F.lit(0))).first()
    blocks = max(1, math.ceil(total / query_block), math.ceil(bytes_ / QUERY_BYTES))
    out = None
    for number in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == number).toArrow().combine_chunks()
        sizes = []
        for at, matrix in _matrix(own.column("vector")) if len(own) else []:
            sizes.append((own.column("id").to_numpy()[at], matrix))
        sent = spark.sparkContext.broadcast(sizes)
        found = candidates.mapInArrow(_Search(sent, k), "query_id long, vec_id long, score long, part long")
        found = _merged(durable(found, "found"), candidates.rdd.getNumPartitions(), k)
        sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out
