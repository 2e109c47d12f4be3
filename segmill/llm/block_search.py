"""Exact nearest neighbours for a stated set of queries, as a block matrix join.

Queries and candidates are dealt to blocks, and a group for each pair of blocks holds both. A group is a tile: vectors
are quantised to 8 bits; sums of their products are whole numbers that single precision holds exactly for up to EXACT
components, and longer vectors are summed in parts. A bound on the quantisation's error gives a lower and an upper bound of
each inner product. Only pairs whose upper bound reaches the k-th largest lower bound of their query are computed again from
the original vectors, in double precision. Heaps merge the best of each tile.

A row is copied once for each block of queries and a query once for each block of rows, so blocks are as large as a task's
memory allows (BLOCK_FLOATS), and smaller only where there would be fewer tiles than cores.

Vectors that are null, empty, zero or hold null, NaN or infinite components take no part, nor do rows with a null vec_id.
Rows that repeat a vec_id count once, with the smallest vector. Vectors are compared with those of the same length
only. Ties go to the smaller vec_id. With fewer than k candidates, all are returned. A product beyond double precision is
infinite, and minus infinity where its parts cancel to no number. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmill.llm.common import materialise, starts_of, whole_groups
from segmill.llm.embedding_common import usable

#: Components of the vectors of a block; as many vectors as that makes, LEAST_BLOCK at least.
BLOCK_FLOATS, LEAST_BLOCK = 1 << 21, 1024
#: 127 * 127 * EXACT is below 2**24.
EXACT = 1024
#: Queries and candidates of a product that is held at once.
QUERY_TILE, ROW_TILE = 256, 4096

TILE = "query_id long, vec_id long, score double"


class Quantised:
    """Vectors as whole numbers from -127 to 127 times a scale, with the norms that bound the error of products."""

    def __init__(self, x: np.ndarray) -> None:
        self.scale = np.abs(x).max(axis=1) / 127
        self.scale[self.scale == 0] = 1.0
        small = np.clip(np.rint(x / self.scale[:, None]), -127, 127).astype(np.int8)
        self.values = small.astype(np.float32)
        near = small * self.scale[:, None]
        # a little more than the norms, for their own rounding
        self.error = np.linalg.norm(x - near, axis=1) * (1 + 1e-9)
        self.norm, self.near_norm = np.linalg.norm(x, axis=1) * (1 + 1e-9), np.linalg.norm(near, axis=1) * (1 + 1e-9)

    def part(self, start: int, end: int) -> Quantised:
        one = object.__new__(Quantised)
        for name, value in vars(self).items():
            setattr(one, name, value[start:end])
        return one


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers up to 127."""
    total = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT):
        total += a[:, i : i + EXACT] @ b[:, i : i + EXACT].T
    return total


def products(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of the pairs q, r, summed from the first component to the last."""
    total = np.zeros(len(q))
    for d in range(queries.shape[1]):
        total += queries[q, d] * rows[r, d]
    total[np.isnan(total)] = -np.inf
    return total


@np.errstate(over="ignore", invalid="ignore")
def nearest_in_tile(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, row id and score of each query's k best rows but its own."""
    small_q, small_r, dim = Quantised(queries), Quantised(rows), queries.shape[1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), QUERY_TILE):
        part = small_q.part(start, start + QUERY_TILE)
        ids, own = query_ids[start : start + QUERY_TILE], queries[start : start + QUERY_TILE]
        floor = np.full(len(ids), -np.inf)
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at in range(0, len(rows), ROW_TILE):
            tile = small_r.part(at, at + ROW_TILE)
            near = whole_products(part.values, tile.values) * part.scale[:, None] * tile.scale[None, :]
            # the last part is for rounding: of these products, and of those in double precision
            slack = part.error[:, None] * tile.near_norm[None, :] + part.norm[:, None] * tile.error[None, :] + (dim + 8) * 5e-16 * part.norm[:, None] * tile.norm[None, :]
            same = ids[:, None] == row_ids[None, at : at + ROW_TILE]
            # bounds that overflow bound nothing
            low = np.where(same | np.isnan(near - slack), -np.inf, near - slack)
            if low.shape[1] >= k:
                floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
            q, r = np.nonzero(~(near + slack < floor[:, None]) & ~same)
            kept.append((q, r + at, products(own, rows, q, r + at)))
        q, r, score = (np.concatenate(c) for c in zip(*kept, strict=True))
        order = np.lexsort((row_ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.searchsorted(q, q)
        best = np.arange(len(q)) - first < k
        found.append((ids[q[best]], row_ids[r[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, query_block: int | None = None, row_block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows with the largest inner product with each query."""
    good = embeddings.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    good = good.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
    good = materialise(good.withColumn("is_query", is_query), "vectors")
    count = good.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("is_query").cast("int")), F.lit(0)).alias("q"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("dim")).first()
    most = max(LEAST_BLOCK, BLOCK_FLOATS // count.dim)
    row_block = row_block or min(most, max(LEAST_BLOCK, math.ceil(count.n / (2 * embeddings.sparkSession.sparkContext.defaultParallelism))))
    n_rows, n_queries = max(1, math.ceil(count.n / row_block)), max(1, math.ceil(count.q / (query_block or most)))

    def dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int, kind: bool) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return rows.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_own)).cast("int").alias(own), every.alias(other), "vec_id", "embedding", F.lit(kind).alias("asks"))

    rows = dealt(good, "r", n_rows, "q", n_queries, False)
    queries = dealt(good.where("is_query"), "q", n_queries, "r", n_rows, True)
    both = rows.unionByName(queries)

    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        dim, asks = table.column("dim")[0].as_py(), table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        if asks.all() or not asks.any():
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = nearest_in_tile(ids[asks], x[asks], ids[~asks], x[~asks], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    best = both.groupBy("dim", "r", "q").applyInArrow(tile, TILE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["query_id"]):
            ids, scores = batch.column("vec_id").to_pylist(), batch.column("score").to_pylist()
            starts = starts_of(batch, ["query_id"]).tolist()
            out = []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                query = batch.column("query_id")[a].as_py()
                top = heapq.nsmallest(k, zip((-s for s in scores[a:b]), ids[a:b], strict=True))
                out += [(query, rank, i, -s) for rank, (s, i) in enumerate(top, 1)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "rank", "vec_id", "score"])

    return best.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
