"""Exact nearest neighbours by a block matrix join on int8 tiles.

Queries and candidates are dealt into blocks, and every query block meets every
candidate block in a tile: a stated query set against all rows. In a tile the
vectors are rounded to int8 with a scale of their own, and one matrix product of
the rounded values gives all inner products with a proven error bound:

    |<q, c> - s_q s_c <q', c'>| <= s_q/2 |c|_1 + s_c/2 |q|_1 + d s_q s_c / 4

(q', c' rounded, s scales, d dimensions). A pair survives if its upper bound
reaches the k-th largest lower bound of its query in the tile; only survivors
are recomputed, in double precision and in one order of summation, so equal
vectors score equally wherever they stand. Heaps merge the k best of the tiles.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, as query or as candidate; vectors of other lengths than
the query's are no candidates; a query is not its own candidate, but another row
with equal components is; rows with a null id take no part; repeated rows count
once; ties go to the smaller id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ship_by_value
from .workspace import Workspace

ship_by_value(__name__)

QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 16384  # vectors of a tile's sides
SLICE = 256  # queries of a tile whose products are held at a time
EXACT = 1040  # dimensions over which float32 holds every sum of products of values up to 127


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values rounded to -127..127 (as float32, whose products of them are exact) and each row's scale."""
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8).astype(np.float32), scale


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of quantised rows as doubles, exact at any number of dimensions."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT):
        out += a[:, d : d + EXACT] @ b[:, d : d + EXACT].T
    return out


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, scores) of the k best candidates of each query in this tile, best first."""
    cq, cs = quantise(c)
    c_norm, dims = np.abs(c).sum(axis=1), c.shape[1]
    columns = np.ascontiguousarray(c.T)
    for at in range(0, len(q), SLICE):
        part = q[at : at + SLICE]
        pq, ps = quantise(part)
        about = products(pq, cq) * ps[:, None] * cs
        error = 0.5 * ps[:, None] * c_norm + 0.5 * np.abs(part).sum(axis=1)[:, None] * cs + 0.25 * dims * ps[:, None] * cs
        error *= 1 + 1e-9
        for i in range(len(part)):
            low, high = about[i] - error[i], about[i] + error[i]
            own = c_ids == q_ids[at + i]
            low[own] = high[own] = -np.inf
            m = min(k, len(c_ids) - int(own.sum()))
            if m <= 0:
                continue
            bar = np.partition(low, len(low) - m)[len(low) - m]
            alive = np.flatnonzero(high >= bar)
            alive = alive[~own[alive]]
            exact = np.zeros(len(alive))
            for d in range(dims):
                exact += part[i, d] * columns[d, alive]
            best = np.lexsort((c_ids[alive], -exact))[:m]
            yield q_ids[at + i], c_ids[alive[best]], exact[best]


def _tiles(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(candidates):
            q, c = (np.array(x.vector.tolist(), np.float64) for x in (queries, candidates))
            for name, ids, scores in tile(queries.vec_id.to_numpy(), q, candidates.vec_id.to_numpy(), c, k):
                found["query_id"].append(np.full(len(ids), name))
                found["vec_id"].append(ids)
                found["score"].append(scores)
        return pd.DataFrame({n: np.concatenate(x) if x else np.zeros(0, np.float64 if n == "score" else np.int64) for n, x in found.items()})

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (query_id, vec_id, score), sorted by query, give its k best with their ranks."""
        now, heap = None, []

        def emit() -> pa.RecordBatch:
            best = sorted(((s, -v) for s, v in heap), key=lambda x: (-x[0], x[1]))
            return pa.RecordBatch.from_arrays(
                [pa.array([now] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([v for _, v in best], pa.int64()), pa.array([s for s, _ in best], pa.float64())],
                ["query_id", "rank", "vec_id", "score"],
            )

        for batch in batches:
            for name, vec, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    if heap:
                        yield emit()
                    now, heap = name, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
        if heap:
            yield emit()

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    good = F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product of each query."""
    space = Workspace(queries.sparkSession, "neighbours")
    q = space.write(usable(queries, id_col, vector_col), "queries")
    c = space.write(usable(vectors, id_col, vector_col), "candidates")
    q_blocks, c_blocks = (max(1, -(-x.count() // n)) for x, n in ((q, QUERY_BLOCK), (c, CANDIDATE_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dim = F.size("vector").alias("dim")
    left = q.select("vec_id", "vector", dim, block(q_blocks).alias("row"), every(c_blocks).alias("column"))
    right = c.select("vec_id", "vector", dim, block(c_blocks).alias("column"), every(q_blocks).alias("row"))
    keys = ["dim", "row", "column"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_tiles(k), "query_id long, vec_id long, score double")
    placed = tiles.repartition("query_id").sortWithinPartitions("query_id")
    return placed.mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
