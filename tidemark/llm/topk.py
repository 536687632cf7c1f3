"""Exact top-k search by inner product, with a pivot table that rules candidates out.

|q - x| >= max over pivots p of | |q - p| - |x - p| |, so the distances to many pivots, computed
once for every vector, bound q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 from above.  Each query takes the
candidates of a block in the order of their bounds and stops when k scores are at least as high as
the next bound; what is left cannot enter.

Rules
    * Vectors that are NULL, empty or hold NULL or non-finite components take no part.
    * A component x becomes floor(256 * x); scores are whole numbers; ties go to the smaller id.
    * Only vectors of equal length are compared.  Rows that repeat an id are separate candidates;
      rows with the query's own id are not candidates.  No rows give no result.

Scale: candidates are cut into blocks by a hash of their id and queries into blocks of a fixed
size; a task holds one block of each, whatever the number of rows.  A block of candidates goes out
once per block of queries.  Each pair of blocks returns k rows per query at most, and the last
choice is a window over those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for, usable_vector

N_PIVOTS = 24
CANDIDATE_ROWS = 8192
QUERY_ROWS = 4096
SCALE = 256
STEP = 512


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    v = table.column("v").combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat.astype(np.float64).reshape(len(v), dim) * SCALE)


def _far_apart(x: np.ndarray, count: int) -> np.ndarray:
    """Pivots: each next one is the row that is farthest from those taken before."""
    take = [int(np.argmax((x * x).sum(1)))]
    near = ((x - x[take[0]]) ** 2).sum(1)
    while len(take) < min(count, len(x)):
        take.append(int(np.argmax(near)))
        near = np.minimum(near, ((x - x[take[-1]]) ** 2).sum(1))
    return x[take]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d, 0)).T.copy()


def search_block(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, n_pivots: int = N_PIVOTS) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the k best of one block, in order; also counts nothing it does not need."""
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    pivots = _far_apart(x, n_pivots)
    table, own = _distances(x, pivots), _distances(queries, pivots)
    norms = (x * x).sum(1)
    out = []
    for i, q in enumerate(queries):
        low = np.abs(table[0] - own[0, i])
        for p in range(1, len(pivots)):
            np.maximum(low, np.abs(table[p] - own[p, i]), out=low)
        qq = q @ q
        # distances are rounded in their last digits: the bound is widened by far more than that
        bound = (qq + norms - low * low) / 2 + 1e-9 * (qq + norms) + 1e-3
        bound[ids == query_ids[i]] = -np.inf
        best_ids, best = np.zeros(0, ids.dtype), np.zeros(0)
        rest, size = np.arange(len(x)), STEP
        while len(rest):
            if len(rest) > size:
                at = np.argpartition(-bound[rest], size - 1)
                now, rest = rest[at[:size]], rest[at[size:]]
            else:
                now, rest = rest, rest[:0]
            now = now[bound[now] > -np.inf]
            best = np.concatenate([best, x[now] @ q])
            best_ids = np.concatenate([best_ids, ids[now]])
            top = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[top], best_ids[top]
            if len(best) == k:
                rest = rest[bound[rest] >= best[-1]]
            size *= 2
        out += [(int(query_ids[i]), int(a), int(b)) for a, b in zip(best_ids, best)]
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of every row with ``is_query``."""
    usable = vectors.where(usable_vector(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows, n_queries = usable.agg(F.count("*"), F.count_if("q")).first()
    nc, nq = blocks_for(rows, candidate_rows), blocks_for(n_queries, query_rows)
    usable = usable.withColumn("dim", F.size("v"))
    block = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = usable.select("dim", block(1, nc).alias("cb"), every(nq).alias("qb"), "id", "v")
    queries = usable.where("q").select("dim", every(nc).alias("cb"), block(2, nq).alias("qb"), "id", "v")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        found = []
        if len(left) and len(right):
            found = search_block(_matrix(right, dim), right.column("id").to_numpy(), _matrix(left, dim), left.column("id").to_numpy(), k)
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    keys = ["dim", "cb", "qb"]
    best = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
