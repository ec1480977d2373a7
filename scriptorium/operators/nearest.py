"""Nearest vectors by blocks: rows and queries meet as matrices, so that a task holds one block of either and no pair is ever a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Products of matrices differ from sums in order by far less; what lies within this of the k-th is summed in order.
MARGIN = 1e-7
CHUNK = 64


def _vectors(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _pick(x: np.ndarray, xn: np.ndarray, q: np.ndarray, qn: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the queries q: places of queries and of rows, and scores, of the k best rows of each, ties to the smaller id. Scores that are no numbers come first, as Spark sorts them."""
    out = []
    with np.errstate(all="ignore"):
        for at in range(0, len(q), CHUNK):
            near = q[at : at + CHUNK] @ x.T / (xn * qn[at : at + CHUNK, None])
            near[np.isnan(near)] = np.inf
            least = np.partition(near, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(near), -np.inf)
            i, j = np.nonzero(near >= (least - MARGIN)[:, None])
            i += at
            total = np.zeros(len(i))
            for d in range(x.shape[1]):  # in the order of components, whatever block a row is in
                total += x[j, d] * q[i, d]
            score = total / (xn[j] * qn[i])
            order = np.lexsort((ids[j], -np.where(np.isnan(score), np.inf, score), i))
            i, j, score = i[order], j[order], score[order]
            start = np.searchsorted(i, i)
            keep = np.arange(len(i)) - start < k
            out.append((i[keep], j[keep], score[keep]))
    return tuple(np.concatenate([o[n] for o in out]) for n in range(3))


def nearest(rows: DataFrame, asked: DataFrame, key: str, k: int, part_rows: int = 8192, block_queries: int = 4096) -> DataFrame:
    """query_id, id, score: of each query the k best rows of each block of rows that it meets, by inner product over the product of norms.

    rows: key, id, v (array without nulls), n (its norm); asked: key, query_id, q, qn. Rows and queries of one key meet, and their
    vectors have one size. Both are dealt by hashes into blocks, and each block of rows meets each block of queries of its key
    in a task of its own; a query leaves k rows there, whatever the number of copies.
    """
    many = rows.groupBy(key).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("__parts"))
    many = many.join(asked.groupBy(key).agg(F.ceil(F.count("*") / block_queries).cast("int").alias("__blocks")), key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    a = rows.join(F.broadcast(many), key).withColumn("__part", one("id", "__parts")).withColumn("__block", every("__blocks"))
    b = asked.join(F.broadcast(many), key).withColumn("__block", one("query_id", "__blocks")).withColumn("__part", every("__parts"))
    by = [key, "__part", "__block"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], right.schema.field("query_id").type), pa.array([], left.schema.field("id").type), pa.array([], pa.float64())], names=["query_id", "id", "score"])
        size = len(left.column("v")[0])
        ids = left.column("id").combine_chunks()
        # ids may be of any type that has an order
        places = np.empty(len(ids), dtype=np.int64)
        places[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        norms = lambda t, c: t.column(c).to_numpy()
        i, j, score = _pick(_vectors(left.column("v"), size), norms(left, "n"), _vectors(right.column("q"), size), norms(right, "qn"), places, k)
        return pa.table([right.column("query_id").take(pa.array(i)), left.column("id").take(pa.array(j)), pa.array(score)], names=["query_id", "id", "score"])

    kind = asked.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    a, b = a.select(*by, "id", "v", "n"), b.select(*by, "query_id", "q", "qn")
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(meet, f"query_id {kind[0]}, id {kind[1]}, score double")
