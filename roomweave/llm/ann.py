"""Nearest neighbours of a query set among all vectors, by a block matrix join.

Vectors are cut into blocks by a hash of their id; every block of queries meets every block of candidates once, as a
tile.  A tile multiplies int8 codes; with the norms of what the codes leave out, each product bounds the cosine from
both sides.  Pairs whose upper bound reaches the k-th lower bound of their query survive and are computed again in
double precision.  Each tile sends its k best a query, and heaps merge them, so the search is exact.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors are compared with those of
their length.  Rows of one id count once, with the least of their vectors.  Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES, CANDIDATES = 1024, 4096  # rows of a block, about
STRIP = 128  # queries multiplied at a time
FOUND = "query_id long, vec_id long, score double"
BLOCK = "dim int, block int, ids binary, vectors binary"


def usable(v: Column) -> Column:
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)


def _blocks(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // rows))

    def gather(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        ids = table["id"].to_numpy()
        values = table["vector"].combine_chunks().values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        order = np.lexsort((*values.T[::-1], ids))
        order = order[np.r_[True, ids[order][1:] != ids[order][:-1]]]
        return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "ids": [ids[order].astype("<i8").tobytes()], "vectors": [values[order].astype("<f8").tobytes()]})

    dealt = vectors.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(gather, BLOCK), n


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors (as float32, in which their products are exact), scales, and norms of the errors."""
    scale = np.abs(x).max(1, keepdims=True) / 127
    code = np.rint(x / scale)
    return code.astype(np.int8).astype(np.float32), scale[:, 0], np.linalg.norm(x - code * scale, axis=1)


def _tile(query_ids, queries, ids, vectors, k: int):
    """(query_id, vec_id, score) of the k best candidates of each query."""
    q_norm, c_norm = np.sqrt((queries * queries).sum(1)), np.sqrt((vectors * vectors).sum(1))
    q_code, q_scale, q_left = _codes(queries / q_norm[:, None])
    c_code, c_scale, c_left = _codes(vectors / c_norm[:, None])
    for lo in range(0, len(queries), STRIP):
        near = (q_code[lo : lo + STRIP] @ c_code.T).astype(np.float64) * q_scale[lo : lo + STRIP, None] * c_scale[None, :]
        # |q.c - q'.c'| <= |c - c'| + |q - q'| |c'|, for unit q and codes q', c'
        bound = c_left[None, :] + q_left[lo : lo + STRIP, None] * (1 + c_left[None, :]) + 1e-9
        for i in range(near.shape[0]):
            qid, low = query_ids[lo + i], near[i] - bound[i]
            own = ids == qid
            low[own] = -np.inf
            floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            alive = np.flatnonzero((near[i] + bound[i] >= floor) & ~own)
            score = (vectors[alive] * queries[lo + i]).sum(1) / (c_norm[alive] * q_norm[lo + i])
            best = heapq.nsmallest(k, zip((-score).tolist(), ids[alive].tolist()))
            yield from ((int(qid), v, -s) for s, v in best)


def _found(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest cosine for each query, other than itself."""
    ready = [df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"))) for df in (vectors, queries)]
    candidates, _ = _blocks(ready[0], CANDIDATES)
    asked, n = _blocks(ready[1], QUERIES)
    asked = asked.select("dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    tiles = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(asked, ["dim", "query_block"])

    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = [np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["queries"], "<f8").reshape(-1, row["dim"]), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])]
                yield _found(list(_tile(*block, k)))

    def merge(table: pa.Table) -> pa.Table:
        best: dict[int, list] = {}
        for q, v, s in zip(*(table[c].to_pylist() for c in ("query_id", "vec_id", "score"))):
            heap = best.setdefault(q, [])
            item = (s, -v)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        rows = [(q, r + 1, -v, s) for q, heap in best.items() for r, (s, v) in enumerate(sorted(heap, reverse=True))]
        columns = list(zip(*rows))
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "rank": pa.array(columns[1], pa.int32()), "vec_id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.float64())})

    found = tiles.mapInArrow(search, FOUND)
    # Queries are merged some at a time, since a group of Python's is costly; a query lies in one group.
    lots = found.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(64 * n)).cast("int"))
    return lots.groupBy("lot").applyInArrow(lambda t: merge(t), "query_id long, rank int, vec_id long, score double")
