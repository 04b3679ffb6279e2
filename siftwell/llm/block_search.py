"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt out evenly (by a hash of the id) into blocks; each tile of query block
and candidate block is one group. In a tile the vectors are coded as int8 with a scale per vector, and
a matrix product of the codes gives every approximate distance. With the length of each vector's coding
error, the true distance is known to lie within ``approx ± (e_q + e_c)``; candidates whose lower bound
exceeds the k-th smallest upper bound (an id counted once, however many rows it has) cannot be among the k nearest and are left out. The others are
recomputed in double precision on the original vectors. A heap per query carries the best k through the
sub-tiles of a tile, and heaps of the tiles are merged per query, for a bounded group of queries at a time. The result is exact.

Vectors that are null, zero, or hold a null or non-finite component take no part; neither do null ids.
Vectors are compared with those of the same length only. Fewer than k candidates: all of them. Ties go
to the smaller id; of rows with the same id and the same vector one counts.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Queries of a block, and vectors of a candidate block (a tile's memory is bounded by these two).
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 32768
_SUB_Q, _SUB_C = 256, 4096
#: Rows of heaps that are merged in one group (expected; queries are dealt out by hash).
MERGE_ROWS = 1 << 18


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    return F.expr(
        f"`{vector}` is not null and size(`{vector}`) > 0 and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        f" and exists(`{vector}`, x -> x <> 0)"
    )


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows of ``x``, their scales, and the lengths of the coding errors."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # components so small that the scale itself vanishes
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, error


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _tile(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        np.seterr(over="ignore", invalid="ignore")  # vectors may be so long that squares overflow
        heaps: dict[int, list] = {}
        if queries.num_rows and candidates.num_rows:
            candidates = candidates.sort_by("c_id")  # rows of an id beside each other
            q_id, c_id = queries.column("id").to_numpy(), candidates.column("c_id").to_numpy()
            q, c = _matrix(queries.column("vector")), _matrix(candidates.column("c_vector"))
            (qa, qs, qe), (ca, cs, ce) = quantise(q), quantise(c)
            exact = np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64  # products of codes stay whole numbers
            q_len = (qa.astype(np.float64) ** 2).sum(1) * qs**2
            c_len = (ca.astype(np.float64) ** 2).sum(1) * cs**2
            qf, cf = qa.astype(exact), ca.astype(exact)
            for i in range(0, len(q), _SUB_Q):
                rows = slice(i, i + _SUB_Q)
                reach = np.full(len(q_id[rows]), np.inf)
                for j in range(0, len(c), _SUB_C):
                    cols = slice(j, j + _SUB_C)
                    dot = (qf[rows] @ cf[cols].T).astype(np.float64) * qs[rows, None] * cs[None, cols]
                    square = q_len[rows, None] + c_len[None, cols] - 2 * dot
                    size = q_len[rows, None] + c_len[None, cols]
                    slack, error = 1e-12 * size, qe[rows, None] + ce[None, cols] + 1e-9 * np.sqrt(size)  # and what rounding may add
                    low = np.sqrt(np.maximum(square - slack, 0)) - error
                    high = np.sqrt(np.maximum(square + slack, 0)) + error
                    own = q_id[rows, None] == c_id[None, cols]
                    high[own | np.isnan(high)] = np.inf  # not a number where squares overflow: no bound
                    # an id counts once, by its smallest bound: k rows of fewer ids are not k neighbours
                    firsts = np.flatnonzero(np.r_[True, c_id[cols][1:] != c_id[cols][:-1]])
                    if len(firsts) < high.shape[1]:
                        high = np.minimum.reduceat(high, firsts, axis=1)
                    if high.shape[1] >= k:
                        reach = np.minimum(reach, np.partition(high, k - 1, axis=1)[:, k - 1])
                    at_q, at_c = np.nonzero(~(low > reach[:, None]) & ~own)
                    if not len(at_q):
                        continue
                    # squares are added in the order of the components, as a plain loop does
                    true, ids = np.sqrt(np.cumsum((q[i + at_q] - c[j + at_c]) ** 2, axis=1)[:, -1]), c_id[j + at_c]
                    order = np.lexsort((ids, true, at_q))
                    at_q, true, ids = at_q[order], true[order], ids[order]
                    new = np.r_[True, (at_q[1:] != at_q[:-1]) | (true[1:] != true[:-1]) | (ids[1:] != ids[:-1])]
                    at_q, true, ids = at_q[new], true[new], ids[new]
                    starts = np.flatnonzero(np.r_[True, at_q[1:] != at_q[:-1]])
                    place = np.arange(len(at_q)) - np.repeat(starts, np.diff(np.append(starts, len(at_q))))
                    best = place < k
                    for a, d, v in zip(at_q[best].tolist(), true[best].tolist(), ids[best].tolist()):
                        heap = heaps.setdefault(int(q_id[i + a]), [])
                        item = (-d, -v)
                        if len(heap) < k:
                            if item not in heap:
                                heapq.heappush(heap, item)
                        elif item > heap[0] and item not in heap:
                            heapq.heapreplace(heap, item)
                    for a in np.unique(at_q).tolist():
                        heap = heaps.get(int(q_id[i + a]), ())
                        if len(heap) == k:
                            reach[a] = min(reach[a], -heap[0][0])
        rows = [(q, -v, -d) for q, heap in heaps.items() for d, v in heap]
        a, b, d = zip(*rows) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(d, pa.float64())})

    return run


def _merge(k: int):
    def run(heaps: pa.Table) -> pa.Table:
        heaps = heaps.sort_by("query_id")
        query = heaps.column("query_id").to_numpy()
        score, vec = heaps.column("score").to_pylist(), heaps.column("vec_id").to_pylist()
        cuts = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True]).tolist()
        rows = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            best = heapq.nsmallest(k, set(zip(score[i:j], vec[i:j])))
            rows += [(int(query[i]), n, v, d) for n, (d, v) in enumerate(best, 1)]
        a, n, v, d = zip(*rows)
        return pa.table({"query_id": pa.array(a, pa.int64()), "rank": pa.array(n, pa.int32()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(d, pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows by Euclidean distance of each row that ``is_query`` holds for, itself left out.

    Returns query_id, rank (from 1), vec_id and score. Queries x blocks and candidates x blocks are what
    is shuffled: each query goes to every candidate block and each candidate to every query block.
    """
    valid = vectors.where(usable(vector_col) & F.col(id_col).isNotNull())
    rows = valid.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    q_blocks = max(1, math.ceil(sizes["q"] / QUERY_BLOCK))
    c_blocks = max(1, math.ceil(sizes["n"] / CANDIDATE_BLOCK), min(rows.sparkSession.sparkContext.defaultParallelism * 2, sizes["n"] // 1024))
    dealt = rows.withColumn("dim", F.size("vector"))
    side = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")))
    queries = side(dealt.where("asks"), "qb", q_blocks, "cb", c_blocks)
    candidates = side(dealt, "cb", c_blocks, "qb", q_blocks)
    # names of its own on each side: both come from the same rows
    queries = queries.select("dim", "qb", "cb", "id", "vector")
    candidates = candidates.select(*(F.col(c).alias(f"c_{c}") for c in queries.columns))
    heaps = queries.groupBy("dim", "qb", "cb").cogroup(candidates.groupBy("c_dim", "c_qb", "c_cb")).applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    # queries are merged many at a time: as many as keep a group's rows bounded, each query having k rows of every candidate block at most
    groups = max(partitions(rows.sparkSession), math.ceil(sizes["q"] * c_blocks * k / MERGE_ROWS))
    return heaps.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part")).applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
