"""Hard negatives by exact integer matrix products.

Vectors become integers (``floor(scale * x)``). Anchors and candidates are dealt into buckets; in a bucket the anchors
are one tile and candidates stream past them in batches. A product of two tiles is Strassen's: seven products of half
the size instead of eight, tiles padded with zeros, all additions on whole numbers, so the scores are exact.
Two passes are made. The first takes, per anchor, the best rows of its own label (candidates only meet anchors whose
label has the same slot). The second takes, per anchor and positive score, the best rows of other labels whose score
lies in the window below the positive's. Each bucket keeps bounded heaps; heaps of the same anchor are merged.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part. Vectors
meet those of the same length only; an empty vector has score 0 with its like. A row is never its own partner, nor is
another row of the anchor's id. Of rows with the same id and score one counts for an anchor; anchors repeated whole
count once. Ties go to the smaller id. A positive with a negative score has an empty window. Scores must fit a long
(otherwise the job fails with an overflow, never with a wrong score). An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, release

#: Anchors of a bucket, and the candidates that stream past them at most (of a bucket's memory only the first counts).
ANCHOR_BLOCK, CANDIDATE_GROUP = 16_384, 1 << 18
#: Slots of labels in the first pass.
LABEL_SLOTS = 1024
_ROWS, _COLUMNS, _LEAF = 512, 4096, 16
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = _LEAF) -> np.ndarray:
    """``a @ b.T`` of whole numbers, both row by row; exact as long as the result fits the type (sums within may wrap and come back)."""
    levels, least = 0, min(a.shape[0], a.shape[1], b.shape[0])
    while least >> (levels + 1) >= leaf:
        levels += 1
    if not levels:
        return a @ b.T
    step = 1 << levels
    up = lambda n: -(-n // step) * step
    out = _strassen(_padded(a, up(a.shape[0]), up(a.shape[1])), _padded(b, up(b.shape[0]), up(b.shape[1])), levels)
    return out[: a.shape[0], : b.shape[0]]


def _padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if x.shape == (rows, columns):
        return x
    out = np.zeros((rows, columns), x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def _strassen(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b.T
    m, d, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[0] // 2
    a11, a12, a21, a22 = a[:m, :d], a[:m, d:], a[m:, :d], a[m:, d:]
    b11, b12, b21, b22 = b[:n, :d], b[:n, d:], b[n:, :d], b[n:, d:]  # the right factor is b transposed
    out = np.empty((2 * m, 2 * n), a.dtype)
    c11, c12, c21, c22 = out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:]
    p = _strassen(a11 + a22, b11 + b22, levels - 1)
    c11[:], c22[:] = p, p
    p = _strassen(a21 + a22, b11, levels - 1)
    c21[:] = p
    c22 -= p
    p = _strassen(a11, b21 - b22, levels - 1)
    c12[:] = p
    c22 += p
    p = _strassen(a22, b12 - b11, levels - 1)
    c11 += p
    c21 += p
    p = _strassen(a11 + a12, b22, levels - 1)
    c11 -= p
    c12 += p
    c22 += _strassen(a21 - a11, b11 + b21, levels - 1)
    c11 += _strassen(a12 - a22, b12 + b22, levels - 1)
    return out


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as int64, or as Python's integers where it does not fit."""
    x = np.floor(values * scale)
    if not x.size or np.abs(x).max() < 2.0**62:
        return x.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows; Python's integers where int64 might not hold them (with room for percentages)."""
    most = lambda x: max(int(x.max()), -int(x.min())) if x.size else 0
    if a.dtype == object or b.dtype == object or a.shape[1] * most(a) * most(b) >= 1 << 55:
        a, b = a.astype(object), b.astype(object)
        return a @ b.T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return strassen(a, b)


def _offer(heap: list, item: tuple[int, int], k: int) -> None:
    """Keep the ``k`` best of (score, -id); one that is there already is not taken twice."""
    if len(heap) < k:
        if item not in heap:
            heapq.heappush(heap, item)
    elif item > heap[0] and item not in heap:
        heapq.heapreplace(heap, item)


class Heaps:
    """Bounded heaps by key; those of other buckets can be merged in."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def take(self, keys: list, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Take the allowed (row, column) places of a tile; ``keys`` names the rows' heaps."""
        least = _LEAST if scores.dtype != object else -math.inf
        masked = np.where(allowed, scores, least)
        full = [heap[0][0] if len(heap := self.heaps.get(key, ())) == self.k else least for key in keys]
        floor = np.array(full, dtype=masked.dtype)
        # an id may be there many times, so the k-th place only bounds where rows have ids of their own
        if masked.shape[1] > 8 * self.k and len(np.unique(ids)) == len(ids):
            floor = np.maximum(floor, np.partition(masked, masked.shape[1] - self.k, axis=1)[:, masked.shape[1] - self.k])
        rows, columns = np.nonzero(allowed & (masked >= floor[:, None]))
        if not len(rows):
            return
        score, of = scores[rows, columns], ids[columns]
        # rows come in order: a stable sort by id, then by score, then by row
        order = np.argsort(of, kind="stable")
        order = order[np.argsort(-score[order], kind="stable")]
        order = order[np.argsort(rows[order], kind="stable")]
        rows, score, of = rows[order], score[order], of[order]
        new = np.r_[True, (rows[1:] != rows[:-1]) | (score[1:] != score[:-1]) | (of[1:] != of[:-1])]
        rows, score, of = rows[new], score[new], of[new]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        best = place < self.k
        for row, s, i in zip(rows[best].tolist(), score[best].tolist(), of[best].tolist()):
            _offer(self.heaps.setdefault(keys[row], []), (s, -i), self.k)

    def merge(self, key, scores: list[int], ids: list[int]) -> None:
        heap = self.heaps.setdefault(key, [])
        for s, i in zip(scores, ids):
            _offer(heap, (s, -i), self.k)


_HEAP = "anchor_id long, tag long, positive_score long, scores array<long>, ids array<long>"


def _packed(heaps: dict) -> Iterator[pa.RecordBatch]:
    """One row per heap, best first."""
    keys = list(heaps)
    for i in range(0, len(keys), 4096):
        part = keys[i : i + 4096]
        best = [sorted(heaps[key], reverse=True) for key in part]
        yield pa.RecordBatch.from_pydict({
            "anchor_id": pa.array([k[0] for k in part], pa.int64()), "tag": pa.array([k[1] for k in part], pa.int64()), "positive_score": pa.array([k[2] for k in part], pa.int64()),
            "scores": pa.array([[s for s, _ in h] for h in best], pa.list_(pa.int64())), "ids": pa.array([[-i for _, i in h] for h in best], pa.list_(pa.int64())),
        })


class _Block:
    """Rows of one side and one vector length: ids, tags, label codes, whole numbers, positive scores."""

    def __init__(self, batch: pa.RecordBatch, labels: dict, scale: int):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        self.ids, self.tags = (column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag"))
        coded = column("label").dictionary_encode()
        names = np.array([labels.setdefault(x, len(labels)) for x in coded.dictionary.to_pylist()], np.int64)
        self.labels = names[coded.indices.to_numpy()]
        flat = column("vector").flatten().to_numpy(zero_copy_only=False)
        self.values = whole(flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0), scale)
        windows = column("windows").to_pylist()
        width = max((len(w) for w in windows if w), default=0)
        self.windows = np.array([(w or []) + [-1] * (width - len(w or [])) for w in windows], np.int64).reshape(batch.num_rows, width)


def _joined(blocks: list[_Block]) -> _Block:
    out = object.__new__(_Block)
    for name in ("ids", "tags", "labels", "values"):
        setattr(out, name, np.concatenate([getattr(b, name) for b in blocks]))
    width = max(b.windows.shape[1] for b in blocks)
    out.windows = np.concatenate([np.pad(b.windows, ((0, 0), (0, width - b.windows.shape[1])), constant_values=-1) for b in blocks])
    return out


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of the batches in which the named columns do not change."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(change).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield tuple(int(k[a]) for k in keys), batch.slice(a, b - a)


def _bucket_pass(k: int, scale: int, low: int, positives: bool) -> Callable:
    """Task of a pass: buckets come one after the other, anchors before candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, heaps, labels, gathered, anchors = None, Heaps(k), {}, {}, {}
        for (slot, a, c, candidate, dim), part in _runs(batches, ("slot", "anchor_block", "group", "candidate", "dim")):
            if (slot, a, c) != bucket:
                yield from _packed(heaps.heaps)
                bucket, heaps, labels, gathered, anchors = (slot, a, c), Heaps(k), {}, {}, {}
            block = _Block(part, labels, scale)
            if not candidate:
                gathered.setdefault(dim, []).append(block)
            elif dim in gathered or dim in anchors:
                if dim not in anchors:
                    anchors[dim] = _joined(gathered.pop(dim))
                for i in range(0, len(block.ids), _COLUMNS):
                    _meet(anchors[dim], block, slice(i, i + _COLUMNS), heaps, low, positives)
        yield from _packed(heaps.heaps)
        release()

    return run


def _meet(anchors: _Block, block: _Block, columns: slice, heaps: Heaps, low: int, positives: bool) -> None:
    ids = block.ids[columns]
    for j in range(0, len(anchors.ids), _ROWS):
        rows = slice(j, j + _ROWS)
        scores = products(anchors.values[rows], block.values[columns])
        same = anchors.labels[rows, None] == block.labels[None, columns]
        names = list(zip(anchors.ids[rows].tolist(), anchors.tags[rows].tolist()))
        if positives:
            heaps.take([(i, t, 0) for i, t in names], scores, ids, same & (anchors.ids[rows, None] != ids[None, :]))
            continue
        other = ~same & (anchors.ids[rows, None] != ids[None, :])
        for w in range(anchors.windows.shape[1]):
            top = anchors.windows[rows, w]
            if top.max(initial=-1) < 0:
                continue
            bottom = np.array([-(-low * t // 100) for t in top.tolist()], scores.dtype)  # rounded up: low * t <= 100 * score
            inside = other & (scores <= top[:, None].astype(scores.dtype)) & (scores >= bottom[:, None])
            heaps.take([(i, t, s) for (i, t), s in zip(names, top.tolist())], scores, ids, inside)


def _merged(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)
        for batch in batches:
            rows = batch.to_pydict()
            for i, t, p, scores, ids in zip(rows["anchor_id"], rows["tag"], rows["positive_score"], rows["scores"], rows["ids"]):
                heaps.merge((i, t, p), scores, ids)
        yield from _packed(heaps.heaps)

    return run


def _pass(anchors: DataFrame, rows: DataFrame, slots: int, run: Callable, k: int) -> DataFrame:
    """Deal anchors and rows into (slot, anchor block, candidate group), run the buckets, merge their heaps."""
    spark = rows.sparkSession
    slot = F.pmod(F.xxhash64("dim", "label"), F.lit(slots)) if slots > 1 else F.lit(0).cast("long")
    anchors, rows = anchors.withColumn("slot", slot), rows.withColumn("slot", slot)
    # at most a row per slot comes to the driver
    sizes = {r["slot"]: [r["n"], 0] for r in rows.groupBy("slot").agg(F.count("*").alias("n")).collect()}
    for r in anchors.groupBy("slot").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r["slot"], [0, 0])[1] = r["n"]
    total = sum(n for n, a in sizes.values() if a)
    group = min(CANDIDATE_GROUP, max(1024, total // (4 * spark.sparkContext.defaultParallelism)))
    blocks = [(s, -(-a // ANCHOR_BLOCK), -(-n // group)) for s, (n, a) in sizes.items() if a and n]
    buckets = sum(a * c for _, a, c in blocks)
    table = F.broadcast(spark.createDataFrame(blocks, "slot long, blocks long, groups long"))  # at most a row per slot
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), F.col(n))
    columns = ("slot", "anchor_block", "group", "candidate", "dim", "id", "tag", "label", "vector", "windows")
    asked = anchors.join(table, "slot").withColumn("anchor_block", part("blocks")).withColumn("group", every("groups")).withColumn("candidate", F.lit(0))
    met = rows.join(table, "slot").withColumn("group", part("groups")).withColumn("anchor_block", every("blocks")).withColumn("candidate", F.lit(1))
    both = asked.select(*columns).unionByName(met.select(*columns))
    keys = ("slot", "anchor_block", "group")
    dealt = both.repartition(max(1, min(buckets, 4 * partitions(spark))), *keys).sortWithinPartitions(*keys, "candidate", "dim")
    heaps = dealt.mapInArrow(run, _HEAP)
    return heaps.repartition(partitions(spark), "anchor_id", "tag").mapInArrow(_merged(k), _HEAP)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels
    that score no more than the positive and at least ``low_percent`` percent of it.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.
    """
    fine = F.expr(f"forall(`{vector_col}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    label = F.col(label) if isinstance(label, str) else label
    valid = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine)
    rows = valid.select(
        F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), is_anchor.alias("asks")
    ).where("label is not null")
    rows = rows.withColumn("dim", F.size("vector")).withColumn("tag", F.lit(0).cast("long")).withColumn("windows", F.lit(None).cast("array<long>"))
    anchors = rows.where("asks").withColumn("tag", F.xxhash64("label", F.transform("vector", lambda x: F.floor(x * scale)))).dropDuplicates(["id", "tag"])
    found = _pass(anchors, rows, LABEL_SLOTS, _bucket_pass(positives, scale, low_percent, True), positives)
    found = materialise(found.drop("positive_score"), "positives")
    asked = anchors.drop("windows").join(found.select(F.col("anchor_id").alias("id"), "tag", F.array_distinct(F.filter("scores", lambda s: s >= 0)).alias("windows")), ["id", "tag"])
    near = _pass(asked.where("size(windows) > 0"), rows, 1, _bucket_pass(negatives, scale, low_percent, False), negatives)
    pairs = found.select("anchor_id", "tag", F.explode(F.arrays_zip("scores", "ids")).alias("p"))
    pairs = pairs.select("anchor_id", "tag", F.col("p.scores").alias("positive_score"), F.col("p.ids").alias("positive_id"))
    near = near.select("anchor_id", "tag", "positive_score", F.posexplode(F.arrays_zip("scores", "ids")).alias("place", "negative"))
    return pairs.join(near, ["anchor_id", "tag", "positive_score"]).select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("negative.ids").alias("negative_id"), "positive_score",
        F.col("negative.scores").alias("negative_score"),
    )


#: The same in DuckDB SQL, for the registered query.
ORACLE = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
a as (select row_number() over () as k, * from (select distinct vec_id, label, e from v where vec_id % 100 = 0)),
s as (select distinct a.k, a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, coalesce(list_sum(list_transform(list_zip(a.e, v.e), lambda z: z[1] * z[2])), 0)::bigint as score
  from a join v on a.vec_id <> v.vec_id and len(a.e) = len(v.e)),
p as (select * from (select *, row_number() over (partition by k order by score desc, vec_id) as place from s where same) where place <= 5),
w as (select p.k, p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.k, p.place order by s.score desc, s.vec_id) as rank
  from p join s on p.k = s.k and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from w where rank <= 5
"""
