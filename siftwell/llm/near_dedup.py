"""MinHash near-dedup with odd sketches.

A document's set is its distinct shingles of ``words`` lower-cased (A-Z) words; with fewer words the whole
sequence is one shingle; without words the set is empty and links with nothing. Documents are linked
where the Jaccard similarity is at least the threshold; a link is only made on full sets.

1. Documents with the same words are one class; a class is represented by its smallest doc_id.
2. Every text gets ``SAMPLES`` MinHash samples. Bands of them propose candidates; the number of bands is
   chosen so that a pair at the threshold shares none with a chance of at most ``MISS``. The samples are also folded
   into an odd sketch: sample i of value v flips bit hash(i, v). The XOR of two sketches has a
   population count that tells how many samples differ: candidates whose count rules the threshold out are no candidates.
3. The remaining candidates tie documents into clusters, for which a spanning forest is enough: first each document
   of a bucket is held against the bucket's smallest, then, in buckets that still hold several clusters, documents
   against those of other clusters. Large buckets do that on packed sketches inside a task; no pair becomes a row
   unless it joins two clusters. Documents that could be linked are in one cluster.
4. In each cluster the links are confirmed on full sets, again only as many as tie components together; a
   document that shares too few shingles with all others of its cluster is set aside before. Buckets and
   clusters beyond a size are cut into blocks, each pair of blocks a group of its own, so that no task grows with them.

Clusters, links and components stay distributed. Texts move once: where clusters have at most ``BROADCAST_NODES`` rows only their texts,
else those of the whole table meet the clusters by a shuffle.

Null text is the empty text. A null doc_id takes no part: component null, kept. Rows of equal doc_id that hold words are one
node, so different texts of one id are linked; a row without words keeps its own id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLACE, WordTable, materialise, mix, partitions, release
from .graph import components

SAMPLES, SKETCH_BITS, MISS = 128, 1024, 1e-6
#: Buckets up to this size are compared by a join, larger ones inside tasks.
SMALL_BUCKET = 6
#: Documents of a bucket's block, and shingles of a cluster's block: two blocks fit in a task.
BUCKET_BLOCK, CLUSTER_BLOCK = 4096, 1_500_000
#: Node ids that may be broadcast to pick their texts; beyond that the texts are joined by a shuffle.
BROADCAST_NODES = 1_000_000

_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_SALT = _rng.integers(1, 1 << 62, SAMPLES, dtype=np.uint64)


def band_plan(threshold: float) -> tuple[int, int]:
    """Rows and number of bands: the most rows whose chance to miss a pair at the threshold is at most MISS."""
    for rows in range(16, 0, -1):
        bands = SAMPLES // rows
        if (1 - threshold**rows) ** bands <= MISS:
            return rows, bands
    return 1, SAMPLES


def sketch_limit(threshold: float) -> int:
    """The largest XOR population count that a pair at the threshold plausibly has (six standard deviations)."""
    differ = SAMPLES * (1 - threshold) + 6 * math.sqrt(SAMPLES * threshold * (1 - threshold))
    flips = 2 * min(SAMPLES, differ)
    expected = SKETCH_BITS / 2 * (1 - math.exp(-2 * flips / SKETCH_BITS))
    return math.ceil(expected + 6 * math.sqrt(expected * (1 - expected / SKETCH_BITS) / 2) + 1)


def lowered(text: bytes | None) -> bytes:
    return b" ".join(text.lower().split()) if text else b""  # bytes.lower() changes A-Z alone


def shingles(table: WordTable, words: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes text by text, and where each text's begin (one more at the end)."""
    hashes, whole = table.windows(words)
    at = np.flatnonzero(whole)
    out, doc = hashes[at], table.doc[at]
    count = np.diff(table.base)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            has = count[short] > k
            extra[has] += table.hash[table.base[short[has]] + k] * PLACE[100 + k]
        order = np.argsort(np.concatenate([doc, short]), kind="stable")
        out, doc = np.concatenate([out, mix(extra)])[order], np.concatenate([doc, short])[order]
    return out, np.searchsorted(doc, np.arange(texts + 1))


def signatures(hashes: np.ndarray, base: np.ndarray, rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and odd sketches (texts x words of 64 bits); texts without shingles get zeros."""
    n = len(base) - 1
    full = np.flatnonzero(np.diff(base) > 0)
    keys, sketch = np.zeros((n, bands), np.int64), np.zeros((n, SKETCH_BITS // 64), np.int64)
    if not len(full):
        return keys, sketch
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.empty((len(full), SAMPLES), np.uint64)
    room = np.empty_like(x)
    for i in range(SAMPLES):
        np.multiply(x, _A[i], out=room)
        np.add(room, _B[i], out=room)
        least[:, i] = np.minimum.reduceat(room, base[full])
    for b in range(bands):
        h = np.full(len(full), b + 1, np.uint64)
        for r in range(rows):
            h += least[:, b * rows + r] * PLACE[r]
            h = mix(h)
        keys[full, b] = h.view(np.int64)
    bit = mix(least + _SALT) % np.uint64(SKETCH_BITS)
    flips = np.bincount((np.arange(len(full))[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel(), minlength=len(full) * SKETCH_BITS)
    sketch[full] = np.packbits((flips & 1).astype(np.uint8).reshape(len(full), -1), axis=1).view(np.int64)
    return keys, sketch


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def _slices(sizes: list[int], room: int = 1 << 20, most: int = 2000):
    i = 0
    while i < len(sizes):
        j, held = i, 0
        while j < len(sizes) and j - i < most and (j == i or held + sizes[j] <= room):
            held += sizes[j]
            j += 1
        yield i, j
        i = j


def _sign(words: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            sizes = [len(x) if x is not None else 0 for x in (v.as_buffer() for v in raw)]
            for i, j in _slices(sizes):
                texts = [lowered(x) for x in raw.slice(i, j - i).to_pylist()]
                table = WordTable(texts)
                hashes, base = shingles(table, words, len(texts))
                sets = [np.sort(hashes[a:b]) for a, b in zip(base[:-1], base[1:])]
                sizes_ = [int(np.count_nonzero(s[1:] != s[:-1])) + 1 if len(s) else 0 for s in sets]
                keys, sketch = signatures(hashes, base, rows, bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()), pa.array(sizes_, pa.int64()), _lists(keys), _lists(sketch)],
                    names=["doc_id", "same", "n_shingles", "bands", "sketch"],
                )
        release()

    return run


def _unite(label: np.ndarray, near: np.ndarray, x: int) -> list[int]:
    """Join x's label with those of the near ones; one of each label that was joined."""
    labels, first = np.unique(label[near], return_index=True)
    joined = [int(near[f]) for lab, f in zip(labels.tolist(), first.tolist()) if lab != label[x]]
    if joined:
        label[np.isin(label, labels)] = label[x]
    return joined


def _outside(label: np.ndarray) -> list[int]:
    """All but the largest label's members: who is compared with everyone, so that every pair of labels is covered."""
    labels, size = np.unique(label, return_counts=True)
    return np.flatnonzero(label != labels[np.argmax(size)]).tolist()


def _tie(limit: int):
    """Edges between the parts of a bucket (or of two of its blocks) by sketches."""

    def run(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        _, label = np.unique(rows.column("part").to_numpy(), return_inverse=True)
        sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        edges = []
        for x in _outside(label):
            others = np.flatnonzero(label != label[x])
            far = np.bitwise_count(sketch[others] ^ sketch[x]).sum(axis=1)
            edges += [(int(node[x]), int(node[y])) for y in _unite(label, others[far <= limit], x)]
        return _edges(edges)

    return run


def _edges(edges: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*edges) if edges else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def linked(sets: list[np.ndarray], level: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (10,000 x intersection >= level x union) among sets of hashes, exactly."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if both and 10_000 * both >= level * (size.sum() - both) else []
    doc = np.repeat(np.arange(n), size)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    alive = size > 0
    while True:
        # two sets x, y at the threshold share at least level / (10,000 + level) x (|x| + |y|), and |y| is no less than that share of |x|
        live = alive[doc]
        often = np.bincount(token[live], minlength=int(token.max()) + 1) > 1
        shared = np.bincount(doc[live], weights=often[token[live]], minlength=n)
        smallest = size[alive].min() if alive.any() else 0
        least = level * (size + np.maximum(np.ceil(level * size / 10_000), smallest)) / (10_000 + level)
        keep = alive & (shared >= least - 1e-6)
        if keep.sum() == alive.sum():
            break
        alive = keep
    use = alive[doc] & often[token]
    doc, token = doc[use], token[use]
    order = np.argsort(token, kind="stable")
    holders = doc[order]
    start = np.searchsorted(token[order], np.arange(int(token.max()) + 2)) if len(token) else np.zeros(1, np.int64)
    base = np.searchsorted(doc, np.arange(n + 1))
    label, edges, done = np.arange(n), [], set()

    def compare(x: int) -> None:
        mine = token[base[x] : base[x + 1]]
        count = start[mine + 1] - start[mine]
        if not len(count):
            return
        at = np.repeat(start[mine] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        both = np.bincount(holders[at], minlength=n)
        near = np.flatnonzero((both > 0) & (10_000 * both >= level * (size[x] + size - both)))
        edges.extend((x, y) for y in _unite(label, near[near != x], x))
        done.add(x)

    members = np.flatnonzero(alive)
    if len(members):
        # the set that shares most comes first: it ties most of the others together
        compare(int(members[np.argmax((shared / np.maximum(size, 1))[members])]))
    while len(members):
        rest = [members[i] for i in _outside(label[members]) if int(members[i]) not in done]
        if not rest:
            break
        # all of these must be compared, but joining may make many of them part of the largest
        for x in rest[: max(8, len(rest) // 4)]:
            compare(int(x))
    return edges


def _confirm(words: int, threshold: float):
    """A spanning forest of the confirmed links in each cluster of a group."""
    level = round(threshold * 10_000)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cluster")
        cluster, node = rows.column("cluster").to_numpy(), rows.column("node").to_numpy()
        raw = rows.column("text").cast(pa.binary()).combine_chunks()
        sets: list[np.ndarray] = []
        for i, j in _slices([len(x.as_buffer()) for x in raw]):
            texts = [lowered(x) for x in raw.slice(i, j - i).to_pylist()]
            hashes, base = shingles(WordTable(texts), words, len(texts))
            sets += [np.unique(hashes[a:b]) for a, b in zip(base[:-1], base[1:])]
        cuts = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1], True]).tolist()
        edges = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            edges += [(int(node[i + a]), int(node[i + b])) for a, b in linked(sets[i:j], level)]
        return _edges(edges)

    return run


def _tiles(block: Column, blocks: Column) -> Column:
    """The pairs of blocks that a block's rows go to: with one block itself, else every pair that it is in."""
    with_each = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(block, k).alias("i"), F.greatest(block, k).alias("j")))
    return F.when(blocks == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.filter(with_each, lambda t: t["i"] < t["j"]))


def _near(pairs: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The distinct pairs whose sketches allow the threshold."""
    own = nodes.select("node", "sketch")
    far = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    a, b = (own.select(F.col("node").alias(k), F.col("sketch").alias(f"s{k}")) for k in "ab")
    return pairs.distinct().join(a, "a").join(b, "b").where(far <= limit).select("a", "b").distinct()


def _clusters(nodes: DataFrame, threshold: float) -> DataFrame:
    """node and component of the graph of candidates."""
    limit = sketch_limit(threshold)
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("bucket", "pivot")
    members = materialise(placed.join(shared, "bucket").distinct(), "members")
    stars = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    near = materialise(_near(stars, nodes, limit), "near")
    parts = components(near)
    known = members.join(parts, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
    spread = known.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "n")
    live = materialise(known.join(spread, "bucket"), "live")
    small = live.where(F.col("n") <= SMALL_BUCKET)
    other = small.select("bucket", F.col("node").alias("b"), F.col("part").alias("other"))
    few = _near(small.join(other, "bucket").where("node < b and part <> other").select(F.col("node").alias("a"), "b"), nodes, limit)
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    dealt = live.where(F.col("n") > SMALL_BUCKET).withColumn("tile", F.explode(_tiles(F.pmod(F.xxhash64("node"), blocks).cast("int"), blocks)))
    many = dealt.join(nodes.select("node", "sketch"), "node").groupBy("bucket", "tile").applyInArrow(_tie(limit), "a long, b long")
    return components(materialise(near.unionByName(few).unionByName(many).distinct(), "candidates"))


def _links(texts: DataFrame, nodes: DataFrame, clusters: DataFrame, words: int, threshold: float) -> DataFrame:
    """A spanning forest (a, b) of the confirmed links. texts: doc_id and text."""
    groups = partitions(texts.sparkSession) * 8
    sized = clusters.join(nodes.select("node", "n_shingles"), "node").groupBy("component").agg(F.sum("n_shingles").alias("n"))
    blocks = F.ceil(F.col("n") / CLUSTER_BLOCK).cast("int")
    # clusters of one block share groups; a larger one has groups of its own
    group = F.when(blocks == 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(-1 - F.col("component"))
    dealt = clusters.join(sized, "component").select(
        "node", F.col("component").alias("cluster"), group.alias("pack"), F.explode(_tiles(F.pmod(F.xxhash64("node"), blocks).cast("int"), blocks)).alias("tile")
    )
    dealt = materialise(dealt, "dealt")
    if dealt.count() <= BROADCAST_NODES:
        dealt = F.broadcast(dealt)
    rows = texts.join(dealt, texts["doc_id"] == dealt["node"]).select("pack", "tile", "cluster", "node", "text")
    return rows.groupBy("pack", "tile").applyInArrow(_confirm(words, threshold), "a long, b long")


def classes(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row per input row."""
    rows, bands = band_plan(threshold)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = materialise(
        texts.mapInArrow(_sign(words, rows, bands), "doc_id long, same binary, n_shingles long, bands array<long>, sketch array<long>"), "signatures"
    )
    filled = signed.where("doc_id is not null and n_shingles > 0")
    # written first: the joins below then meet plain shuffles, which may be split where many copies share a key
    same = materialise(filled.groupBy("same").agg(F.min("doc_id").alias("node")), "same")
    nodes = filled.join(same, (filled["same"] == same["same"]) & (filled["doc_id"] == same["node"]), "left_semi").select(
        F.col("doc_id").alias("node"), "bands", "sketch", "n_shingles"
    )
    clusters = _clusters(nodes, threshold)
    links = _links(texts.where("doc_id is not null"), nodes, clusters, words, threshold)
    keyed = signed.select("doc_id", "same", "n_shingles").join(same.withColumnRenamed("node", "first"), "same", "left")
    keyed = materialise(keyed.select("doc_id", "n_shingles", "first"), "keyed")
    # an id with several texts ties their classes together
    own = keyed.where("doc_id is not null and first is not null")
    low = own.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("last")).where("a < last").select("doc_id", "a")
    ties = own.join(low, "doc_id").where("first <> a").select("a", F.col("first").alias("b"))
    parts = components(materialise(links.unionByName(ties), "links"))
    found = keyed.join(parts.withColumnRenamed("node", "first"), "first", "left")
    component = F.when(F.col("n_shingles") > 0, F.least(F.coalesce("component", "first"), "doc_id")).otherwise(F.col("doc_id"))
    out = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def keep_first(docs: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, less those that are near copies of one with a smaller id.

    Rows of equal id go or stay together.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, inner))
    gone = classes(docs, words, threshold, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    gone = materialise(gone, "gone")
    if gone.count() <= BROADCAST_NODES:
        gone = F.broadcast(gone)
    rows = docs.toDF(*inner)
    return rows.join(gone, rows[at[id_col]].cast("long") == gone["gone"], "left_anti").select(*(F.col(a).alias(b) for a, b in zip(inner, names)))
