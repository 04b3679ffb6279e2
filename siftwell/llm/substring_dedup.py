"""Substring dedup by super-k-mers.

A window is ``window`` consecutive words of one text. Windows are dealt out by a minimiser (the
smallest hash among their runs of ``minimiser`` words), which depends on the window's words alone, so
equal windows always meet. Consecutive windows of one text with the same minimiser travel as one
packed string. In each bucket sorting groups equal windows exactly (hash order, then bytes), and each
group's smallest doc_id goes back to the documents that hold a later copy.

Runs of words so common that their bucket would be several times the average come last as minimisers, so that a window's bucket is named by
its rarer runs; a window of common runs alone is a super-k-mer of its own and its bucket depends on the whole window. Which runs are common
is estimated on about ``SAMPLE`` documents, as a range partitioning is: it is known before any window is dealt out, holds for all of them and so
never changes the result.

Documents are handled in chunks of neighbouring ids. A packed string goes out once for a chunk (with
the chunk's smallest and largest doc_id for it), so a passage in very many documents makes few rows
in its bucket, and what comes back goes to chunks, never to one task.

Null text: no words. Null doc_id: the row takes no part and keeps all its words. Repeated rows of one
doc_id are judged alike (neither is smaller) and meet in one task. Fewer than ``window`` words: nothing is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACE, WordTable, joined, mix, partitions, sliding_min, window_classes

#: Documents of neighbouring ids, 2 to this power, that share a chunk.
CHUNK_BITS = 8
#: Buckets for each shuffle partition.
BUCKETS_EACH = 8
#: Packed bytes held in a task before they are sent on.
FLUSH_BYTES = 24 << 20
#: Documents on which common runs of words are estimated, and a run's share of all runs, in buckets' average shares, from which it is common.
SAMPLE, COMMON = 20_000, 4
_LATE = np.uint64(1 << 63)

_PACKED = "bucket int, n int, strings binary, facts binary"
_FACTS = np.dtype([("chunk", "i8"), ("doc", "i8"), ("tag", "i8"), ("word", "i4"), ("last", "i8")])
_FOUND = np.dtype([("doc", "i8"), ("tag", "i8"), ("word", "i4"), ("n", "i4"), ("first", "i8")])


def _runs(table: WordTable, size: int) -> np.ndarray:
    """A hash below 2^63 for each run of ``size`` words."""
    return table.windows(size)[0] >> np.uint64(1)


def _super_kmers(table: WordTable, window: int, minimiser: int, buckets: int, common: np.ndarray):
    """First and last window of each super-k-mer, and its bucket. common: sorted hashes of runs that come last."""
    n = len(table) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    grams = _runs(table, minimiser)
    if len(common):
        grams[common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams] |= _LATE
    least = sliding_min(grams, window - minimiser + 1)[:n]
    alone = np.flatnonzero(least >= _LATE)
    if len(alone):
        own = np.zeros(len(alone), np.uint64)
        for k in range(window):
            own += table.hash[alone + k] * PLACE[k]
        least[alone] = mix(own) | _LATE
    whole = table.doc[:n] == table.doc[window - 1 :]
    start = whole.copy()
    start[1:] &= (least[1:] != least[:-1]) | (table.doc[1:n] != table.doc[: n - 1])
    first = np.flatnonzero(start)
    ends = whole.copy()
    ends[:-1] &= start[1:] | ~whole[1:]
    return first, np.flatnonzero(ends), (mix(least[first]) % np.uint64(buckets)).astype(np.int64)


def _pack(window: int, minimiser: int, buckets: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=3)
        held: dict[tuple[int, bytes], list] = {}

        def flush():
            by: dict[int, tuple[list, list]] = {}
            for (chunk, string), (bucket, doc, tag, word, last) in held.items():
                strings, facts = by.setdefault(bucket, ([], []))
                strings.append(string)
                facts.append((chunk, doc, tag, word, last))
            held.clear()
            rows = [
                (b, len(s), zstd.compress(b"\n".join(s)), zstd.compress(np.array(f, _FACTS).tobytes()))
                for b, (s, f) in by.items()
            ]
            for i in range(0, len(rows), 64):
                b, n, s, f = zip(*rows[i : i + 64])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b, pa.int32()), pa.array(n, pa.int32()), pa.array(s, pa.binary()), pa.array(f, pa.binary())],
                    names=["bucket", "n", "strings", "facts"],
                )

        size = 0
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            i = 0
            while i < len(ids):
                part, room, j = [], 0, i
                while j < len(ids) and room < (1 << 20):
                    part.append(joined(texts[j].as_py()))
                    room += len(part[-1])
                    j += 1
                table = WordTable(part)
                first, last, bucket = _super_kmers(table, window, minimiser, buckets, common.value)
                a, b = table.start[first].tolist(), table.end[last + window - 1].tolist()
                docs = table.doc[first] if len(first) else first
                words = (first - table.base[docs]).tolist() if len(first) else []
                buf = table.buf
                for s, e, k, d, w in zip(a, b, bucket.tolist(), docs.tolist(), words):
                    doc, key = ids[i + d], (ids[i + d] >> CHUNK_BITS, buf[s:e])
                    had = held.get(key)
                    if had is None:
                        held[key] = [k, doc, tags[i + d], w, doc]
                        size += e - s + 64
                    else:
                        if doc < had[1]:
                            had[1:4] = doc, tags[i + d], w
                        if doc > had[4]:
                            had[4] = doc
                i = j
                if size > FLUSH_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _count_runs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for i in range(0, len(texts), 500):
                table = WordTable([joined(t) for t in texts.slice(i, 500).to_pylist()])
                runs, n = np.unique(_runs(table, size)[table.windows(size)[1]], return_counts=True)
                often = n > 1  # a run that is common occurs again among 500 texts
                yield pa.RecordBatch.from_arrays([pa.array(runs[often].view(np.int64)), pa.array(n[often]), pa.array(np.where(np.arange(often.sum()) == 0, n.sum(), 0))], names=["run", "n", "all"])

    return run


def common_runs(rows: DataFrame, minimiser: int, buckets: int) -> np.ndarray:
    """Sorted hashes of the common runs; at most a quarter as many as there are buckets, by their definition. rows: doc_id and text."""
    total = rows.count()
    sampled = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // SAMPLE))) == 0).select("text")
    counts = sampled.mapInArrow(_count_runs(minimiser), "run long, n long, all long")
    whole = counts.agg(F.sum("all").alias("n")).first()["n"] or 0
    often = counts.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > max(7.0, COMMON * whole / buckets))
    return np.sort(np.array([r["run"] for r in often.select("run").collect()], np.int64).view(np.uint64))


def _meet(window: int):
    """Equal windows of a bucket, exactly; for each chunk, the runs of windows that some smaller document has."""

    def run(rows: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        strings: list[bytes] = []
        facts = []
        for s, f in zip(rows.column("strings").to_pylist(), rows.column("facts").to_pylist()):
            strings += unzip.decompress(s).split(b"\n")
            facts.append(np.frombuffer(unzip.decompress(f), _FACTS))
        fact = np.concatenate(facts)
        table = WordTable(strings)
        hashes, whole = table.windows(window)
        at = np.flatnonzero(whole)
        owner = table.doc[at]
        classes = window_classes(table, at, window, hashes)
        first = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, classes, fact["doc"][owner])
        first = first[classes]
        hit = np.flatnonzero(first < fact["last"][owner])
        out: dict[int, bytes] = {}
        if len(hit):
            own, word, low = owner[hit], (at - table.base[owner])[hit], first[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (own[1:] != own[:-1]) | (word[1:] != word[:-1] + 1) | (low[1:] != low[:-1])
            begin = np.flatnonzero(new)
            runs = np.empty(len(begin), _FOUND)
            src = fact[own[begin]]
            runs["doc"], runs["tag"], runs["word"] = src["doc"], src["tag"], src["word"] + word[begin]
            runs["n"] = np.diff(np.append(begin, len(hit)))
            runs["first"] = low[begin]
            order = np.argsort(src["chunk"], kind="stable")
            chunks, cuts = np.unique(src["chunk"][order], return_index=True)
            zstd = zstandard.ZstdCompressor(level=3)
            for chunk, part in zip(chunks.tolist(), np.split(runs[order], cuts[1:])):
                out[chunk] = zstd.compress(part.tobytes())
        return pa.table({"chunk": pa.array(out.keys(), pa.int64()), "found": pa.array(out.values(), pa.binary())})

    return run


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a chunk as one compressed string, words joined by one space: what moves is small."""
    zstd = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        by: dict[int, list] = {}
        for chunk, i in zip(batch.column("chunk").to_pylist(), range(batch.num_rows)):
            by.setdefault(chunk, []).append(i)
        for chunk, at in by.items():
            rows = batch.take(pa.array(at))
            texts = [joined(t) for t in rows.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int64()), pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([rows.column("tag").to_pylist()], pa.list_(pa.int64())), pa.array([zstd.compress(b"\n".join(texts))], pa.binary()),
                ],
                names=["chunk", "ids", "tags", "texts"],
            )


def _apply(window: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        ids = [i for row in docs.column("ids").to_pylist() for i in row]
        tags = [i for row in docs.column("tags").to_pylist() for i in row]
        texts = [t for blob in docs.column("texts").to_pylist() for t in unzip.decompress(blob).split(b"\n")]
        parts = [np.frombuffer(unzip.decompress(x), _FOUND) for x in found.column("found").to_pylist()]
        removed: np.ndarray | None = None
        table = None
        if parts and texts:
            runs = np.concatenate(parts)
            table = WordTable(texts)
            hashes, whole = table.windows(window)
            at = np.flatnonzero(whole)
            classes = window_classes(table, at, window, hashes)
            place = np.full(len(table), -1, np.int64)
            place[at] = classes
            row = {key: i for i, key in enumerate(zip(ids, tags))}
            base = np.array([table.base[row[k]] for k in zip(runs["doc"].tolist(), runs["tag"].tolist())], np.int64)
            n = runs["n"].astype(np.int64)
            starts = np.repeat(base + runs["word"] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            first = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, place[starts], np.repeat(runs["first"], n))
            own = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)[table.doc[at]]
            gone = at[first[classes] < own]
            cover = np.zeros(len(table) + 1, np.int64)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + window, -1)
            removed = np.cumsum(cover)[:-1] > 0
        words, cut, kept = [], [], []
        for i, text in enumerate(texts):
            n, n_cut, rest = text.count(b" ") + 1 if text else 0, 0, text
            if removed is not None:
                mine = removed[table.base[i] : table.base[i + 1]]
                n_cut = int(mine.sum())
                if n_cut:
                    rest = b" ".join(compress(text.split(b" "), (~mine).tolist()))
            words.append(n)
            cut.append(n_cut)
            kept.append(rest)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()),
            "n_removed": pa.array(cut, pa.int64()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return run


def remove_repeats(docs: DataFrame, window: int = 13, minimiser: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window that a document with a smaller id also has.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space), a row per input row.
    An empty table gives an empty result.
    """
    if not 1 <= minimiser <= window <= len(PLACE):
        raise ValueError("1 <= minimiser <= window is needed")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    full, buckets = rows.where("doc_id is not null and text is not null"), BUCKETS_EACH * partitions(spark)
    common = spark.sparkContext.broadcast(common_runs(full.select("doc_id", "text"), minimiser, buckets))
    packed = full.mapInArrow(_pack(window, minimiser, buckets, common), _PACKED)
    found = packed.groupBy("bucket").applyInArrow(_meet(window), "chunk long, found binary")
    # rows without an id take no part and are spread over chunks of their own
    by_chunk = rows.withColumn("chunk", F.coalesce(F.shiftright("doc_id", CHUNK_BITS), -(F.lit(1 << 60) + F.monotonically_increasing_id() % (1 << 20))))
    bundles = by_chunk.mapInArrow(_bundle, "chunk long, ids array<long>, tags array<long>, texts binary")
    return bundles.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        _apply(window), "doc_id long, n_words long, n_removed long, kept_text string"
    )


def digest(kept: DataFrame) -> DataFrame:
    """The kept texts as SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
