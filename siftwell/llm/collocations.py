"""Phrase collocations from an FM-index per shard.

Each task gathers texts of a language into shards and indexes a shard's words: the order of its suffixes by their first
``depth`` words (that is all that patterns of up to ``depth`` words need), and the Burrows-Wheeler transform of the word ids
in both directions. A phrase is an interval in either; extending an interval to the left reads the forward transform,
to the right the backward one, and keeps both in step. All intervals of a length are extended at once by every word that
occurs there, which enumerates the shard's phrases with their counts.

Counts are summed across shards in two steps, since most phrases are rare. First each shard sends, for every phrase, some
bits of its hash and its count (cut off at ``min_count``); hashes whose sum stays below ``min_count`` are struck out: no
phrase behind them can reach it. Then the shards, whose transforms were written, enumerate again and send the text and
count of what is left, and these exact counts are summed by text. All else is joins over the frequent phrases.

Pieces end at ``.,;:!?`` and ``\\x0A-\\x0D``, words at space and tab; A-Z is lower-cased. No phrase crosses a piece.
A text longer than a shard is cut at pieces; a piece longer than a shard is cut with ``depth - 1`` words of overlap, and
what lies within an overlap is counted once less. Defined results: a null text is empty, a null language is ``und``,
repeated rows count each, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import PLACE, forget, materialise, mix, partitions, release

#: Bytes of text in a shard (its index takes some ten times that while it is built).
SHARD_BYTES = 8 << 20
#: Bits of a phrase's hash that are sent; phrases that share them are told apart by text afterwards.
HASH_BYTES = 4
#: Parts per language into which the best phrases are split before they meet.
TOP_PARTS = 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_BOUNDARIES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


class Words:
    """Word ids of a text: 0 is the boundary of pieces, others are places in ``names``."""

    def __init__(self, buf: bytes):
        """buf: lower-cased, pieces divided by newlines and words by spaces."""
        buf = b" " + buf.replace(b"\n", b" \n ") + b" \n "
        ends = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32).astype(np.int64) + 1
        # each item is a word and the space behind it, side by side in the buffer
        items = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(buf)])
        coded = items.dictionary_encode()
        found = coded.dictionary.to_pylist()
        code = np.full(len(found), -1, np.int64)
        full = [i for i, w in enumerate(found) if len(w) > 1 and w != b"\n "]
        code[full] = np.arange(1, len(full) + 1)
        code[found.index(b"\n ")] = 0
        ids = code[coded.indices.to_numpy()]
        ids = ids[ids >= 0]
        # one boundary between pieces, one at the start and one at the end
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == 0) & (ids[:-1] == 0)
        self.ids = np.r_[0, ids[~again]] if len(ids) and ids[0] else ids[~again]
        self.names = [b"", *(found[i][:-1] for i in full)]


def _order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` words (cyclic; ties by place): a radix sort, last word first."""
    order = np.argsort(ids, kind="stable")
    for _ in range(depth - 1):
        before = np.where(order == 0, len(ids) - 1, order - 1)  # the suffix one word longer to the left
        order = before[np.argsort(ids[before], kind="stable")]
    return order


class Index:
    """Both transforms of a shard's words, with intervals of phrases in each."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray):
        self.columns = forward, backward
        self.size = len(forward)
        counts = np.bincount(forward, minlength=1) if len(forward) else np.zeros(1, np.int64)
        self.first = np.r_[0, np.cumsum(counts)]  # by word: where its suffixes begin
        self.jump = [self._jumps(c) for c in self.columns]

    @classmethod
    def of(cls, ids: np.ndarray, depth: int) -> Index:
        forward = ids[_order(ids, depth) - 1]
        turned = ids[::-1]
        return cls(forward, turned[_order(turned, depth) - 1])

    @staticmethod
    def _jumps(column: np.ndarray) -> np.ndarray:
        """Where the suffix that begins one word further left stands (C[c] + Occ(c, i))."""
        out = np.empty(len(column), np.int64)
        out[np.argsort(column, kind="stable")] = np.arange(len(column))
        return out

    def words(self) -> Intervals:
        start, size = self.first[1:-1], np.diff(self.first)[1:]
        return Intervals(np.arange(1, len(self.first) - 1, dtype=np.int32)[:, None], start, start, size)

    def extend(self, phrases: Intervals, left: bool) -> Intervals:
        """Every phrase with one more word before it (or behind it), and its count."""
        column, jump = self.columns[not left], self.jump[not left]
        starts, others = (phrases.forward, phrases.backward) if left else (phrases.backward, phrases.forward)
        of = np.repeat(np.arange(len(starts)), phrases.count)
        within = np.arange(len(of)) - np.repeat(np.cumsum(phrases.count) - phrases.count, phrases.count)
        at = starts[of] + within
        key = of * np.int64(len(self.first)) + column[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        parent, word = key[new] // len(self.first), key[new] % len(self.first)
        start = jump[at[order[new]]]  # of the first row that has this word
        # smaller words (and boundaries) come first in the other direction's interval
        other = others[parent] + new - (np.cumsum(phrases.count) - phrases.count)[parent]
        real = word > 0
        parent, word, start, other, count = parent[real], word[real].astype(phrases.words.dtype), start[real], other[real], count[real]
        known = phrases.words[parent]
        return Intervals(np.c_[word, known], start, other, count) if left else Intervals(np.c_[known, word], other, start, count)

    def phrases(self, depth: int) -> Iterator[Intervals]:
        """Phrases of 1 to ``depth`` words, extended behind and before in turn."""
        found = self.words()
        yield found
        for n in range(1, depth):
            found = self.extend(found, left=n % 2 == 0)
            yield found


class Intervals:
    """Phrases of one length: their words, where they begin in the forward and backward order, and how often they occur."""

    def __init__(self, words, forward, backward, count):
        self.words, self.forward, self.backward, self.count = words, forward, backward, count

    def __len__(self) -> int:
        return len(self.count)


def _segments(text: str | None, size: int, depth: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a text of about ``size`` bytes, each with the weight its phrases have."""
    buf = (text or "").encode("utf-8", "replace").lower().translate(_BOUNDARIES)
    first = lead = 0  # lead: bytes at the start of a part that the one before had as well
    while len(buf) - first > size:
        last = buf.rfind(b"\n", first + lead, first + size)
        if last <= first:  # one piece fills it: cut between words, and begin again depth - 1 words before
            last = buf.rfind(b" ", first + lead + 1, first + size)
            if last < 0:
                last = min((x for x in (buf.find(c, first + max(size, lead + 1)) for c in (b" ", b"\n")) if x >= 0), default=len(buf))
        yield buf[first:last], 1
        again = b" ".join(buf[first:last].rsplit(b"\n", 1)[-1].split()[1 - depth :]) if depth > 1 else b""
        if again and last < len(buf) and buf[last : last + 1] == b" ":
            yield again, -1
            # the words of the overlap lead the next part
            buf, first, lead = again + buf[last:], 0, len(again)
        else:
            first, lead = last, 0
    yield buf[first:], 1


def _flush(parts: dict[tuple[str, int], list[bytes]], depth: int) -> Iterator[tuple[str, int, Words, Index]]:
    for (lang, weight), texts in parts.items():
        words = Words(b"\n".join(texts))
        if len(words.names) > 1:
            yield lang, weight, words, Index.of(words.ids, depth)


def _shards(depth: int, size: int):
    """Rows of documents to written shards: lang, weight, names, both transforms."""

    def rows(parts):
        for lang, weight, words, index in _flush(parts, depth):
            pack = lambda x: pa.compress(x.astype("<u4").tobytes(), "zstd", asbytes=True)
            names = b" ".join(words.names[1:])
            # names hold no space, so one space parts them
            yield {"lang": lang, "weight": weight, "n": index.size, "names_bytes": len(names), "names": pa.compress(names, "zstd", asbytes=True), "forward": pack(index.columns[0]), "backward": pack(index.columns[1])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = {}, 0
        for batch in batches:
            for i in range(batch.num_rows):
                lang = batch.column(0)[i].as_py()
                for part, weight in _segments(batch.column(1)[i].as_py(), size, depth):
                    parts.setdefault((lang, weight), []).append(part)
                    held += len(part) + 1
                    if held >= size:
                        yield from (pa.RecordBatch.from_pylist([r], _SHARD) for r in rows(parts))
                        parts, held = {}, 0
                        release()
        yield from (pa.RecordBatch.from_pylist([r], _SHARD) for r in rows(parts))
        release()

    return run


_SHARD = pa.schema([("lang", pa.string()), ("weight", pa.int64()), ("n", pa.int64()), ("names_bytes", pa.int64()), ("names", pa.binary()), ("forward", pa.binary()), ("backward", pa.binary())])


def _opened(row: dict) -> tuple[list[bytes], Index]:
    names = pa.decompress(row["names"], row["names_bytes"], "zstd", asbytes=True).split(b" ")
    forward, backward = (np.frombuffer(pa.decompress(row[c], 4 * row["n"], "zstd"), "<u4").astype(np.int64) for c in ("forward", "backward"))
    return [b"", *names], Index(forward, backward)


def _hashes(lang: str, names: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "replace"))
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in names], np.uint64)


def _keys(of_words: np.ndarray, phrases: Intervals) -> np.ndarray:
    h = np.full(len(phrases), phrases.words.shape[1], np.uint64)
    for k in range(phrases.words.shape[1]):
        h += of_words[phrases.words[:, k]] * PLACE[k]
    return mix(h)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys bucket by bucket, and where each bucket begins."""
    bucket = (keys * _SPREAD >> np.uint64(32)).astype(np.int64) * buckets >> 32  # depends on all bits, not on those that are sent alone
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_SENT = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _sent(depth: int, buckets: int, most: int):
    """Written shards to the hashes and counts of all their phrases, by bucket of the hash."""
    kind = np.uint8 if most < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, index = _opened(row)
                of_words = _hashes(row["lang"], names)
                found = [(_keys(of_words, p), np.minimum(p.count, most).astype(kind)) for p in index.phrases(depth)]
                keys, counts = (np.concatenate(x) for x in zip(*found))
                order, starts = _by_bucket(keys, buckets)
                hashes = keys[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
                counts = counts[order].tobytes()
                full = np.flatnonzero(np.diff(starts)).tolist()
                a, b = starts[full].tolist(), starts[np.array(full) + 1].tolist()
                width = np.dtype(kind).itemsize
                yield pa.RecordBatch.from_arrays([
                    pa.array(full, pa.int64()), pa.array([row["shard"]] * len(full), pa.int64()), pa.array([hashes[HASH_BYTES * i : HASH_BYTES * j] for i, j in zip(a, b)], pa.binary()),
                    pa.array([counts[width * i : width * j] for i, j in zip(a, b)], pa.binary()),
                ], schema=_SENT)
                del names, index, of_words, found, keys, counts, order, hashes
                release()

    return run


def _struck(most: int):
    """One bucket's hashes of all shards: which of them reach ``most`` together, a bit each, by shard."""
    kind = np.uint8 if most < 256 else np.uint32

    def run(rows: pa.Table) -> pa.Table:
        shards, blobs = rows.column("shard").to_pylist(), rows.column("hashes").to_pylist()
        sizes = [len(b) // HASH_BYTES for b in blobs]
        raw = np.zeros((sum(sizes), 8), np.uint8)
        raw[:, :HASH_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, HASH_BYTES)
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), kind)
        _, of = np.unique(raw.view("<u8").ravel(), return_inverse=True)
        frequent = np.bincount(of, counts) >= most
        kept = frequent[of]
        bits = [np.packbits(part).tobytes() for part in np.split(kept, np.cumsum(sizes)[:-1])]
        return pa.table({"bucket": rows.column("bucket"), "shard": pa.array(shards, pa.int64()), "bits": pa.array(bits, pa.binary())})

    return run


_PHRASES = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def _texts(depth: int, buckets: int):
    """A written shard and its bits: text and count of each phrase that is left."""

    def run(shard: pa.Table, bits: pa.Table) -> pa.Table:
        out = []
        if shard.num_rows and bits.num_rows:
            row = shard.to_pylist()[0]
            names, index = _opened(row)
            of_words = _hashes(row["lang"], names)
            found = list(index.phrases(depth))
            index = None  # what is extended no more need not stay
            order, starts = _by_bucket(np.concatenate([_keys(of_words, p) for p in found]), buckets)
            kept = np.zeros(len(order), bool)
            for bucket, packed in zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist()):
                a, b = int(starts[bucket]), int(starts[bucket + 1])
                kept[order[a:b]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a).astype(bool)
            spelled = np.array([n.decode("utf-8", "replace") for n in names], object)
            base = 0
            for p in found:
                own = np.flatnonzero(kept[base : base + len(p)])
                base += len(p)
                text = spelled[p.words[own, 0]]
                for k in range(1, p.words.shape[1]):
                    text = text + " " + spelled[p.words[own, k]]
                n = len(own)
                out.append(pa.table([pa.array([row["lang"]] * n, pa.string()), pa.array([p.words.shape[1]] * n, pa.int32()), pa.array(text, pa.string()), pa.array(p.count[own] * row["weight"], pa.int64())], schema=_PHRASES))
            del names, index, of_words, found, order, kept, spelled
            release()
        return pa.concat_tables(out) if out else _PHRASES.empty_table()

    return run


def frequent(docs: DataFrame, min_count: int, depth: int, lang: Column | str = "lang", text_col: str = "text", size: int = 0) -> tuple[DataFrame, DataFrame]:
    """Written tables: (lang, size, phrase, f) of every phrase of 1 to ``depth`` words with f >= ``min_count``, and (lang, n) of all words.

    Shards of weight -1 hold what overlaps counted twice; their counts are taken off, so they are never part of the first sum.
    """
    spark = docs.sparkSession
    lang = F.col(lang) if isinstance(lang, str) else lang
    rows = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = "lang string, weight long, n long, names_bytes long, names binary, forward binary, backward binary"
    shards = materialise(rows.mapInArrow(_shards(depth, size or SHARD_BYTES), schema).withColumn("shard", F.monotonically_increasing_id()), "shards")
    buckets = 2 * partitions(spark)
    sent = shards.where("weight > 0").mapInArrow(_sent(depth, buckets, min_count), "bucket long, shard long, hashes binary, counts binary")
    bits = sent.groupBy("bucket").applyInArrow(_struck(min_count), "bucket long, shard long, bits binary")
    negative = shards.where("weight < 0")
    found = shards.where("weight > 0").groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(_texts(depth, buckets), "lang string, size int, phrase string, f long")
    found = found.unionByName(negative.mapInArrow(_all_texts(depth), "lang string, size int, phrase string, f long"))
    summed = materialise(found.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count), "phrases")
    totals = materialise(shards.mapInArrow(_totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    forget(shards)
    return summed, totals


def _all_texts(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, index = _opened(row)
                for p in index.phrases(depth):
                    text = [b" ".join(names[w] for w in words).decode("utf-8", "replace") for words in p.words.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(text), pa.string()), pa.array([p.words.shape[1]] * len(text), pa.int32()), pa.array(text, pa.string()), pa.array(-p.count, pa.int64())], schema=_PHRASES)

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["lang", "weight", "n", "forward"]).to_pylist()
        n = [r["weight"] * int(np.count_nonzero(np.frombuffer(pa.decompress(r["forward"], 4 * r["n"], "zstd"), "<u4"))) for r in rows]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([r["lang"] for r in rows], pa.string()), "n": pa.array(n, pa.int64())})


def mine(
    docs: DataFrame, min_count: int = 10, max_words: int = 3, best: int = 2000, absorb_percent: int = 50, lang: Column | str = "lang", text_col: str = "text", shard_bytes: int = 0
) -> DataFrame:
    """The ``best`` collocations of 2 to ``max_words`` words of each language.

    f(phrase) = a >= ``min_count``; cut after k words, l and r are the counts of its parts; the score is the least of
    floor(1000000 * a * a / (l * r)) over k (ties to the smallest). A phrase inside a longer one with at least ``absorb_percent``
    percent of its count is left out. Returns lang, rank, phrase, a, l, r, n (the language's words) and score, by score and a descending, then phrase.
    """
    summed, totals = frequent(docs, min_count, max_words, lang, text_col, shard_bytes)
    words = F.split("phrase", " ", -1)
    longer = summed.where("size > 1").withColumn("words", words)
    join = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    counts = lambda part, name: summed.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(counts("head", "l"), ["lang", "head"]).join(counts("tail", "r"), ["lang", "tail"])
    # decimals of 38 digits hold 1000000 * a * a for counts up to 10^16
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    inner = longer.where("size > 2").select("lang", "f", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("lang", "f", "words", "k", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("at"))
    inner = inner.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("k")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    left = scored.join(inner, ["lang", "phrase"], "left").where(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * absorb_percent))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))).orderBy(*order)
    few = left.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= best).drop("_place")
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB SQL, for the registered query.
ORACLE = r"""
with d as (select row_number() over () as i, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from d),
grams as (select lang, k as size, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest([1, 2, 3]) as k) where len(w) >= k)),
f as (select lang, size, phrase, count(*) as f from grams group by all),
total as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
c as (select lang, size, phrase, string_split(phrase, ' ') as w, f as a from f where size > 1 and f >= 10),
cuts as (select lang, size, phrase, w, a, unnest(range(1, size)) as k from c),
parts as (select *, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:size], ' ') as tail from cuts),
scored as (select p.lang, p.size, p.phrase, p.a, k, x.f as l, y.f as r, (1000000::hugeint * p.a * p.a // (x.f::hugeint * y.f))::bigint as score
  from parts p join f x on x.lang = p.lang and x.phrase = head and x.size = k join f y on y.lang = p.lang and y.phrase = tail and y.size = p.size - k),
lowest as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as place from scored) where place = 1),
inner_ as (select lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase, a as longer from c where size = 3),
covers as (select lang, phrase, max(longer) as longer from inner_ group by lang, phrase),
kept as (select s.* from lowest s left join covers v on s.lang = v.lang and s.phrase = v.phrase and s.size = 2 where v.longer is null or 100 * v.longer < 50 * s.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select ranked.lang, rank::int as rank, phrase, a, l, r, n, score from ranked join total on total.lang = ranked.lang where rank <= 2000
"""
