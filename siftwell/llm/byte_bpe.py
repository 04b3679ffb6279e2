"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are merged together, all those of a slice of texts that were not seen lately: their symbols are linked lists in
one buffer, with a gap between pre-tokens, across which nothing merges. Each merge rank has a bucket of the list
positions where its pair starts. A bitmap of two levels marks the ranks with a filled bucket, and
find-first-set from the top picks the next rank in a few steps. An entry whose pair has changed since
is stale and skipped. Each merge makes at most two new entries, so n bytes take O(n log n)
whatever the length of a pre-token. The leftmost pair of the lowest rank merges first, which is the usual merge rule: of a
pre-token with several places in a bucket they are taken one by one, and where a merge makes a pair of a lower rank, the rest goes
back and waits; pre-tokens with one place in a bucket are independent of each other and merge at once, in numpy.

Short pre-tokens repeat; each Python worker keeps the ids of those seen lately, in two generations of a fixed size.
Null text encodes as the empty text. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: Pre-tokens of each of the two generations that a Python worker keeps (about 200 bytes each), and the longest that are kept (characters).
KEPT, KEPT_CHARS = 200_000, 32
#: Bytes of texts that are encoded together, and pre-tokens of a longer text.
SLICE_BYTES, SLICE_PARTS = 1 << 20, 200_000
#: Places of a bucket from which on numpy is faster.
_MANY = 24

#: The usual pattern of byte-level vocabularies, and for texts of ASCII and Latin letters (that :data:`_OTHER` finds nothing in) the same split
#: by plain character ranges, which is twice as fast.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^\t-\r -~¡-¨«-±´¶-¸»¿×÷‐-‧{_LETTERS}]")


def splitter(pattern: str):
    """A function from a text to its pre-tokens, as lists of at most SLICE_PARTS where the text is long."""
    general = regex.compile(pattern)

    def split(text: str) -> Iterator[list[str]]:
        found = general if pattern != USUAL or _OTHER.search(text) else _LATIN
        if len(text) <= SLICE_BYTES:
            yield [m.group() for m in found.finditer(text)] if found.groups else found.findall(text)
            return
        matches = (m.group() for m in found.finditer(text))
        while part := list(islice(matches, SLICE_PARTS)):
            yield part

    return split


def gather(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of a table that ``index`` names, one after the other, and where each one ends."""
    n = sizes[index]
    ends = np.cumsum(n, dtype=np.int64)
    return table[np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


class Strings:
    """Byte strings by number."""

    def __init__(self, strings: list[bytes]):
        self.table = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def join(self, numbers: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The strings one after the other, and where each one ends."""
        flat, ends = gather(self.table, self.starts, self.sizes, numbers)
        return memoryview(flat), ends


class _Partners:
    """For each symbol, those that merge with it from one side, and the ranks of the pairs."""

    def __init__(self, own: list[int], other: list[int], rank: list[int], top: int):
        own = np.array(own, np.int32)
        order = np.argsort(own, kind="stable")
        self.other, self.rank = np.array(other, np.int32)[order], np.array(rank, np.int32)[order]
        self.start = np.searchsorted(own[order], np.arange(top + 1)).tolist()
        self._room = np.full(top + 1, -1, np.int32)  # of the last place: the partner -1, which is none

    def ranks(self, symbol: int, others: np.ndarray) -> np.ndarray:
        """The ranks of the pairs of a symbol with each of the others, -1 where there is none."""
        a, b = self.start[symbol], self.start[symbol + 1]
        self._room[self.other[a:b]] = self.rank[a:b]
        found = self._room[others]
        self._room[self.other[a:b]] = -1
        return found


class Vocabulary:
    """Merge ranks of byte sequences, as in a ``.tiktoken`` file (base64 bytes, space, rank); a rank is the id too."""

    def __init__(self, data: bytes):
        self.ranks = ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        top = max(ranks.values(), default=0) + 1
        self.single, self.pair = np.full(256, -1, np.int32), np.full(1 << 16, -1, np.int32)
        pieces, pairs = [b""] * top, []
        for piece, rank in ranks.items():
            pieces[rank] = piece
            if len(piece) == 1:
                self.single[piece[0]] = rank
            elif len(piece) == 2:
                self.pair[piece[0] << 8 | piece[1]] = rank
            for cut in range(1, len(piece)):
                a = ranks.get(piece[:cut])
                if a is not None:
                    b = ranks.get(piece[cut:])
                    if b is not None:
                        pairs.append((a, b, rank))
        left, right, both = zip(*pairs) if pairs else ((), (), ())
        self.lefts, self.rights = _Partners(right, left, both, top), _Partners(left, right, both, top)
        self.pieces, self.decimals = Strings(pieces), Strings([b"%d," % i for i in range(top)])
        # Two levels: words of 2^shift bits (Python's whole numbers can be that wide), and one word over those that aren't zero.
        self.shift = (top.bit_length() + 1) // 2
        self.bits = tuple(1 << i for i in range(1 << self.shift))
        # The rank queue is empty between calls, so that one will do for all.
        self.words = [0] * ((top >> self.shift) + 1)
        self.buckets: list[array | None] = [None] * top

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token."""
        return self.merge_all([token])[0].tolist()

    def merge_all(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after the other, and where each one's end: again and again the lowest rank's leftmost pair is merged."""
        whole = np.fromiter(map(self.ranks.get, tokens, [-1] * len(tokens)), np.int32, len(tokens))
        rest = np.flatnonzero(whole < 0)
        split, ends = self._merge([tokens[i] for i in rest.tolist()])
        sizes = np.ones(len(tokens), np.int64)
        sizes[rest] = np.diff(ends, prepend=0)
        out_ends = np.cumsum(sizes)
        ids = np.empty(int(sizes.sum()), np.int32)
        ids[(out_ends - sizes)[whole >= 0]] = whole[whole >= 0]
        ids[np.repeat(whole < 0, sizes)] = split
        return ids, out_ends

    def _merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        get, words, buckets, bits, shift = self.ranks.get, self.words, self.buckets, self.bits, self.shift
        mask, top = (1 << shift) - 1, 0

        def push(rank: int) -> array:
            """The bucket of a rank, marked as filled."""
            nonlocal top
            bucket = buckets[rank]
            if bucket is None:
                bucket = buckets[rank] = array("i")
                word = rank >> shift
                words[word] |= bits[rank & mask]
                top |= bits[word]
            return bucket

        def push_all(ranks: np.ndarray, places: np.ndarray) -> None:
            good = ranks >= 0
            ranks, places = ranks[good], places[good]
            if len(ranks):
                order = np.argsort(ranks, kind="stable")
                ranks, blob = ranks[order], places[order].astype(np.int32).tobytes()
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
                for a, b, rank in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
                    push(rank).frombytes(blob[4 * a : 4 * b])

        buf = b"\0".join(tokens) + b"\0"
        n, raw = len(buf), np.frombuffer(buf, np.uint8)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
        gaps = np.cumsum(sizes + 1) - 1
        # a symbol stands at its first byte; -1 at gaps and where a symbol has gone into the one before
        symbol = self.single[raw]
        symbol[gaps] = 0
        if (symbol < 0).any():
            raise KeyError("the vocabulary lacks a byte")
        symbol[gaps] = -1
        owner = np.repeat(np.arange(len(gaps), dtype=np.int32), sizes + 1)
        end, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        before[np.r_[0, gaps[:-1] + 1]] = -1  # the last place, a gap
        current = np.full(n, -1, np.int32)  # the rank of the pair that starts here
        current[:-1] = self.pair[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        current[gaps] = current[gaps - 1] = -1
        push_all(current, np.arange(n))
        at_symbol, at_end, at_before, at_current = map(memoryview, (symbol, end, before, current))

        def one_by_one(rank: int, places: list[int]) -> None:
            left = iter(places)
            for i in left:
                if at_current[i] != rank:
                    continue  # stale
                j = at_end[i]
                k = at_end[i] = at_end[j]
                at_symbol[i], at_symbol[j], at_current[i], at_current[j] = rank, -1, -1, -1
                least, h = rank, at_before[i]
                if h >= 0:
                    new = at_current[h] = get(buf[h:k], -1)
                    if new >= 0:
                        push(new).append(h)
                        least = min(least, new)
                if at_symbol[k] >= 0:
                    at_before[k] = i
                    new = at_current[i] = get(buf[i : at_end[k]], -1)
                    if new >= 0:
                        push(new).append(i)
                        least = min(least, new)
                if least < rank:
                    wait = list(left)
                    if wait:
                        push(rank).extend(array("i", wait))

        while top:
            # find-first-set on both levels gives the lowest rank
            word = (top & -top).bit_length() - 1
            had = words[word]
            lowest = had & -had
            rank = (word << shift) + lowest.bit_length() - 1
            bucket = buckets[rank]
            buckets[rank] = None
            words[word] = had = had ^ lowest
            if not had:
                top ^= bits[word]
            if len(bucket) < _MANY:
                one_by_one(rank, sorted(bucket))
                continue
            places = np.frombuffer(bucket, np.int32)
            places = np.sort(places[current[places] == rank])
            owners = owner[places]
            again = owners[1:] == owners[:-1]
            if again.any():
                several = np.zeros(len(places), bool)
                several[1:] |= again
                several[:-1] |= again
                one_by_one(rank, places[several].tolist())
                places = places[~several]
            gone = end[places]
            following, previous = end[gone], before[places]
            end[places], before[following] = following, places
            symbol[places], symbol[gone], current[gone] = rank, -1, -1
            new_left, new_right = self.lefts.ranks(rank, symbol[previous]), self.rights.ranks(rank, symbol[following])
            current[previous], current[places] = new_left, new_right
            push_all(np.concatenate([new_left, new_right]), np.concatenate([previous, places]))
        live = symbol >= 0
        return symbol[live], np.cumsum(live)[gaps] if tokens else np.zeros(0, np.int64)

    def decode(self, ids) -> bytes:
        return bytes(self.pieces.join(np.asarray(ids, np.int64))[0])


class _Seen:
    """The vocabulary and the ids of pre-tokens seen lately. When the younger generation is full it becomes the elder
    one, whose place it takes; what is asked for again is carried over."""

    def __init__(self, data: bytes):
        self.vocab = Vocabulary(data)
        self.young: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def encode(self, parts: list[str], kept: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens one after the other, and where each one's end."""
        coded = pa.array(parts, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        young, elder = self.young, self.elder
        found = list(map(young.get, distinct))
        lacking = [i for i, x in enumerate(found) if x is None]
        for i in lacking:
            got = elder.get(distinct[i])
            if got is not None:
                found[i] = young[distinct[i]] = got
        lacking = [i for i in lacking if found[i] is None]
        ids, ends = self.vocab.merge_all([distinct[i].encode() for i in lacking])
        blob, ends = ids.tobytes(), (4 * ends).tolist()
        for i, a, b in zip(lacking, [0, *ends], ends):
            got = found[i] = blob[a:b]
            if len(distinct[i]) <= KEPT_CHARS:
                young[distinct[i]] = got
        if len(young) >= kept:
            self.elder, self.young = young, {}
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return gather(np.frombuffer(b"".join(found), np.int32), np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy())


_workers: dict[bytes, _Seen] = {}


def _worker(data: bytes) -> _Seen:
    """What a Python worker keeps for its next tasks."""
    key = hashlib.sha256(data).digest()
    if key not in _workers:
        _workers.clear()
        _workers[key] = _Seen(data)
    return _workers[key]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows that are encoded together: a batch is never held as Python strings all at once."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    i = 0
    while i < len(sizes):
        j, room = i + 1, sizes[i]
        while j < len(sizes) and room + sizes[j] <= SLICE_BYTES:
            room += sizes[j]
            j += 1
        yield i, j
        i = j


def _encoder(vocabulary, pattern: str, out: str, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what tasks of other kinds left behind
        seen = _worker(vocabulary.value)
        split = splitter(pattern)
        for batch in batches:
            rest = batch.select([i for i in range(batch.num_columns) if i != 1])
            for i, j in _slices(batch.column(1)):
                texts = batch.column(1).slice(i, j - i).to_pylist()
                if len(texts) == 1:
                    pieces = [seen.encode(parts, kept)[0] for parts in split(texts[0] or "")]
                    ids = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
                    ends = np.array([len(ids)])
                else:
                    listed = [parts for text in texts for parts in split(text or "")]
                    ids, part_ends = seen.encode([p for parts in listed for p in parts], kept)
                    ends = np.r_[0, part_ends][np.cumsum([len(parts) for parts in listed])]
                yield _rows(rest.slice(i, j - i), ids, ends, seen.vocab, out)
        release()

    return run


def _rows(rest: pa.RecordBatch, ids: np.ndarray, ends: np.ndarray, vocab: Vocabulary, out: str) -> pa.RecordBatch:
    """Output rows of texts whose ids end at ``ends``."""
    starts = np.r_[0, ends[:-1]]
    names, columns = ["n_tokens"], [pa.array(ends - starts, pa.int64())]
    if out == "digests":
        listed, decoded = [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            sums = hashlib.sha256(), hashlib.sha256()
            for i in range(a, b, SLICE_PARTS):
                own = ids[i : min(b, i + SLICE_PARTS)]
                decimals = vocab.decimals.join(own)[0]
                sums[0].update(decimals[:-1] if i + SLICE_PARTS >= b else decimals)
                sums[1].update(vocab.pieces.join(own)[0])
            listed.append(sums[0].hexdigest())
            decoded.append(sums[1].hexdigest())
        names, columns = [*names, "ids_sha256", "decoded_sha256"], [*columns, pa.array(listed), pa.array(decoded)]
    else:
        names, columns = [*names, "token_ids"], [*columns, pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), ids.astype(np.int32))]
        if out == "both":
            texts = [vocab.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
            names, columns = [*names, "decoded"], [*columns, pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays([*rest.columns, *columns], names=[*rest.schema.names, *names])


_COLUMNS = {
    "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string", "ids": "n_tokens long, token_ids array<int>", "both": "n_tokens long, token_ids array<int>, decoded string",
}


def encode(
    docs: DataFrame, vocabulary_path: str, pattern: str, out: str = "both", id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), kept: int = KEPT,
) -> DataFrame:
    """Encode every whole text and, unless only ``ids`` are asked for, decode the ids again, a row per input row.

    Returns doc_id, the long columns ``keep`` of ``docs``, n_tokens, and by ``out``: token_ids (array of int; ``ids``), these and decoded
    (``both``), or ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded bytes; ``digests``).
    The vocabulary is read on the driver (its size is fixed) and sent to each executor once. ``kept`` bounds the memory of a Python worker.
    """
    with open(vocabulary_path, "rb") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id long, " + "".join(f"{c} long, " for c in keep) + _COLUMNS[out]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).cast("long").alias(c) for c in keep))
    return rows.mapInArrow(_encoder(vocabulary, pattern, out, kept), schema)
