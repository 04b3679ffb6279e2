"""Best-fit packing of tokenised documents by bin completion.

Documents are tokenised in Spark, cut into pieces of at most ``capacity`` tokens, and written once. What decides a packing is
only how many pieces there are of each length, a table of at most ``capacity`` numbers whatever the corpus. On it a branch and
bound completes sequences around the largest piece that is left: it enumerates the fillings of the remaining room that no other filling
dominates (one dominates another if the other's pieces fit into its pieces' places), uses each as often as the counts allow,
and turns back where the sequences used so far and a lower bound of the rest cannot beat the best known packing. Best fit decreasing gives
the first of those. The search ends at the lower bound or after ``steps`` steps; the best packing found is kept and is always whole.

Spark then numbers the pieces of each length (counts per part, their running sums, a rank within a part, so that a length that very many
pieces share is no single group) and each piece looks its place up in the plan.

Defined results: a null text is empty, and an empty text is the end token alone. Repeated rows are packed each. Texts of any
length are tokenised whole, a slice at a time. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, partitions, release

#: Bytes of text tokenised at once, and words whose ids a worker keeps.
SLICE_BYTES, KEPT = 4 << 20, 800_000
#: Steps of the search, and fillings tried at each.
STEPS, FILLINGS = 20_000, 3

# ---- tokens -----------------------------------------------------------------


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LETTER = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_CAPITAL = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = _table(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def units(buf: bytes) -> pa.Array:
    """Cut a text into parts of words, each with the spaces behind it, at places where the tokenizer starts anew in any case.

    These are behind white space, between a letter and a mark, and between a mark other than ``'`` and a letter (ASCII;
    before a mark also Latin-1 letters). Capitals followed by ASCII are lower-cased: nothing can combine with them.
    """
    arr = np.frombuffer(buf.translate(_SPACES), np.uint8)
    space, letter, mark = arr == 32, _LETTER[arr], _MARK[arr]
    capital = _CAPITAL[arr]
    capital[:-1] &= arr[1:] < 128
    low = arr + np.uint8(32) * capital
    before = letter.copy()
    before[1:] |= (arr[:-1] == 0xC3) & (arr[1:] != 0x97) & (arr[1:] != 0xB7)  # é and the like, not × and ÷
    cut = np.ones(len(arr) + 1, bool)
    cut[1:-1] = (space[:-1] & ~space[1:]) | (before[:-1] & mark[1:]) | (mark[:-1] & (arr[:-1] != 39) & letter[1:])
    offsets = np.flatnonzero(cut).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low)])


class Tokens:
    """Ids of texts, by a word table of the tokenizer's results."""

    #: Plain words that are given to the tokenizer as one text.
    TOGETHER = 256

    def __init__(self, definition: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_str(definition), kept
        self.tokenizer.encode_special_tokens = True  # special tokens' strings are ordinary text
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only: many in one text, told apart by the tokens that end a word."""
        n = self.TOGETHER
        ids, _ = self._encode([b" ".join(words[i : i + n]).decode() for i in range(0, len(words), n)])
        last = np.flatnonzero(self.ends[ids])
        if len(last) == len(words) and (not len(words) or last[-1] == len(ids) - 1):
            return ids, np.diff(np.r_[-1, last])
        return self._encode([w.decode() for w in words])

    def _places(self, words: list[bytes]) -> np.ndarray:
        if len(self.place) > self.kept:
            self._forget()
        known = self.place
        out = [known.get(w, -1) for w in words]
        new = [i for i, at in enumerate(out) if at < 0]
        if new:
            fresh = list(dict.fromkeys(words[i] for i in new))
            plain = [w.isalpha() for w in fresh]  # of bytes: ASCII letters
            for encode, own in ((self._plain, [w for w, p in zip(fresh, plain) if p]), (lambda x: self._encode([w.decode() for w in x]), [w for w, p in zip(fresh, plain) if not p])):
                ids, sizes = encode(own)
                self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
                self.sizes, self.ids = np.r_[self.sizes, sizes], np.r_[self.ids, ids]
                known.update(zip(own, range(len(known), len(known) + len(own))))
            for i in new:
                out[i] = known[words[i]]
        return np.array(out, np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and where each text's end."""
        ends = np.cumsum([len(t) + 1 for t in texts])  # a space parts the texts
        items = units(b" ".join(texts) + b" ")
        coded = items.dictionary_encode()
        at = self._places([w.rstrip(b" ") for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        sizes = self.sizes[at]
        after = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[at] - after + sizes, sizes) + np.arange(int(after[-1]))]
        starts = np.frombuffer(items.buffers()[1], np.int32)[: len(items)]
        # parts of a text begin before the space that ends it
        return ids, np.r_[0, after][np.searchsorted(starts, ends - 1, side="left")]


def _slices(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, bool]]]:
    """(row, text or part of one, whether it is the last) in slices of about ``SLICE_BYTES``; long texts are cut at spaces."""
    held, room = [], 0
    for row, text in enumerate(texts):
        while len(text) > SLICE_BYTES:
            cut = max(text.rfind(c, 0, SLICE_BYTES) for c in (b" ", b"\n"))
            if cut <= 0:
                cut = min((x for x in (text.find(c, SLICE_BYTES) for c in (b" ", b"\n")) if x > 0), default=0)
            if not cut:
                break
            yield [*held, (row, text[:cut], False)]
            held, room, text = [], 0, text[cut:]
        held.append((row, text, True))
        room += len(text)
        if room > SLICE_BYTES:
            yield held
            held, room = [], 0
    if held:
        yield held


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
_worker: dict[str, Tokens] = {}


def _tokenise(definition, capacity: int, end_id: int, with_ids: bool):
    def rows(doc, ids: list[np.ndarray]):
        all_ids = np.concatenate([*ids, np.array([end_id], np.uint32)]).astype("<u4")
        for piece, start in enumerate(range(0, len(all_ids), capacity)):
            own = all_ids[start : start + capacity]
            yield (doc, piece, start, len(own), zlib.crc32(own.tobytes())) + ((own,) if with_ids else ())

    def batch_of(out):
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(_PIECE_TYPES)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([r[5].astype(np.int32) for r in out], pa.list_(pa.int32())))
            names.append("token_ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        text = definition.value
        if text not in _worker:
            _worker.clear()
            _worker[text] = Tokens(text)
        tokens = _worker[text]
        for batch in batches:
            docs = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            begun: list[np.ndarray] = []
            for held in _slices([t or b"" for t in texts]):
                ids, ends = tokens.encode([t for _, t, _ in held])
                out = []
                for (row, _, last), own in zip(held, np.split(ids, ends[:-1])):
                    begun.append(own)
                    if last:
                        out += rows(docs[row], begun)
                        begun = []
                if out:
                    yield batch_of(out)
        release()

    return run


# ---- the plan -----------------------------------------------------------------

Filling = tuple[tuple[int, int], ...]  # (length, how often), longest first


def lower_bound(counts: np.ndarray) -> int:
    """No packing has fewer sequences (Martello and Toth's bound: pieces over half a sequence cannot share one)."""
    cap = len(counts) - 1
    at = np.arange(cap + 1)
    pieces, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * at)]  # below each length
    best = -(-int(tokens[-1]) // cap)
    a = np.arange(cap // 2 + 1)  # pieces of at least a tokens count
    half = cap // 2 + 1
    high = np.maximum(cap - a + 1, half)
    alone = pieces[-1] - pieces[high]
    large, large_tokens = pieces[high] - pieces[half], tokens[high] - tokens[half]
    rest = tokens[half] - tokens[a] - (large * cap - large_tokens)
    return max(best, int((alone + large + np.maximum(0, -(-rest // cap))).max(initial=0)))


def best_fit(counts: np.ndarray) -> list[tuple[Filling, int]]:
    """Best fit decreasing, pieces of equal length and sequences of equal filling at once."""
    cap = len(counts) - 1
    open_: dict[int, list[list]] = {}  # room: [filling, how many sequences]
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((r for r in open_ if r >= length), default=cap)
            group = open_[room] if room in open_ else [[(), -(-left // (cap // length))]]
            filling, n = group.pop()
            if room in open_ and not group:
                del open_[room]
            per = room // length
            whole = min(n, left // per)
            parts = [(per, whole)] if whole else []
            if whole < n and left % per and whole == left // per:
                parts.append((left % per, 1))
            used = sum(k for _, k in parts)
            if used < n and room != cap or (used < n and filling):
                open_.setdefault(room, []).append([filling, n - used])
            for take, times in parts:
                open_.setdefault(room - take * length, []).append([(*filling, (length, take)), times])
                left -= take * times
    return [(filling, n) for groups in open_.values() for filling, n in groups if filling]


def _dominates(a: Filling, b: Filling) -> bool:
    """Whether the pieces of ``b`` fit into the places of those of ``a`` (tried for few pieces only)."""
    places, pieces = [x for x, k in a for _ in range(min(k, 7))], [x for x, k in b for _ in range(min(k, 7))]
    if len(places) > 6 or len(pieces) > 6 or len(places) > len(pieces) or sum(places) < sum(pieces):
        return False

    def fit(i: int, rooms: tuple[int, ...]) -> bool:
        return i == len(pieces) or any(r >= pieces[i] and fit(i + 1, (*rooms[:j], r - pieces[i], *rooms[j + 1 :])) for j, r in enumerate(rooms))

    return fit(0, tuple(places))


def fillings(counts: np.ndarray, room: int, most: int = FILLINGS, tries: int = 200) -> list[Filling]:
    """The best fillings of ``room`` that none of the others dominates, least waste first, then the longest pieces."""
    lengths = np.flatnonzero(counts[: room + 1])[::-1]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return [()]
    if lengths[0] == room:
        return [((room, 1),)]  # dominates every other
    found: list[Filling] = [((int(lengths[0]), 1),)]
    up = lengths[::-1]

    def pairs(space: int, less: int, first: int) -> list[tuple[int, int]]:
        """The two pieces that fill ``space`` best, the first at most ``less`` long; ``first`` of that length are taken already."""
        a = lengths[(lengths <= less) & (lengths < space)]
        at = np.searchsorted(up, np.minimum(space - a, a), side="right") - 1
        a, at = a[at >= 0], at[at >= 0]
        b = up[at]
        # the same length twice needs so many pieces
        need = 1 + (a == b) + np.where(a == less, first, 0)
        twice = counts[a] >= need
        a, b = a[twice], b[twice]
        if not len(a):
            return []
        best = np.argsort(space - a - b, kind="stable")[:most]
        return list(zip(a[best].tolist(), b[best].tolist()))

    found += [_counted(p) for p in pairs(room, room, 0)]
    if min(_waste(f, room) for f in found):
        for a in lengths[: tries].tolist():
            more = [_counted((a, *p)) for p in pairs(room - a, a, 1)]
            found += more
            if any(not _waste(f, room) for f in more):
                break
    if min(_waste(f, room) for f in found):
        found += _deep(counts, up.tolist(), room, tries)
    found = sorted(set(found), key=lambda f: (_waste(f, room), [(-x, -k) for x, k in f]))[: 4 * most]
    kept: list[Filling] = []
    for f in found:
        if not any(_dominates(k, f) for k in kept):
            kept.append(f)
    return kept[:most]


def _counted(pieces: tuple[int, ...]) -> Filling:
    return tuple((x, len(list(g))) for x, g in itertools.groupby(sorted(pieces, reverse=True)))


def _waste(filling: Filling, room: int) -> int:
    return room - sum(x * k for x, k in filling)


def _deep(counts: np.ndarray, up: list[int], room: int, tries: int) -> list[Filling]:
    """Fillings of any number of pieces: longest first, as many as fit, then fewer; ends at one without waste."""
    found: list[Filling] = []
    stack: list[tuple[int, int, Filling]] = [(len(up) - 1, room, ())]
    while stack and tries:
        tries -= 1
        i, space, taken = stack.pop()
        while i >= 0 and up[i] > space:
            i -= 1
        if i < 0 or not space:
            if taken:
                found.append(taken)
            if not space:
                break
            continue
        most = min(int(counts[up[i]]), space // up[i])
        for k in {0, most // 2, max(0, most - 1), most} if most > 3 else range(most + 1):
            stack.append((i - 1, space - k * up[i], (*taken, (up[i], k)) if k else taken))
        stack[-1 - most if most <= 3 else -4 :] = sorted(stack[-1 - most if most <= 3 else -4 :], key=lambda s: -s[1])
    return found


def complete(counts: np.ndarray, steps: int = STEPS, branches: int = FILLINGS) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used; ``counts[n]`` pieces have ``n`` tokens, a sequence holds ``len(counts) - 1``."""
    counts = np.array(counts, np.int64)
    cap, goal = len(counts) - 1, lower_bound(counts)
    best = best_fit(counts)
    fewest = sum(n for _, n in best)
    # each entry: counts that are left, sequences used, what was used (a linked list)
    stack = [(counts, 0, None)]
    while stack and steps and fewest > goal:
        steps -= 1
        left, used, chain = stack.pop()
        if used + lower_bound(left) >= fewest:
            continue
        present = np.flatnonzero(left)
        if not len(present):
            fewest, best = used, []
            while chain:
                best.append(chain[0])
                chain = chain[1]
            continue
        longest = int(present[-1])
        without = left.copy()
        without[longest] -= 1
        for filling in reversed(fillings(without, cap - longest, branches)):
            whole = _counted((longest, *(x for x, k in filling for _ in range(k))))
            times = min(int(left[x]) // k for x, k in whole)
            rest = left.copy()
            for x, k in whole:
                rest[x] -= k * times
            stack.append((rest, used + times, ((whole, times), chain)))
    return best


class Plan:
    """Where the pieces of each length go, in the order of their numbers."""

    def __init__(self, packing: list[tuple[Filling, int]]):
        rows, sequence, seen = [], 0, {}
        for filling, times in packing:
            offset = 0
            for length, k in filling:
                first = seen.get(length, 0)
                rows.append(((length << 40) + first, k, sequence, offset))
                seen[length] = first + k * times
                offset += k * length
            sequence += times
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.sequences = sequence

    def places(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, by length and number among the pieces of that length."""
        key = (lengths << 40) + numbers
        row = self.table[np.searchsorted(self.table[:, 0], key, side="right") - 1]
        j = key - row[:, 0]
        return row[:, 2] + j // row[:, 1], row[:, 3] + j % row[:, 1] * lengths


def _place(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.schema.get_field_index("_number")
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            sequence, offset = plan.value.places(length, batch.column(number).to_numpy())
            kept = [i for i in range(batch.num_columns) if i != number]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, steps: int = STEPS
) -> DataFrame:
    """Pack every document's tokens and ``end_id`` into sequences of ``capacity``; longer documents are cut into pieces of that length.

    Returns per piece doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32, sequence_id, offset, and
    token_ids if asked for. The tokenizer's file is read on the driver (its size is fixed).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = _PIECES + (", token_ids array<int>" if with_ids else "")
    pieces = materialise(rows.mapInArrow(_tokenise(definition, capacity, end_id, with_ids), schema), "pieces")
    parts = 8 * partitions(spark)
    pieces = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    counts = materialise(pieces.groupBy("length", "_part").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most a row per length
        histogram[r["length"]] = r["n"]
    plan = spark.sparkContext.broadcast(Plan(complete(histogram, steps)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    first = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = pieces.join(first, ["length", "_part"]).withColumn("_number", F.col("_first") + F.row_number().over(within) - 1)
    columns = [c for c in pieces.columns if c != "_part"]
    return numbered.select(*columns, "_number").mapInArrow(_place(plan), f"{schema}, sequence_id long, offset long")
