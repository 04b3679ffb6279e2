"""Helpers shared by the corpus operators: the shared folder, and word tables in numpy.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; all separators are ASCII, so
whole UTF-8 texts can be cut as bytes (``bytes.split()`` has exactly this set).
"""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text hashed at once: keeps temporary arrays small whatever the batch holds.
SLICE_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd factors for the places of a window; a window may hold at most this many words.
PLACE = np.random.default_rng(20240102).integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is set on one machine (tests); on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = getattr(spark, "_siftwell_shared", None)
        if not folder:
            folder = spark._siftwell_shared = "file://" + tempfile.mkdtemp(prefix="siftwell-")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared place, never used before."""
    return f"{shared_dir(spark)}/siftwell/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    written = df.sparkSession.read.schema(df.schema).parquet(folder)
    written._siftwell_folder = folder
    return written


def forget(*written: DataFrame) -> None:
    """Remove the files of materialised frames that nothing will read again."""
    for df in written:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._siftwell_folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, which its user sets in proportion to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory back to the system at the end of a task: Python workers stay alive beside the JVM."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int, kept: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the prime and of its inverse; only those of a slice are kept."""
    if n <= SLICE_BYTES and kept:
        return kept[0]
    size = max(n, SLICE_BYTES)
    both = np.cumprod(np.full(size, _PRIME)), np.cumprod(np.full(size, _INVERSE))
    if n <= SLICE_BYTES:
        kept.append(both)
    return both


class WordTable:
    """The words of several texts: ``hash``, ``start`` and ``end`` (byte offsets), ``doc`` (place of its text).

    ``buf`` holds the texts, words joined by one space and texts ended by a newline. Equal words have
    equal hashes; what must be exact compares bytes of ``buf`` afterwards.
    """

    def __init__(self, texts: list[bytes]):
        """texts: with words already joined by one space (see :func:`joined`)."""
        self.buf = buf = b"\n".join(texts) + b"\n" if texts else b""
        parts, first, doc = [], 0, 0
        whole = np.frombuffer(buf, np.uint8)
        while first < len(buf):
            # slices end behind a separator; a long text may be several
            last = min(len(buf), first + SLICE_BYTES)
            stop = max(buf.rfind(b" ", first, last), buf.rfind(b"\n", first, last)) + 1
            if not stop:
                stop = min(x for x in (buf.find(b" ", last), buf.find(b"\n", last)) if x >= 0) + 1
            parts.append(self._slice(whole[first:stop], first, doc))
            first, doc = stop, doc + buf.count(b"\n", first, stop)
        none = np.zeros(0, np.int64)
        self.hash, self.start, self.end, self.doc = (
            (np.concatenate(x) if parts else none) for x in (zip(*parts) if parts else ((), (), (), ()))
        )
        #: Index of the first word of each text, and one more at the end.
        self.base = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    @staticmethod
    def _slice(arr: np.ndarray, offset: int, doc: int):
        newline = arr == 10
        end = np.flatnonzero((arr == 32) | newline)
        start = np.empty_like(end)
        start[0], start[1:] = 0, end[:-1] + 1
        docs = np.cumsum(newline[end])
        docs -= newline[end]
        full = end > start
        start, end, docs = start[full], end[full], docs[full]
        up, down = _powers(len(arr))
        acc = _BYTE[arr]
        acc *= up[: len(arr)]
        np.cumsum(acc, out=acc)
        h = acc[end - 1]
        before = acc[np.maximum(start - 1, 0)]
        before[start == 0] = 0
        h -= before
        h *= down[start]
        return mix(h), start + offset, end + offset, docs + doc

    def __len__(self) -> int:
        return len(self.hash)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``size`` words by its first word's index, and whether it lies in one text."""
        n = max(0, len(self) - size + 1)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h += self.hash[k : k + n] * PLACE[k]
        return mix(h), self.doc[:n] == self.doc[size - 1 : size - 1 + n]

    def bytes_of(self, i: int, size: int) -> bytes:
        return self.buf[self.start[i] : self.end[i + size - 1]]


def joined(text: bytes | None) -> bytes:
    """The words of a text joined by one space; null has none."""
    return b" ".join(text.split()) if text else b""


def window_classes(table: WordTable, at: np.ndarray, size: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """A class number for each window that starts at word ``at``: equal exactly when the word sequences are.

    Windows are sorted by hash; neighbours of equal hash are then compared as bytes, and where two
    differ, all windows that share a hash are numbered by their bytes instead.
    """
    if hashes is None:
        hashes = table.windows(size)[0]
    h = hashes[at]
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    same = np.flatnonzero(~new)
    if len(same):
        a, b = at[order[same]], at[order[same - 1]]
        a0, a1, b0, b1 = table.start[a], table.end[a + size - 1], table.start[b], table.end[b + size - 1]
        buf = table.buf
        bad = bool(np.any(a1 - a0 != b1 - b0)) or any(
            buf[i:j] != buf[k:m] for i, j, k, m in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist())
        )
        if bad:
            shared = np.zeros(len(h), bool)
            shared[same] = shared[same - 1] = True
            numbers: dict[bytes, int] = {}
            out = np.empty(len(h), np.int64)
            alone = ~shared
            out[order[alone]] = np.arange(alone.sum())
            rest = order[shared]
            first = int(alone.sum())
            for i in rest.tolist():
                out[i] = first + numbers.setdefault(table.bytes_of(int(at[i]), size), len(numbers))
            return out
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values."""
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if have < size else x
