"""Language identification by error-correcting output codes.

Every language gets a codeword of bits; a binary classifier on hashed character n-grams predicts each
bit, and loss-weighted decoding picks the codeword nearest to the margins. With up to ``EXHAUSTIVE``
languages the code is the exhaustive one (2^(k-1)-1 columns, distance 2^(k-2)); beyond that, columns
are drawn from a fixed seed and the best of many draws by least distance is kept.

The binary classifiers are naive Bayes models over the same features, so one n-gram count vector per
language, summed by Spark over a bounded sample of labelled rows, trains all of them.

Null text, or text with no letter: ``und``, score 0. No labelled row at all: every row is ``und``.
A text whose n-grams were never seen gets the decoded language of a zero margin and is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release

#: Hashed features, a power of two, shared by byte n-grams of orders 2 to 4.
FEATURES = 1 << 13
ORDERS = (2, 3, 4)
#: Largest number of languages with the exhaustive code.
EXHAUSTIVE = 6
#: Labels that may be languages; more than that is an error in the data, not a model.
MOST = 1000
#: Bytes and texts that are counted at once.
_SLICE, _TEXTS = 1 << 18, 64


def codewords(classes: int) -> np.ndarray:
    """A ±1 matrix, a row per class and a column per binary problem."""
    if classes <= 1:
        return np.ones((classes, 1), np.int8)
    if classes <= EXHAUSTIVE:
        columns = range(1 << (classes - 1), (1 << classes) - 1)
        code = np.array([[1 if c >> (classes - 1 - i) & 1 else -1 for c in columns] for i in range(classes)], np.int8)
        return code
    rng, width = np.random.default_rng(5), int(np.ceil(15 * np.log2(classes)))
    best, least = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, width))
        code = code[:, np.abs(code.sum(0)) < classes]
        # words that agree in one place more than they differ have a product of one: the largest product tells the smallest distance
        likeness = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(likeness, -code.shape[1])
        apart = int(code.shape[1] - likeness.max()) // 2
        if apart > least:
            best, least = code, apart
    return best


def _features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts x FEATURES) of hashed byte n-grams of the lower-cased texts, and their totals."""
    data = [b"\n" + (t or "").lower().encode() + b"\n" for t in texts]
    arr = np.frombuffer(b"".join(data), np.uint8)
    # digits and ASCII marks say nothing about a language
    clean = _CLASS[arr].astype(np.uint32)
    row = np.repeat(np.arange(len(data), dtype=np.int64), [len(x) for x in data]) * FEATURES
    counts = np.zeros(len(data) * FEATURES, np.int64)
    code = clean.copy()
    for order in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(0x01000193) ^ clean[order - 1 :]
        if order in ORDERS:
            h = code * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h >>= np.uint32(32 - 13)
            start = row[: len(h)]
            inside = start == row[order - 1 :]
            counts += np.bincount((start + h)[inside], minlength=len(counts))
    counts = counts.reshape(len(data), FEATURES)
    return counts, counts.sum(1)


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[:65] = 32
_CLASS[91:97] = 32
_CLASS[123:128] = 32


def _slices(texts: pa.Array):
    """First row and the texts of each slice: a batch is never held as Python strings all at once."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    i = 0
    while i < len(sizes):
        j, room = i, 0
        while j < len(sizes) and room < _SLICE and j - i < _TEXTS:
            room += sizes[j]
            j += 1
        yield i, texts.slice(i, j - i).to_pylist()
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i, part in _slices(batch.column(1)):
            counts, _ = _features(part)
            for k, lang in enumerate(langs[i : i + len(part)]):
                held = total.setdefault(lang, np.zeros(FEATURES, np.int64))
                held += counts[k]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "counts"])
    release()


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # FEATURES x bits: log odds of bit +1 against bit -1
    trust: np.ndarray  # bits: weight of each bit's loss


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int = 4000) -> Model:
    """Fit on about ``per_language`` rows of each language, picked by a hash of ``key_col`` (the documented bound).

    The driver receives one count vector per language and task, of FEATURES numbers; the number of
    languages is the number of labels.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_col).alias("pick")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST + 1).collect()}
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} labels are no languages")
    if not sizes:
        return Model((), np.zeros((0, 1), np.int8), np.zeros((FEATURES, 1)), np.ones(1))
    shares = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))))
    picked = rows.where(F.expr("pmod(pick, 1000000)") < F.try_element_at(shares, "lang") * 1_000_000).select("lang", "text")
    parts = picked.mapInArrow(_count, "lang string, counts array<long>")
    summed = parts.select("lang", F.posexplode("counts")).groupBy("lang", "pos").agg(F.sum("col").alias("n"))
    langs = tuple(sorted(sizes))
    counts = np.zeros((len(langs), FEATURES))
    for r in summed.groupBy("lang").agg(F.collect_list(F.struct("pos", "n")).alias("v")).collect():
        at = [x["pos"] for x in r["v"]]
        counts[langs.index(r["lang"]), at] = [x["n"] for x in r["v"]]
    # each language weighs the same, however many rows it had
    rate = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * FEATURES)
    code = codewords(len(langs))
    weights = np.zeros((FEATURES, code.shape[1]))
    for b in range(code.shape[1]):
        on, off = rate[code[:, b] > 0], rate[code[:, b] < 0]
        if len(on) and len(off):
            weights[:, b] = np.log(on.mean(0)) - np.log(off.mean(0))
    # a bit is trusted by how far its two sides lie apart in expectation
    apart = np.array([np.abs((rate * weights[:, b]).sum(1)).min() for b in range(code.shape[1])]) + 1e-6
    return Model(langs, code, weights, apart / apart.sum())


def decode(model: Model, counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, runner-up's distance as a share (the score, 0.5..1 over two languages), and the margins' gap."""
    margins = counts @ model.weights / np.sqrt(np.maximum(totals, 1))[:, None]
    # logistic loss of each codeword's bits, weighted by the bits' trust
    loss = np.logaddexp(0, -margins[:, None, :] * model.code[None]) @ model.trust
    order = np.argsort(loss, axis=1, kind="stable")
    low = loss.min(1, keepdims=True)
    p = np.exp(-(loss - low))
    p /= p.sum(1, keepdims=True)
    best = order[:, 0]
    rows = np.arange(len(best))
    score = p[rows, best]
    gap = score - (p[rows, order[:, 1]] if loss.shape[1] > 1 else 0)
    return best, score, gap


def _predictor(model, ambiguous_gap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            lang, score, unsure = [], [], []
            for _, part in _slices(batch.column(batch.num_columns - 1)):
                letters = [any(map(str.isalpha, t or "")) for t in part]
                if not m.langs or not any(letters):
                    lang += ["und"] * len(part)
                    score += [0.0] * len(part)
                    unsure += [False] * len(part)
                    continue
                best, p, gap = decode(m, *_features(part))
                lang += [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters)]
                score += [s if ok else 0.0 for s, ok in zip(p.tolist(), letters)]
                unsure += [bool(ok and g < ambiguous_gap) for g, ok in zip(gap.tolist(), letters)]
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"],
            )
        release()

    return run


def predict(docs: DataFrame, model: Model, keys: list[str], text_col: str = "text", ambiguous_gap: float = 0.02) -> DataFrame:
    """keys, lang_pred, score (0 to 1) and ambiguous, a row per input row, from the text alone."""
    spark = docs.sparkSession
    rows = docs.select(*keys, F.col(text_col).cast("string").alias("text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{types}, lang_pred string, score double, ambiguous boolean"
    return rows.mapInArrow(_predictor(spark.sparkContext.broadcast(model), ambiguous_gap), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = 4000) -> DataFrame:
    """Train on the rows outside the held-out fold, predict all: doc_id, held_out, lang_pred, score, ambiguous."""
    model = train(docs.where(~held_out()), per_language=per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return predict(rows, model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, whose language was recognised; ``und`` and ambiguous ones go."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = docs.toDF(*inner)
    text = inner[names.index("text")]
    found = predict(rows.withColumn("text", F.col(text)), model, inner)
    return found.where("lang_pred <> 'und' and not ambiguous").select(*(F.col(a).alias(b) for a, b in zip(inner, names)))
