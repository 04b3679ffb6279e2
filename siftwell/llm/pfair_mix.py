"""Mixing sources to target weights by Pfair scheduling.

The documents of each class (a source with a target weight) form blocks of ``block_docs`` documents. In
a schedule of one block per slot, a fluid schedule serves all classes at once in proportion to their exact weights; when
a class has no blocks left, the shares of the others are scaled up. A block is released at the slot in which the
fluid reaches its start (for block ``j`` of a class of share ``w``, and no class ended: ``floor(j / w)``) and due before the
slot ``ceil((j + 1) / w)`` in which its end is passed; the released block with the earliest deadline goes first. The fluid itself
fits these windows, so no block is late, and at every prefix each class has less than one block more or less than
its weight's share. Windows are computed in whole numbers, without rounding. Nothing is repeated or dropped: every document gets one position.

The slots are laid out by one task that holds two numbers a class and streams a row per block (some microseconds each; a block is ``block_docs``
documents at every size of the corpus). Which of the blocks that are due goes first depends on all slots before, so that this is one
pass in order; a larger ``block_docs`` shortens it. Documents find their block by a count per part of a class and a join, by broadcast only
where blocks are counted few (``BROADCAST_BLOCKS``).

Weights given: sources without one share ``rest_weight`` as one class. None given: every source is a class and weighs its
count to the power ``temperature``. A class of weight zero comes after all others. A null source belongs to the rest. With a
``period``, weights are first rounded to whole numbers over it (at least one each), so that the schedule repeats.
Rows of equal id are ordered by their text's hash; those equal in both get distinct, interchangeable places. The rest is a class apart even
from a source that bears its name.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: A class is ordered in 2 to this power parts by hash, so that no task orders a large class.
SALT_BITS = 10
#: Slots of at most this many blocks are broadcast, else documents meet them in a join by shuffle.
BROADCAST_BLOCKS = 200_000
REST = "(rest)"
_NAMED = "="  # before the names of sources, so that none is the rest's


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers, one at least, that add up to the period (or the number of classes, if larger), by largest remainder."""
    total = sum(weights.values())
    period = max(period, len(weights))
    spare = period - len(weights)
    exact = {c: w / total * spare for c, w in weights.items()}
    out = {c: 1 + int(x) for c, x in exact.items()}
    for c in sorted(exact, key=lambda c: (int(exact[c]) - exact[c], c))[: period - sum(out.values())]:
        out[c] += 1
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int, int]]:
    """Class, block, release, deadline and slot of every block, slot by slot."""
    start = 0
    for weighty in (True, False):
        names = sorted(c for c, n in blocks.items() if n and (weights[c] > 0) is weighty)
        n, w = [blocks[c] for c in names], [Fraction(weights[c]) if weighty else Fraction(1) for c in names]
        scale = lcm(*(x.denominator for x in w))
        w = [int(x * scale) for x in w]
        order = sorted(range(len(names)), key=lambda i: Fraction(n[i], w[i]))
        ends = [Fraction(n[i], w[i]) for i in order]
        # of the first k classes to end: their blocks, and the weight of those that go on
        done, live = [0], [sum(w)]
        for i in order:
            done.append(done[-1] + n[i])
            live.append(live[-1] - w[i])
        ended = [0] * len(names)

        def served(i: int, j: int) -> tuple[int, int]:
            """Floor and ceiling of the time at which the fluid has served j blocks of class i."""
            k = ended[i]
            if k < len(order) and n[order[k]] * w[i] <= j * w[order[k]]:
                k = ended[i] = bisect_right(ends, Fraction(j, w[i]), k)
            whole, part = divmod(live[k] * j, w[i])
            return done[k] + whole, done[k] + whole + (part > 0)

        waiting = [(0, i, 0) for i in range(len(names))]  # release, class, block
        heapify(waiting)
        ready: list[tuple[int, int, int, int, int]] = []  # deadline, class, block, release, release of the next block
        for t in range(sum(n)):
            while waiting and waiting[0][0] <= t:
                release, i, j = heappop(waiting)
                following, deadline = served(i, j + 1)
                heappush(ready, (deadline, i, j, release, following))
            deadline, i, j, release, following = heappop(ready)
            yield names[i], j, start + release, start + deadline, start + t
            if j + 1 < n[i]:
                heappush(waiting, (following, i, j + 1))
        start += sum(n)


def edf(k: dict[str, int]) -> list[tuple[str, int]]:
    """One period of whole-number weights: the class and its block for each slot."""
    return [(c, j) for c, j, *_ in schedule(k, k)]


def _layout(block_docs: int, period: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, int] = {}
        weights: dict[str, float] = {}
        for batch in batches:
            for c, n, weight in zip(*(column.to_pylist() for column in batch.columns)):
                blocks[c], weights[c] = -(-n // block_docs), weight
        if period and weights:
            weights = shares(weights, period)
        total = sum(weights.values())
        kinds = [pa.string(), *[pa.int64()] * 4, pa.float64()]
        names = ["tclass", "tblock", "release", "deadline", "slot", "weight"]
        batched: list[tuple] = []
        for row in schedule(blocks, weights):
            batched.append((*row, weights[row[0]] / total if total else 0.0))
            if len(batched) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*batched), kinds)], names=names)
                batched = []
        if batched:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*batched), kinds)], names=names)

    return run


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, rest_weight: float = 1.0, block_docs: int = 64, period: int | None = None,
    temperature: float = 0.7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """A row per input row: doc_id, source, class, weight (of its class when all are there), block, release, deadline and
    slot (of the whole schedule), position (of the document; 0 to n-1 but for gaps that part-filled last blocks leave)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(id_col).alias("order"), F.xxhash64(text_col).alias("tie"))
    return place(rows, weights, rest_weight, block_docs, period, temperature).select(
        "doc_id", "source", "class", "weight", "block", "release", "deadline", "slot", "position"
    )


def with_places(
    docs: DataFrame, weights: dict[str, float] | None = None, rest_weight: float = 1.0, block_docs: int = 64, period: int | None = None,
    temperature: float = 0.7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``docs``, and the slot and position of each in the schedule (``_siftwell_``-prefixed)."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, inner))
    rows = docs.toDF(*inner).withColumn("source", F.col(at[source_col]).cast("string")).withColumn("order", F.xxhash64(at[id_col])).withColumn("tie", F.xxhash64(at[text_col]))
    placed = place(rows, weights, rest_weight, block_docs, period, temperature)
    return placed.select(*(F.col(a).alias(b) for a, b in zip(inner, names)), F.col("slot").alias("_siftwell_slot"), F.col("position").alias("_siftwell_position"))


def in_mix_order(docs: DataFrame, **parameters) -> DataFrame:
    """All rows and columns of ``docs``, laid out in the order of the schedule: partitions by ranges of positions, each sorted.

    The order holds for this DataFrame only: Spark may read its files in another one. What is to last takes :func:`with_places`.
    """
    placed = with_places(docs, **parameters).repartitionByRange("_siftwell_position").sortWithinPartitions("_siftwell_position")
    return placed.drop("_siftwell_slot", "_siftwell_position")


def place(rows: DataFrame, weights, rest_weight, block_docs, period, temperature) -> DataFrame:
    """The columns of the schedule beside all of ``rows``, which hold ``source``, ``order`` and ``tie``."""
    spark = rows.sparkSession
    if weights is None:
        of_class = F.coalesce(F.concat(F.lit(_NAMED), "source"), F.lit(REST))
    else:
        weights = {_NAMED + c: float(w) for c, w in weights.items() if w > 0}
        own = F.concat(F.lit(_NAMED), "source")
        of_class = F.when(own.isin(list(weights)) if weights else F.lit(False), own).otherwise(F.lit(REST))
    salted = rows.withColumn("class", of_class).withColumn("salt", F.shiftrightunsigned("order", 64 - SALT_BITS).cast("int"))
    sizes = materialise(salted.groupBy("class", "salt").agg(F.count("*").alias("n")), "mix-sizes")
    total = sizes.groupBy("class").agg(F.sum("n").alias("n"))
    if weights is None:
        weighed = total.withColumn("weight", F.pow("n", F.lit(float(temperature))))
    else:
        given = spark.createDataFrame(list(weights.items()), "class string, weight double")
        weighed = total.join(F.broadcast(given), "class", "left").withColumn("weight", F.coalesce("weight", F.lit(float(rest_weight))))
    layout = weighed.select("class", "n", "weight").repartition(1).mapInArrow(
        _layout(block_docs, period), "tclass string, tblock long, release long, deadline long, slot long, weight double"
    )
    slots = materialise(layout, "mix-slots")
    if slots.count() <= BROADCAST_BLOCKS:
        slots = F.broadcast(slots)
    earlier = Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("class", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = (
        salted.withColumn("nth", F.row_number().over(Window.partitionBy("class", "salt").orderBy("order", "tie")))
        .join(offset, ["class", "salt"])
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
        .withColumn("block", F.expr(f"rank div {block_docs}"))
    )
    placed = ranked.join(slots, F.expr("class = tclass and block = tblock"))
    name = F.when(F.col("class") == REST, REST).otherwise(F.substring("class", len(_NAMED) + 1, 1 << 30))
    return placed.withColumn("position", F.expr(f"slot * {block_docs} + rank % {block_docs}")).withColumn("class", name)
