"""Structured Streaming forms of the lifecycle: incremental merge, first-seen detection, open/closed state, run health, screening."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import buckets
from ..operators.screening import screen


def merge_stream(fetches: DataFrame, folder: str, checkpoint: str, stream: str = "fetches") -> StreamingQuery:
    """Merge each micro-batch into the bucketed corpus in ``folder`` (``operators.buckets``). fetches need a ``fetched_at``.

    A batch rewrites only the buckets that hold its ids. The manifest names the stream and its epoch, so that a batch that is
    repeated after a failure changes nothing.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        latest = batch.agg(F.max("fetched_at")).first()[0]
        if latest is not None:
            buckets.merge_into(batch.drop("fetched_at"), folder, F.lit(latest), stream=stream, epoch=epoch)

    return fetches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(events: DataFrame, key: list[str], at: str, horizon: str) -> DataFrame:
    """The first event of each key within the horizon; state older than that is dropped."""
    return events.withWatermark(at, horizon).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, at: str, late: str, window: str, aggregates: dict, by: tuple[str, ...] = ()) -> DataFrame:
    """Aggregates per tumbling window (and ``by``), final once the watermark has passed; later rows are dropped."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, window), *by)
    return grouped.agg(*(c.alias(n) for n, c in aggregates.items())).select(F.col("window.start").alias("window_start"), *by, *aggregates)


class _Day(StatefulProcessor):
    """A day's least fetched and kept and most failed; one timer, at the day's end, set by whatever comes first: a run or a heartbeat."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "fetched double, kept double, failed double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fetched, kept, failed = self.seen.get() if self.seen.exists() else (None, None, None)
        low = lambda a, b: b if a is None else a if b is None else min(a, b)
        high = lambda a, b: b if a is None else a if b is None else max(a, b)
        for r in rows:
            fetched, kept, failed = low(fetched, r["fetched"]), low(kept, r["kept"]), high(failed, r["failed"])
        self.seen.update((fetched, kept, failed))
        self.handle.registerTimer((key[0] + 1) * 86_400_000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        fetched, kept, failed = self.seen.get()
        self.seen.clear()
        yield Row(number=key[0], fetched=fetched, kept=kept, failed=failed)

    def close(self) -> None:
        pass


def run_health(runs: DataFrame, heartbeats: DataFrame, late: str = "1 day", min_fetched: int = 5000, min_kept: int = 100, max_failed: int = 204) -> DataFrame:
    """A row per day, once the watermark has passed its end: least fetched and kept, most failed, and whether a limit is breached.

    runs: at, fetched, kept, failed. heartbeats: at; a tick a day is enough. A tick opens its day, whose timer fires whether or not a run came, so a day
    without one is a row without numbers, and breaches. Ticks also carry the watermark on where no runs come. Append mode; RocksDB state store.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    both = runs.select("at", number("fetched"), number("kept"), number("failed")).unionByName(heartbeats.select("at"), allowMissingColumns=True)
    days = both.withWatermark("at", late).withColumn("number", F.unix_date(F.to_date("at")).cast("long"))
    daily = days.groupBy("number").transformWithState(_Day(), "number long, fetched double, kept double, failed double", "append", "EventTime")
    c = F.col
    breach = c("fetched").isNull() | F.coalesce((c("fetched") < min_fetched) | (c("kept") < min_kept) | (c("failed") > max_failed), F.lit(True))
    return daily.select(F.date_from_unix_date(c("number").cast("int")).alias("day"), "fetched", "kept", "failed", breach.alias("breach"))


def screen_stream(postings: DataFrame, **options) -> DataFrame:
    """The batch screen: a stateless select runs on a stream as it is."""
    return screen(postings, **options)


def gate_counts_stream(screened: DataFrame, at: str, late: str, window: str) -> DataFrame:
    """Failed gates per window."""
    return windowed(screened.withColumn("gate", F.explode("exclusions")), at, late, window, {"n": F.count("*")}, ("gate",))


class _OpenState(StatefulProcessor):
    """First and last event of a key in microseconds, and whether it is open; one event-time timer a key."""

    def __init__(self, days: int):
        self.width = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "first long, last long, open boolean")

    def _wait(self, last: int, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # a timer fires once the watermark has passed last + days
        self.handle.registerTimer(max(-(-(last + self.width) // 1000), watermark + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first, last, is_open = self.span.get() if self.span.exists() else (None, None, False)
        for at in sorted(r["micros"] for r in rows):
            if first is None:
                first = at
                yield Row(id=key[0], change="new", micros=at)
            elif not is_open:
                yield Row(id=key[0], change="reopened", micros=at)
            is_open, last = True, at if last is None else max(last, at)
        self.span.update((first, last, True))
        self._wait(last, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        first, last, is_open = self.span.get()
        if is_open:
            self.span.update((first, last, False))
            yield Row(id=key[0], change="closed", micros=last + self.width)

    def close(self) -> None:
        pass


def open_state(events: DataFrame, id_col: str, at: str, late: str, days: int) -> DataFrame:
    """id, change (new, reopened, closed) and at. A key not seen for ``days`` closes when the watermark passes that.

    Arbitrary state with event-time timers (``transformWithState``, which needs the RocksDB state store). A batch run closes what a trusted
    fetch lacks, which a stream cannot see; the timeout stands in for it. Feed it no events of other sources while one is degraded: without
    events the watermark stands still and no timer fires.
    """
    rows = events.select(F.col(id_col).cast("string").alias("id"), F.col(at).alias("at")).withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    changes = rows.groupBy("id").transformWithState(_OpenState(days), "id string, change string, micros long", "append", "EventTime")
    return changes.select("id", "change", F.timestamp_micros("micros").alias("at"))


class _Earliest(StatefulProcessor):
    """The earliest event of a key: kept until the watermark has passed it, given out once, remembered for a while."""

    def __init__(self, horizon_ms: int, columns: str, names: list[str]):
        self.horizon, self.columns, self.names = horizon_ms, columns, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", f"given boolean, {self.columns}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = tuple(self.best.get()) if self.best.exists() else None
        if known and known[0]:
            return iter(())
        n = len(key)
        found = min(((False, *tuple(r)[n:]) for r in rows), key=lambda r: (r[1], tuple((x is None, x) for x in r[2:])))
        if known is None or (found[1], tuple((x is None, x) for x in found[2:])) < (known[1], tuple((x is None, x) for x in known[2:])):
            if known:
                self.handle.deleteTimer(-(-known[1] // 1000))
            self.best.update(found)
            self.handle.registerTimer(max(-(-found[1] // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        best = tuple(self.best.get())
        if best[0]:
            self.best.clear()
            return
        self.best.update((True, *best[1:]))
        self.handle.registerTimer(max(best[1] // 1000 + self.horizon, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(**dict(zip(self.names, (*key, *best[1:]))))

    def close(self) -> None:
        pass


def earliest(events: DataFrame, key: list[str], at: str, late: str, horizon_days: int = 365) -> DataFrame:
    """The earliest event of each key by its own time, not by arrival; of several at that time the least by the other columns.

    Given out when the watermark has passed it, as nothing earlier can come then; a key is remembered for ``horizon_days`` after its first event.
    """
    rest = [f for f in events.schema.fields if f.name not in (*key, at)]
    fields = "micros long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    rows = events.withWatermark(at, late).select(*key, F.unix_micros(at).alias("micros"), *(f.name for f in rest), at)
    # the time itself only carries the watermark
    slim = rows.groupBy(*key)
    keys = "".join(f"`{k}` {events.schema[k].dataType.simpleString()}, " for k in key)
    found = slim.transformWithState(_Earliest(horizon_days * 86_400_000, fields + f", `{at}` timestamp", [*key, "micros", *(f.name for f in rest), at]), f"{keys}{fields}, `{at}` timestamp", "append", "EventTime")
    return found.select(*key, at, *(f.name for f in rest))


class _Guarded(StatefulProcessor):
    """Postings of a part of a source: when each was last seen, and whether the source is trusted.

    Rows wait in ``waiting`` until the watermark has passed them and are then taken in the order of their times, so that the result
    does not depend on how they were dealt into batches. One timer, at the next thing to happen.
    """

    def __init__(self, days: int):
        self.width = days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, id string, degraded boolean")
        self.seen = handle.getMapState("seen", "id string", "last long, state string")
        self.trust = handle.getValueState("trust", "degraded boolean")

    def _wake(self, moments, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        first = min(moments, default=None)
        if first is not None:
            self.handle.registerTimer(max(-(-first // 1000), watermark + 1))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        came = [(r["micros"], r["id"], r["degraded"]) for r in rows]
        self.waiting.appendList(came)
        timers = [t * 1000 for t in self.handle.listTimers()]
        self._wake([*timers, *(m for m, _, _ in came)], timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        now, later = [r for r in rows if r[0] <= until], [r for r in rows if r[0] > until]
        degraded = self.trust.get()[0] if self.trust.exists() else False
        seen = {k[0]: tuple(v) for k, v in self.seen.iterator()}
        before = dict(seen)
        deadlines = [(last + self.width, i) for i, (last, state) in seen.items() if state == "open"]
        heapq.heapify(deadlines)
        # at one moment health comes first, then what was seen, then what is overdue
        now.sort(key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        resumed: list[tuple[int, str]] = []

        def overdue(moment: int, including: bool):
            """Deadlines before a moment (or at it too): closed, or held while the source is not trusted."""
            while deadlines and (deadlines[0][0] < moment or including and deadlines[0][0] == moment):
                due, i = heapq.heappop(deadlines)
                last, state = seen[i]
                if state == "open" and last + self.width == due:
                    seen[i] = last, "held" if degraded else "closed"
                    yield Row(source=key[0], id=i, change=seen[i][1], micros=due)

        def released(moment: int):
            for at, i in resumed:
                if at < moment and seen[i][1] == "held":
                    seen[i] = seen[i][0], "closed"
                    yield Row(source=key[0], id=i, change="closed", micros=at)
            resumed[:] = [x for x in resumed if x[0] >= moment]

        for at, i, bad in now:
            yield from released(at)
            yield from overdue(at, False)
            if i is None:
                if degraded and not bad:
                    resumed += [(at, j) for j, (_, state) in sorted(seen.items()) if state == "held"]
                degraded = bad
                continue
            last, state = seen.get(i, (at, None))
            if state is None or state == "closed":
                yield Row(source=key[0], id=i, change="new" if state is None else "reopened", micros=at)
            seen[i] = max(last, at), "open"
            heapq.heappush(deadlines, (seen[i][0] + self.width, i))
        yield from released(until + 1)
        yield from overdue(until, True)
        for i, v in seen.items():
            if before.get(i) != v:
                self.seen.updateValue((i,), v)
        self.trust.update((degraded,))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        self._wake([*(r[0] for r in later), *(last + self.width for last, state in seen.values() if state == "open")], until // 1000)

    def close(self) -> None:
        pass


def guarded_state(events: DataFrame, health: DataFrame, late: str, days: int, parts: int = 64) -> DataFrame:
    """source, id, change and at: postings that are new, closed, held or reopened, with closing held back while their source is degraded.

    events: source, id, at (a posting was seen). health: source, degraded, at (the judgement holds until the source's next). A posting not seen
    for ``days`` closes at that moment, or is ``held`` if its source is degraded then; a held one closes at the source's next good
    judgement, unless it is seen by then. Both inputs meet in one state keyed by source and a part of its ids: health goes to all ``parts``,
    so that a source of very many postings is not one task. Append mode; RocksDB state store.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    seen = events.select(F.col("source").cast("string").alias("source"), part.alias("part"), "at", F.col("id").cast("string").alias("id"), F.lit(False).alias("degraded"))
    judged = health.select(F.col("source").cast("string").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "at", F.lit(None).cast("string").alias("id"), F.coalesce("degraded", F.lit(False)).alias("degraded"))
    both = seen.where("id is not null").unionByName(judged).where("source is not null and at is not null").withWatermark("at", late).withColumn("micros", F.unix_micros("at"))
    changes = both.groupBy("source", "part").transformWithState(_Guarded(days), "source string, id string, change string, micros long", "append", "EventTime")
    return changes.select("source", "id", "change", F.timestamp_micros("micros").alias("at"))
