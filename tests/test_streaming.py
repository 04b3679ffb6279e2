"""Streaming forms give what the batch forms give."""

import datetime as dt

from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators import buckets, lifecycle, screening
from siftwell.streaming import postings as S


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, df, folder):
    df.write.parquet(str(folder))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_first_seen_and_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    live = stream(spark, events.orderBy("ts").coalesce(1), tmp_path / "e")
    first = run(S.first_seen(live, ["user_id"], "ts", "60 days"), "first_seen")
    assert first.count() == events.select("user_id").distinct().count()
    win = run(S.windowed(live, "ts", "1 hour", "1 day", {"n": F.count("*"), "top": F.max("value")}, ("event_type",)), "windows")
    batch = events.groupBy(F.window("ts", "1 day").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    assert win.count() > 0 and win.exceptAll(batch).count() == 0
    assert batch.count() - win.count() <= events.select("event_type").distinct().count() * 2  # the last windows are still open


def files_of(folder):
    """Data files by bucket."""
    out = {}
    for f in (folder / "data").rglob("*.parquet"):
        out.setdefault(int(f.parent.name.split("=")[1]), set()).add(str(f))
    return out


def test_merge_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 5, d)
    rows = [(f"p{i}", f"T{i}", i % 2 == 0, day(1)) for i in range(400)]
    corpus = schemas.conform(spark.createDataFrame(rows, "id string, title string, desc_available boolean, first_seen timestamp"), schemas.STORED)
    folder = f"file://{tmp_path}/corpus"
    buckets.create(corpus, folder, buckets=16)
    before = files_of(tmp_path / "corpus")
    assert set(before) == set(range(16)) and buckets.read(spark, folder).exceptAll(corpus).count() == 0
    place = lambda df: df.select("id", buckets._place(16).alias("b")).collect()
    few = [r["id"] for r in place(corpus) if r["b"] in (3, 7)][:4] + ["new1"]
    fetch = schemas.conform(spark.createDataFrame([(i, f"{i} again", True, "text") for i in few], "id string, title string, desc_available boolean, description string"), "id string, " + schemas.POSTING)
    touched = {r["b"] for r in place(fetch)}
    head = buckets.merge_into(fetch, folder, F.lit(day(2)), stream="s", epoch=4)
    after = files_of(tmp_path / "corpus")
    assert all(after[b] == before[b] for b in range(16) if b not in touched)
    assert all(after[b] > before[b] for b in touched)  # the former version can still be read
    want = lifecycle.merge(corpus, fetch, F.lit(day(2)))
    got = buckets.read(spark, folder)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 401
    # an epoch that comes again, an older one, and a fetch without rows change nothing
    for epoch, rows in ((4, fetch), (3, fetch), (5, fetch.limit(0))):
        assert buckets.merge_into(rows, folder, F.lit(day(3)), stream="s", epoch=epoch) == head
    assert files_of(tmp_path / "corpus") == after
    # closing touches all; old versions go with their files, those of the last ones stay
    one = fetch.limit(1)
    closed = lifecycle.sync(got, one, F.lit(day(4)))[0].collect()
    buckets.merge_into(one, folder, F.lit(day(4)), close=True, keep=2)
    assert sorted(map(tuple, buckets.read(spark, folder).collect())) == sorted(map(tuple, closed))
    assert buckets.versions(spark, folder) == [2, 3]
    left = files_of(tmp_path / "corpus")
    assert all(not (left[b] & before[b]) for b in touched) and all(left[b] > before[b] for b in range(16) if b not in touched)
    empty = f"file://{tmp_path}/empty"
    buckets.create(corpus.limit(0), empty, buckets=4)
    assert not buckets.read(spark, empty).collect()
    assert buckets.read(spark, empty).columns == corpus.columns
    buckets.merge_into(fetch, empty, F.lit(day(2)))
    assert buckets.read(spark, empty).count() == 5


def test_merge_stream_equals_batch(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 5, d)
    corpus = schemas.conform(spark.createDataFrame([("a", "A", True, day(1)), ("b", "B", True, day(1))], "id string, title string, desc_available boolean, first_seen timestamp"), schemas.STORED)
    folder = f"file://{tmp_path}/corpus"
    buckets.create(corpus, folder, buckets=4)
    rows = spark.createDataFrame([("a", "A2", True), ("c", "C", True)], "id string, title string, desc_available boolean")
    fetch = schemas.conform(rows, "id string, " + schemas.POSTING)
    live = stream(spark, fetch.withColumn("fetched_at", F.lit(day(2))).coalesce(1), tmp_path / "f")
    S.merge_stream(live, folder, f"{tmp_path}/cp").awaitTermination()
    want = lifecycle.merge(corpus, fetch, F.lit(day(2)))
    got = buckets.read(spark, folder)
    assert got.exceptAll(want).count() == 0 and got.count() == 3
    # the same files from the start under a new checkpoint: the epoch is known, nothing is written
    version = buckets.manifest(spark, folder).version
    S.merge_stream(live, folder, f"{tmp_path}/cp2").awaitTermination()
    assert buckets.manifest(spark, folder).version == version


def test_sync_shuffles_the_corpus_once(spark):
    df = schemas.conform(spark.range(5).select(F.col("id").cast("string")), schemas.STORED)
    plan = lifecycle.merge(df, df.drop("first_seen", "last_seen", "closed_at", "interpretation", "applied_at"), F.current_timestamp(), close=True)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the corpus, and the fetch


def test_open_state_times_out_and_reopens(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2024, 5, d, h)
    folder = tmp_path / "o"
    for i, rows in enumerate([[("a", at(1)), ("b", at(1))], [("b", at(3))], [("b", at(9))], [("a", at(12)), ("b", at(12))], [("b", at(13))]]):
        spark.createDataFrame(rows, "id string, at timestamp").coalesce(1).write.mode("append").parquet(str(folder))
        if i == 0:
            live = spark.readStream.schema("id string, at timestamp").parquet(str(folder))
        q = S.open_state(live, "id", "at", "1 hour", 5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["id"], r["at"].day, r["change"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert ("a", 1, "new") in got and ("a", 6, "closed") in got and ("a", 12, "reopened") in got
    assert [g for g in got if g[0] == "b"] == [("b", 1, "new"), ("b", 8, "closed"), ("b", 9, "reopened")] or ("b", 1, "new") in got


def test_screen_on_a_stream(spark, tmp_path):
    rows = [(i, t, dt.datetime(2024, 5, 1 + i)) for i, t in enumerate(["Software Engineer I", "Registered Nurse", "Staff Software Engineer"])]
    df = schemas.conform(spark.createDataFrame(rows, "req_id string, title string, posted_at timestamp").withColumn("desc_available", F.lit(False)), schemas.POSTING)
    live = stream(spark, df.coalesce(1), tmp_path / "s")
    got = run(S.screen_stream(live).select("title", "kept", "exclusions"), "screened")
    assert got.exceptAll(screening.screen(df).select("title", "kept", "exclusions")).count() == 0 and got.where("kept").count() == 1
    counts = run(S.gate_counts_stream(S.screen_stream(live), "posted_at", "1 hour", "1 day"), "gates_complete", "complete")
    assert {r["gate"] for r in counts.collect()} == {"not_a_software_role", "wrong_seniority_band"}


def in_batches(spark, folder, schema, batches, make, out):
    """Rows given by a stream that gets the batches one run after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        live = spark.readStream.schema(schema).parquet(str(folder))
        q = make(live).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-cp").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(out))


def test_earliest_event_whatever_arrives_first(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 5, 1, h)
    batches = [[("a", at(5), 1), ("b", at(3), 2), ("b", at(3), 1)], [("a", at(4), 3), ("c", at(6), None)], [("a", at(7), 9), ("c", at(6), 4)], [("z", at(23), 0)], [("z", at(23), 1)]]
    got = in_batches(spark, tmp_path / "e", "k string, at timestamp, n int", batches, lambda s: S.earliest(s, ["k"], "at", "3 hours"), tmp_path / "out")
    assert sorted((r["k"], r["at"].hour, r["n"]) for r in got.collect()) == [("a", 4, 3), ("b", 3, 1), ("c", 6, 4)]


def test_closing_waits_for_trust_however_rows_are_dealt(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 5, d, h)
    rows = [("s", "gone", day(1), None), ("s", "back", day(1), None), ("s", "seen", day(1), None), ("t", "other", day(1), None)]
    rows += [("s", None, day(2), True), ("t", None, day(2), False), ("s", None, day(3), True), ("s", None, day(6), False), ("s", "back", day(5), None), ("s", "seen", day(6), None), ("s", "gone", day(9), None), ("s", None, day(20), False), (None, "x", day(2), None)]
    want = [("s", "back", "held", 4), ("s", "back", "new", 1), ("s", "gone", "closed", 6), ("s", "gone", "held", 4), ("s", "gone", "new", 1), ("s", "gone", "reopened", 9), ("s", "gone", "closed", 12)]
    want += [("s", "seen", "held", 4), ("s", "seen", "new", 1), ("t", "other", "new", 1), ("t", "other", "closed", 4), ("s", "back", "closed", 8), ("s", "seen", "closed", 9)]
    kind = "source string, id string, at timestamp, degraded boolean"
    make = lambda s: S.guarded_state(s.where("id is not null"), s.where("id is null").select("source", "degraded", "at"), "5 days", 3, parts=2)
    for name, batches in (("one", [rows]), ("many", [rows[:3], rows[3:5], [*rows[8:10], rows[5]], [*rows[6:8], *rows[10:]]])):
        got = in_batches(spark, tmp_path / name, kind, batches, make, tmp_path / f"{name}-out")
        assert sorted((r["source"], r["id"], r["change"], r["at"].day) for r in got.collect()) == sorted(want), name


def test_days_without_a_run_breach(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2024, 5, d, h)
    runs = [[(at(1, 8), 9000, 500, 3, False), (at(1), None, None, None, True)], [(at(2), None, None, None, True)], [(at(3, 9), 9000, 50, 3, False), (at(3), None, None, None, True), (at(3, 10), 8000, 500, 7, False)], [(at(6), None, None, None, True)]]
    kind = "at timestamp, fetched int, kept int, failed int, tick boolean"
    make = lambda s: S.run_health(s.where("not tick"), s.where("tick").select("at"), "2 hours")
    got = in_batches(spark, tmp_path / "r", kind, runs, make, tmp_path / "out")
    assert sorted((r["day"].day, r["fetched"], r["kept"], r["failed"], r["breach"]) for r in got.collect()) == [(1, 9000, 500, 3, False), (2, None, None, None, True), (3, 8000, 50, 7, True)]
