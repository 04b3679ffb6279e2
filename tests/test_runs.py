"""Whole runs over small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators import inbox, paging, runs, scoring, screening
from test_operators import T0, T1, T2, at, demo


def test_discovery(spark):
    rows = [(0, "", "https://jobs.lever.co/acme/1"), (1, "Acme", "jobs.lever.co/acme/2"), (2, "B", "https://careers.icims.com/x"), (3, "C", "https://example.com/x"), (4, "", ""), (5, "W", "https://w.wd1.myworkdayjobs.com/Site")]
    watch, counters, others = runs.discover(spark.createDataFrame(rows, "ordinal int, company string, url string"))
    assert [tuple(r) for r in watch.collect()] == [("acme", "lever", "acme", "", ""), ("W", "workday", "w", "wd1", "Site")]
    assert tuple(counters.first()) == (6, 4, 3, 4 / 6)
    assert {tuple(r) for r in others.collect()} == {("unsupported", "icims", 1), ("unknown_host", "example.com", 1)}


def test_daily_run_and_reads(spark, tmp_path):
    fetch = demo(spark).drop("id").withColumn("ordinal", F.col("n"))
    corpus = schemas.conform(demo(spark).where("n in (1, 2)").withColumn("first_seen", at(T0)), schemas.STORED)
    gone = schemas.conform(spark.createDataFrame([("gone", "Developer", "https://x/gone")], "id string, title string, url string").withColumn("desc_available", F.lit(False)), schemas.STORED)
    sources = spark.createDataFrame([("a", False, "")], "source string, failed boolean, label string")
    folder = f"file://{tmp_path}/run"
    posting = schemas.conform(fetch, schemas.POSTING).withColumn("ordinal", F.monotonically_increasing_id())
    out = runs.daily_run(corpus.unionByName(gone), posting, sources, at(T2), folder).first()
    # five equal rows and two of the same title collapse; one known row and the gone one are not in the fetch
    assert (out["fetched"], out["unique"], out["new"], out["closed"], out["not_closed"], out["degraded"]) == (15, 10, 9, 2, None, False)
    assert out["screened"] == 10 and out["kept"] + out["excluded"] == 10
    from siftwell.operators.lifecycle import read_snapshot

    stored = read_snapshot(spark, f"{folder}/corpus")
    rows = screening.read_generation(spark, f"{folder}/views", out["generation"])
    page = runs.read_view(rows, stored, "kept", 3, mine=["Python"])
    assert page.count() == 3 and page.first()["matched"] == out["kept"] and "score" in page.columns
    same = runs.read_published(spark, f"{folder}/views", stored, "kept", 3, mine=["Python"])
    assert sorted(map(str, same.select(*page.columns).collect())) == sorted(map(str, page.collect()))
    excluded = runs.read_excluded(rows, 1)
    assert excluded.count() == excluded.select("gate").distinct().count()
    one = runs.detail(stored, rows.where("view = 'kept'").first()["posting_id"], ["Python"]).first()
    assert one["kept"] and one["first_seen"] is None
    runs.write_document(rows, stored, f"{folder}/doc")
    head = spark.read.json(f"{folder}/doc/summary").first()
    assert (head["items_total"], head["internships_total"], head["gates"]["wrong_seniority_band"]) == (out["kept"], 1, 1)
    items = spark.read.json(f"{folder}/doc/items")
    assert items.count() == out["kept"] and "description" not in items.columns and "levelWhy" in items.columns
    with pytest.raises(ValueError, match="items: wrote"):
        runs.write_document(rows, stored.limit(3), f"{folder}/short")
    again = runs.daily_run(stored, posting, sources, at(T2 + dt.timedelta(hours=1)), folder).first()
    assert (out["rescreened"], again["rescreened"], again["kept"], again["gates"]) == (10, 0, out["kept"], out["gates"])
    empty = runs.daily_run(stored, posting.limit(0), sources, at(T2 + dt.timedelta(days=1)), folder).first()
    assert (empty["not_closed"], empty["closed"], empty["new"]) == ("empty_fetch", 0, 0)


def test_published_pages_open_few_files_and_count_from_the_cube(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    n = F.col("id")
    moment = F.when(n % 11 != 0, F.timestamp_micros(F.lit(1_704_067_200_000_000) + (n * 7919) % 4000 * 3_600_000_000 + (n % 7 - 3)))
    base = spark.range(6000).select(
        F.when(n % 3 == 0, "kept").otherwise("internships").alias("view"), moment.alias("posted_at"), F.concat(F.lit("p"), n.cast("string")).alias("posting_id"), F.lit(True).alias("kept"),
        F.element_at(F.array(*map(F.lit, ("entry", "intern", "unknown"))), (n % 3 + F.when(n % 2 == 0, 0).otherwise(1)).cast("int") % 3 + 1).alias("level"), F.lit("").alias("gate"), F.lit(True).alias("leads"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        generation = screening.publish(base, folder, F.lit(0), at(T0))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = screening.read_generation(spark, folder, generation)
    total = spark.read.parquet(f"{folder}/files/generation={generation}").where("view = 'kept'").count()
    assert total > 10
    day = lambda d, *t: dt.datetime(2024, 2, d, *t)
    cases = [
        {}, {"levels": ["entry"]}, {"levels": ["entry", "unknown"], "posted_after": day(3)}, {"posted_after": day(3, 7, 30), "posted_before": day(20, 12)}, {"posted_before": day(2)},
        {"posted_after": dt.datetime(2030, 1, 1)}, {"posted_after": day(3), "include_undated": True}, {"include_undated": False}, {"levels": ["none"]}, {"posted_after": day(9, 5), "posted_before": day(9, 6)},
    ]
    starts = ((25, None), (25, (day(10, 3), "p5")), (3, (None, "p3")), (5000, None), (25, (dt.datetime(2023, 1, 1), "x")))
    for i, filters in enumerate(cases):
        for limit, boundary in (starts[i % 5], starts[(i + 1) % 5]):
            page = paging.published_page(spark, folder, generation, "kept", limit, boundary, **filters)
            want = paging.filtered_page(rows.where("view = 'kept'"), paging.row_filter(**filters), limit, boundary)
            get = lambda df: sorted((r["position"], r["posting_id"], r["posted_at"], r["more"], r["matched"]) for r in df.collect())
            assert get(page) == get(want), (filters, limit, boundary)
    top = paging.published_page(spark, folder, generation, "kept", 25, levels=["entry"], posted_after=day(3))
    assert len(top.inputFiles()) <= 3 < total
    screening.expire(spark, folder, at(T2 + dt.timedelta(days=30)))
    assert not list((tmp_path / "v" / "cube").iterdir()) and not list((tmp_path / "v" / "files").iterdir())


def test_delta_screening_carries_rows_over(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    rows = schemas.conform(demo(spark), schemas.STORED)
    first, n = screening.rescreen(rows, None, folder)
    total = rows.count()
    assert n == total and first.drop("judged").exceptAll(screening.view_rows(screening.screen(rows))).count() == 0
    # a former generation that says of every row where it comes from
    marked = first.withColumn("reason", F.lit("carried over"))
    screening.publish(marked, folder, F.lit(0), at(T0))
    former = screening.newest_rows(spark, folder)
    ids = sorted(r["id"] for r in rows.select("id").distinct().collect())
    changed, gone = ids[0], ids[1]
    now = rows.where(F.col("id") != gone).withColumn("description", F.when(F.col("id") == changed, "An active security clearance is needed.").otherwise(F.col("description")))
    now = now.withColumn("desc_available", F.col("desc_available") | (F.col("id") == changed))
    got, n = screening.rescreen(now, former, folder)
    assert n == 1
    by = {True: set(), False: set()}
    for r in got.collect():
        by[r["reason"] == "carried over"].add(r["posting_id"])
    assert by[False] == {changed} and by[True] == set(ids) - {changed, gone}
    want = screening.view_rows(screening.screen(now))
    assert got.drop("judged", "reason").exceptAll(want.drop("reason")).count() == 0 and got.count() == want.count()
    # more than may be broadcast: by shuffle, the same rows
    screening.DELTA_ROWS, few = 0, screening.DELTA_ROWS
    try:
        again = screening.rescreen(now, former, folder)[0]
        assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    finally:
        screening.DELTA_ROWS = few
    # other rules, or rows without digests: everything anew
    assert screening.rescreen(now, former, folder, wanted=("mid",))[1] == now.count() == screening.rescreen(now, former.drop("judged"), folder)[1]
    assert screening.rules_version() != screening.rules_version(include_internships=True)


def test_comparison_and_briefings(spark, tmp_path):
    rows = demo(spark).withColumn("ordinal", F.col("n"))
    ranked = scoring.keyword_rank(rows, min_score=10, limit=8)
    got = {r["label"]: tuple(r)[1:] for r in runs.compare_with_rank(screening.screen(rows), ranked).collect()}
    assert got["junior"][:2] == (9, 8) and got["senior"] == (1, 0, 0)
    mail = inbox.triage(spark.createDataFrame([("a@lever.co", "thank you for applying", "")], "sender string, subject string, snippet string"))
    jobs = spark.createDataFrame([("1", "T", "C", 5)], "id string, title string, company string, score int")
    for moment in (T0, T2, T1):
        runs.save_briefing(inbox.briefing(mail, jobs, at(moment)), f"file://{tmp_path}/b", "u")
    assert runs.briefings(spark, f"file://{tmp_path}/b", "u").first()["generated_at"] == T2
    assert paging.by_recency("a", "b")
