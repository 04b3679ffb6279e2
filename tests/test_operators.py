"""Sources, lifecycle, screening, paging, scoring, selection, audit, backlog, quality: golden rows."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators import audit, backlog, inbox, lifecycle, paging, quality, scoring, screening, selection
from siftwell.sources import boards, feeds

T0, T1, T2 = (dt.datetime(2024, 5, d, 9) for d in (1, 2, 3))


def at(moment):
    return F.lit(moment).cast("timestamp")


def payloads(spark, *docs, **columns):
    rows = spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "payload string")
    return rows.withColumns({k: F.lit(v) for k, v in ({"tenant": "acme"} | columns).items()})


# --- sources ---------------------------------------------------------------------------------------------------


def test_nested_jobs(spark):
    jobs = {"jobs": [
        {"title": "Dev", "absolute_url": "https://x/1", "content": "&lt;p&gt;Hi&lt;/p&gt;&lt;script&gt;a()&lt;/script&gt;", "location": {"name": "Oslo"}, "id": 7, "updated_at": "2024-01-02T00:00:00Z"},
        {"title": "No url"}, {"title": "", "absolute_url": "https://x/2"},
        {"title": "Bare", "absolute_url": "https://x/3", "company_name": "Beta", "first_published": "2024-02-01", "updated_at": "2024-03-01", "requisition_id": "R1"},
    ]}
    got = {r["url"]: r for r in boards.nested_jobs(payloads(spark, jobs, "garbage", "[]")).collect()}
    assert set(got) == {"https://x/1", "https://x/3"}
    a, b = got["https://x/1"], got["https://x/3"]
    assert (a["company"], a["location"], a["description"], a["desc_available"], a["req_id"], a["posted_at"]) == ("acme", "Oslo", "Hi", True, "7", dt.datetime(2024, 1, 2))
    assert (b["company"], b["desc_available"], b["req_id"], b["posted_at"], b["remote"]) == ("Beta", False, "R1", dt.datetime(2024, 2, 1), None)


def test_listed_jobs_hides_only_a_literal_false(spark):
    job = lambda i, **k: {"title": "Dev", "jobUrl": f"https://x/{i}", "id": str(i)} | k
    jobs = {"jobs": [job(1, isListed=False), job(2, isListed=None, isRemote=True, descriptionPlain="plain", descriptionHtml="<p>html</p>"), job(3, descriptionHtml="<p>html</p>", isRemote=False)]}
    got = {r["req_id"]: r for r in boards.listed_jobs(payloads(spark, jobs)).collect()}
    assert set(got) == {"2", "3"}
    assert (got["2"]["description"], got["2"]["remote"], got["3"]["description"], got["3"]["remote"]) == ("plain", True, "html", False)


def test_array_jobs(spark):
    jobs = [
        {"text": "Dev", "hostedUrl": "https://x/1", "descriptionPlain": "a", "additionalPlain": "b", "createdAt": 1700000000123, "workplaceType": "Remote", "categories": {"commitment": "Intern"}},
        {"text": "Dev", "applyUrl": "https://x/2", "description": "<p>c</p>", "workplaceType": "onsite"},
    ]
    got = {r["url"]: r for r in boards.array_jobs(payloads(spark, jobs, "{}")).collect()}
    a, b = got["https://x/1"], got["https://x/2"]
    assert (a["description"], a["remote"], a["employment_type"], a["posted_at"].microsecond) == ("a\n\nb", True, "Intern", 123000)
    assert (b["description"], b["remote"], b["posted_at"]) == ("c", None, None)


def test_search_widget_and_title_jobs(spark):
    page = {"jobs": [
        {"id": "1", "url": "https://x/1", "title": "Dev", "company": {"title": "Acme"}, "location": {"city": "Rome", "countryName": "Italy"}, "workplace": "remote"},
        {"id": "2", "url": "https://x/2", "title": "Dev", "company": "Beta", "location": "Paris", "workplace": "hybrid", "updated": "2024-01-01"}, {"id": "3", "url": "https://x/3", "title": "Dev"},
    ], "nextPageToken": "n"}
    got = {r["req_id"]: r for r in boards.search_jobs(payloads(spark, page)).collect()}
    assert [(got[i]["company"], got[i]["location"], got[i]["remote"]) for i in "123"] == [("Acme", "Rome, Italy", True), ("Beta", "Paris", False), ("", "", None)]
    assert boards.search_tokens(payloads(spark, page, {})).select("next_token").rdd.map(lambda r: r[0]).collect() == ["n", ""]
    widget = {"name": "Acme Inc", "jobs": [{"title": "Dev", "shortlink": "https://x/s", "full_description": "<p>f</p>", "city": "Bonn", "shortcode": "S", "created_at": "2024-01-01"}]}
    w = boards.widget_jobs(payloads(spark, widget)).first()
    assert (w["company"], w["url"], w["description"], w["location"], w["req_id"]) == ("Acme Inc", "https://x/s", "f", "Bonn", "S")
    titles = {"jobPostings": [{"externalPath": "/job/a_R12", "title": "Dev", "remoteType": "Fully Remote"}, {"title": "no path"}]}
    t = boards.title_jobs(payloads(spark, titles, wd="wd1", site="Careers")).collect()
    assert [(r["url"], r["req_id"], r["desc_available"], r["remote"]) for r in t] == [("https://acme.wd1.myworkdayjobs.com/Careers/job/a_R12", "R12", False, True)]
    landed = payloads(spark, titles, ats="workday", wd="wd1", site="s").unionByName(payloads(spark, widget, ats="workable", wd="", site=""))
    assert boards.normalise(landed).count() == 2
    with pytest.raises(Exception, match="no source for"):
        boards.normalise(landed.withColumn("ats", F.lit("other"))).collect()
    assert [r["source_order"] for r in boards.fan_in(boards.normalise(landed), w and boards.widget_jobs(payloads(spark, widget))).collect()].count(1) == 1


def test_pages_stop_when_they_wrap(spark):
    rows = spark.createDataFrame([("b", 0, ["x", "y"]), ("b", 1, ["z"]), ("b", 2, ["y", "x"]), ("b", 3, ["w"]), ("c", 0, ["x"]), ("c", 1, []), ("c", 2, ["v"])], "board string, page int, paths array<string>")
    assert sorted(map(tuple, boards.drop_wrapped_pages(rows, ["board"], "page", "paths").select("board", "page").collect())) == [("b", 0), ("b", 1), ("c", 0)]
    walk = spark.createDataFrame([("w", "a", 0, 0), ("w", "b", 0, 1), ("w", "a", 1, 0), ("w", "c", 1, 1), ("w", "a", 2, 0), ("w", "d", 3, 0)], "walk string, id string, page int, pos int")
    assert sorted(r["id"] for r in boards.fresh_rows(walk, ["walk"], "id", "page", "pos").collect()) == ["a", "b", "c"]


def test_watchlist_and_feeds(spark, tmp_path):
    rows = [{"company": "A", "ats": " Greenhouse ", "tenant": "a"}, {"ats": "workday", "tenant": "w", "wd": "wd1"}, {"ats": "nope", "tenant": "x"}, {"ats": "lever", "tenant": "leverdemo"}, {"ats": "lever", "tenant": ""}]
    for name, doc in (("a.json", {"companies": rows}), ("b.json", rows)):
        (tmp_path / name).write_text(json.dumps(doc))
        assert [(r["ats"], r["tenant"]) for r in feeds.watchlist_file(spark, f"file://{tmp_path}/{name}").collect()] == [("greenhouse", "a")]
    assert feeds.watchlist_file(spark, f"file://{tmp_path}/none.json").count() == 0
    assert feeds.watchlist_file(spark, f"file://{tmp_path}/b.json", allow_sandbox=True).count() == 2
    (tmp_path / "p.json").write_text(json.dumps([{"title": "Dev", "url": "u", "posted_at": "2024-01-01T00:00:00Z"}]))
    assert feeds.posting_file(spark, f"file://{tmp_path}/p.json").first()["company"] == ""
    m = spark.createDataFrame([((([("From", "a"), ("SUBJECT", "s1"), ("Subject", "s2")]),), None)], "payload struct<headers:array<struct<name:string,value:string>>>, snippet string")
    assert tuple(feeds.mail(m).first()) == ("a", "s2", "")
    jobs = spark.createDataFrame([(f"t{i}", "c", None, f"u{i}", float(70 + i) + 0.5, i, "new" if i else "old") for i in range(12)], "title string, company string, location string, url string, match_score double, fetched_at int, status string")
    seen = lifecycle.with_id(jobs.where("url = 'u11'")).select("id")
    got = feeds.new_scored_jobs(jobs, seen, most=3).collect()
    assert [(r["title"], r["score"], r["location"]) for r in got] == [("t10", 80, ""), ("t9", 80, ""), ("t8", 78, "")]
    scraped = spark.createDataFrame([(0, None, "Backend Engineer", "u1", "python aws"), (1, "Senior Engineer", None, "u2", "python aws backend"), (2, "Engineer", None, "u3", "nothing")], "ordinal int, title string, positionName string, link string, description string")
    assert [(r["title"], r["score"]) for r in feeds.scraped_jobs(scraped).collect()] == [("Backend Engineer", 30)]


def test_answers_are_found_in_free_text(spark):
    texts = spark.createDataFrame([("1", 'Here: ```json\n{"answers": [{"id": "a", "band": "entry", "min_years": 2}]}\n```'), ("2", '[{"id": "b", "min_years": true}]'), ("3", "nothing { broken"), ("4", None)], "r string, t string")
    got = {x["id"]: x for x in feeds.answers(texts, "r", "t").collect()}
    assert (got["a"]["min_years"], got["a"]["confidence"], got["a"]["bad_years"]) == (2, "low", False)
    assert (got["b"]["min_years"], got["b"]["bad_years"]) == (None, True) and len(got) == 2
    assert feeds.first_json('{bad} then {"x": {"y": [1]}}') == {"x": {"y": [1]}} and feeds.first_json("none") is None


def plain_first_json(raw):
    for opener in "{[":
        at = raw.find(opener)
        while at >= 0:
            try:
                return json.JSONDecoder().raw_decode(raw, at)[0]
            except json.JSONDecodeError:
                at = raw.find(opener, at + 1)
    return None


def test_first_json_is_the_decoders_and_linear():
    rng = random.Random(5)
    bits = ["{", "}", "[", "]", '"', '"a"', ":", ",", " ", "1", "-0.5e3", "01", "true", "nul", "null", "NaN", "-Infinity", "\\", '\\"', "\\u00e9", "\\x", "\n", "\t", "x", '{"a":1}', "[1,2]", '"k":', '{"k":[]}', '":"', '{}']
    for _ in range(60_000):
        raw = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert repr(feeds.first_json(raw)) == repr(plain_first_json(raw)), raw
    hostile = ["[" * 100_000, '{"a":' * 60_000, '{"' * 60_000, '{":"' * 60_000, "{" * 100_000 + "}" * 100_000, '[{"a":' * 40_000 + "1", '{"a": "' + "{" * 100_000, '{"\\' * 50_000, "[[" * 50_000 + "]" * 99_999, "[1," * 60_000, "{}x" * 3 + "1" * 9000]
    began = time.monotonic()
    for raw in hostile:
        feeds.first_json("x " + raw)
    assert time.monotonic() - began < 20
    assert feeds.first_json("x " + "[" * 100_000) is None and feeds.first_json("[" * 5000 + "]" * 5000) is None and feeds.first_json("[" + "9" * 9000 + "]") is None
    assert feeds.first_json("[" * 100_000 + '{"a": 1}') == {"a": 1} and feeds.first_json("[" * 200 + "]" * 200) is not None


def test_a_bad_answer_loses_only_itself(spark):
    rows = [("1", "[" * 100_000), ("2", '{"answers": [{"id": "a", "evidence": "\\ud800 half"}]}'), ("3", "{" * 50_000 + '"answers": [{"id": "b"}]}'), ("4", '[{"id": "c"}, 3, null, {"id": 7}]'), ("5", '{"answers": ' + "9" * 9000 + "}")]
    got = sorted((r["round"], r["position"], r["id"]) for r in feeds.answers(spark.createDataFrame(rows, "r string, t string"), "r", "t").collect())
    assert got == [("2", 0, "a"), ("3", 0, "b"), ("4", 0, "c"), ("4", 3, None)]


# --- lifecycle ---------------------------------------------------------------------------------------------------


def stored(spark, rows):
    return schemas.conform(spark.createDataFrame(rows, "id string, title string, company string, description string, desc_available boolean, first_seen timestamp, closed_at timestamp"), schemas.STORED)


def fetched(spark, rows):
    return schemas.conform(spark.createDataFrame(rows, "id string, title string, company string, description string, desc_available boolean"), "id string, " + schemas.POSTING)


def test_merge_close_reopen(spark):
    corpus = stored(spark, [("a", "A", "c", "real", True, T0, None), ("b", "B", "c", "", False, T0, None), ("c", "C", "c", "x", True, T0, T1), ("d", "D", "c", "x", True, T0, None)])
    fetch = fetched(spark, [("a", "A2", "other", "", False), ("b", "B", "c", "now", True), ("c", "C", "c", "x", True), ("e", "E", "c", "", False), ("e", "E", "c", "longer", True)])
    got = {r["id"]: r for r in lifecycle.sync(corpus, fetch, at(T2))[0].collect()}
    assert (got["a"]["title"], got["a"]["description"], got["a"]["company"], got["a"]["first_seen"], got["a"]["last_seen"]) == ("A2", "real", "c", T0, T2)
    assert (got["b"]["description"], got["b"]["desc_available"]) == ("now", True)
    assert (got["c"]["closed_at"], got["c"]["first_seen"], got["d"]["closed_at"]) == (None, T0, T2)
    assert (got["e"]["first_seen"], got["e"]["description"]) == (T2, "longer") and len(got) == 5
    same, refused = lifecycle.sync(corpus, fetch.limit(0), at(T2))
    assert refused == "empty_fetch" and same.where("closed_at is null").count() == 3
    sources = spark.createDataFrame([(f"s{i}", i < 3, f"E{i}: x") for i in range(10)], "source string, failed boolean, label string")
    assert lifecycle.sync(corpus, fetch, at(T2), sources)[1] == "degraded_fetch"
    health = lifecycle.source_health(sources).first()
    assert (health["failed"], health["degraded"], len(health["failures"])) == (3, True, 3)
    assert lifecycle.source_health(sources.limit(0)).first()["degraded"] is False
    known, new = lifecycle.split_known(fetch, corpus)
    assert (known.count(), new.count()) == (3, 1)
    assert tuple(lifecycle.stats(corpus).first()) == (4, 3, 1, 0, 0)
    assert [r["id"] for r in lifecycle.changed_since(lifecycle.merge(corpus, fetch, at(T2)), at(T1)).collect()] == ["e"]


def test_events_and_snapshots(spark, tmp_path):
    corpus = stored(spark, [("a", "A", "c", "x", True, T0, None), ("b", "B", "c", "x", True, T0, None)])
    once = lifecycle.mark_applied(corpus, spark.createDataFrame([("a", T2), ("a", T1), ("zz", T1)], "id string, at timestamp"))
    twice = lifecycle.mark_applied(once, spark.createDataFrame([("a", T0)], "id string, at timestamp"))
    assert {r["id"]: r["applied_at"] for r in twice.collect()} == {"a": T1, "b": None}
    saved = lifecycle.save_interpretations(corpus, spark.createDataFrame([("b", "{}"), ("q", "{}")], "id string, payload string"))
    assert {r["id"]: r["interpretation"] for r in saved.collect()} == {"a": None, "b": "{}"}
    folder = f"file://{tmp_path}/corpus"
    lifecycle.write_snapshot(corpus, folder)
    lifecycle.write_snapshot(twice.drop("experience_level"), folder)
    back = lifecycle.read_snapshot(spark, folder)
    several = spark.createDataFrame([("b", "x"), ("b", "{}")], "id string, payload string")
    assert sorted((r["id"], r["interpretation"]) for r in lifecycle.save_interpretations(corpus, several).collect()) == [("a", None), ("b", "{}")]
    for _ in range(2):
        lifecycle.write_snapshot(corpus, f"{folder}_few", keep=1)
    assert len(list((tmp_path / "corpus_few").glob("run=*"))) == 1 and lifecycle.read_snapshot(spark, f"{folder}_few").count() == 2
    assert back.where("applied_at is not null").count() == 1 and back.first()["experience_level"] == ""
    copies = spark.createDataFrame([(0, " Acme", "Dev", "ab"), (1, "acme", "dev ", "abcd"), (2, "ACME", "DEV", "wxyz"), (3, "b", "dev", None)], "ordinal int, company string, title string, description string")
    assert [(r["ordinal"], r["first_ordinal"]) for r in lifecycle.best_copies(copies).orderBy("first_ordinal").collect()] == [(1, 0), (3, 3)]
    items = spark.createDataFrame([("u", "1"), ("u", "2")], "user_id string, job_id string")
    assert lifecycle.surfaced(items, items).count() == 2


# --- the fifteen-row corpus -----------------------------------------------------------------------------------------


def demo(spark):
    row = lambda i, title, text="Build things.", days=1, company="Acme", kind="", tenant="acme", available=True: (
        i, title, company, tenant, f"https://x/{i}", text if available else "", available, None if days is None else dt.datetime(2024, 5, 20) - dt.timedelta(days=days), kind)
    rows = [row(i, "Software Engineer I", "Junior role.", i) for i in range(1, 6)]
    rows += [
        row(6, "New Grad Software Engineer", days=2), row(7, "Junior Software Engineer", days=None), row(8, "Software Engineering Intern", kind="Intern"),
        row(9, "Marketing Intern", kind="Intern"), row(10, "Staff Software Engineer", "10+ years of experience"), row(11, "Software Engineer", "Active TS/SCI clearance. You must be a U.S. citizen."),
        row(12, "Software Engineer", "We will not sponsor visas."), row(13, "Software Engineer, Platform", available=False),
        row(14, "Software Engineer I", tenant="leverdemo", company="Real Name"), row(15, "Registered Nurse"),
    ]
    df = spark.createDataFrame(rows, "n int, title string, company string, tenant string, url string, description string, desc_available boolean, posted_at timestamp, employment_type string")
    return lifecycle.with_id(df)


def test_demo_corpus(spark, tmp_path):
    screened = screening.screen(demo(spark)).cache()
    assert tuple(screening.funnel(screened).first()) == (15, 9, 6, 1)
    counts = {r["gate"]: r["n"] for r in screening.gate_counts(screened).collect()}
    assert list(counts.values()) and [counts[g] for g in ("not_a_software_role", "ats_vendor_demo_board", "internship_not_full_time", "wrong_seniority_band")] == [2, 0, 2, 1]
    rows = screening.view_rows(screened).cache()
    assert rows.count() == 18 and rows.where("view = 'internships' and kept and gate = ''").count() == 1
    intern = rows.where("view = 'internship_not_full_time'").orderBy("quote").collect()
    assert [r["quote"] for r in intern] == ["Marketing Intern", "Software Engineering Intern"] and "'Intern' in the title" in intern[0]["reason"]
    clear = rows.where("view = 'security_clearance_required'").first()
    assert "TS/SCI" in clear["quote"] and clear["reason"].startswith("clearance required — 'Active TS/SCI")
    assert rows.where("view = 'citizenship_or_itar_restricted'").first()["quote"] == "must be a U.S. citizen"
    assert {r["n"] for r in screening.screen(demo(spark), sandbox_key="tenant").where("array_contains(exclusions, 'ats_vendor_demo_board')").collect()} == {14}
    assert screening.screen(demo(spark), include_internships=True).where("n = 8").first()["kept"]

    corpus = schemas.conform(demo(spark).withColumn("first_seen", at(T0)).withColumn("closed_at", F.when(F.col("n") == 1, at(T1))), schemas.STORED)
    stamped = screening.stamp_first_seen(rows, corpus)
    assert stamped.count() == 18 and stamped.where("first_seen is null").count() == 1
    folder = f"file://{tmp_path}/views"
    generation = screening.publish(stamped, folder, F.lit(15), at(T2))
    assert generation == "20240503T090000.000000Z"
    summary = screening.read_summary(spark, folder)
    assert (summary.first()["internship_total"], summary.first()["gates"]["wrong_seniority_band"]) == (1, 1)
    state = lambda now: screening.readiness(summary, at(now)).first()["state"]
    assert (state(T2), state(T2 + dt.timedelta(hours=49)), state(T1)) == ("ready", "stale", "stale")
    assert screening.readiness(summary.limit(0), at(T2)).first()["state"] == "not_screened"
    assert tuple(summary.select("screened", "kept", "excluded", "needs_level_check", "corpus_size").first()) == (15, 9, 6, 1, 15)
    assert screening.live_generations(summary, at(T2 + dt.timedelta(days=4))).count() == 0
    later = screening.publish(stamped, folder, F.lit(15), at(T2 + dt.timedelta(days=4)))
    assert screening.expire(spark, folder, at(T2 + dt.timedelta(days=1))) == []
    assert screening.read_generation(spark, folder, later).count() == 18
    kept = screening.read_generation(spark, folder, generation).where("view = 'kept'")
    first = paging.page(kept, 4)
    ids, boundary = [r["posting_id"] for r in first.orderBy("position").collect()], first.where("position = 4").first()
    rest = []
    while True:
        nxt = paging.page(kept, 4, boundary=(boundary["posted_at"], boundary["posting_id"])).orderBy("position").collect()
        if not nxt:
            break
        rest += [r["posting_id"] for r in nxt]
        boundary = nxt[-1]
    assert len(ids + rest) == 9 == len(set(ids + rest)) and kept.where("posted_at is null").first()["posting_id"] == rest[-1]
    assert paging.filtered_page(kept, paging.row_filter(["entry"], posted_after="2024-05-18"), 2).first()["matched"] == kept.where("level = 'entry' and posted_at >= '2024-05-18'").count()
    assert kept.where(paging.row_filter()).count() == 9 and kept.where(paging.row_filter(posted_before="2030-01-01")).count() == 8
    items = paging.hydrate(first, corpus)
    cards = paging.withheld(paging.project(paging.card(items), paging.CARD_FIELDS))
    assert cards.count() == 4 and "description" not in cards.columns and quality.prose_faults(cards, ["levelWhy"]) == []
    with pytest.raises(ValueError, match="missing"):
        paging.project(cards.drop("title"), paging.CARD_FIELDS)
    with pytest.raises(ValueError, match="leaf"):
        paging.project(cards.withColumn("title", F.struct("id")), paging.CARD_FIELDS)
    with pytest.raises(Exception, match="too long"):
        paging.project(cards.withColumn("url", F.repeat(F.lit("u"), 500)), paging.CARD_FIELDS).collect()
    with pytest.raises(LookupError):
        paging.lookup(corpus, "id", "none")
    with pytest.raises(ValueError):
        paging.tier_filter(["strong"], None)
    by = screening.evaluate(screened).collect()
    assert {r["label"]: (r["labelled"], r["kept"]) for r in by}["junior"] == (9, 8)
    head = screening.evaluation_rates(screened).first()
    assert (head["juniors"], head["recovered"], head["seniors_kept"], head["inversion_rate"]) == (9, 8, 0, 0.0) and abs(head["recall"] - 8 / 9) < 1e-12
    missed = screening.missed_juniors(screened).collect()
    assert len(missed) == 1 and missed[0]["gate"] and missed[0]["reason"]
    empty = screening.evaluation_rates(screened.limit(0)).first()
    assert (empty["total"], empty["recall"], empty["inversion_rate"]) == (0, 0.0, 0.0)
    assert quality.overlap(kept, rows.where("view = 'internships'")).count() == 0
    found = paging.by_url(demo(spark).withColumn("req_id", F.lit("")).withColumn("ordinal", F.col("n")), spark.createDataFrame([("https://y/x/1",)], "url string"))
    assert found.first()["n"] == 1
    feed = spark.createDataFrame([(0, "https://x/ab-77-c", ""), (1, "https://x/77", ""), (2, "https://x/q", "R9"), (3, "https://y/R9/z", None)], "ordinal int, url string, req_id string")
    asked = spark.createDataFrame([("https://z/77/?q=1",), ("https://z/R9",), ("https://z/none",), ("///",)], "url string")
    assert {(r["wanted"], r["ordinal"]) for r in paging.by_url(feed, asked).collect()} == {("https://z/77/?q=1", 0), ("https://z/R9", 2)}


# --- scores, selection, audit ---------------------------------------------------------------------------------------


def test_scores_and_facets(spark):
    df = spark.createDataFrame([("Required:\nPython, Kafka and SQL.\nNice to have:\nDocker, React", "A", "Lever"), ("", "B", None), ("plain prose", "a ", "")], "description string, company string, ats string")
    got = scoring.score(df, ["Python", "SQL", "Docker"], F.lit(True)).collect()
    assert (got[0]["score"]["total"], got[0]["score"]["tier"], got[0]["report"]["missing_required"], got[0]["coverage"]) == (68, "partial", ["Kafka"], "covers 2 of 3 named requirements")
    assert got[0]["explanation"] == "covers 2/3 required · 1/2 preferred · level confirmed"
    assert (got[1]["unscored"], got[1]["unparsed"], got[2]["unscored"]) == ("no_description", True, "no_technologies_named")
    assert scoring.score(df, None).first()["score"] is None
    assert scoring.distinct_companies(df).first()[0] == 2
    f = scoring.facets(df.withColumns({"level": F.lit("entry"), "tier": F.lit(None).cast("string")})).collect()
    assert {(r["facet"], r["value"]): r["n"] for r in f} == {("level", "entry"): 3, ("source", "lever"): 1, ("source", "unknown"): 2}
    assert scoring.profile_tokens(spark.createDataFrame([("<b>Python</b> and<br>Rust",)], "text string")) == ["Python", "Rust"]
    ranked = spark.createDataFrame([(0, "Software Engineer", "u0", "python aws"), (1, "Backend Developer", "u1", "python aws flutter"), (2, "Senior Engineer", "u2", "python aws flutter backend"), (3, "Engineer", "", "x")], "ordinal int, title string, url string, description string")
    top = scoring.keyword_rank(ranked, min_score=25).collect()
    assert [(r["ordinal"], r["score"]) for r in top] == [(1, 45), (0, 30)]


def bank(spark):
    rows = [("b1", 0, "b1", "Built services in Python", ["Python"]), ("b1", 1, "b1-k", "Built Kafka and Redis services in Python", ["Python", "Kafka", "Redis"]), ("b2", 0, "b2", "Ran Docker", ["Docker"]), ("b2", 1, "b2-k", "Ran Kafka on Docker", ["Docker", "Kafka"]), ("b3", 0, "b3", "Long baseline about nothing in particular", []), ("b3", 1, "b3-s", "Longer text that names SQL and a lot more besides it", ["SQL"])]
    return spark.createDataFrame(rows, "bullet_id string, position int, variant_id string, text string, tech array<string>")


def test_selection(spark):
    budgets = spark.createDataFrame([("b1", 40), ("b2", 40), ("b3", -10)], "bullet_id string, budget int")
    wants = spark.createDataFrame([("p", [" kafka ", "Redis", "Haskell"]), ("none", [])], "p string, requirements array<string>")
    got = {r["p"]: r for r in selection.select(wants, selection.bank_array(bank(spark), budgets)).collect()}
    c = got["p"]["choices"]
    assert [x["variant_id"] for x in c] == ["b1-k", "b2", "b3"]
    assert (c[0]["newly_covered"], got["p"]["uncovered"], got["p"]["overflowed"]) == (["Kafka", "Redis"], ["Haskell"], ["b3"])
    assert [x["variant_id"] for x in got["none"]["choices"]] == ["b1", "b2", "b3"] and c[2]["within_budget"] is False
    said = selection.select(wants.where("p = 'p'"), selection.bank_array(bank(spark), budgets)).select(F.explode("choices").alias("c")).select(selection.reason(F.col("c")).alias("r")).collect()
    assert said[0]["r"] == "surfaces Kafka, Redis, not stated by any earlier bullet" and said[2]["r"].startswith("no variant fits a -10-character budget")
    assert selection.coverable(bank(spark)).first()["tokens"] == ["Docker", "Kafka", "Python", "Redis", "SQL"]
    metric = "array<struct<numbers:array<string>,subject_head:string>>"
    v = bank(spark).withColumns({"metrics": F.lit(None).cast(metric), "must_keep_verbatim": F.lit(None).cast("array<string>")})
    assert selection.validate_bank(v).count() == 0
    bad = v.withColumn("tech", F.lit(None).cast("array<string>")).unionByName(v.limit(1))
    assert {r["rule"] for r in selection.validate_bank(bad).collect()} == {"v1-technology", "duplicate-id"}


AUDIT = [
    ("Reduced cost by 82% on tests", None), ("Reduced cost by 82% with Azure on tests", "v1-technology"), ("Reduced cost by 82% and 45% on tests", "v2-number"),
    ("Reduced tests " + "x " * 90 + "82% of cost", "v2-subject"), ("Reduced TODO by 82% on tests", "v5-placeholder"), ("Reduced " + "very " * 12 + "cost by 82% on tests", "v6-width"),
    ("Orchestrated cost by 82% on tests", "v7-verb"), ("Reduced cost by 82% of it", "v8-must-keep"), ("Reduced cost by 82% and 82% on tests", "v9-borrowed-digit"),
    ("Reduced cost by 82% at Globex on tests", "v10-proper-noun"), ("  ", "v4-structure"),
]


def test_audit(spark):
    schema = "doc_id string, bullet_id string, text string, tech array<string>, metrics array<struct<numbers:array<string>,subject_head:string>>, entry_start string, allowed_verbs array<string>, must_keep_verbatim array<string>"
    bullets = spark.createDataFrame([(str(i), "b", "Reduced cost by 82% on tests", ["Kafka"], [(["82"], "tests")], "2010-01", ["Reduced"], ["on tests"] if rule != "v2-subject" else []) for i, (_, rule) in enumerate(AUDIT)], schema)
    rewrites = spark.createDataFrame([(str(i), "b", text) for i, (text, _) in enumerate(AUDIT)], "doc_id string, bullet_id string, rewritten string")
    budgets = spark.createDataFrame([("b", 50)], "bullet_id string, budget int")
    found = {}
    for r in audit.audit(bullets, rewrites, budgets=budgets).collect():
        found.setdefault(int(r["doc_id"]), set()).add(r["rule"])
    for i, (_, rule) in enumerate(AUDIT):
        assert rule is None and i not in found or rule in found[i], (i, found.get(i))
    verdict = {r["doc_id"]: r["passed"] for r in audit.verdicts(bullets, audit.audit(bullets, rewrites, budgets=budgets)).collect()}
    assert verdict["0"] and not any(v for k, v in verdict.items() if k != "0")
    late = spark.createDataFrame([("0", "b", "Reduced cost with Kubernetes and Terraform")], "doc_id string, bullet_id string, rewritten string")
    temporal = audit.anachronisms(bullets.join(late, ["doc_id", "bullet_id"]), audit.released_table(spark)).collect()
    assert sorted(r["detail"] for r in temporal) == ["Kubernetes 2015-07", "Terraform 2014-07"]
    shape = audit.structure(bullets.limit(2), rewrites.where("doc_id = '0'").unionByName(spark.createDataFrame([("0", "new", "x")], rewrites.schema)))
    assert {(r["bullet_id"], r["detail"]) for r in shape.collect()} == {("b", "bullet is missing from the rewrite"), ("new", "bullet was invented by the rewrite")}
    numbers = spark.createDataFrame([("OAuth 2.0 and 1,200. items in S3, 45.",)], "t string").select(audit.numbers_in(F.col("t")).alias("n")).first()["n"]
    assert sorted(numbers) == ["1,200", "45"]


# --- inbox, backlog, quality ------------------------------------------------------------------------------------------


def test_briefing(spark):
    m = spark.createDataFrame([("Ann <a@greenhouse.io>", "We are pleased to offer", ""), ("b@lever.co", "thank you for applying", ""), ("c@shop.com", "sale", "")], "sender string, subject string, snippet string")
    jobs = spark.createDataFrame([("1", "T", "C", 50)], "id string, title string, company string, score int")
    b = inbox.briefing(inbox.triage(m), jobs, at(T0)).first()
    assert (b["scanned"], b["job_mail"], b["noise"], b["pipeline"], b["needs_action"][0]["sender"]) == (3, 2, 1, {"offer": 1, "applied": 1}, "Ann")


def test_import_answers(spark):
    text = "You need 3 years'\n of experience with things."
    a = [("a", "mid", 3, "3 years' of experience", "high"), ("b", "entry", 7, "experience with things", "high"), ("c", "entry", None, "not there at all", "high"), ("d", "odd", None, "x", "high"), ("e", "unknown", None, "", "medium"), ("zz", "mid", None, "", "low")]
    answers = spark.createDataFrame(a, schemas.ANSWER).withColumn("round", F.lit("1"))
    sources = spark.createDataFrame([(i, text) for i in "abcde"], "id string, description string")
    done = backlog.import_answers(answers, sources).cache()
    got = {r["id"]: (r["outcome"], r["confidence"], r["evidence_verified"]) for r in done.collect()}
    assert got == {"a": ("saved", "medium", True), "b": ("saved", "medium", True), "c": ("saved_unverified", "low", False), "d": ("bad_band_or_confidence", None, None), "e": ("saved", "medium", False), "zz": ("unknown_id", None, None)}
    cache = done.where("payload is not null").select("id", "payload")
    assert cache.where(backlog.read_cached(F.col("payload")).isNotNull()).count() == 4
    odd = spark.createDataFrame([("a", '{"schema": 2, "band": "mid"}'), ("b", "x"), ("c", '{"schema":1,"band":"mid","confidence":"low","min_years":true}')], "id string, payload string")
    assert backlog.uncached(sources, odd).count() == 5 and backlog.uncached(sources, cache).count() == 1
    assert {(r["round"], r["outcome"]): r["n"] for r in backlog.tally(done).collect()}[None, "saved"] == 3
    cost = backlog.usage(spark.createDataFrame([(1, 2, 0, 0, 1_000_000, 200_000)], "cache_hits int, calls int, failures int, unverified int, input_tokens int, output_tokens int"))
    assert cost.first()["cost"] == 10.0


def test_quality_checks(spark, tmp_path):
    df = spark.createDataFrame([("1", (5, ["x"]), "2024-01-01T00:00:00"), ("2", None, "2024-01-01T00:00:00Z"), ("3", None, "soon"), ("4", None, None)], "id string, s struct<total:int,have:array<string>>, first_seen string")
    assert quality.missing_fields(df, ["id", "s.total", "s.tier", "x"]) == ["s.tier", "x"]
    assert sorted(r["id"] for r in quality.first_seen_faults(df).collect()) == ["1", "3"]
    assert quality.reconcile(df, 5, df.limit(1), 2, 1) == ["walked 4 of 5", "1 internships held, 2 stated, gate 1"]
    assert quality.sandbox_rows(spark.createDataFrame([("https://jobs.lever.co/leverdemo/1",), ("https://jobs.lever.co/acme/sales-demo",)], "url string")).count() == 1
    runs = spark.createDataFrame([(T0, 6000, 200, 10), (T0, 4000, 200, 10), (T2, 6000, 200, 205)], "at timestamp, fetched int, kept int, failed int")
    assert [r["breach"] for r in quality.run_health(runs, "2024-05-01", "2024-05-03").orderBy("day").collect()] == [True, True, True]
    assert quality.run_health(runs.limit(1), "2024-05-01", "2024-05-01").first()["breach"] is False
