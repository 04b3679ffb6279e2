"""Corpus lifecycle: dedupe a fetch, merge it, close what vanished, apply events, publish snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as K
from ..functions.rules import dedupe_key, posting_id
from ..schemas import STORED, conform
from ..sources.folders import children, exists, remove


def best_copies(postings: DataFrame, ordinal: str = "ordinal", key: list[Column] | None = None, text: str = "description") -> DataFrame:
    """One row per key: the longest text, the first arrival on ties; ``first_ordinal`` is where the key first came.

    Picked by an aggregate, which reduces before the shuffle: a key of very many copies is no problem.
    """
    keys = key or [dedupe_key(F.col("company"), F.col("title"))]
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = postings.withColumns(dict(zip(names, keys)))
    best = F.max_by(F.struct(*postings.columns), F.struct(F.length(F.coalesce(F.col(text), F.lit(""))), -F.col(ordinal)))
    return keyed.groupBy(*names).agg(best.alias("_row"), F.min(ordinal).alias("first_ordinal")).select("_row.*", "first_ordinal")


def fetch_report(postings: DataFrame) -> DataFrame:
    """raw, uniq (distinct by company and title) and no_description of a fetch, in one row."""
    return postings.agg(
        F.count("*").alias("raw"), F.count_distinct(dedupe_key(F.col("company"), F.col("title"))).alias("uniq"), F.count_if(~F.col("desc_available")).alias("no_description"),
    )


def with_id(postings: DataFrame) -> DataFrame:
    return postings.withColumn("id", posting_id(F.col("url")))


def split_known(fetch: DataFrame, corpus: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Distinct fetched keys that the corpus has (open or closed), and those that are new."""
    ids, have = fetch.select(key).distinct(), corpus.select(key)
    return ids.join(have, key, "left_semi"), ids.join(have, key, "left_anti")


def merge(corpus: DataFrame, fetch: DataFrame, now: Column, close: bool = False) -> DataFrame:
    """Upsert a fetch. A match is seen now, is open again, and takes title and location, and the description only if there is one.

    All else keeps what was first seen. New rows come in; rows not fetched stay as they are, or with ``close`` those that are open are
    closed now. One full outer join on id, which knows who came, so that closing takes no join of its own.
    """
    schema = corpus.columns
    # picking a row sorts what a task has read, and a file's part may hold any number of rows: they are dealt out first, an id of many rows to many tasks
    latest = fetch.repartition("id", "url", "description").groupBy("id").agg(F.max_by(F.struct(*fetch.columns), F.struct(F.col("desc_available"), F.length("description"), "url")).alias("_f"))
    # the key itself, not its copy in the struct: the join finds the rows dealt out by it
    f = latest.select(F.col("id").alias("f_id"), *(F.col(f"_f.{c}").alias(f"f_{c}") for c in fetch.columns if c != "id"))
    both = corpus.join(f, corpus["id"] == f["f_id"], "full_outer")
    came, old = F.col("f_id").isNotNull(), F.col("id").isNotNull()
    fresh_text = came & (F.col("f_desc_available") | ~old)
    rules = {
        "id": F.coalesce("id", "f_id"),
        "last_seen": F.when(came, now).otherwise(F.col("last_seen")),
        "first_seen": F.when(old, F.col("first_seen")).otherwise(now),
        "closed_at": F.when(~came, F.coalesce("closed_at", now) if close else F.col("closed_at")),
        "title": F.when(came, F.col("f_title")).otherwise(F.col("title")),
        "location": F.when(came, F.col("f_location")).otherwise(F.col("location")),
        "description": F.when(fresh_text, F.col("f_description")).otherwise(F.col("description")),
        "desc_available": F.coalesce(F.col("desc_available"), F.lit(False)) | F.coalesce(F.col("f_desc_available"), F.lit(False)),
    }
    fetched = set(fetch.columns)
    out = []
    for c in schema:
        keep = F.when(old, F.col(c)).otherwise(F.col(f"f_{c}")) if c in fetched else F.col(c)
        out.append(rules.get(c, keep).alias(c))
    return both.select(*out)


def close_missing(corpus: DataFrame, fetched_ids: DataFrame, now: Column) -> DataFrame:
    """Open rows absent from the fetch are closed now."""
    seen = fetched_ids.select(F.col("id").alias("_seen")).distinct()
    absent = F.col("closed_at").isNull() & F.col("_seen").isNull()
    return corpus.join(seen, corpus["id"] == seen["_seen"], "left").withColumn("closed_at", F.when(absent, now).otherwise(F.col("closed_at"))).drop("_seen")


def source_health(sources: DataFrame) -> DataFrame:
    """attempted, failed, share, degraded and up to ten failure labels of a table of (source, failed, label)."""
    failed = F.coalesce(F.col("failed"), F.lit(False))
    counts = sources.agg(F.count("*").alias("attempted"), F.count_if(failed).alias("failed"))
    labels = sources.where(failed).orderBy("source").limit(K.REPORTED_FAILURES).agg(F.array_sort(F.collect_list("label")).alias("failures"))
    share = F.when(F.col("attempted") > 0, F.col("failed") / F.col("attempted")).otherwise(0.0)
    return counts.join(labels, F.lit(True)).withColumn("share", share).withColumn("degraded", F.col("share") > K.MAX_FAILED_SHARE)


def closing_refused(fetch: DataFrame, sources: DataFrame | None = None) -> str | None:
    """Why a fetch is no ground to close anything: ``empty_fetch``, ``degraded_fetch`` or None."""
    if not fetch.take(1):
        return "empty_fetch"
    if sources is not None and source_health(sources).first()["degraded"]:
        return "degraded_fetch"
    return None


def sync(corpus: DataFrame, fetch: DataFrame, now: Column, sources: DataFrame | None = None) -> tuple[DataFrame, str | None]:
    """Merge, then close what vanished unless that is refused; the corpus and the refusal."""
    refused = closing_refused(fetch, sources)
    return merge(corpus, fetch, now, close=not refused), refused


def mark_applied(corpus: DataFrame, events: DataFrame) -> DataFrame:
    """applied_at from events (id, at): the earliest, and only where none was set; unknown ids do nothing."""
    first = events.groupBy("id").agg(F.min("at").alias("_at"))
    return corpus.join(first, "id", "left").withColumn("applied_at", F.coalesce("applied_at", "_at")).select(*corpus.columns)


def save_interpretations(corpus: DataFrame, updates: DataFrame) -> DataFrame:
    """interpretation from updates (id, payload, and perhaps at); unknown ids do nothing. Of several updates of an id the latest counts, or without ``at`` the largest."""
    newest = F.max_by("payload", "at") if "at" in updates.columns else F.max("payload")
    u = updates.groupBy("id").agg(newest.alias("_payload"))
    return corpus.join(u, "id", "left").withColumn("interpretation", F.coalesce("_payload", "interpretation")).select(*corpus.columns)


def stats(corpus: DataFrame) -> DataFrame:
    """total, open, closed, interpreted and applied."""
    return corpus.agg(
        F.count("*").alias("total"), F.count_if(F.col("closed_at").isNull()).alias("open"), F.count_if(F.col("closed_at").isNotNull()).alias("closed"),
        F.count_if(F.col("interpretation").isNotNull()).alias("interpreted"), F.count_if(F.col("applied_at").isNotNull()).alias("applied"),
    )


def first_stance(listings: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The first non-empty sponsorship stance of each company, both lower-cased."""
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    rows = listings.select(clean("company_name").alias("company"), clean("sponsorship").alias("stance"), ordinal).where("company <> '' and stance <> ''")
    return rows.groupBy("company").agg(F.min_by("stance", ordinal).alias("stance"))


def changed_since(corpus: DataFrame, moment: Column) -> DataFrame:
    """Open rows first seen strictly after a moment, newest first."""
    return corpus.where(F.col("closed_at").isNull() & (F.col("first_seen") > moment)).orderBy(F.col("first_seen").desc(), F.col("id").desc())


def open_rows(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("closed_at").isNull()).orderBy(F.col("posted_at").desc_nulls_last(), F.col("id").desc())


def write_snapshot(df: DataFrame, folder: str, keep: int = 3) -> str:
    """Write a snapshot in a directory of its own, then a numbered pointer: readers see all of it or the one before.

    The last ``keep`` stay; what falls out goes with its pointer, so there are never more than these to look at.
    """
    run, spark = uuid.uuid4().hex, df.sparkSession
    df.write.parquet(f"{folder}/run={run}")
    known = _pointers(spark, folder)
    pointer = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"))
    pointer.write.parquet(f"{folder}_pointer/v={(known[-1] if known else 0) + 1}")
    for old in known[: max(0, len(known) + 1 - keep)]:
        remove(spark, f"{folder}/run={_run(spark, folder, old)}")
        remove(spark, f"{folder}_pointer/v={old}")
    return run


def _pointers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the pointers that were written whole, oldest first."""
    found = [name for name in children(spark, f"{folder}_pointer") if name.startswith("v=")]
    return sorted(int(name[2:]) for name in found if exists(spark, f"{folder}_pointer/{name}/_SUCCESS"))


def _run(spark: SparkSession, folder: str, pointer: int) -> str:
    return spark.read.schema("run string").parquet(f"{folder}_pointer/v={pointer}").first()["run"]


def read_snapshot(spark: SparkSession, folder: str, schema: str = STORED) -> DataFrame:
    """The newest snapshot, columns added since it was written filled in."""
    run = _run(spark, folder, _pointers(spark, folder)[-1])
    return conform(spark.read.parquet(f"{folder}/run={run}"), schema)


def latest_by(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), at).alias("_r")).select("_r.*")


def surfaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Surfaced items of users, each once."""
    return old.unionByName(new).dropDuplicates(["user_id", "job_id"])


def rounds(backlog: DataFrame, order: list[Column], limit: int = K.BACKLOG_LIMIT, chunk: int = K.BACKLOG_CHUNK) -> DataFrame:
    """The first ``limit`` rows (at most a thousand) cut into rounds of ``chunk``."""
    limit = min(limit, K.BACKLOG_CEILING)
    top = backlog.orderBy(*order).limit(limit)
    nth = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("position", nth).withColumn("round", F.ceil(F.col("position") / chunk).cast("int"))
