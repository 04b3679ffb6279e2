"""Whole runs: discovery of boards, the daily supply run, reading a view, the detail of a row, the published snapshot, comparisons."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.urls import classify_apply_url, host_of, known_host
from ..sources.folders import remove
from . import lifecycle, paging, scoring, screening


def discover(rows: DataFrame, ordinal: str = "ordinal") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply urls (company, url) to a watchlist, one-row counters, and counts by unmodelled board and unknown host.

    The first entry of each board counts; the watchlist is ordered by ats and tenant.
    """
    judged = rows.withColumn("entry", classify_apply_url(F.col("url"), F.col("company"))).withColumn("known", known_host(F.col("url")))
    supported = F.col("entry").isNotNull()
    entries = judged.where(supported).select("entry.*", ordinal)
    watch = (
        entries.groupBy("ats", "tenant", "wd", "site").agg(F.min_by("company", ordinal).alias("company")).select("company", "ats", "tenant", "wd", "site").orderBy("ats", "tenant", "wd", "site")
    )
    classified = supported | F.col("known").isNotNull()
    counters = judged.agg(F.count("*").alias("total_urls"), F.count_if(classified).alias("classified"), F.count_if(supported).alias("supported"))
    counters = counters.withColumn("coverage", F.when(F.col("total_urls") > 0, F.col("classified") / F.col("total_urls")).otherwise(0.0))
    rest = judged.where(~supported)
    kind = F.when(F.col("known").isNotNull(), "unsupported").otherwise("unknown_host")
    others = rest.select(kind.alias("kind"), F.coalesce("known", host_of(F.col("url"))).alias("name")).where("name <> ''").groupBy("kind", "name").agg(F.count("*").alias("n"))
    return watch, counters, others


def daily_run(corpus: DataFrame, fetch: DataFrame, sources: DataFrame, now: Column, folder: str, wanted: Sequence[str] = K.JUNIOR_BANDS, most: int = 8) -> DataFrame:
    """One supply run: dedupe the fetch, merge and close, screen the *stored* open corpus, publish, digest; a summary row.

    The merged corpus is written first and read back, so that all later steps see one snapshot. Every count is always
    there; ``not_closed`` holds the reason only when closing was refused. ``rescreened`` postings are new or changed since the generation
    before, or all where there is none or the rules are others; the rows of the rest are carried over.
    """
    spark = corpus.sparkSession
    deduped = f"{folder}/fetch/{uuid.uuid4().hex}"
    lifecycle.with_id(lifecycle.best_copies(fetch)).write.parquet(deduped)  # three steps read it
    best = spark.read.parquet(deduped)
    merged, refused = lifecycle.sync(corpus, best, now, sources)
    lifecycle.write_snapshot(merged, f"{folder}/corpus")
    stored = lifecycle.read_snapshot(spark, f"{folder}/corpus")
    rows, rescreened = screening.rescreen(stored.where("closed_at is null"), screening.newest_rows(spark, f"{folder}/views"), f"{folder}/screening", wanted)
    rows = screening.stamp_first_seen(rows, stored)
    generation = screening.publish(rows, f"{folder}/views", F.lit(stored.count()), now)
    remove(spark, f"{folder}/screening")  # the digests are in the rows now
    published = screening.read_generation(spark, f"{folder}/views", generation)  # the screen runs once: what follows reads its rows
    _, new = lifecycle.split_known(best, corpus)
    todays = scoring.digest(published.where("view = 'kept'").withColumnRenamed("posting_id", "id"), new, most)
    counts = (
        fetch.agg(F.count("*").alias("fetched")).join(best.agg(F.count("*").alias("unique")), F.lit(True))
        .join(new.agg(F.count("*").alias("new")), F.lit(True)).join(lifecycle.source_health(sources), F.lit(True))
        .join(stored.agg(F.count_if(F.col("closed_at") == now).alias("closed")), F.lit(True))
        .join(todays.agg(F.count("*").alias("digest")), F.lit(True)).join(screening.read_summary(spark, f"{folder}/views"), F.lit(True))
    )
    return counts.select(
        F.lit(generation).alias("generation"), F.lit(rescreened).cast("long").alias("rescreened"), "fetched", "unique", (F.col("fetched") - F.col("unique")).alias("duplicates"), "new", "closed", "attempted", "failed", "degraded", "failures",
        "screened", "kept", "excluded", "gates", "needs_level_check", "internship_total", "digest", F.lit(refused).cast("string").alias("not_closed"),
    )


def read_view(
    rows: DataFrame, corpus: DataFrame, view: str, limit: int = 25, boundary: tuple | None = None, where: Column | None = None,
    mine: Sequence[str] | None = None,
) -> DataFrame:
    """A page of a view: filtered and cut first, hydrated after, scored last; ``matched`` counts the whole view."""
    own = rows.where(F.col("view") == view)
    return finish(paging.filtered_page(own, F.lit(True) if where is None else where, min(limit, 100), boundary), corpus, mine)


def read_published(spark: SparkSession, folder: str, corpus: DataFrame, view: str, limit: int = 25, boundary: tuple | None = None, mine: Sequence[str] | None = None, **filters) -> DataFrame:
    """As :func:`read_view`, of the newest generation in ``folder``: the count comes from its cube and only the page's files are opened.

    filters: levels, posted_after, posted_before, include_undated (see ``paging.row_filter``).
    """
    generation = screening.read_summary(spark, folder).first()["generation"]
    return finish(paging.published_page(spark, folder, generation, view, min(limit, 100), boundary, **filters), corpus, mine)


def finish(page: DataFrame, corpus: DataFrame, mine: Sequence[str] | None = None) -> DataFrame:
    """A page's rows with their postings, scored."""
    items = paging.hydrate(page.withColumnRenamed("level", "band"), corpus)
    leveled = items.withColumn("level", F.struct(F.col("band").alias("level"), F.col("level_source").alias("source")))
    return scoring.score(leveled, mine).withColumn("level", F.col("band")).drop("band")


def read_excluded(rows: DataFrame, n: int = 10) -> DataFrame:
    """The first n of every gate with its total, reason and quote."""
    return paging.top_of_each(rows.where("gate <> ''"), "gate", min(n, 100))


def detail(corpus: DataFrame, key: str, mine: Sequence[str] | None = None, wanted: Sequence[str] = K.JUNIOR_BANDS) -> DataFrame:
    """One row, screened and scored again with its full evidence; first_seen is not part of it."""
    return scoring.score(screening.screen(paging.lookup(corpus, "id", key), wanted), mine).withColumn("first_seen", F.lit(None).cast("timestamp"))


#: The published collections and the views they show.
COLLECTIONS = {"items": "kept", "internships": "internships"}


def collection(rows: DataFrame, corpus: DataFrame, view: str) -> DataFrame:
    """All cards of a view, without prose, laid out by ranges in recency order."""
    shown = paging.project(paging.card(corpus.join(rows.where(F.col("view") == view).select("posting_id", "level", "level_source", "level_why"), F.col("id") == F.col("posting_id"))), paging.CARD_FIELDS)
    order = paging.by_recency("postedAt", "id")
    return shown.repartitionByRange(*order).sortWithinPartitions(*order)


def snapshot_summary(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: total of each collection, rows per gate, and facets of the kept rows."""
    totals = rows.agg(*(F.count_if(F.col("view") == v).alias(f"{n}_total") for n, v in COLLECTIONS.items()))
    gates = rows.where("gate <> ''").groupBy("gate").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gate", "n")))).alias("gates"))
    kept = rows.where("view = 'kept'").join(corpus.select(F.col("id").alias("posting_id"), "ats"), "posting_id")
    faceted = scoring.facets(kept.withColumn("tier", F.lit(None).cast("string")))
    sides = faceted.agg(F.array_sort(F.collect_list(F.struct("facet", "value", "n"))).alias("facets"))
    return totals.join(gates, F.lit(True)).join(sides, F.lit(True))


def write_document(rows: DataFrame, corpus: DataFrame, folder: str) -> None:
    """The published document as JSON: a folder of cards for each collection, whole, and a one-row summary written last.

    The rows written must equal the totals, else the job fails and no summary is there.
    """
    spark = rows.sparkSession
    head = snapshot_summary(rows, corpus)
    totals = head.first()
    for name, view in COLLECTIONS.items():
        collection(rows, corpus, view).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")
        written = spark.read.schema("id string").json(f"{folder}/{name}").count()
        if written != totals[f"{name}_total"]:
            raise ValueError(f"{name}: wrote {written} of {totals[f'{name}_total']} rows")
    head.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def compare_with_rank(screened: DataFrame, ranked: DataFrame) -> DataFrame:
    """How many labelled-junior rows the funnel and the legacy rank surface: label, labelled, by_funnel, by_rank."""
    top = ranked.select("id", F.lit(True).alias("_top"))
    both = screened.withColumn("label", screening.truth_band(F.col("title"))).join(top, "id", "left")
    return both.groupBy("label").agg(F.count("*").alias("labelled"), F.count_if("kept").alias("by_funnel"), F.count_if(F.col("_top")).alias("by_rank"))


def briefings(spark: SparkSession, folder: str, user: str) -> DataFrame:
    """The newest briefing of a user."""
    return lifecycle.latest_by(spark.read.parquet(folder).where(F.col("user_id") == user), "user_id", "generated_at")


def save_briefing(briefing: DataFrame, folder: str, user: str) -> None:
    briefing.withColumn("user_id", F.lit(user)).write.mode("append").partitionBy("user_id").parquet(folder)
