"""Screening: every gate of every posting in one pass, counts, views with evidence, publication."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as K
from ..functions.rules import (
    eligibility,
    explain_level,
    gate_quote,
    gate_reason,
    in_role_family,
    is_internship,
    is_sandbox,
    level,
    title_band,
    wrong_band,
)
from ..functions.text import once, stamp
from ..schemas import VIEW_VERSION
from ..sources.folders import exists, remove

#: Postings to screen that are broadcast to the corpus; more are joined by shuffle.
DELTA_ROWS = 100_000


def screen(postings: DataFrame, wanted: Sequence[str] = K.JUNIOR_BANDS, include_internships: bool = False, sandbox_key: str = "company") -> DataFrame:
    """level, eligible, exclusions (failed gates in gate order) and kept beside the postings' columns. No shuffle.

    Filters on the result read it and do not screen again. Works on streaming frames alike. ``sandbox_key="tenant"`` tests the tenant instead of the company's name.
    """
    c = F.col
    judged = postings.withColumns({
        "level": once(level(c("title"), c("description"), c("desc_available"))),
        "eligible": once(eligibility(c("description"), c("desc_available"))),
    })
    intern = F.lit(False) if include_internships else is_internship(c("title"), c("employment_type"))
    failed = (
        ~in_role_family(c("title")), is_sandbox(c(sandbox_key)), intern, wrong_band(c("level.level"), wanted), c("eligible.clearance"),
        c("eligible.citizenship"), c("eligible.sponsorship") == "will_not_sponsor",
    )
    gates = F.array_compact(F.array(*(F.when(f, F.lit(g)) for g, f in zip(K.GATES, failed))))
    return judged.withColumn("exclusions", gates).withColumn("kept", F.size("exclusions") == 0)


def funnel(screened: DataFrame) -> DataFrame:
    """total, kept, excluded and needs_level_check in one row."""
    return screened.agg(
        F.count("*").alias("total"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("excluded"),
        F.count_if(F.col("kept") & (F.col("level.level") == "unknown")).alias("needs_level_check"),
    )


def gate_counts(screened: DataFrame) -> DataFrame:
    """gate and n, a row per gate, zero where none failed. A row counts once per failed gate. One aggregate, turned into rows."""
    counts = screened.agg(*(F.count_if(F.array_contains("exclusions", g)).alias(g) for g in K.GATES))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(g).alias("gate"), F.col(g).alias("n")) for g in K.GATES))).alias("x")).select("x.*")


#: What a screen and its view rows depend on in a posting.
JUDGED = ("title", "company", "tenant", "description", "desc_available", "employment_type", "posted_at")


def rules_version(wanted: Sequence[str] = K.JUNIOR_BANDS, include_internships: bool = False, sandbox_key: str = "company") -> str:
    """A digest of all fixed values and of a screen's options: another one means that everything is to be screened anew."""
    fixed = [(n, v) for n, v in sorted(vars(K).items()) if n.isupper() or n.startswith("_") and n[1:2].isupper()]
    return hashlib.sha256(repr((VIEW_VERSION, tuple(wanted), include_internships, sandbox_key, fixed)).encode()).hexdigest()[:16]


def judged(version: str) -> Column:
    """A digest of what a posting is judged by, under a version of the rules. Null and empty differ; no field can run into the next."""
    fields = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in JUDGED]
    return F.sha2(F.concat(F.lit(version), *fields), 256)


def rescreen(
    postings: DataFrame, former: DataFrame | None, folder: str, wanted: Sequence[str] = K.JUNIOR_BANDS, include_internships: bool = False, sandbox_key: str = "company"
) -> tuple[DataFrame, int]:
    """View rows of ``postings``, and how many of these were screened for them.

    Rows of postings that are as they were when ``former`` (the rows of a generation) was made, under the same rules, are carried over from it; only
    new and changed ones meet the patterns. The digests, a small table beside the texts, are written once to ``folder``; former rows without digests
    are not used. The postings to screen are broadcast if they are few, else joined by shuffle.
    """
    spark = postings.sparkSession
    options = (wanted, include_internships, sandbox_key)
    digests = f"{folder}/digests-{uuid.uuid4().hex}"
    postings.select("id", judged(rules_version(*options)).alias("judged")).write.parquet(digests)
    now = spark.read.schema("id string, judged string").parquet(digests)
    if former is None or "judged" not in former.columns:
        former = None
    todo = now if former is None else now.join(former.where("leads").select(F.col("posting_id").alias("id"), "judged"), ["id", "judged"], "left_anti")
    n = todo.count()
    few = F.broadcast(todo) if n <= DELTA_ROWS else todo
    rows = view_rows(screen(postings.join(few, "id"), *options))
    if former is None:
        return rows, n
    kept = former.join(now.withColumnRenamed("id", "posting_id"), ["posting_id", "judged"], "left_semi")
    return kept.select(*rows.columns).unionByName(rows), n


def _view_row(rows: DataFrame, view: Column, gate: Column) -> DataFrame:
    c = F.col
    reason = gate_reason(c("gate"), c("title"), c("company"), c("employment_type"), c("level"), c("eligible"))
    quote = gate_quote(c("gate"), c("title"), c("employment_type"), c("level"), c("eligible"))
    return rows.withColumn("gate", gate).select(
        view.alias("view"), "posted_at", c("id").alias("posting_id"), "kept", c("level.level").alias("level"), c("level.source").alias("level_source"),
        explain_level(c("level")).alias("level_why"), c("eligible.checked").alias("eligibility_checked"), c("eligible.sponsorship").alias("sponsorship"),
        "gate", F.when(c("gate") == "", "").otherwise(reason).alias("reason"), F.when(c("gate") == "", "").otherwise(quote).alias("quote"), "leads", *(["judged"] if "judged" in rows.columns else []),
    )


def view_rows(screened: DataFrame) -> DataFrame:
    """One row per (posting, view): kept ones, internships that fail nothing else, and one per failed gate.

    A single explode of the views a row belongs to; the screen runs once. ``leads`` marks one row of each posting, so that
    postings can be counted on the rows.
    """
    gate = F.col("_view")
    internship = F.when((F.array_size("exclusions") == 1) & F.array_contains("exclusions", K.GATES[2]), F.lit("internships"))
    views = F.array_compact(F.concat(F.array(F.when(F.col("kept"), "kept"), internship), F.col("exclusions")))
    rows = screened.select("*", F.posexplode(views).alias("_at", "_view")).withColumn("leads", F.col("_at") == 0)
    # an internship is kept once that one gate is off
    rows = rows.withColumn("kept", F.col("kept") | (gate == "internships"))
    return _view_row(rows, gate, F.when(gate.isin(*K.GATES), gate).otherwise(""))


def stamp_first_seen(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """first_seen of open corpus rows, null otherwise; whatever the pass supplied is ignored."""
    seen = corpus.where(F.col("closed_at").isNull()).select(F.col("id").alias("posting_id"), "first_seen")
    return rows.drop("first_seen").join(seen, "posting_id", "left")


def summary(rows: DataFrame, corpus_size: Column, now: Column) -> DataFrame:
    """The one-row summary of a generation, all of it counted in one pass over its view rows."""
    view, kept = F.col("view"), F.col("view") == "kept"
    counts = rows.agg(
        F.count_if("leads").alias("screened"), F.count_if(kept).alias("kept"), F.count_if(F.col("leads") & ~kept).alias("excluded"),
        F.count_if(kept & (F.col("level") == "unknown")).alias("needs_level_check"), F.count_if(view == "internships").alias("internship_total"),
        *(F.count_if(view == g).alias(g) for g in K.GATES),
    )
    gates = F.create_map(*(c for g in K.GATES for c in (F.lit(g), F.col(g))))
    # an internship leads with the view of its own, so that it counts once
    return counts.select(
        stamp(now).alias("generation"), now.alias("screened_at"), corpus_size.alias("corpus_size"), "screened", "kept", "excluded",
        gates.alias("gates"), "needs_level_check", F.col("kept").alias("eligible_total"), "internship_total", F.lit(VIEW_VERSION).alias("view_version"),
    )


def publish(rows: DataFrame, folder: str, corpus_size: Column, now: Column) -> str:
    """Write a generation: its rows, a table of its files, a cube of counts, then its summary, all counted on what was written.

    The screen behind the rows runs once: rows are staged, then laid out by view and recency, so that a file holds a short stretch of time and a
    page needs few of them. The cube (view, level, day, n) is as small as there are days. Readers go by the summary, so a half-written
    generation is not seen.
    """
    spark = rows.sparkSession
    generation = spark.range(1).select(stamp(now).alias("g")).first()["g"]
    staging, target = f"{folder}/staging/{uuid.uuid4().hex}", f"{folder}/rows/generation={generation}"
    rows.write.parquet(staging)
    order = (F.col("view"), F.col("posted_at").desc_nulls_last(), F.col("posting_id").desc())
    staged = spark.read.schema(rows.schema).parquet(staging)
    staged.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("view").parquet(target)
    remove(spark, staging)
    written = spark.read.schema(rows.schema).parquet(target)
    by_file = written.groupBy("view", F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("n"), F.min("posted_at").alias("oldest"), F.max("posted_at").alias("newest"), F.count_if(F.col("posted_at").isNull()).alias("undated")
    )
    by_file.coalesce(1).write.mode("overwrite").parquet(f"{folder}/files/generation={generation}")
    cube = written.groupBy("view", "level", F.to_date("posted_at").alias("day")).agg(F.count("*").alias("n"))
    cube.coalesce(1).write.mode("overwrite").parquet(f"{folder}/cube/generation={generation}")
    summary(written, corpus_size, now).write.mode("append").parquet(f"{folder}/summary")
    return generation


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The newest summary of this version; no row if there is none."""
    heads = spark.read.parquet(f"{folder}/summary").where(F.col("view_version") == VIEW_VERSION)
    return heads.orderBy(F.desc("screened_at")).limit(1)


def readiness(head: DataFrame, now: Column) -> DataFrame:
    """``ready``, ``stale`` (age below 0 or above 48 hours) or ``not_screened`` in one row."""
    hours = (F.unix_timestamp(now) - F.unix_timestamp("screened_at")) / 3600
    return head.agg(F.max(F.struct("screened_at", F.when(hours.between(0, K.STALE_HOURS), "ready").otherwise("stale").alias("state"))).alias("s")).select(
        F.coalesce("s.state", F.lit("not_screened")).alias("state")
    )


def read_generation(spark: SparkSession, folder: str, generation: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/rows/generation={generation}").withColumn("generation", F.lit(generation))


def newest_rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of the newest generation of this version, or None where there is none (any more)."""
    head = read_summary(spark, folder).first() if exists(spark, f"{folder}/summary") else None
    if head is None or not exists(spark, f"{folder}/rows/generation={head['generation']}"):
        return None
    return read_generation(spark, folder, head["generation"])


def live_generations(heads: DataFrame, now: Column) -> DataFrame:
    """Generations younger than three days."""
    return heads.where(F.col("screened_at") > now - F.expr(f"interval {K.VIEW_DAYS} days")).select("generation")


def expire(spark: SparkSession, folder: str, now: Column) -> list[str]:
    """Remove the rows of generations that are no longer live; their names. Summaries (a row a run) stay."""
    heads = spark.read.parquet(f"{folder}/summary").select("generation", "screened_at").distinct()
    gone = sorted(r["generation"] for r in heads.join(live_generations(heads, now), "generation", "left_anti").collect())
    for generation in gone:
        for part in ("rows", "files", "cube"):
            remove(spark, f"{folder}/{part}/generation={generation}")
    return gone


def seeded_sample(rows: DataFrame, n: int = 50, seed: int = 7, key: str = "id") -> DataFrame:
    """n rows in the order of a seeded digest of their key: the same at every run and however rows are dealt out. A top-k cut."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def truth_band(title: Column) -> Column:
    """What a title alone says for sure: not_swe, junior, mid, senior, or unmarked."""
    band = title_band(title)
    return F.when(~in_role_family(title), "not_swe").when(band.isin("entry", "intern"), "junior").when(band.isin("senior", "mid"), band).otherwise("unmarked")


def evaluate(screened: DataFrame) -> DataFrame:
    """Bands by title markers alone against what is kept: a row per label with labelled, kept and share of kept."""
    by = screened.groupBy(truth_band(F.col("title")).alias("label")).agg(F.count("*").alias("labelled"), F.count_if("kept").alias("kept"))
    # the labels are five at most: their sum is a window over them, and the screen runs once
    total = F.greatest(F.sum("kept").over(Window.partitionBy()), F.lit(1))
    return by.withColumn("share_of_kept", F.col("kept") / total)


def evaluation_rates(screened: DataFrame) -> DataFrame:
    """One row, from one pass over the screen: total, kept, needs_level_check, juniors, recovered, recall (0 without juniors), seniors_kept (leakage) and
    inversion_rate (seniors among the kept, 0 where nothing is kept)."""
    label, kept = F.col("_label"), F.col("kept")
    head = screened.withColumn("_label", truth_band(F.col("title"))).agg(
        F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(kept & (F.col("level.level") == "unknown")).alias("needs_level_check"),
        F.count_if(label == "junior").alias("juniors"), F.count_if((label == "junior") & kept).alias("recovered"), F.count_if((label == "senior") & kept).alias("seniors_kept"),
    )
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return head.withColumns({"recall": ratio("recovered", "juniors"), "inversion_rate": ratio("seniors_kept", "kept")})


def missed_juniors(screened: DataFrame) -> DataFrame:
    """id, title, gate and reason of every posting labelled junior that is not kept: the first gate that it fails, each of which should be a real reason. No shuffle."""
    c = F.col
    missed = screened.where(~c("kept")).where(truth_band(c("title")) == "junior").withColumn("gate", c("exclusions")[0])
    return missed.select("id", "title", "gate", gate_reason(c("gate"), c("title"), c("company"), c("employment_type"), c("level"), c("eligible")).alias("reason"))
