"""Data-quality checks of published output, and run health. Checks return violations: none is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed as K
from ..functions.rules import is_sandbox
from ..functions.text import iso_time
from ..functions.urls import board_slugs


def missing_fields(df: DataFrame, paths: list[str]) -> list[str]:
    """Required (dotted) paths that the schema lacks; extra columns are fine."""

    def has(kind: T.DataType, parts: list[str]) -> bool:
        if not parts:
            return True
        if isinstance(kind, T.ArrayType):
            return has(kind.elementType, parts)
        if isinstance(kind, T.MapType):
            return has(kind.valueType, parts[1:])
        return isinstance(kind, T.StructType) and any(f.name == parts[0] and has(f.dataType, parts[1:]) for f in kind.fields)

    return [p for p in paths if not has(df.schema, p.split("."))]


def reconcile(walked: DataFrame, matched: int, internships: DataFrame, internship_total: int, gate_count: int) -> list[str]:
    """Rows walked must equal the count; internships held must equal their total and not exceed the gate's."""
    n, held = walked.count(), internships.count()
    faults = [f"walked {n} of {matched}"] if n != matched else []
    if held != internship_total or internship_total > gate_count:
        faults.append(f"{held} internships held, {internship_total} stated, gate {gate_count}")
    return faults


def overlap(a: DataFrame, b: DataFrame, key: str = "posting_id") -> DataFrame:
    """Keys in both collections; there must be none."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def first_seen_faults(rows: DataFrame, stamp: str = "first_seen") -> DataFrame:
    """Rows whose textual stamp does not parse or has no offset."""
    c = F.col(stamp)
    return rows.where(c.isNotNull() & (iso_time(c).isNull() | ~c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")))


def fresh_count(rows: DataFrame, now, stamp: str = "first_seen") -> DataFrame:
    """How many were first seen in the last day."""
    return rows.agg(F.count_if(F.col(stamp) >= now - F.expr("interval 1 day")).alias("fresh"))


def sandbox_rows(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.where(F.exists(board_slugs(F.col(url)), is_sandbox))


def prose_faults(df: DataFrame, excerpts: list[str]) -> list[str]:
    """A description column in published output, or excerpts beyond the cap."""
    faults = [f.name for f in df.schema.fields if f.name == "description"]
    if excerpts:
        longest = df.agg(*(F.max(F.length(c)).alias(c) for c in excerpts)).first()
        faults += [c for c in excerpts if (longest[c] or 0) > K.QUOTE_CHARS]
    return faults


def score_faults(rows: DataFrame) -> DataFrame:
    """Scored rows without all of their components."""
    s = F.col("score")
    parts = [s[c] for c in ("total", "required_covered", "required_total", "preferred_covered", "preferred_total", "tier")]
    lacks = parts[0].isNull()
    for p in parts[1:]:
        lacks = lacks | p.isNull()
    return rows.where(s.isNotNull() & lacks)


def run_health(runs: DataFrame, first_day, last_day, min_fetched: int = 5000, min_kept: int = 100, boards: int = 819) -> DataFrame:
    """A row per day of the calendar: minimum fetched and kept, maximum failed, and whether any limit is breached.

    runs: at, fetched, kept, failed. A day without a run breaches.
    """
    daily = runs.groupBy(F.to_date("at").alias("day")).agg(F.min("fetched").alias("fetched"), F.min("kept").alias("kept"), F.max("failed").alias("failed"))
    days = runs.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day)))).alias("day"))
    breach = F.col("fetched").isNull() | (F.col("fetched") < min_fetched) | (F.col("kept") < min_kept) | (F.col("failed") > int(boards * K.MAX_FAILED_SHARE))
    return days.join(daily, "day", "left").withColumn("breach", breach)
