"""The backlog of unknown bands: what to ask, and importing the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.rules import band_of_years
from ..functions.text import or_empty
from ..functions.tokens import clean_evidence, clean_years, downgraded, locate
from .lifecycle import rounds

BANDS, CONFIDENCES = ("intern", "entry", "mid", "senior", "unknown"), ("high", "medium", "low")
CACHED = "schema int, band string, min_years string, evidence string, confidence string, evidence_verified boolean"


def read_cached(payload: Column) -> Column:
    """A cached interpretation, null where it is absent or not valid (tag 1, known band and confidence, whole years or none)."""
    p = F.from_json(payload, CACHED)
    years = p["min_years"]
    ok = (p["schema"] == 1) & p["band"].isin(*BANDS) & p["confidence"].isin(*CONFIDENCES) & (years.isNull() | years.rlike(r"^-?\d+$"))
    return F.when(ok, p)


def uncached(rows: DataFrame, cache: DataFrame, key: str = "id") -> DataFrame:
    """Rows without a valid cache value (unusable payloads count as none)."""
    valid = cache.where(read_cached(F.col("payload")).isNotNull()).select(key).distinct()
    return rows.join(valid, key, "left_anti")


def backlog(screened: DataFrame, cache: DataFrame, order: list[Column], limit: int = K.BACKLOG_LIMIT, chunk: int = K.BACKLOG_CHUNK) -> DataFrame:
    """Kept rows of unknown band with a description and no valid answer, in rounds; the text is cut as the question is."""
    open_ = screened.where(F.col("kept") & (F.col("level.level") == "unknown") & F.col("desc_available") & (or_empty(F.col("description")) != ""))
    asked = rounds(uncached(open_, cache), order, limit, chunk)
    return asked.withColumn("description", F.substring("description", 1, K.BACKLOG_CHARS))


def write_rounds(asked: DataFrame, folder: str) -> None:
    """A folder of JSON per round; earlier ones are replaced."""
    asked.write.mode("overwrite").partitionBy("round").json(folder)


def verify(band: Column, years: Column, evidence: Column, confidence: Column, description: Column) -> Column:
    """``struct(confidence, evidence_verified)``: an absent span makes a stated band low; a re-flowed one costs a
    step; years that contradict the band cost another."""
    place = locate(description, evidence)
    found = place != "absent"
    first = F.when(place == "reflowed", downgraded(confidence)).when(~found & (band != "unknown"), "low").otherwise(confidence)
    contradicts = years.isNotNull() & (band != "unknown") & (band_of_years(years) != band)
    return F.struct(F.when(contradicts, downgraded(first)).otherwise(first).alias("confidence"), found.alias("evidence_verified"))


def import_answers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """outcome, and for accepted answers the cleaned fields and the payload to cache. sources: id, description."""
    s = sources.select(F.col("id").alias("_sid"), F.col("description").alias("_text"))
    a = answers.join(s, answers["id"] == s["_sid"], "left")
    bad_years = F.col("bad_years") if "bad_years" in answers.columns else F.lit(False)
    reject = (
        F.when(F.col("_sid").isNull(), "unknown_id")
        .when(~F.coalesce(F.col("band").isin(*BANDS) & F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "bad_band_or_confidence")
        .when(bad_years, "bad_min_years")
    )
    a = a.withColumn("_reject", reject).withColumns({"min_years": clean_years(F.col("min_years")), "evidence": clean_evidence(F.col("evidence"))})
    a = a.withColumn("_v", verify(F.col("band"), F.col("min_years"), F.col("evidence"), F.col("confidence"), F.col("_text")))
    saved = F.when(F.col("_v.evidence_verified") | (F.col("band") == "unknown"), "saved").otherwise("saved_unverified")
    ok = F.col("_reject").isNull()
    done = a.withColumns({"outcome": F.coalesce("_reject", saved), "confidence": F.when(ok, F.col("_v.confidence")), "evidence_verified": F.when(ok, F.col("_v.evidence_verified"))})
    payload = F.to_json(F.struct(F.lit(1).alias("schema"), "band", "min_years", "evidence", "confidence", "evidence_verified"))
    return done.withColumn("payload", F.when(F.col("_reject").isNull(), payload)).drop("_sid", "_text", "_reject", "_v")


def tally(outcomes: DataFrame, by: str = "round") -> DataFrame:
    """Outcomes by round and over all (round null)."""
    return outcomes.groupingSets([[by, "outcome"], ["outcome"]], by, "outcome").agg(F.count("*").alias("n"))


def usage(log: DataFrame) -> DataFrame:
    """Cache hits, calls, failures, unverified, tokens and their cost at list price (5 and 25 per million)."""
    total = log.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cache_hits", "calls", "failures", "unverified", "input_tokens", "output_tokens")))
    return total.withColumn("cost", F.col("input_tokens") / 1e6 * 5 + F.col("output_tokens") / 1e6 * 25)
