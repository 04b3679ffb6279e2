"""Coverage scores against a profile, facets, keyword ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.rules import keyword_score, level_confirmed, posting_id, title_matches
from ..functions.text import once, strip, strip_tags
from ..functions.tokens import coverage_line, coverage_score, explain_score, gap, sections, tokens_in, unscored_reason


def profile_tokens(df: DataFrame, text_col: str = "text", vocabulary=K.VOCABULARY) -> list[str]:
    """The tokens of one profile document (a single row)."""
    return df.select(tokens_in(strip_tags(F.col(text_col)), vocabulary).alias("t")).first()["t"]


def score(postings: DataFrame, mine: Column | Sequence[str] | None, confirmed: Column | None = None, vocabulary=K.VOCABULARY) -> DataFrame:
    """report (``gap``), score, explanation and unscored reason beside the postings' columns; all null without a profile.

    A blank description is unparsed: no tokens, so unscored.
    """
    if mine is None:
        return postings.withColumns({c: F.lit(None) for c in ("report", "score", "explanation", "unscored", "coverage")})
    own = mine if isinstance(mine, Column) else (F.array(*map(F.lit, mine)) if len(mine) else F.array().cast("array<string>"))
    sure = level_confirmed(F.col("level")) if confirmed is None else confirmed
    # in steps, so that each row's patterns are evaluated once
    split = postings.withColumn("_parts", sections(F.col("description")))
    found = split.withColumns({"_req": once(tokens_in(F.col("_parts.required"), vocabulary)), "_pref": once(tokens_in(F.col("_parts.preferred"), vocabulary))})
    reported = found.withColumn("report", gap(F.col("_req"), F.col("_pref"), own))
    scored = reported.withColumn("score", coverage_score(F.col("report"), sure)).drop("_parts", "_req", "_pref")
    return scored.withColumns({
        "explanation": explain_score(F.col("score")), "unscored": unscored_reason(F.col("score"), F.col("description")), "coverage": coverage_line(F.col("report")),
        "unparsed": strip(F.coalesce("description", F.lit(""))) == "",
    })


def facets(rows: DataFrame, level: str = "level", source: str = "ats", tier: str = "tier") -> DataFrame:
    """facet, value and n by level, source (lower, ``unknown`` when empty) and tier (scored rows), in one pass of grouping sets."""
    src = F.coalesce(F.nullif(F.lower(F.trim(F.col(source))), F.lit("")), F.lit("unknown"))
    slim = rows.select(F.col(level).alias("level"), src.alias("source"), F.col(tier).alias("tier"))
    sets = slim.groupingSets([["level"], ["source"], ["tier"]], "level", "source", "tier").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    facet = F.when(F.col("g") == 3, "level").when(F.col("g") == 5, "source").otherwise("tier")
    return sets.select(facet.alias("facet"), F.coalesce("level", "source", "tier").alias("value"), "n").where(F.col("value").isNotNull())


def distinct_companies(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct(F.lower(strip(F.col("company")))).alias("companies"))


def keyword_rank(
    rows: DataFrame, seen: DataFrame | None = None, weights: dict[str, int] = K.KEYWORDS, must: Sequence[str] = K.TITLE_MUST,
    block: Sequence[str] = K.TITLE_BLOCK, min_score: int = 40, limit: int = 8, ordinal: str = "ordinal",
) -> DataFrame:
    """The legacy rank: title gate, unseen, scored, best first (earlier rows on ties)."""
    named = rows.where("title <> '' and url <> ''").where(title_matches(F.col("title"), must, block)).withColumn("id", posting_id(F.col("url")))
    fresh = named if seen is None else named.join(seen.select("id"), "id", "left_anti")
    scored = fresh.withColumn("score", keyword_score(F.col("title"), F.col("description"), weights)).where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), ordinal).limit(limit)


def digest(kept: DataFrame, new_ids: DataFrame, most: int = 8) -> DataFrame:
    """The newest kept rows that are new in this run."""
    return kept.join(new_ids.select("id"), "id", "left_semi").orderBy(F.col("posted_at").desc_nulls_last(), F.col("id").desc()).limit(most)
