"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings are never null ("" when unknown); posted_at and remote (yes, no, unknown) may be.
POSTING = (
    "title string, company string, url string, ats string, tenant string, location string, description string, desc_available boolean, "
    "req_id string, posted_at timestamp, remote boolean, employment_type string, experience_level string"
)
HISTORY = "first_seen timestamp, last_seen timestamp, closed_at timestamp, interpretation string, applied_at timestamp"
STORED = f"id string, {POSTING}, {HISTORY}"
WATCHLIST = "company string, ats string, tenant string, wd string, site string"
MAIL = "sender string, subject string, snippet string"
ANSWER = "id string, band string, min_years int, evidence string, confidence string"
VIEW_VERSION = 1


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the columns of a schema: missing ones null (strings empty for postings), others dropped, types cast."""
    from pyspark.sql.types import StructType

    out = []
    for f in StructType.fromDDL(schema).fields:
        have = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        column = have.cast(f.dataType)
        text = f.dataType.simpleString() == "string" and f.name not in ("interpretation", "id")
        out.append((F.coalesce(column, F.lit("")) if text else column).alias(f.name))
    return df.select(*out)
