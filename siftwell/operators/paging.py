"""Reading views: recency order, keyset pages, filters with exact counts, hydrating, cards, safe projections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fixed as K
from ..functions.literals import matches
from ..functions.text import cap, or_empty
from ..sources.folders import broadcast_small

#: Rows of a page that are broadcast.
PAGE_ROWS = 10_000


def by_recency(stamp: str, key: str) -> list[Column]:
    """Newest first, undated last; the key breaks ties, so the order is total."""
    return [F.col(stamp).desc_nulls_last(), F.col(key).desc()]


def after(stamp: str, key: str, boundary: tuple | None) -> Column:
    """Rows strictly below a boundary (stamp, key) in recency order; none is the top."""
    if boundary is None:
        return F.lit(True)
    ts, bid = boundary
    if ts is None:
        return F.col(stamp).isNull() & (F.col(key) < bid)
    at = F.lit(ts).cast("timestamp")
    return F.col(stamp).isNull() | (F.col(stamp) < at) | ((F.col(stamp) == at) & (F.col(key) < bid))


def page(rows: DataFrame, limit: int, stamp: str = "posted_at", key: str = "posting_id", boundary: tuple | None = None) -> DataFrame:
    """A page of ``limit`` rows; ``more`` (on each row) tells whether another follows.

    One row more than the page is read. Only the page is ranked, after the top-k cut.
    """
    top = rows.where(after(stamp, key, boundary)).orderBy(*by_recency(stamp, key)).limit(limit + 1)
    nth = F.row_number().over(Window.orderBy(*by_recency(stamp, key)))
    return top.withColumn("position", nth).withColumn("more", F.max("position").over(Window.partitionBy()) > limit).where(F.col("position") <= limit)


def row_filter(levels: Sequence[str] | None = None, posted_after=None, posted_before=None, include_undated: bool | None = None) -> Column:
    """The filter on view rows: band, and an inclusive window; undated rows pass without a window and not with one, unless told."""
    window = posted_after is not None or posted_before is not None
    undated = not window if include_undated is None else include_undated
    ok = F.col("level").isin(*levels) if levels else F.lit(True)
    dated = F.lit(True)
    if posted_after is not None:
        dated = dated & (F.col("posted_at") >= F.lit(posted_after).cast("timestamp"))
    if posted_before is not None:
        dated = dated & (F.col("posted_at") <= F.lit(posted_before).cast("timestamp"))
    return ok & F.when(F.col("posted_at").isNull(), F.lit(undated)).otherwise(dated)


def filtered_page(rows: DataFrame, where: Column, limit: int, boundary: tuple | None = None, stamp: str = "posted_at", key: str = "posting_id") -> DataFrame:
    """A page of the matching rows, and how many match in all (``matched``, over the whole view, not below the boundary).

    rows are those of a published generation: they are read twice, for the count and for the page.
    """
    hits = rows.where(where)
    matched = hits.agg(F.count("*").alias("matched"))
    return page(hits, limit, stamp, key, boundary).join(matched, F.lit(True))


def published_page(
    spark: SparkSession, folder: str, generation: str, view: str, limit: int, boundary: tuple | None = None, levels: Sequence[str] | None = None, posted_after=None,
    posted_before=None, include_undated: bool | None = None,
) -> DataFrame:
    """As :func:`filtered_page` with :func:`row_filter`, on a published generation, without a scan of its view.

    ``matched`` comes from the generation's cube of counts; only days that the window cuts are counted on rows. The cube also tells
    how many days the page needs, and the table of files which of them hold these days: just those are opened. Undated rows come last
    and have no days: a page that reaches them opens the files that hold any.
    """
    where = row_filter(levels, posted_after, posted_before, include_undated)
    window = posted_after is not None or posted_before is not None
    undated = not window if include_undated is None else include_undated
    edges = [F.lit(x).cast("timestamp") for x in (posted_after, posted_before, boundary and boundary[0])]
    after_, before, below = spark.sql("select 1").select(*edges).first()
    cube = spark.read.parquet(f"{folder}/cube/generation={generation}").where((F.col("view") == view) & (F.col("level").isin(*levels) if levels else F.lit(True)))
    days = {r["day"]: r["n"] for r in cube.groupBy("day").agg(F.sum("n").alias("n")).collect()}  # a row per day
    files = spark.read.parquet(f"{folder}/files/generation={generation}").where(F.col("view") == view)
    schema = spark.read.parquet(f"{folder}/rows/generation={generation}").schema

    def rows_of(wanted: Column) -> DataFrame:
        paths = [r["file"] for r in files.where(wanted).select("file").collect()]
        if not paths:
            return spark.createDataFrame([], schema)
        own = T.StructType([f for f in schema.fields if f.name != "view"])
        return spark.read.schema(own).parquet(*paths).withColumn("view", F.lit(view)).select(*schema.names)

    def overlapping(low: Column, high: Column) -> Column:
        return (F.col("newest") >= low) & (F.col("oldest") < high)

    start = lambda d: dt.datetime.combine(d, dt.time())
    end = lambda d: start(d) + dt.timedelta(days=1)
    dated = sorted((d for d in days if d is not None), reverse=True)
    touched = [d for d in dated if (after_ is None or end(d) > after_) and (before is None or start(d) <= before)]
    cut = [d for d in touched if (after_ is not None and start(d) < after_) or (before is not None and end(d) - dt.timedelta(microseconds=1) > before)]
    matched = sum(days[d] for d in touched if d not in cut) + (days.get(None, 0) if undated else 0)
    for d in cut:
        low, high = F.lit(start(d)), F.lit(end(d))
        matched += rows_of(overlapping(low, high)).where(where & (F.col("posted_at") >= low) & (F.col("posted_at") < high)).count()
    # days from the newest on, until whole ones below the boundary hold a page and one row more
    needed: list = []
    sure = 0
    if boundary is None or below is not None:
        for d in touched:
            if below is not None and start(d) > below:
                continue
            needed.append(d)
            sure += 0 if d in cut or (below is not None and end(d) > below) else days[d]
            if sure > limit:
                break
    wanted = F.lit(False)
    if needed:
        wanted = overlapping(F.lit(start(needed[-1])), F.lit(end(needed[0])))
    if undated and sure <= limit:
        wanted = wanted | (F.col("undated") > 0)
    hits = rows_of(wanted).where(where)
    if sure > limit:
        hits = hits.where(F.col("posted_at") >= F.lit(start(needed[-1])))
    return page(hits, limit, boundary=boundary).withColumns({"matched": F.lit(matched).cast("long"), "generation": F.lit(generation)})


def hydrate(page_rows: DataFrame, corpus: DataFrame, key: str = "posting_id", corpus_key: str = "id") -> DataFrame:
    """The postings of a page (open or closed); rows whose posting is missing drop out. A page is broadcast; more rows than that are an ordinary join."""
    own = [c for c in corpus.columns if c not in page_rows.columns or c == corpus_key]
    return corpus.select(*own).join(broadcast_small(page_rows, PAGE_ROWS), F.col(corpus_key) == F.col(key), "inner")


def source_filter(sources: Sequence[str]) -> Column:
    return F.lower(or_empty(F.col("ats"))).isin(*(s.lower() for s in sources))


def tier_filter(tiers: Sequence[str], profile: str | None) -> Column:
    """Needs scored rows, so a profile: without one the request is refused before anything is planned."""
    if not profile:
        raise ValueError("a tier filter needs a profile")
    return F.col("score.tier").isin(*tiers)


def top_of_each(rows: DataFrame, group: str, n: int, stamp: str = "posted_at", key: str = "posting_id") -> DataFrame:
    """The first n of each group in recency order, with ``total`` and ``more``. The count is a pre-aggregated join, not a window;
    rows are those of a published generation, which are read twice."""
    totals = rows.groupBy(group).agg(F.count("*").alias("total"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*by_recency(stamp, key)))).where(F.col("nth") <= n)
    return ranked.join(totals, group).withColumn("more", F.col("total") > n)


def description_status(available: Column, description: Column) -> Column:
    return F.when(~available, "not_provided").when(or_empty(description) == "", "empty").otherwise("available")


def card(items: DataFrame) -> DataFrame:
    """The list row: fifteen columns, no description."""
    c = F.col
    return items.select(
        "id", "title", "company", "location", "url", "ats", "level", c("level_source").alias("levelSource"), c("level_why").alias("levelWhy"),
        c("posted_at").alias("postedAt"), c("first_seen").alias("firstSeen"), "remote", c("employment_type").alias("employmentType"),
        c("desc_available").alias("descAvailable"), description_status(c("desc_available"), c("description")).alias("descriptionStatus"),
    )


#: How a published leaf is bounded: cut excerpt, cut text, refused when too long, or as it is.
EXCERPT, BOUNDED, EXACT, PLAIN = "excerpt", "bounded", "exact", "plain"
CARD_FIELDS = {
    "id": PLAIN, "title": BOUNDED, "company": BOUNDED, "location": BOUNDED, "url": EXACT, "ats": PLAIN, "level": PLAIN, "levelSource": PLAIN,
    "levelWhy": EXCERPT, "postedAt": PLAIN, "firstSeen": PLAIN, "remote": PLAIN, "employmentType": PLAIN, "descAvailable": PLAIN,
    "descriptionStatus": PLAIN,
}


def project(df: DataFrame, fields: dict) -> DataFrame:
    """Only the allowed fields: one missing, or a leaf that has become a struct, fails; others are dropped.

    A dict of fields allows a struct (or an array of them) field by field.
    """

    def leaf(c: Column, kind: T.DataType, rule, path: str) -> Column:
        if isinstance(rule, dict):
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                return F.transform(c, lambda x: struct(x, kind.elementType, rule, path))
            if not isinstance(kind, T.StructType):
                raise ValueError(f"{path}: a struct is expected")
            return F.when(c.isNotNull(), struct(c, kind, rule, path))
        inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if isinstance(inner, T.StructType):
            raise ValueError(f"{path}: a leaf has become a struct")
        if rule == EXCERPT:
            return F.when(c.isNotNull(), cap(c, K.QUOTE_CHARS))
        if rule == BOUNDED:
            return F.when(c.isNotNull(), cap(c, K.CARD_CHARS))
        if rule == EXACT:
            return F.when(F.length(c) > K.CARD_CHARS, F.raise_error(F.lit(f"{path}: too long to publish"))).otherwise(c)
        return c

    def struct(c: Column, kind: T.StructType, rules: dict, path: str) -> Column:
        types = {f.name: f.dataType for f in kind.fields}
        gone = [n for n in rules if n not in types]
        if gone:
            raise ValueError(f"{path}: missing {gone}")
        return F.struct(*(leaf(c[n], types[n], r, f"{path}.{n}").alias(n) for n, r in rules.items()))

    types = {f.name: f.dataType for f in df.schema.fields}
    gone = [n for n in fields if n not in types]
    if gone:
        raise ValueError(f"missing {gone}")
    return df.select(*(leaf(F.col(n), types[n], r, n).alias(n) for n, r in fields.items()))


def withheld(df: DataFrame) -> DataFrame:
    """The provenance of a published page."""
    return df.withColumns({
        "descriptionWithheld": F.col("descriptionStatus") == "available", "prosePublished": F.lit(False), "quoteMaxChars": F.lit(K.QUOTE_CHARS),
    })


def lookup(corpus: DataFrame, key: str, value) -> DataFrame:
    """One row by id, open or closed; its absence is an error."""
    found = corpus.where(F.col(key) == value)
    if not found.take(1):
        raise LookupError(f"no row {value!r}")
    return found


def by_url(postings: DataFrame, urls: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """For each wanted url the first posting whose url contains its last path segment or whose req_id is it.

    An automaton of the segments runs over each posting's url once. Only (ordinal, segment) pairs that match are grouped; the postings themselves are
    fetched by ordinal for the ones found. A url without a path segment finds nothing.
    """
    path = F.regexp_replace(F.regexp_replace("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "")
    ident = F.try_element_at(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(-1))
    wanted = urls.select(F.col("url").alias("wanted"), ident.alias("ident")).where("ident is not null").distinct()
    kind = postings.schema[ordinal].dataType
    within = matches(postings, wanted, ordinal, "url", "ident").select(F.col("id").cast(kind).alias("_at"), F.col("string").alias("ident"))
    named = postings.select(F.col(ordinal).alias("_at"), F.col("req_id").alias("ident")).join(wanted.select("ident").distinct(), "ident", "left_semi")
    first = within.unionByName(named.select("_at", "ident")).groupBy("ident").agg(F.min("_at").alias("_at"))
    found = wanted.join(first, "ident").select("wanted", "_at")
    rows = postings.join(broadcast_small(found), postings[ordinal] == found["_at"])
    # an ordinal that several postings share gives one of them
    return rows.groupBy("wanted").agg(F.min_by(F.struct(*(postings[c] for c in postings.columns)), "_at").alias("p")).select("wanted", "p.*")
