"""Landed board payloads to postings: one normaliser per payload shape, all returning the posting schema.

Payload tables hold one payload per row beside ``tenant`` (and ``wd``, ``site``, ``page`` where the shape
needs them). A payload that does not parse gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed as K
from ..functions.rules import is_sandbox
from ..functions.text import epoch_ms, filled, first_filled, html_to_text, iso_time, or_empty
from ..schemas import POSTING, WATCHLIST, conform

NESTED = (
    "jobs array<struct<title:string,absolute_url:string,company_name:string,location:struct<name:string>,content:string,"
    "requisition_id:string,id:string,first_published:string,updated_at:string>>"
)
LISTED = (
    "jobs array<struct<title:string,jobUrl:string,applyUrl:string,isListed:boolean,descriptionPlain:string,descriptionHtml:string,"
    "isRemote:boolean,employmentType:string,publishedAt:string,location:string,id:string>>"
)
ARRAY = (
    "array<struct<id:string,text:string,hostedUrl:string,applyUrl:string,descriptionPlain:string,additionalPlain:string,description:string,"
    "createdAt:double,workplaceType:string,categories:struct<location:string,commitment:string>>>"
)
SEARCH = (
    "jobs array<struct<id:string,url:string,title:string,company:string,description:string,workplace:string,location:string,"
    "created:string,updated:string,employmentType:string>>, nextPageToken string"
)
WIDGET = (
    "name string, jobs array<struct<title:string,application_url:string,url:string,shortlink:string,description:string,full_description:string,"
    "location:string,city:string,id:string,shortcode:string,published_on:string,created_at:string>>"
)
TITLES = "jobPostings array<struct<externalPath:string,title:string,locationsText:string,remoteType:string>>"
#: The JSON parser gives up a job with a string of over 20 million characters, unless told otherwise.
WHOLE = {"maxStringLen": str(2**31 - 1)}


def _jobs(payloads: DataFrame, schema: str, jobs: str = "jobs", keep: tuple[str, ...] = ("tenant",)) -> DataFrame:
    parsed = payloads.select(*keep, F.from_json("payload", schema, WHOLE).alias("p"))
    field = F.col("p") if schema.startswith("array") else F.col(f"p.{jobs}")
    return parsed.select(*keep, F.col("p").alias("page_fields"), F.explode(field).alias("j")) if not schema.startswith("array") else parsed.select(*keep, F.explode(field).alias("j"))


def _done(rows: DataFrame, ats: str, title: Column, url: Column, description: Column | None, **more: Column) -> DataFrame:
    out = rows.withColumns({"_title": or_empty(title), "_url": url}).where((F.col("_title") != "") & (F.col("_url") != ""))
    text = F.lit("") if description is None else description
    columns = {"title": F.col("_title"), "url": F.col("_url"), "ats": F.lit(ats), "description": text} | more
    made = out.select(*(c.alias(n) for n, c in columns.items()))
    return conform(made.withColumn("desc_available", F.col("description") != ""), POSTING)


def nested_jobs(payloads: DataFrame) -> DataFrame:
    """Jobs with encoded HTML content."""
    j, rows = F.col("j"), _jobs(payloads, NESTED)
    return _done(
        rows, "greenhouse", j["title"], or_empty(j["absolute_url"]), html_to_text(j["content"]), company=first_filled(j["company_name"], F.col("tenant")),
        tenant=F.col("tenant"), location=or_empty(j["location"]["name"]), req_id=first_filled(j["requisition_id"], j["id"]),
        posted_at=F.coalesce(iso_time(j["first_published"]), iso_time(j["updated_at"])),
    )


def listed_jobs(payloads: DataFrame) -> DataFrame:
    """Jobs with a listed flag: only a literal false hides one. Plain text first, HTML otherwise."""
    j, rows = F.col("j"), _jobs(payloads, LISTED)
    rows = rows.where(~j["isListed"].eqNullSafe(F.lit(False)))
    text = F.when(or_empty(j["descriptionPlain"]) != "", j["descriptionPlain"]).otherwise(html_to_text(j["descriptionHtml"]))
    return _done(
        rows, "ashby", j["title"], first_filled(j["jobUrl"], j["applyUrl"]), text, company=F.col("tenant"), tenant=F.col("tenant"),
        location=or_empty(j["location"]), req_id=or_empty(j["id"]), posted_at=iso_time(j["publishedAt"]), remote=j["isRemote"],
        employment_type=or_empty(j["employmentType"]),
    )


def array_jobs(payloads: DataFrame) -> DataFrame:
    """A top-level array. Remote is true or unknown, never false."""
    j, rows = F.col("j"), _jobs(payloads, ARRAY)
    plain = F.concat_ws("\n\n", filled(j["descriptionPlain"]), filled(j["additionalPlain"]))
    return _done(
        rows, "lever", j["text"], first_filled(j["hostedUrl"], j["applyUrl"]), F.when(plain != "", plain).otherwise(html_to_text(j["description"])),
        company=F.col("tenant"), tenant=F.col("tenant"), location=or_empty(j["categories"]["location"]), req_id=or_empty(j["id"]),
        posted_at=epoch_ms(j["createdAt"]), remote=F.when(F.lower(or_empty(j["workplaceType"])) == "remote", True),
        employment_type=or_empty(j["categories"]["commitment"]),
    )


def search_jobs(payloads: DataFrame) -> DataFrame:
    """A page of a search over all companies; company and location are an object or a scalar. See :func:`search_tokens`."""
    j, rows = F.col("j"), _jobs(payloads.withColumn("tenant", F.lit("")), SEARCH)
    title_of = lambda c: F.when(or_empty(c).startswith("{"), or_empty(F.get_json_object(c, "$.title"))).otherwise(or_empty(c))
    part = lambda c, k: filled(F.get_json_object(c, f"$.{k}"))
    place = F.when(
        or_empty(j["location"]).startswith("{"),
        F.concat_ws(", ", part(j["location"], "city"), part(j["location"], "subregion"), part(j["location"], "countryName")),
    ).otherwise(or_empty(j["location"]))
    work = F.lower(or_empty(j["workplace"]))
    return _done(
        rows, "workable", j["title"], or_empty(j["url"]), html_to_text(j["description"]), company=title_of(j["company"]), location=place,
        req_id=or_empty(j["id"]), posted_at=F.coalesce(iso_time(j["created"]), iso_time(j["updated"])),
        remote=F.when(work == "remote", True).when(work != "", False), employment_type=or_empty(j["employmentType"]),
    )


def search_tokens(payloads: DataFrame) -> DataFrame:
    """Each search page's token of the next page ("" at the end), beside the table's other columns."""
    return payloads.withColumn("next_token", or_empty(F.from_json("payload", SEARCH, WHOLE)["nextPageToken"]))


def widget_jobs(payloads: DataFrame) -> DataFrame:
    """One company's widget."""
    j, rows = F.col("j"), _jobs(payloads, WIDGET)
    text = F.coalesce(filled(html_to_text(j["description"])), html_to_text(j["full_description"]))
    return _done(
        rows, "workable", j["title"], first_filled(j["application_url"], j["url"], j["shortlink"]), text,
        company=first_filled(F.col("page_fields.name"), F.col("tenant")), tenant=F.col("tenant"), location=first_filled(j["location"], j["city"]),
        req_id=first_filled(j["id"], j["shortcode"]), posted_at=F.coalesce(iso_time(j["published_on"]), iso_time(j["created_at"])),
    )


def title_jobs(payloads: DataFrame) -> DataFrame:
    """Titles only: never a description, and dates in prose that are left out."""
    j, rows = F.col("j"), _jobs(payloads, TITLES, "jobPostings", ("tenant", "wd", "site"))
    path = or_empty(j["externalPath"])
    url = F.when(path != "", F.format_string("https://%s.%s.myworkdayjobs.com/%s%s", F.col("tenant"), F.col("wd"), F.col("site"), path)).otherwise("")
    return _done(
        rows, "workday", j["title"], url, None, company=F.col("tenant"), tenant=F.col("tenant"), location=or_empty(j["locationsText"]),
        req_id=F.substring_index(path, "_", -1), remote=F.when(F.lower(or_empty(j["remoteType"])).contains("remote"), True),
    )


def drop_wrapped_pages(pages: DataFrame, board: list[str], page: str, paths: str) -> DataFrame:
    """Pages of a board up to the first that is empty or repeats an earlier page's set of paths."""
    keyed = pages.withColumn("_set", F.array_sort(F.array_distinct(F.col(paths))))
    again = F.row_number().over(Window.partitionBy(*board, "_set").orderBy(page)) > 1
    bad = keyed.withColumn("_bad", (F.size("_set") == 0) | again)
    first = F.min(F.when(F.col("_bad"), F.col(page))).over(Window.partitionBy(*board))
    return bad.withColumn("_first", first).where(F.col("_first").isNull() | (F.col(page) < F.col("_first"))).drop("_set", "_bad", "_first")


def fresh_rows(rows: DataFrame, walk: list[str], key: str, page: str, position: str) -> DataFrame:
    """Within a walk the first row of each id, up to the first page that adds none."""
    nth = F.row_number().over(Window.partitionBy(*walk, key).orderBy(page, position))
    marked = rows.withColumn("_fresh", nth == 1)
    by_page = marked.groupBy(*walk, page).agg(F.max("_fresh").alias("_adds")).where("not _adds").groupBy(*walk).agg(F.min(page).alias("_stop"))
    return marked.where("_fresh").join(by_page, walk, "left").where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).select(*rows.columns)


NORMALISERS = {"greenhouse": nested_jobs, "ashby": listed_jobs, "lever": array_jobs, "workable": widget_jobs, "workday": title_jobs}


def normalise(landed: DataFrame) -> DataFrame:
    """Landed payloads (ats, tenant, wd, site, payload) to postings, each branch by its own normaliser.

    The landing is partitioned by ats, so that each branch reads its own files and a payload is read once. An unknown ats fails the job.
    """
    ats = or_empty(F.col("ats"))
    refused = landed.where(~ats.isin(*NORMALISERS)).select(F.raise_error(F.concat(F.lit("no source for "), ats)).cast("string").alias("title"))
    out = conform(refused, POSTING)
    for name, parse in NORMALISERS.items():
        out = out.unionByName(parse(landed.where(F.col("ats") == name)))
    return out


def fan_in(*sources: DataFrame) -> DataFrame:
    """All sources one after the other: the first has the smallest ``source_order``."""
    out = None
    for i, s in enumerate(sources):
        rows = s.withColumn("source_order", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def watchlist(rows: DataFrame, allow_sandbox: bool = False) -> DataFrame:
    """Valid watchlist rows: a known ats (any case), a tenant, a shard and site where the ats needs them, no sandbox board."""
    w = conform(rows, WATCHLIST).withColumn("ats", F.lower(F.trim("ats")))
    complete = (F.col("tenant") != "") & ((F.col("ats") != "workday") | ((F.col("wd") != "") & (F.col("site") != "")))
    return w.where(F.col("ats").isin(*K.SUPPORTED) & complete & (F.lit(allow_sandbox) | ~is_sandbox(F.col("tenant"))))
