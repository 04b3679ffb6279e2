"""Other scans: corpora, watchlist files, listings, mail, scraped data, scored jobs, model answers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.rules import keyword_score, posting_id, title_matches
from ..functions.text import first_filled, or_empty
from ..schemas import ANSWER, POSTING, conform
from .boards import watchlist
from .folders import exists


def posting_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of postings."""
    return conform(spark.read.schema(POSTING).json(path, multiLine=True), POSTING)


def watchlist_file(spark: SparkSession, path: str, allow_sandbox: bool = False) -> DataFrame:
    """A watchlist document: ``{companies: [..]}`` or a bare list. A missing file is an empty list."""
    row = "struct<company:string,ats:string,tenant:string,wd:string,site:string>"
    texts = spark.read.option("ignoreMissingFiles", "true").text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{row}>")).otherwise(F.from_json("value", f"companies array<{row}>")["companies"])
    return watchlist(texts.select(F.inline(listed)), allow_sandbox)


def listings(rows: DataFrame, active_only: bool = True) -> DataFrame:
    active = rows.where(F.coalesce(F.col("active"), F.lit(False))) if active_only else rows
    return active.select(or_empty(F.col("company_name")).alias("company"), or_empty(F.col("url")).alias("url"))


def mail(messages: DataFrame) -> DataFrame:
    """sender, subject and snippet of messages with a header list; of repeated headers the last counts, in any case."""
    last = lambda name: or_empty(F.element_at(F.filter("payload.headers", lambda h: F.lower(h["name"]) == name), -1)["value"])
    found = lambda name: F.when(F.size(F.filter("payload.headers", lambda h: F.lower(h["name"]) == name)) > 0, last(name)).otherwise("")
    return messages.select(found("from").alias("sender"), found("subject").alias("subject"), or_empty(F.col("snippet")).alias("snippet"))


def newest_mail(messages: DataFrame, most: int, by: str) -> DataFrame:
    return messages.orderBy(F.col(by).desc()).limit(most)


def new_scored_jobs(jobs: DataFrame, seen: DataFrame, most: int = 8, min_score: float = 75, scanned: int = 300) -> DataFrame:
    """The best new jobs not surfaced before: of the ``scanned`` best, scores rounded half to even."""
    top = jobs.where((F.col("status") == "new") & (F.col("match_score") >= min_score)).orderBy(F.desc("match_score"), F.desc("fetched_at")).limit(scanned)
    fresh = top.withColumn("id", posting_id(F.col("url"))).join(seen.select("id"), "id", "left_anti")
    best = fresh.orderBy(F.desc("match_score"), F.desc("fetched_at")).limit(most)
    return best.select("id", "title", "company", or_empty(F.col("location")).alias("location"), "url", F.bround("match_score").cast("int").alias("score"))


def scraped_jobs(rows: DataFrame, most: int = 25, min_score: int = 30) -> DataFrame:
    """Scraped rows with fields under several names, gated by title, scored, best first (ties by ``ordinal``)."""
    pick = lambda *names: first_filled(*(F.col(n) for n in names if n in rows.columns), F.lit(""))
    title, url = pick("title", "positionName"), pick("url", "link", "jobUrl")
    slim = rows.select(
        "ordinal", title.alias("title"), url.alias("url"), pick("companyName", "company").alias("company"), pick("location").alias("location"),
        pick("description", "descriptionText").alias("description"),
    ).where("title <> '' and url <> ''")
    scored = slim.where(title_matches(F.col("title"), K.OLD_TITLE_MUST, K.OLD_TITLE_BLOCK)).withColumn(
        "score", keyword_score(F.col("title"), F.col("description"), K.OLD_KEYWORDS)
    )
    top = scored.where(F.col("score") >= min_score).orderBy(F.desc("score"), "ordinal").limit(most)
    return top.select(posting_id(F.col("url")).alias("id"), "title", "company", "location", "url", "score")


#: Containers within one another that an answer may have; a value with more is not read.
NESTING = 200

_BLANK = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"')
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity")


class _Spans:
    """Where the JSON objects and arrays of a text end.

    What a container's end is depends on its start alone, so each start is judged once: a container that closes skips over those within
    it that are known, and one that fails takes with it all that are open around the failure. The work is linear in the text,
    however its brackets lie, and nothing recurses.
    """

    def __init__(self, text: str):
        self.text, self.ends = text, {}

    def end(self, start: int) -> tuple[int, int]:
        """The end of the container at ``start`` (-1 if it is none) and how deep it is nested."""
        if start not in self.ends:
            self._walk(start)
        return self.ends[start]

    def _walk(self, start: int) -> None:
        text, blank = self.text, lambda i: _BLANK.match(self.text, i).end()
        stack = [[start, 1]]
        at, fresh = start + 1, True  # fresh: nothing in the innermost container yet
        while stack:
            opener = text[stack[-1][0]]
            at = blank(at)
            c = text[at : at + 1]
            if c == ("}" if opener == "{" else "]"):  # only ever reached where a container may close
                begun, depth = stack.pop()
                at += 1
                self.ends[begun] = at, depth
                if stack:
                    stack[-1][1] = max(stack[-1][1], depth + 1)
                fresh = False
                continue
            if not fresh:
                if c != ",":
                    break
                at = blank(at + 1)
            if opener == "{":
                key = _STRING.match(text, at)
                if not key:
                    break
                at = blank(key.end())
                if text[at : at + 1] != ":":
                    break
                at = blank(at + 1)
            c = text[at : at + 1]
            if c and c in "{[":
                if at not in self.ends:
                    stack.append([at, 1])
                    at, fresh = at + 1, True
                    continue
                end, depth = self.ends[at]
                if end < 0:
                    break
                stack[-1][1] = max(stack[-1][1], depth + 1)
                at = end
            else:
                value = _STRING.match(text, at) if c == '"' else _SCALAR.match(text, at)
                if not value:
                    break
                at = value.end()
            fresh = False
        for begun, _ in stack:
            self.ends[begun] = -1, 0


def first_json(raw: str, openers: str = "{[", spans: _Spans | None = None):
    """The first JSON object in a text, else the first array, else None. ``spans`` of the text may be shared between calls.

    Linear in the text's length. A value nested beyond ``NESTING``, or with a number that Python does not read, makes the text one without JSON.
    """
    spans = spans or _Spans(raw)
    shallow = raw.count("{") + raw.count("[") <= NESTING
    for opener in openers:
        at = raw.find(opener)
        if at >= 0 and shallow:  # the usual case: the first one is it
            try:
                return json.JSONDecoder().raw_decode(raw, at)[0]
            except json.JSONDecodeError:
                pass
            except ValueError:
                return None
        while at >= 0:
            end, depth = spans.end(at)
            if end >= 0:
                try:
                    return json.loads(raw[at:end]) if depth <= NESTING else None
                except ValueError:
                    return None
            at = raw.find(opener, at + 1)
    return None


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = _Spans(text or "")
            found = first_json(text or "", spans=spans)
            items = found.get("answers") if isinstance(found, dict) else found
            if not isinstance(items, list):
                items = first_json(text or "", "[", spans)  # a bare list: the first object was its first answer
            for i, a in enumerate(items if isinstance(items, list) else []):
                if isinstance(a, dict):
                    # half of a surrogate pair, which JSON may spell, is no text
                    get = lambda k, a=a: a[k].encode("utf-8", "replace").decode() if isinstance(a.get(k), str) else None
                    years = a.get("min_years")
                    whole = isinstance(years, int) and not isinstance(years, bool) and abs(years) < 1 << 31
                    bad = years is not None and not whole
                    out.append((key, i, get("id"), get("band"), years if whole else None, get("evidence") or "", get("confidence") or "low", bad))
        if out:
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
            names = ["round", "position", "id", "band", "min_years", "evidence", "confidence", "bad_years"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def answers(texts: DataFrame, round_col: str, text_col: str) -> DataFrame:
    """Model answers in free text, a row per answer; a text without a readable value loses only itself."""
    slim = texts.select(F.col(round_col).cast("string").alias("round"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_answers, f"round string, position int, {ANSWER}, bad_years boolean")
