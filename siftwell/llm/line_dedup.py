"""Line dedup by site-relative frequency.

Per host, the number of pages that contain a line is divided by the host's pages; a line above
``max_ratio`` on at least ``min_pages`` pages is boilerplate of that host and is dropped from all of its pages.
All of it is DataFrame functions.

Lines are what ``\\n`` separates and are compared whole, by two independent 64-bit hashes; lines without a word
are neither counted nor dropped. A page counts once for a line however often it holds it; pages of a host with the same
text count as one page (``distinct``), so that copies of a document do not make its own lines boilerplate. With
``distinct`` off, each row is a page, rows of equal id too. A null host is no site: its lines stay. Null text stays null. A page whose
lines all go keeps an empty text.

What grows is pre-aggregated before each shuffle: pages per host, and pages per (host, line); of distinct texts only the
lines' hashes are shuffled, and the lines of a host meet its total in salted parts. A host
has at most (lines of a page) / ``max_ratio`` boilerplate lines, in a table of lists by hash, one for every ``LIST`` of them, so that a line is compared with few
and a host's table is as large as its lines (some 30 bytes each); where all hosts' together are few (``broadcast_rows``, counted first, so some megabytes)
they are broadcast and texts are not shuffled at all, else texts meet them in a plain join on the host, in which Spark splits hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

_WORD = r"[^\x20\x09-\x0D]"
#: Boilerplate lines of a host for each list of its table, and parts of a host in the join with its total.
LIST, SALTS = 8, 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _slot(key: Column, lists: Column) -> Column:
    return F.pmod(key["a"], lists.cast("long"))


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int, distinct: bool = True) -> DataFrame:
    """host, ``keys`` (the keys of its n boilerplate lines, an array of arrays by hash) and n. pages: columns host and text."""
    rows = pages.where("host is not null")
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: x.rlike(_WORD)), _key))
    lines, content = rows.select("host", keys.alias("keys")), _key(F.col("text")).alias("content")
    if distinct:
        lines = rows.select("host", content, keys.alias("keys")).dropDuplicates(["host", "content"])
        rows = rows.select("host", content).distinct()
    totals = rows.groupBy("host").agg(F.count("*").alias("total"))
    counts = lines.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    parts = totals.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    common = counts.withColumn("part", F.pmod(F.col("key.b"), F.lit(SALTS)).cast("int")).join(parts, ["host", "part"]).where(F.col("n") > max_ratio * F.col("total"))
    by_host = common.groupBy("host").agg(F.collect_list("key").alias("all")).select("host", "all", F.size("all").cast("long").alias("n"))
    lists = F.expr(f"n div {LIST} + 1")
    table = F.transform(F.sequence(F.lit(0).cast("long"), lists - 1), lambda i: F.filter("all", lambda k: _slot(k, lists) == i))
    return by_host.select("host", table.alias("keys"), "n")


def drop_boilerplate(
    docs: DataFrame, max_ratio: float = 0.02, min_pages: int = 3, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
    broadcast_rows: int = 50_000, distinct: bool = True,
) -> DataFrame:
    """All columns of ``docs``, the text without boilerplate lines, and n_lines and n_dropped (``_siftwell_``-prefixed)."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, inner))
    rows = docs.toDF(*inner).withColumn("host", F.col(at[host_col]).cast("string")).withColumn("text", F.col(at[text_col]).cast("string"))
    found = materialise(boilerplate(rows.select("host", "text"), max_ratio, min_pages, distinct), "line-dedup")
    lines = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if lines <= broadcast_rows:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        joined = rows.join(found.hint("merge"), "host", "left")
    # a line's key is computed once: it is the one element of an array
    common = lambda x: F.exists(F.array(_key(x)), lambda k: F.array_contains(F.get("keys", _slot(k, F.size("keys")).cast("int")), k))
    kept = F.filter(_lines(F.col("text")), lambda x: ~common(x) | ~x.rlike(_WORD))
    joined = joined.withColumn("kept", F.when(F.col("keys").isNull(), _lines(F.col("text"))).otherwise(kept))
    columns = [F.array_join("kept", "\n").alias(b) if b == text_col else F.col(a).alias(b) for a, b in zip(inner, names)]
    n_lines = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0))
    n_kept = F.coalesce(F.size("kept"), F.lit(0))
    count = lambda c: F.when(F.col("text").isNull(), F.lit(0)).otherwise(c).cast("long")
    return joined.select(*columns, count(n_lines).alias("_siftwell_lines"), count(n_lines - n_kept).alias("_siftwell_dropped"))


#: DuckDB SQL for the digest query over ``documents``: every row is a page; the other parameters are the operator's defaults.
ORACLE = r"""
with lines as (
  select doc_id, source, pos, line from (
    select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from documents)
), totals as (select source, count(*) as total from documents where source is not null group by source),
counted as (
  select source, line, count(distinct doc_id) as n from lines
  where source is not null and regexp_matches(line, '[^\x20\x09-\x0D]') group by source, line
), common as (
  select c.source, c.line from counted c join totals t on c.source = t.source where c.n >= 3 and c.n > 0.02 * t.total
), kept as (
  select l.doc_id, count(*) as n_lines, sum(case when c.line is null then 0 else 1 end) as n_dropped,
    string_agg(l.line, chr(10) order by l.pos) filter (where c.line is null) as text
  from lines l left join common c on l.source = c.source and l.line = c.line group by l.doc_id
)
select d.doc_id, d.source as host, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_dropped, 0)::bigint as n_dropped,
  case when d.text is null then null else sha256(coalesce(k.text, '')) end as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id
"""


def digest(docs: DataFrame, distinct: bool = False, **parameters) -> DataFrame:
    """doc_id, host, n_lines, n_dropped and the kept text's SHA-256, a row per input row. Like its SQL, it counts every row as a page."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), F.col("text").alias("text"))
    out = drop_boilerplate(slim, distinct=distinct, **parameters)
    return out.select(
        "doc_id", F.col("source").alias("host"), F.col("_siftwell_lines").alias("n_lines"), F.col("_siftwell_dropped").alias("n_dropped"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )
