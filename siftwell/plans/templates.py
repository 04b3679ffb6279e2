"""Input frames of the registered queries, each in Spark and in DuckDB SQL: postings made from ``documents`` by a fixed template, and
two daily snapshots of ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import posting_id
from ..schemas import STORED, conform

TITLES = (
    "Software Engineer I", "Senior Software Engineer", "New Grad Software Engineer", "Software Engineering Intern", "Staff Platform Engineer",
    "Registered Nurse", "Software Engineer, Platform", "Junior Web Developer", "Marketing Intern", "Backend Engineer II", "Solutions Engineer",
    "Software Developer", "Leadership Programmer", "Engineering Manager", "International Software Engineer", "Android Developer",
)
SENTENCES = (
    "We build tools for farms.", "You bring 3+ years of experience.", "At least 1 year of practice and 5 years experience.",
    "An active security clearance is needed.", "You must be a US citizen.", "We will not sponsor work visas.", "We will sponsor visas for this role.",
    "Open to US citizens or permanent residents, or candidates requiring visa sponsorship.", "A 4-year degree program, or 2-4 years' experience.",
    "Requirements:\nPython, Go, and Kubernetes.\nNice to have:\nReact and Docker.", "Required:\nJava, SQL and Kafka.",
    "Minimum of 7 years in military or sanitary work.", "US citizenship is required. Experience with REST APIs.",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A posting per document; ``doc_id`` stays as the ordinal."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    there = n % 11 != 0
    made = d.select(
        "doc_id", pick(TITLES, n).alias("title"), F.col("source").alias("company"), F.concat(F.lit("https://jobs.example.com/"), n.cast("string")).alias("url"),
        F.when(n % 3 == 0, "greenhouse").when(n % 3 == 1, "Lever").otherwise("").alias("ats"), F.col("source").alias("tenant"), F.col("lang").alias("location"),
        F.when(there, F.concat(pick(SENTENCES, n), F.lit("\n"), "text")).otherwise("").alias("description"), there.alias("desc_available"),
        F.when(n % 17 != 0, F.timestamp_seconds(F.lit(1_704_067_200) + n % 500 * 3600)).alias("posted_at"), F.when(n % 19 == 0, "Intern").otherwise("").alias("employment_type"),
    )
    return made.withColumn("id", posting_id(F.col("url")))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


POSTINGS_SQL = f"""postings as (
  select doc_id, list_extract({_list(TITLES)}, (doc_id % {len(TITLES)} + 1)::int) as title, source as company, 'https://jobs.example.com/' || doc_id as url,
    case doc_id % 3 when 0 then 'greenhouse' when 1 then 'Lever' else '' end as ats, source as tenant, lang as location,
    case when doc_id % 11 <> 0 then list_extract({_list(SENTENCES)}, (doc_id % {len(SENTENCES)} + 1)::int) || chr(10) || text else '' end as description,
    doc_id % 11 <> 0 as desc_available,
    case when doc_id % 17 <> 0 then timestamp '2024-01-01 00:00:00' + to_hours((doc_id % 500)::int) end as posted_at,
    case when doc_id % 19 = 0 then 'Intern' else '' end as employment_type,
    substr(sha1('https://jobs.example.com/' || doc_id), 1, 16) as id
  from documents)"""


DAY_1, DAY_2 = "2024-03-01 00:00:00", "2024-03-02 00:00:00"


def _orders(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    """Orders as postings: the second day lacks other keys, and has changed titles and some descriptions."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = o.where(key % 7 != 0 if second else key % 10 != 0)
    available = key % 5 != 0 if second else key % 4 != 0
    text = F.concat(F.lit("day 2 " if second else "day 1 "), F.col("o_orderpriority"))
    return rows.select(
        key.cast("string").alias("id"), F.concat(F.lit("T2 " if second else "T1 "), "o_orderstatus").alias("title"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("company"),
        F.concat(F.lit("u"), key.cast("string")).alias("url"), F.when(available, text).otherwise("").alias("description"), available.alias("desc_available"),
        F.when(key % 50 != 0, F.col("o_orderdate").cast("timestamp")).alias("posted_at"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after the first day; a twelfth of it has been closed before."""
    day = F.lit(DAY_1).cast("timestamp")
    rows = _orders(spark, sf_dir, False).withColumns({"first_seen": day, "last_seen": day})
    return conform(rows.withColumn("closed_at", F.when(F.col("id").cast("long") % 12 == 0, day)), STORED)


def fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second day's fetch."""
    return conform(_orders(spark, sf_dir, True), STORED.split(", first_seen")[0])


def _orders_sql(second: bool) -> str:
    left, text, title = ("o_orderkey % 7 <> 0", "day 2 ", "T2 ") if second else ("o_orderkey % 10 <> 0", "day 1 ", "T1 ")
    there = "o_orderkey % 5 <> 0" if second else "o_orderkey % 4 <> 0"
    return f"""select o_orderkey::varchar as id, o_orderkey, '{title}' || o_orderstatus as title, 'c' || o_custkey as company,
      case when {there} then '{text}' || o_orderpriority else '' end as description, {there} as desc_available,
      case when o_orderkey % 50 <> 0 then o_orderdate end as posted_at from orders where {left}"""


DAYS_SQL = f"""day1 as (select *, timestamp '{DAY_1}' as first_seen, case when o_orderkey % 12 = 0 then timestamp '{DAY_1}' end as closed_at from ({_orders_sql(False)})),
day2 as ({_orders_sql(True)}),
merged as (
  select coalesce(a.id, b.id) as id, coalesce(b.title, a.title) as title, coalesce(a.company, b.company) as company,
    case when b.id is not null and (b.desc_available or a.id is null) then b.description else a.description end as description,
    coalesce(a.desc_available, false) or coalesce(b.desc_available, false) as desc_available, coalesce(a.posted_at, case when a.id is null then b.posted_at end) as posted_at,
    coalesce(a.first_seen, timestamp '{DAY_2}') as first_seen, case when b.id is null then timestamp '{DAY_1}' else timestamp '{DAY_2}' end as last_seen,
    case when b.id is null then a.closed_at end as closed_at, b.id is not null as came
  from day1 a full join day2 b on a.id = b.id),
closed as (select * replace (case when closed_at is null and not came then timestamp '{DAY_2}' else closed_at end as closed_at) from merged)"""
