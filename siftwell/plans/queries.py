"""The registered queries: an operator (or a pipeline of them) over the supplied tables, and the same in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import rules as R
from ..functions import text as X
from ..functions import tokens as N
from ..functions import urls as U
from ..operators import backlog, inbox, lifecycle, paging, quality, scoring, screening
from ..sources.folders import shared_folder
from .templates import DAY_1, DAY_2, DAYS_SQL, POSTINGS_SQL, corpus, fetch, postings, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _q(pattern: str) -> str:
    """A pattern as a SQL string for RE2: look-aheads that a following boundary implies are left out."""
    for ahead in ("(?!ership)", "(?![a-z])", "(?![ivx])", "(?!script)"):
        pattern = pattern.replace(ahead, "")
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _bounded(pattern: str) -> str:
    r"""As :func:`_q` with ``\b`` seeing letters of every script, for prose."""
    spread = re.sub(r"(^|\(|\||\?:)\\b", r"\1(?:^|[^\\pL\\pN_])", pattern).replace(r"\b", r"(?:$|[^\pL\pN_])")
    return _q(spread)


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_q(pattern)})"


def _collapse(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


# --- bands, eligibility, screening ------------------------------------------------------------------

_BAND = "case " + " ".join(f"when {_has('title', p)} then '{b}'" for p, b in K.TITLE_BANDS) + " else 'unknown' end"
_CLEAN = f"regexp_replace(description, {_q(K.EDUCATION_NOISE)}, ' ', 'g')"
_YEARS = (
    "list_min(list_filter(list_transform(list_concat(list_concat(" + "), list_concat(".join(
        f"regexp_extract_all({_CLEAN}, {_q(a)}, 1), regexp_extract_all({_CLEAN}, {_q(b)}, 1)" for a, b in zip(K.YEARS_PATTERNS[::2], K.YEARS_PATTERNS[1::2])
    ) + f")), lambda x: x::int), lambda x: x between 0 and {K.MAX_YEARS}))"
)
_YEARS_BAND = f"case when years is null then 'unknown' when years <= {K.ENTRY_MAX_YEARS} then 'entry' when years <= {K.MID_MAX_YEARS} then 'mid' else 'senior' end"


def _evidence(pattern: str) -> str:
    hit = f"regexp_extract(description, {_q(pattern)}, 0)"
    at = f"instr(description, {hit})"
    low = f"greatest({at} - {K.EVIDENCE_CONTEXT}, 1)"
    return f"case when {hit} = '' then '' else {_collapse(f'substr(description, {low}, {at} - {low} + length({hit}) + {K.EVIDENCE_CONTEXT})')} end"


_CITE = f"regexp_extract(description, {_q(K.CITIZENSHIP)}, 0)"
_CITE_AT = f"instr(description, {_CITE})"
_CITE_LOW = f"greatest({_CITE_AT} - {K.VETO_WINDOW}, 1)"
# no text of the template states citizenship twice, so that the first hit decides
_CITIZEN = (
    f"case when {_CITE} <> '' and not regexp_matches(substr(description, {_CITE_LOW}, {_CITE_AT} - {_CITE_LOW} + length({_CITE}) + {K.VETO_WINDOW}), {_bounded(K.CITIZENSHIP_VETO)})"
    f" then trim({_CITE}) else '' end"
)
_SCREENED = f"""{POSTINGS_SQL}, facts as (
  select *, {_BAND} as title_band, case when desc_available then {_YEARS} end as years,
    case when desc_available then {_evidence(K.CLEARANCE)} else '' end as clearance, case when desc_available then {_CITIZEN} else '' end as citizenship,
    case when desc_available then {_evidence(K.NO_SPONSORSHIP)} else '' end as refused, case when desc_available then {_evidence(K.YES_SPONSORSHIP)} else '' end as offered
  from postings
), leveled as (
  select *, case when title_band <> 'unknown' then title_band else {_YEARS_BAND} end as level,
    case when title_band <> 'unknown' then 'title' when years is not null then 'years' else 'none' end as level_source
  from facts
), gated as (
  select *, list_filter([
      case when title = '' or {_has('title', K.ROLE_DENY)} or not {_has('title', K.ROLE_ALLOW)} then '{K.GATES[0]}' end,
      case when {_has('company', K.SANDBOX_SLUG)} then '{K.GATES[1]}' end,
      case when {_has('title', K.INTERNSHIP_TITLE)} or lower(employment_type) = 'intern' then '{K.GATES[2]}' end,
      case when level not in ('unknown', 'intern', 'entry') then '{K.GATES[3]}' end, case when clearance <> '' then '{K.GATES[4]}' end,
      case when citizenship <> '' then '{K.GATES[5]}' end, case when refused <> '' then '{K.GATES[6]}' end], lambda g: g is not null) as gates
  from leveled
), screened as (select *, len(gates) = 0 as kept from gated)"""


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen(postings(spark, sf_dir))


@query("lvl_1_title_band", f"with {POSTINGS_SQL} select doc_id, {_BAND} as band from postings")
def title_band(spark, sf_dir):
    return postings(spark, sf_dir).select("doc_id", R.title_band(F.col("title")).alias("band"))


@query("lvl_2_min_years", f"with {POSTINGS_SQL} select doc_id, {_YEARS} as min_years from postings")
def min_years(spark, sf_dir):
    return postings(spark, sf_dir).select("doc_id", R.min_years(F.col("description")).alias("min_years"))


@query(
    "lvl_4_level",
    f"""with {_SCREENED} select doc_id, level, level_source, case level_source when 'title' then title when 'years'
      then years || case when years = 1 then '+ year' else '+ years' end else '' end as evidence from screened""",
)
def level(spark, sf_dir):
    v = R.level(F.col("title"), F.col("description"), F.col("desc_available"))
    return postings(spark, sf_dir).withColumn("v", v).select("doc_id", F.col("v.level").alias("level"), F.col("v.source").alias("level_source"), F.col("v.evidence").alias("evidence"))


@query(
    "eli_4_eligibility",
    f"""with {_SCREENED} select doc_id, clearance <> '' as clearance, citizenship <> '' as citizenship,
      case when refused <> '' then 'will_not_sponsor' when offered <> '' then 'will_sponsor' else 'unstated' end as sponsorship, desc_available as checked,
      clearance as clearance_quote, citizenship as citizenship_quote, refused as refusal_quote from screened""",
)
def eligible(spark, sf_dir):
    e = F.col("e")
    rows = postings(spark, sf_dir).withColumn("e", R.eligibility(F.col("description"), F.col("desc_available")))
    return rows.select(
        "doc_id", e["clearance"].alias("clearance"), e["citizenship"].alias("citizenship"), e["sponsorship"].alias("sponsorship"), e["checked"].alias("checked"),
        R.quote_of(e, "clearance").alias("clearance_quote"), R.quote_of(e, "citizenship").alias("citizenship_quote"), R.quote_of(e, "no_sponsorship").alias("refusal_quote"),
    )


@query("pipe_1_screen", f"with {_SCREENED} select doc_id, kept, level, array_to_string(gates, ',') as exclusions from screened")
def screen(spark, sf_dir):
    return _screened(spark, sf_dir).select("doc_id", "kept", F.col("level.level").alias("level"), F.array_join("exclusions", ",").alias("exclusions"))


@query(
    "agg_1_funnel",
    f"""with {_SCREENED} select count(*) as total, count(*) filter (kept) as kept, count(*) filter (not kept) as excluded,
      count(*) filter (kept and level = 'unknown') as needs_level_check from screened""",
)
def funnel(spark, sf_dir):
    return screening.funnel(_screened(spark, sf_dir))


@query(
    "agg_2_gate_counts",
    f"""with {_SCREENED}, hits as (select unnest(gates) as gate from screened), all_gates as (select unnest([{', '.join(f"'{g}'" for g in K.GATES)}]) as gate)
      select a.gate, count(h.gate) as n from all_gates a left join hits h on a.gate = h.gate group by a.gate""",
)
def gate_counts(spark, sf_dir):
    return screening.gate_counts(_screened(spark, sf_dir))


_CAP = lambda t: f"case when length({_collapse(t)}) > {K.QUOTE_CHARS} then substr({_collapse(t)}, 1, {K.QUOTE_CHARS - 1}) || '…' else {_collapse(t)} end"
_VIEWS_SQL = f"""{_SCREENED}, listed as (
  select *, unnest(list_filter(list_concat([case when kept then 'kept' end, case when gates = ['{K.GATES[2]}'] then 'internships' end], gates), lambda v: v is not null)) as view
  from screened
), view_rows as (
  select id as posting_id, doc_id, view, posted_at, kept or view = 'internships' as kept, level, level_source,
    case when view in ('kept', 'internships') then '' else view end as gate,
    case view when '{K.GATES[0]}' then {_CAP('title')} when '{K.GATES[2]}' then case when {_has('title', K.INTERNSHIP_TITLE)} then {_CAP('title')} else {_CAP('employment_type')} end
      when '{K.GATES[3]}' then case level_source when 'title' then {_CAP('title')} else years || case when years = 1 then '+ year' else '+ years' end end
      when '{K.GATES[4]}' then {_CAP('clearance')} when '{K.GATES[5]}' then {_CAP('citizenship')} when '{K.GATES[6]}' then {_CAP('refused')} else '' end as quote
  from listed
)"""


def _view_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.view_rows(_screened(spark, sf_dir))


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a generation: what reads are made on. The screen runs once, whatever reads follow."""
    return screening.read_generation(spark, *_generation(spark, sf_dir))


def _generation(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folder and name of a published generation."""
    folder = shared_folder(spark)
    return folder, screening.publish(_view_rows(spark, sf_dir), folder, F.lit(0), F.lit(DAY_2).cast("timestamp"))


@query("pipe_4_view_rows", f"with {_VIEWS_SQL} select posting_id, view, posted_at, kept, level, level_source, gate, quote from view_rows")
def view_rows(spark, sf_dir):
    return _view_rows(spark, sf_dir).select("posting_id", "view", "posted_at", "kept", "level", "level_source", "gate", "quote")


@query(
    "win_4_gate_top_n",
    f"""with {_VIEWS_SQL}, ranked as (
      select gate, posting_id, row_number() over (partition by gate order by posted_at desc nulls last, posting_id desc) as nth, count(*) over (partition by gate) as total
      from view_rows where gate <> '') select gate, posting_id, nth::int as nth, total, total > 10 as more from ranked where nth <= 10""",
)
def gate_top_n(spark, sf_dir):
    rows = _published(spark, sf_dir).where("gate <> ''")
    return paging.top_of_each(rows, "gate", 10).select("gate", "posting_id", "nth", "total", "more")


@query(
    "ord_3_filtered_page",
    f"""with {_VIEWS_SQL}, hits as (select * from view_rows where view = 'kept' and level in ('entry', 'unknown') and posted_at >= timestamp '2024-01-05 00:00:00'),
      top as (select *, row_number() over (order by posted_at desc, posting_id desc) as position from hits)
      select posting_id, posted_at, position::int as position, (select count(*) from hits) as matched, (select count(*) from hits) > 25 as more from top where position <= 25""",
)
def filtered_page(spark, sf_dir):
    page = paging.published_page(spark, *_generation(spark, sf_dir), "kept", 25, levels=["entry", "unknown"], posted_after="2024-01-05 00:00:00")
    return page.select("posting_id", "posted_at", "position", "matched", "more")


@query(
    "pred_13_card",
    f"""with {_VIEWS_SQL} select p.id, p.title, p.company, p.location, p.url, p.ats, v.level, v.level_source as "levelSource", p.posted_at as "postedAt", p.employment_type as "employmentType",
      p.desc_available as "descAvailable", case when not p.desc_available then 'not_provided' when p.description = '' then 'empty' else 'available' end as "descriptionStatus"
      from view_rows v join postings p on v.posting_id = p.id where v.view = 'kept'""",
)
def cards(spark, sf_dir):
    corpus_rows = postings(spark, sf_dir).withColumns({"remote": F.lit(None).cast("boolean"), "first_seen": F.lit(None).cast("timestamp")})
    kept = _view_rows(spark, sf_dir).where("view = 'kept'").select("posting_id", "level", "level_source", "level_why")
    # every kept row, not a page: an ordinary join
    items = corpus_rows.join(kept, corpus_rows["id"] == kept["posting_id"])
    shown = paging.project(paging.card(items), paging.CARD_FIELDS)
    return shown.drop("firstSeen", "remote", "levelWhy")


_LABELLED = f"""{_SCREENED}, labelled as (
      select *, case when {_has('title', K.ROLE_DENY)} or not {_has('title', K.ROLE_ALLOW)} then 'not_swe' when title_band in ('entry', 'intern') then 'junior'
        when title_band in ('senior', 'mid') then title_band else 'unmarked' end as label from screened)"""


@query(
    "agg_15_evaluation",
    f"""with {_LABELLED}
      select label, count(*) as labelled, count(*) filter (kept) as kept, count(*) filter (kept) / greatest((select count(*) from labelled where kept), 1)::double as share_of_kept
      from labelled group by label""",
)
def evaluation(spark, sf_dir):
    return screening.evaluate(_screened(spark, sf_dir))


@query(
    "agg_15_rates",
    f"""with {_LABELLED}, n as (select count(*) as total, count(*) filter (kept) as kept, count(*) filter (kept and level = 'unknown') as needs_level_check, count(*) filter (label = 'junior') as juniors,
        count(*) filter (label = 'junior' and kept) as recovered, count(*) filter (label = 'senior' and kept) as seniors_kept from labelled)
      select *, recovered / greatest(juniors, 1)::double as recall, seniors_kept / greatest(kept, 1)::double as inversion_rate from n""",
)
def evaluation_rates(spark, sf_dir):
    return screening.evaluation_rates(_screened(spark, sf_dir))


# --- dedupe, merge, close, what changed ----------------------------------------------------------------


@query(
    "win_1_best_copy",
    """with k as (select doc_id, length(text) as n, source, lower(trim(split_part(text, chr(10), 1))) as head from documents)
      select arg_max(doc_id, n * 1000000000 - doc_id) as doc_id, max(n)::int as n, min(doc_id) as first_ordinal from k group by source, head""",
)
def best_copy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    best = lifecycle.best_copies(d, "doc_id", [F.col("source"), F.lower(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))))], "text")
    return best.select("doc_id", F.length("text").alias("n"), "first_ordinal")


@query(
    "join_1_known_new",
    f"with {DAYS_SQL} select b.id, case when a.id is null then 'new' else 'known' end as state from day2 b left join day1 a on a.id = b.id",
)
def known_new(spark, sf_dir):
    known, new = lifecycle.split_known(fetch(spark, sf_dir), corpus(spark, sf_dir))
    return known.withColumn("state", F.lit("known")).unionByName(new.withColumn("state", F.lit("new")))


_CORPUS_COLUMNS = "id, title, company, description, desc_available, posted_at, first_seen, last_seen, closed_at"


@query("join_2_merge", f"with {DAYS_SQL} select {_CORPUS_COLUMNS} from merged")
def merged(spark, sf_dir):
    return lifecycle.merge(corpus(spark, sf_dir), fetch(spark, sf_dir), F.lit(DAY_2).cast("timestamp")).select(*_CORPUS_COLUMNS.split(", "))


def _synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.sync(corpus(spark, sf_dir), fetch(spark, sf_dir), F.lit(DAY_2).cast("timestamp"))[0]


@query("life_2_sync", f"with {DAYS_SQL} select {_CORPUS_COLUMNS} from closed")
def synced(spark, sf_dir):
    return _synced(spark, sf_dir).select(*_CORPUS_COLUMNS.split(", "))


@query(
    "agg_9_corpus_stats",
    f"""with {DAYS_SQL} select count(*) as total, count(*) filter (closed_at is null) as open, count(*) filter (closed_at is not null) as closed,
      0::bigint as interpreted, 0::bigint as applied from closed""",
)
def corpus_stats(spark, sf_dir):
    return lifecycle.stats(_synced(spark, sf_dir))


@query("ord_6_what_changed", f"with {DAYS_SQL} select id, title from closed where closed_at is null and first_seen > timestamp '{DAY_1}'")
def what_changed(spark, sf_dir):
    return lifecycle.changed_since(_synced(spark, sf_dir), F.lit(DAY_1).cast("timestamp")).select("id", "title")


@query(
    "pred_18_mark_applied",
    f"""with {DAYS_SQL}, e as (select user_id::varchar as id, min(ts) as at from events where event_type = 'purchase' group by user_id)
      select a.id, e.at as applied_at from day1 a left join e on a.id = e.id""",
)
def mark_applied(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return lifecycle.mark_applied(corpus(spark, sf_dir), events).select("id", "applied_at")


@query(
    "win_3_latest",
    "select user_id, max(ts) as ts, arg_max(event_id, ts) as event_id from events group by user_id",
)
def latest(spark, sf_dir):
    return lifecycle.latest_by(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")


@query(
    "win_2_first_stance",
    """select lower(o_orderpriority) as company, arg_min(lower(o_orderstatus), o_orderkey) as stance from orders group by 1""",
)
def first_stance(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("company_name"), F.col("o_orderstatus").alias("sponsorship"), F.col("o_orderkey").alias("ordinal"))
    return lifecycle.first_stance(rows)


# --- paging -----------------------------------------------------------------------------------------------

_STAMPED = "select o_orderkey as key, o_custkey, case when o_orderkey % 50 <> 0 then o_orderdate end as stamp from orders"


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key"), "o_custkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("timestamp")).alias("stamp"))


_PAGE_SQL = f"""with o as ({_STAMPED}), below as (select * from o where stamp is null or stamp < timestamp '1997-01-01' or (stamp = timestamp '1997-01-01' and key < 500)),
  page as (select *, row_number() over (order by stamp desc nulls last, key desc) as position from below)"""


@query("ord_2_keyset_page", _PAGE_SQL + " select key, stamp, position::int as position, (select count(*) from below) > 100 as more from page where position <= 100")
def keyset_page(spark, sf_dir):
    return paging.page(_stamped(spark, sf_dir), 100, "stamp", "key", ("1997-01-01 00:00:00", 500)).select("key", "stamp", "position", "more")


@query("ord_2_undated_page", f"with o as ({_STAMPED}) select key from o where stamp is null and key < 1000")
def undated_page(spark, sf_dir):
    return _stamped(spark, sf_dir).where(paging.after("stamp", "key", (None, 1000))).select("key")


@query("join_4_hydrate", _PAGE_SQL + " select p.key, p.position::int as position, c.c_name from page p join customer c on p.o_custkey = c.c_custkey where position <= 100")
def hydrate(spark, sf_dir):
    page = paging.page(_stamped(spark, sf_dir), 100, "stamp", "key", ("1997-01-01 00:00:00", 500))
    return paging.hydrate(page, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey").select("key", "position", "c_name")


# --- tokens and scores ---------------------------------------------------------------------------------------

#: A vocabulary of words that the prose of the tables holds.
PROSE = {"the": (r"\bthe\b",), "and": (r"\band\b",), "with": (r"\bwith\b",), "nation": (r"\bnation\b", r"\bonan\b"), "que": (r"\bque\b",), "und": (r"\bund\b",), "les": (r"\bles\b",), "para": (r"\bpara\b",)}
_MINE = ("the", "with", "que", "und")


def _tokens_sql(text: str) -> str:
    hits = ", ".join("case when " + " or ".join(f"regexp_matches({text}, {_bounded(p)})" for p in ps) + f" then '{t}' end" for t, ps in sorted(PROSE.items()))
    return f"list_filter([{hits}], lambda t: t is not null)"


@query("tok_1_tokens", f"select doc_id, array_to_string({_tokens_sql('text')}, ',') as tokens from documents")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(N.tokens_in(F.col("text"), PROSE), ",").alias("tokens"))


@query("join_10_vocabulary_join", f"select doc_id, unnest({_tokens_sql('text')}) as token from documents")
def vocabulary_join(spark, sf_dir):
    pairs = F.array(*(F.struct(F.lit(t).alias("token"), F.lit(p).alias("pattern")) for t, ps in PROSE.items() for p in ps))
    return N.tokens_by_join(table(spark, sf_dir, "documents"), spark.range(1).select(F.inline(pairs)), "doc_id", "text")


_SCORE_SQL = f"""with base as (select conv_id, turn, text, {_tokens_sql('text')} as req from conversations),
  s as (select *, list_filter(req, lambda t: t in ('the', 'with', 'que', 'und')) as have from base),
  r as (select *, len(req) as rt, len(have) as h, turn % 2 = 0 as sure from s),
  scored as (select *, case when rt = 0 then 0.0 else h / rt end as ratio from r),
  tiered as (select conv_id, turn, h as required_covered, rt as required_total, case when rt = 0 then 'unscored' when rt >= 3 and h = rt and sure then 'exact match'
    when ratio >= 0.8 then 'strong' when ratio >= 0.5 then 'partial' else 'weak' end as tier,
    case when rt = 0 then 0 else round_even(60 * ratio * least(1.0, rt / 3.0) + case when sure then 15.0 else 0.0 end, 0)::int end as total from scored)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("description", F.col("text"))
    return scoring.score(rows, list(_MINE), F.col("turn") % 2 == 0, PROSE)


@query("sco_4_coverage", _SCORE_SQL + " select conv_id, turn, required_covered::int as required_covered, required_total::int as required_total, total, tier from tiered")
def coverage(spark, sf_dir):
    s = F.col("score")
    return _scored(spark, sf_dir).select("conv_id", "turn", *(s[c].alias(c) for c in ("required_covered", "required_total", "total", "tier")))


@query(
    "agg_8_facets",
    _SCORE_SQL + """, rows as (select t.tier, c.role as level, case when t.turn % 5 = 0 then '' when t.turn % 5 = 1 then 'Lever' else 'greenhouse' end as ats
      from tiered t join conversations c on c.conv_id = t.conv_id and c.turn = t.turn)
      select 'level' as facet, level as value, count(*) as n from rows group by level union all
      select 'source', case when ats = '' then 'unknown' else lower(ats) end, count(*) from rows group by 2 union all
      select 'tier', tier, count(*) from rows where tier <> 'unscored' group by tier""",
)
def facets(spark, sf_dir):
    ats = F.when(F.col("turn") % 5 == 0, "").when(F.col("turn") % 5 == 1, "Lever").otherwise("greenhouse")
    rows = _scored(spark, sf_dir).select(F.col("role").alias("level"), ats.alias("ats"), F.when(F.col("score.tier") != "unscored", F.col("score.tier")).alias("tier"))
    return scoring.facets(rows)


@query(
    "sco_2_sections",
    f"""with {POSTINGS_SQL}, lines as (
      select doc_id, generate_subscripts(string_split(description, chr(10)), 1) as pos, unnest(string_split(description, chr(10))) as line from postings
    ), marked as (
      select *, case when length(trim(line)) < {K.HEADING_CHARS} and {_has('line', K.PREFERRED_HEAD)} then 'p' when length(trim(line)) < {K.HEADING_CHARS} and {_has('line', K.REQUIRED_HEAD)} then 'r' end as head
      from lines
    ), carried as (select *, coalesce(last_value(head ignore nulls) over (partition by doc_id order by pos), 'r') as bucket from marked)
    select doc_id, md5(coalesce(string_agg(line, chr(10) order by pos) filter (head is null and bucket = 'r'), '')) as required,
      md5(coalesce(string_agg(line, chr(10) order by pos) filter (head is null and bucket = 'p'), '')) as preferred from carried group by doc_id""",
)
def sections(spark, sf_dir):
    rows = postings(spark, sf_dir).withColumn("s", N.sections(F.col("description")))
    return rows.select("doc_id", F.md5("s.required").alias("required"), F.md5("s.preferred").alias("preferred"))


@query(
    "pipe_18_keyword_rank",
    """with s as (select p_partkey, p_name, case when p_name like '%ring%' then 30 else 0 end + case when lower(p_type) like '%economy%' then 25 else 0 end
        + case when p_name like '%red%' then 20 else 0 end as score from parts_named)
      select p_partkey as ordinal, score from s where score >= 40 order by score desc, p_partkey limit 8""".replace(
        "parts_named", "(select * from part where (p_name like '%ring%' or p_name like '%widget%' or p_name like '%gear%') and p_name not like '%small%')"
    ),
)
def keyword_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("url")
    )
    top = scoring.keyword_rank(rows, None, {"ring": 30, "economy": 25, "red": 20}, ("ring", "widget", "gear"), ("small",), 40, 8)
    return top.select("ordinal", "score")


# --- mail -------------------------------------------------------------------------------------------------------

_MAIL_RULES = (("offer", r"\bthe\b.{0,24}(and|of)\b"), ("interview", "que|und"), ("rejected", "les?"))
_TRIAGED = f"""with t as (select conv_id, turn, role, text, role = 'user' or {_has('text', K.MAIL_SUBJECT)} as is_job from conversations),
  s as (select *, case when not is_job then 'other' {' '.join(f"when {_has('text', p)} then '{n}'" for n, p in _MAIL_RULES)} else 'other' end as status from t)"""


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select("conv_id", "turn", F.col("role").alias("sender"), F.col("text").alias("subject"), F.lit("").alias("snippet"))
    return inbox.triage(rows, _MAIL_RULES, ("user",))


@query("tri_1_status", _TRIAGED + " select conv_id, turn, is_job as is_job_related, status, is_job and status in ('offer', 'interview') as needs_action from s")
def mail_status(spark, sf_dir):
    return _triaged(spark, sf_dir).select("conv_id", "turn", "is_job_related", "status", "needs_action")


@query("agg_6_pipeline_counts", _TRIAGED + " select status, count(*) as n from s where is_job group by status")
def pipeline_counts(spark, sf_dir):
    return inbox.pipeline_counts(_triaged(spark, sf_dir))


# --- pages and urls -----------------------------------------------------------------------------------------------


@query(
    "url_2_board_slugs",
    """select page_id, lower(split_part(regexp_extract(url, '^https?://([^/?#]+)', 1), '.', 1)) as slug from pages""",
)
def board_slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(U.board_slugs(F.col("url")), ",").alias("slug"))


@query(
    "agg_5_unknown_hosts",
    """select lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as host, count(*) as n from pages group by 1""",
)
def unknown_hosts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").withColumn("entry", U.classify_apply_url(F.col("url"), F.lit("")))
    return rows.where("entry is null").groupBy(U.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(
    "chk_5_sandbox_rows",
    f"""select page_id from pages where {_has("split_part(regexp_extract(url, '^https?://([^/?#]+)', 1), '.', 1)", K.SANDBOX_SLUG)}""",
)
def sandbox_rows(spark, sf_dir):
    return quality.sandbox_rows(table(spark, sf_dir, "pages")).select("page_id")


# --- answers --------------------------------------------------------------------------------------------------------

_STRIPPED = r"regexp_replace(raw, '^\s+|\s+$', '', 'g')"
_ANSWERS = rf"""with a as (select doc_id, text, case doc_id % 5 when 0 then '' when 1 then substr(text, 11, 60) when 2 then regexp_replace(substr(text, 11, 60), '\s+', '  ', 'g')
    when 3 then 'not in the text at all' else substr(text, 1, 30) end as raw, case when doc_id % 4 = 0 then 'unknown' when doc_id % 4 = 1 then 'entry' else 'senior' end as band,
    (doc_id % 9)::int as years from documents),
  e as (select *, case when length({_STRIPPED}) < 5 then '' else {_STRIPPED} end as evidence from a),
  l as (select *, case when evidence = '' then 'absent' when contains(text, evidence) then 'verbatim'
    when contains({_collapse('text')}, {_collapse('evidence')}) then 'reflowed' else 'absent' end as place from e),
  c as (select *, case when place = 'reflowed' then 'medium' when place = 'absent' and band <> 'unknown' then 'low' else 'high' end as first,
    band <> 'unknown' and case when years <= 2 then 'entry' when years <= 5 then 'mid' else 'senior' end <> band as contradicts from l),
  v as (select doc_id, place, case when not contradicts then first when first = 'high' then 'medium' else 'low' end as confidence, place <> 'absent' as evidence_verified,
    case when place <> 'absent' or band = 'unknown' then 'saved' else 'saved_unverified' end as outcome from c)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n, t = F.col("doc_id"), F.col("text")
    raw = (
        F.when(n % 5 == 0, "").when(n % 5 == 1, F.substring(t, 11, 60)).when(n % 5 == 2, F.regexp_replace(F.substring(t, 11, 60), r"\s+", "  "))
        .when(n % 5 == 3, "not in the text at all").otherwise(F.substring(t, 1, 30))
    )
    band = F.when(n % 4 == 0, "unknown").when(n % 4 == 1, "entry").otherwise("senior")
    answers = d.select(n.cast("string").alias("id"), (n % 7).cast("string").alias("round"), band.alias("band"), (n % 9).cast("int").alias("min_years"), raw.alias("evidence"), F.lit("high").alias("confidence"))
    return backlog.import_answers(answers, d.select(n.cast("string").alias("id"), t.alias("description")))


@query("pipe_14_import", _ANSWERS + " select doc_id, confidence, evidence_verified, outcome from v")
def import_answers(spark, sf_dir):
    return _answers(spark, sf_dir).select(F.col("id").cast("long").alias("doc_id"), "confidence", "evidence_verified", "outcome")


@query("agg_10_tally", _ANSWERS + " select (doc_id % 7)::varchar as round, outcome, count(*) as n from v group by 1, 2 union all select null, outcome, count(*) from v group by outcome")
def tally(spark, sf_dir):
    return backlog.tally(_answers(spark, sf_dir))


@query(
    "pipe_13_backlog",
    f"""with {_SCREENED}, b as (select doc_id, row_number() over (order by doc_id) as position from screened where kept and level = 'unknown' and desc_available and description <> '')
      select doc_id, position::int as position, ceil(position / 25.0)::int as round from b where position <= 150""",
)
def backlog_rounds(spark, sf_dir):
    cache = spark.range(0).select(F.lit("").alias("id"), F.lit("").alias("payload"))
    return backlog.backlog(_screened(spark, sf_dir), cache, [F.col("doc_id")]).select("doc_id", "position", "round")


# --- run health -------------------------------------------------------------------------------------------------------


@query(
    "agg_14_run_health",
    """with d as (select ts::date as day, min(value) as fetched, min(user_id) as kept, max(event_id) as failed from events group by 1),
      c as (select unnest(generate_series(date '2023-12-30', date '2024-02-02', interval 1 day))::date as day)
      select c.day::varchar as day, d.fetched, d.kept, d.failed, d.fetched is null or d.fetched < 1 or d.kept < 2 or d.failed > 204 as breach from c left join d on c.day = d.day""",
)
def run_health(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("value").alias("fetched"), F.col("user_id").alias("kept"), F.col("event_id").alias("failed"))
    return quality.run_health(runs, "2023-12-30", "2024-02-02", 1, 2).withColumn("day", F.col("day").cast("string"))


@query(
    "agg_15_label_confusion",
    """with s as (select d.doc_id, length(d.text) >= 400 as long, l.quality from documents d join labels l on d.doc_id = l.doc_id)
      select quality, count(*) filter (long) as said_good, count(*) filter (not long) as said_bad from s group by quality""",
)
def label_confusion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 400).alias("long"))
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("quality").agg(F.count_if("long").alias("said_good"), F.count_if(~F.col("long")).alias("said_bad"))
