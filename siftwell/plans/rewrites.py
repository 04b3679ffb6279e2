"""Registered queries of variant selection and of the rewrite audit, over whole documents, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import tokens as N
from ..functions.text import once
from ..operators import audit, selection
from .queries import _bounded, query
from .templates import POSTINGS_SQL, postings, table

# --- SQL of the vocabulary -------------------------------------------------------------------------------------


def _states(text: str, pattern: str) -> str:
    """Whether a text states a pattern, in RE2: look-aheads are said in another way."""
    if pattern.endswith("(?! native)"):
        text, pattern = f"regexp_replace({text}, '(?i)react native', ' ', 'g')", pattern.removesuffix("(?! native)")
    if pattern.startswith(r"\bgo\b(?="):
        return rf"regexp_matches({text}, '(?i)(?:^|[^\pL\pN_])go(?:\s*[,/)]|\s+(?:programming|lang))')"
    pattern = pattern.replace("(?!script)", "")
    return f"regexp_matches({text}, {_bounded(pattern)})"


def _vocabulary_sql(text: str) -> str:
    """The tokens of the vocabulary that a text states, sorted."""
    hits = ", ".join("case when " + " or ".join(_states(text, p) for p in patterns) + f" then '{t}' end" for t, patterns in K.VOCABULARY.items())
    return f"list_sort(list_filter([{hits}], lambda t: t is not null))"


# --- selection ---------------------------------------------------------------------------------------------------

#: A bank of variants: a parameter, as small as what one person has written.
BANK = tuple(
    (f"b{i // 3}", i % 3, f"v{i:02d}", text)
    for i, text in enumerate((
        "Built services", "Built services in Python and SQL", "Built services in Python, Kafka and Redis", "Ran the platform", "Ran the platform on Kubernetes and Docker", "Ran the platform in Go, and on AWS",
        "Wrote pages", "Wrote pages with React and TypeScript", "Wrote pages with JavaScript and REST", "Moved data", "Moved data between PostgreSQL and MongoDB", "Moved data with Java, Kafka and SQL",
    ))
)
_BUDGETS = {"b0": 20, "b1": None, "b2": 30, "b3": None}


def _bank(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = F.array(*(F.struct(F.lit(b).alias("bullet_id"), F.lit(n).alias("position"), F.lit(v).alias("variant_id"), F.lit(t).alias("text")) for b, n, v, t in BANK))
    budgets = F.array(*(F.struct(F.lit(b).alias("bullet_id"), F.lit(n).cast("int").alias("budget")) for b, n in _BUDGETS.items()))
    return spark.range(1).select(F.inline(rows)), spark.range(1).select(F.inline(budgets))


def _bank_states(text: str) -> list[str]:
    return sorted(t for t, patterns in K.VOCABULARY.items() if any(re.search(p, text, re.I) for p in patterns))


def _selection_sql() -> str:
    """A step per bullet: of the variants that fit the budget the one that covers most of what is wanted and not covered yet."""
    steps, last = [], "wants"
    for bullet in sorted(_BUDGETS):
        own = [r for r in BANK if r[0] == bullet]
        base, budget = len(own[0][3]), _BUDGETS[bullet]
        fits = [r for r in own if budget is None or len(r[3]) - base <= budget] or [min(own, key=lambda r: (len(r[3]), r[1]))]
        options = ", ".join(
            f"struct_pack(gain := -len(list_filter({_bank_states(t)}::varchar[], lambda s: list_contains(wanted, s) and not list_contains(covered, s))), position := {n}, id := '{v}', states := {_bank_states(t)}::varchar[])"
            for _, n, v, t in fits
        )
        steps.append(f"pick_{bullet} as (select *, list_sort([{options}])[1] as best from {last})")
        steps.append(
            f"step_{bullet} as (select doc_id, wanted, list_distinct(list_concat(covered, list_filter(best.states, lambda s: list_contains(wanted, s)))) as covered,"
            f" list_append(chosen, best.id) as chosen from pick_{bullet})"
        )
        last = f"step_{bullet}"
    return f"""with {POSTINGS_SQL}, wants as (select doc_id, {_vocabulary_sql('description')} as wanted, []::varchar[] as covered, []::varchar[] as chosen from postings), {', '.join(steps)}"""


_SELECTED = _selection_sql()


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    wants = postings(spark, sf_dir).select("doc_id", N.tokens_in(F.col("description")).alias("requirements"))
    return selection.select(wants, selection.bank_array(*_bank(spark)))


@query(
    "greedy_selection",
    _SELECTED + """ select doc_id, array_to_string(chosen, ',') as chosen, array_to_string(list_sort(covered), ',') as covered,
      array_to_string(list_sort(list_filter(wanted, lambda w: not list_contains(covered, w))), ',') as uncovered from step_b3""",
)
def greedy_selection(spark, sf_dir):
    """PIPE-11: for every posting one variant per bullet, by the tokens its description names."""
    chosen = F.array_join(F.transform("choices", lambda c: c["variant_id"]), ",")
    return _selected(spark, sf_dir).select("doc_id", chosen.alias("chosen"), F.array_join("covered", ",").alias("covered"), F.array_join("uncovered", ",").alias("uncovered"))


@query("agg_12_coverable", _SELECTED + " select token, count(*) as n from (select unnest(covered) as token from step_b3) group by token")
def coverable(spark, sf_dir):
    """AGG-12: the tokens that some choice covers, of those the bank can cover, and for how many postings."""
    can = selection.coverable(_bank(spark)[0]).select(F.explode("tokens").alias("token"))
    covered = _selected(spark, sf_dir).select(F.explode("covered").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return covered.join(can, "token", "left_semi")


@query(
    "tok_2_requirements",
    f"""with k as (select unnest([{', '.join(f"'{t}'" for t in K.VOCABULARY)}]) as token), r as (select conv_id, turn, unnest(list_distinct(string_split(text, ' '))) as word from conversations),
      t as (select conv_id, turn, regexp_replace(word, '^\\s+|\\s+$', '', 'g') as word from r)
      select conv_id, turn, count(distinct coalesce(k.token, t.word)) as n, count(distinct k.token) as known from t left join k on lower(k.token) = lower(t.word) where t.word <> '' group by conv_id, turn""",
)
def requirements(spark, sf_dir):
    """TOK-2: words as canonical tokens where the vocabulary knows them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", N.normalise_requirements(F.split("text", " ")).alias("r")).where(F.size("r") > 0)
    known = F.filter("r", lambda x: x.isin(*K.VOCABULARY))
    return rows.select("conv_id", "turn", F.size("r").cast("long").alias("n"), F.size(known).cast("long").alias("known"))


@query(
    "pipe_12_validate_bank",
    f"""with v as (select doc_id, text, {_vocabulary_sql('text')} as said from documents)
      select 'v1-technology' as rule, 'v' || doc_id as variant_id, 'introduces ' || array_to_string(list_filter(said, lambda t: t <> 'Go'), ', ') as detail from v where len(list_filter(said, lambda t: t <> 'Go')) > 0
      union all select 'v8-must-keep', 'v' || doc_id, 'kept words' from v where not contains(text, 'kept words')
      union all select 'duplicate-id', 'v' || doc_id, 'id is not unique' from v where doc_id % 5 = 0""",
)
def validate_bank(spark, sf_dir):
    """PIPE-12: documents as variants of a nested bank; every fifth twice, no numbers declared but all allowed."""
    d = table(spark, sf_dir, "documents")
    none, metric = F.array().cast("array<string>"), "array<struct<numbers:array<string>,subject_head:string>>"
    d = d.select("doc_id", "text", once(audit.numbers_in(F.col("text"))).alias("numbers"))
    numbers = F.transform(F.col("numbers"), lambda n: F.struct(F.array(n).alias("numbers"), F.lit("").alias("subject_head")))
    one = lambda i, own: F.struct(i.alias("id"), F.col("text").alias("text"), own.alias("tech"), numbers.cast(metric).alias("metrics"), none.alias("allowed_verbs"), F.array(F.lit("kept words")).alias("must_keep_verbatim"))
    name = F.concat(F.lit("v"), F.col("doc_id").cast("string"))
    again = F.when(F.col("doc_id") % 5 == 0, F.array(one(name, F.lit(None).cast("array<string>"))))
    bullet = F.struct(one(name, F.array(F.lit("Go"))).alias("b"), F.coalesce(again, F.slice(F.array(one(name, none)), 1, 0)).alias("variants"))
    entries = d.select(F.lit("2020-01").alias("date_start"), F.array(F.struct(*(bullet["b"][c].alias(c) for c in ("id", "text", "tech", "metrics", "allowed_verbs", "must_keep_verbatim")), bullet["variants"].alias("variants"))).alias("bullets"))
    return selection.validate_bank(selection.flatten_bank(entries)).distinct()


# --- audit -------------------------------------------------------------------------------------------------------

_PAIRS_SQL = """pairs as (
  select doc_id::varchar as doc_id, doc_id as n, text as old, split_part(text, chr(10), 1) as first_line,
    case doc_id % 6 when 0 then text when 1 then text || ' TODO' when 2 then text || case when doc_id % 24 = 14 then ' 4711 kiwi' else ' 4711 ' end when 3 then ''
      when 4 then text || ' Kubernetes' else text || ' and' || repeat(' so', 30) end as new,
    doc_id % 12 = 2 as metric, doc_id % 5 = 0 as verbs, doc_id % 11 <> 10 as there from documents)"""


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole documents as bullets, and rewrites of six kinds; some declare a metric or the verbs they may begin with."""
    d = table(spark, sf_dir, "documents")
    n, text = F.col("doc_id"), F.col("text")
    none, key = F.array().cast("array<string>"), n.cast("string").alias("doc_id")
    metric = F.array(F.struct(F.array(F.lit("4711")).alias("numbers"), F.lit("Kiwi").alias("subject_head")))
    bullets = d.select(
        key, F.lit("b").alias("bullet_id"), text, none.alias("tech"), F.when(n % 12 == 2, metric).otherwise(F.slice(metric, 1, 0)).alias("metrics"), F.lit("2015-01").alias("entry_start"),
        F.when(n % 5 == 0, F.array(F.lit("The"), F.lit("Built"))).otherwise(none).alias("allowed_verbs"), F.array(F.split_part(text, F.lit("\n"), F.lit(1))).alias("must_keep_verbatim"),
    )
    change = (
        F.when(n % 6 == 0, text).when(n % 6 == 1, F.concat(text, F.lit(" TODO"))).when(n % 24 == 14, F.concat(text, F.lit(" 4711 kiwi"))).when(n % 6 == 2, F.concat(text, F.lit(" 4711 ")))
        .when(n % 6 == 3, F.lit("")).when(n % 6 == 4, F.concat(text, F.lit(" Kubernetes"))).otherwise(F.concat(text, F.lit(" and"), F.repeat(F.lit(" so"), 30)))
    )
    rewrites = d.where("doc_id % 11 <> 10").select(key, F.lit("b").alias("bullet_id"), change.alias("rewritten"))
    return bullets, rewrites


_WORDS = K.WORD.replace("'", "''")
_RELEASED = ", ".join(f"('{t}', '{at}')" for t, at in K.RELEASED.items())
_PRODUCTS = "'(?i)" + K.PRODUCT_NUMBERS + "'"
_COUNT = lambda text: f"(length({text}) - length(replace({text}, '4711', ''))) // 4"
_AUDIT_SQL = f"""{_PAIRS_SQL}, both_there as (select * from pairs where there), said as (select *, {_vocabulary_sql('new')} as tokens,
    list_distinct(list_transform(regexp_extract_all(regexp_replace(new, {_PRODUCTS}, ' ', 'g'), '\\b\\d[\\d,.]*\\b'), lambda x: regexp_replace(x, '\\.+$', ''))) as numbers,
    regexp_extract_all(new, '{_WORDS}') as words, regexp_extract_all(old, '{_WORDS}') as source from both_there),
  rules as (
    select doc_id, 'v1-technology' as rule, 'introduces ' || array_to_string(tokens, ', ') as detail from said where len(tokens) > 0
    union all select doc_id, 'v2-number', 'states ' || array_to_string(list_sort(list_filter(numbers, lambda x: not (metric and replace(x, ',', '') = '4711'))), ', ') from said
      where len(list_filter(numbers, lambda x: not (metric and replace(x, ',', '') = '4711'))) > 0
    union all select doc_id, 'v2-subject', 'moves 4711' from said where metric and contains(new, '4711') and not contains(lower(new), 'kiwi')
    union all select s.doc_id, 'v3-temporal', r.token || ' ' || r.released from said s, (values {_RELEASED}) r(token, released) where list_contains(s.tokens, r.token) and r.released > '2015-01'
    union all select doc_id, 'v4-structure', case when not there then 'bullet is missing from the rewrite' else 'bullet was emptied' end from pairs where not there or trim(new) = ''
    union all select doc_id, 'v5-placeholder', array_to_string(regexp_extract_all(new, '{K.PLACEHOLDER}'), ', ') from said where regexp_matches(new, '{K.PLACEHOLDER}')
    union all select doc_id, 'v6-width', 'grew by ' || (length(new) - length(old)) from said where length(new) - length(old) > 40
    union all select doc_id, 'v7-verb', case when len(words) = 0 then 'no leading word' else words[1] end from said where verbs and (len(words) = 0 or words[1] not in ('The', 'Built'))
    union all select doc_id, 'v8-must-keep', first_line from said where not contains(new, first_line)
    union all select doc_id, 'v9-borrowed-digit', '4711' from said where metric and {_COUNT('new')} > {_COUNT('old')}
    union all select doc_id, 'v10-proper-noun', array_to_string(list_sort(odd), ', ') from (
      select doc_id, list_distinct(list_filter(words[2:], lambda w: length(w) > 1 and regexp_matches(w, '^[A-Z]') and not list_contains(source, w))) as odd from said) where len(odd) > 0)"""


@query("rewrite_audit", f"with {_AUDIT_SQL} select doc_id, 'b' as bullet_id, rule, detail from rules")
def rewrite_audit(spark, sf_dir):
    """AUD-11: all violations of all pairs, with the release table and a budget of 40 characters."""
    bullets, rewrites = _pairs(spark, sf_dir)
    budgets = spark.range(1).select(F.lit("b").alias("bullet_id"), F.lit(40).alias("budget"))
    return audit.audit(bullets, rewrites, audit.released_table(spark), budgets)


@query(
    "aud_11_verdicts",
    f"with {_AUDIT_SQL}, per as (select doc_id, count(*) as n from rules group by doc_id) select p.doc_id, coalesce(per.n, 0) as violations, per.n is null as passed from pairs p left join per on p.doc_id = per.doc_id",
)
def verdicts(spark, sf_dir):
    return audit.verdicts(_pairs(spark, sf_dir)[0], rewrite_audit(spark, sf_dir))


@query("aud_4_structure", f"with {_AUDIT_SQL} select doc_id, detail from rules where rule = 'v4-structure'")
def structure(spark, sf_dir):
    return audit.structure(*_pairs(spark, sf_dir)).select("doc_id", "detail")


@query(
    "aud_5_placeholders_width",
    f"with {_PAIRS_SQL} select doc_id, regexp_matches(new, '{K.PLACEHOLDER}') as placeholder, length(new) - length(old) > 40 as wide, not contains(new, first_line) as dropped from pairs where there",
)
def placeholders(spark, sf_dir):
    bullets, rewrites = _pairs(spark, sf_dir)
    pairs = bullets.join(rewrites, ["doc_id", "bullet_id"]).withColumn("budget", F.lit(40))
    some = lambda c: F.size(c) > 0
    return pairs.select("doc_id", some(audit.placeholders()).alias("placeholder"), some(audit.width()).alias("wide"), some(audit.dropped_text()).alias("dropped"))
