"""DuckDB SQL of the corpus queries that SQL can say whole; the others are tested against brute force."""

from __future__ import annotations

from .collocations import ORACLE as OP12
from .hard_negatives import ORACLE as OP11
from .line_dedup import ORACLE as OP8
from .quality_rules import END, LINE_RULES, LINKS, Rules

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _words(text: str) -> str:
    return _WORDS.format(f"coalesce({text}, '')")


OP1 = f"""
with w as (select row_number() over () as r, doc_id, {_words('text')} as words from documents),
starts as (select r, doc_id, words, unnest(range(1, len(words) - 11)) as i from w where doc_id is not null),
windows as (select r, doc_id, i, array_to_string(words[i:i + 12], ' ') as s from starts),
firsts as (select s, min(doc_id) as first from windows group by s),
hits as (select r, i from windows join firsts on windows.s = firsts.s where first < doc_id),
gone as (select distinct r, i + k as pos from hits, (select unnest(range(0, 13)) as k)),
placed as (select r, unnest(words) as word, generate_subscripts(words, 1) as pos from w),
kept as (select p.r, count(*) as n, count(g.pos) as cut, string_agg(word, ' ' order by p.pos) filter (g.pos is null) as text
  from placed p left join gone g on p.r = g.r and p.pos = g.pos group by p.r)
select w.doc_id, coalesce(k.n, 0) as n_words, coalesce(k.cut, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from w left join kept k on w.r = k.r
"""

_RULES = Rules()
_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_NAVIGATION = _QUOTED(_RULES.navigation)
_PHRASES = " or ".join(f"contains(low, {_QUOTED(p)})" for p in _RULES.phrases)
_NOTICES = _QUOTED("|".join(_RULES.notices))
_LINKS = " or ".join(f"starts_with(x, {_QUOTED(p)})" for p in LINKS)
_LOST = ", ".join(f"count(*) filter (rule = {i}) as lines_{r}" for i, r in enumerate(LINE_RULES))
_ENDS = " or ".join(f"ends_with(regexp_replace(line, '[\\x20\\x09-\\x0D]+$', ''), {_QUOTED(e)})" for e in dict.fromkeys(END))
OP2 = f"""
with w as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_words('text')} as words from documents),
windows as (select r, i, array_to_string(words[i:i + 7], ' ') as s from (select r, words, unnest(range(1, len(words) - 6)) as i from w)),
twice as (select r, s from windows group by r, s having count(*) > 1),
covered as (select r, count(distinct i + k) as n from windows join twice using (r, s), (select unnest(range(0, 8)) as k) group by r),
lines as (select r, line, {_words('line')} as own from (select r, unnest(string_split(text, chr(10))) as line from w)),
judged as (select r, line, lower(line) as low, len(own) as n, coalesce(list_sum(list_transform(own, lambda x: length(x))), 0)::bigint as chars, own from lines where len(own) > 0),
failed as (select *, case when length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > {_RULES.symbol_share}::double * chars then 0 when regexp_matches(line, {_NAVIGATION}) then 1
    when n <= {_RULES.boilerplate_words} and ({_PHRASES} or regexp_matches(low, {_NOTICES})) then 2
    when len(list_filter({_words('low')}, lambda x: {_LINKS})) > {_RULES.link_share}::double * n then 3
    when n >= {_RULES.run_words} and list_max(map_values(list_histogram(own))) > {_RULES.run_share}::double * n then 4 when n >= {_RULES.sentence_words} and not ({_ENDS}) then 5 end as rule from judged),
by_text as (select r, count(*) - count(distinct line) as dups, sum(chars) filter (rule is not null) as lost, {_LOST} from failed group by r),
facts as (select w.r, w.doc_id, len(words) as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(b.dups, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words, coalesce(b.lost, 0)::bigint as lost_chars,
    {', '.join(f'coalesce(b.lines_{r}, 0) as lines_{r}' for r in LINE_RULES)}
  from w left join by_text b on w.r = b.r left join covered c on w.r = c.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and lost_chars <= {_RULES.lost_share}::double * word_chars as kept, lost_chars, {', '.join(f'lines_{r}' for r in LINE_RULES)} from facts
"""

OP4 = """
with p as (select page_id, coalesce(html, '') as html from pages),
again as (select html, max(page_id) as best, count(*) as n from p where octet_length(encode(html)) >= 1000 group by html having count(*) > 1)
select p.page_id, octet_length(encode(p.html))::bigint as payload_bytes, sha1(p.html) as payload_digest,
  case when a.best is not null and p.page_id is distinct from a.best then 'revisit' else 'response' end as record_type,
  case when a.best is not null and p.page_id is distinct from a.best then a.best end as refers_to
from p left join again a on p.html = a.html
"""

OP5 = """
with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (select q.vec_id as query_id, v.vec_id, min(list_distance(q.e, v.e)) as score from v q join v on len(q.e) = len(v.e) and q.vec_id <> v.vec_id where q.vec_id % 100 = 0 group by 1, 2),
ranked as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from d)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10
"""

OP7 = f"""
with recursive w as (select row_number() over () as r, doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as words from documents),
starts as (select r, doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) as i from w where len(words) > 0),
shingles as (select distinct r, doc_id, array_to_string(words[i:i + 2], ' ') as s from starts),
sizes as (select r, doc_id, count(*) as n from shingles group by r, doc_id),
shared as (select a.r as a, b.r as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.r < b.r group by a.r, b.r),
links as (select x.doc_id as a, y.doc_id as b from shared l join sizes x on l.a = x.r join sizes y on l.b = y.r where 100 * l.n >= 85 * (x.n + y.n - l.n)),
edges as (select a, b from links union select b, a from links),
reach as (select distinct doc_id as a, doc_id as b from w union select r.a, e.b from reach r join edges e on r.b = e.a),
parts as (select a as doc_id, min(b) as component_id from reach group by a)
select w.doc_id, coalesce(s.n, 0) as n_shingles, p.component_id, w.doc_id = p.component_id as kept from w left join sizes s on w.r = s.r left join parts p on w.doc_id = p.doc_id
"""

ORACLES = {"op1_substring_dedup": OP1, "op2_quality_rules": OP2, "op4_warc": OP4, "op5_block_search": OP5, "op7_near_dedup": OP7, "op8_line_dedup": OP8, "op11_hard_negatives": OP11, "op12_collocations": OP12}
