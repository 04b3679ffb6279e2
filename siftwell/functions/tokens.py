"""Vocabulary tokens, requirement sections, coverage scores and spans."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed as K
from .literals import occurring, table_of
from .text import collapse, has, let, or_empty, strip


#: Patterns of a vocabulary table that become one expression, and those of one index beyond that.
PATTERNS, INDEXED = 100, 100_000


def _alternatives(pattern: str) -> bool:
    """Whether a pattern has alternatives outside of its groups and classes."""
    depth, flat = 0, re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]", "", pattern)
    for c in flat:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return True
    return False


def needed(pattern: str) -> str:
    """An upper-case string that every match of a pattern begins with ("" if there is none to tell)."""
    if _alternatives(pattern):
        return ""
    plain = re.sub(r"\\b", "", pattern)
    head = re.match(r"(?:[A-Za-z0-9 #/]|\\[+.])*", plain)[0]
    if plain[len(head) : len(head) + 1] in ("?", "*", "{"):
        head = head[:-2] if head[-2:-1] == "\\" else head[:-1]  # what may be absent
    return head.replace("\\", "").upper()


def begun(pattern: str) -> str:
    """A pattern that begins at a word with its first letter said before: a look at a letter is far quicker than one for a word's boundary."""
    return f"(?={pattern[2]}){pattern}" if re.match(r"\\b[A-Za-z0-9]", pattern) else pattern


def upper_ascii(text: Column) -> Column:
    """Upper case as far as ASCII strings can tell: what is upper-cased to no ASCII letter is blanked, for upper case of other scripts costs ten times that of ASCII."""
    plain = F.replace(F.replace(text, F.lit("\u0131"), F.lit("I")), F.lit("\u017f"), F.lit("S"))
    return F.upper(F.regexp_replace(plain, r"[^\x00-\x7f]+", " "))


def tokens_in(text: Column, vocabulary: dict[str, tuple[str, ...]] = K.VOCABULARY) -> Column:
    """The sorted tokens of the vocabulary that a text states. One pass per row, no shuffle; a pattern runs only where its plain beginning occurs."""

    def found(upper: Column) -> Column:
        # a longer string is found by leaps as a pattern, a short one by looking
        there = lambda s: upper.rlike(rf"\Q{s}\E") if len(s) > 3 else upper.contains(s)
        one = lambda p: there(needed(p)) & has(text, begun(p))
        hits = [F.when(reduce(lambda a, b: a | b, map(one, patterns)), F.lit(token)) for token, patterns in sorted(vocabulary.items())]
        return F.array_sort(F.array_compact(F.array(*hits)))

    return F.coalesce(let(upper_ascii(text), found), F.array().cast("array<string>"))


def tokens_by_join(texts: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and token, a row for each token of a table (token, pattern) that a text states.

    Up to ``PATTERNS`` patterns become one expression. More are found by an index of the strings that their matches begin with: one pass over
    a text tells which of these occur, and only their patterns run; patterns without such a string run on every text. The table
    comes to the driver in parts of ``INDEXED`` patterns, each of which is one pass over the texts. No shuffle of texts.
    """
    rows = vocabulary.select("token", "pattern").distinct()
    few = rows.limit(PATTERNS + 1).collect()
    if len(few) <= PATTERNS:
        patterns: dict[str, tuple[str, ...]] = {}
        for r in sorted(few):
            patterns[r["token"]] = (*patterns.get(r["token"], ()), r["pattern"])
        return texts.select(F.col(id_col), F.explode(tokens_in(F.col(text_col), patterns)).alias("token"))
    parts = -(-rows.count() // INDEXED)
    part = F.pmod(F.xxhash64("token"), F.lit(parts))  # all patterns of a token in one part
    found = [_indexed(texts, sorted(rows.where(part == i).collect()), id_col, text_col) for i in range(parts)]
    return reduce(DataFrame.unionByName, found)


def _indexed(texts: DataFrame, rows: list, id_col: str, text_col: str) -> DataFrame:
    """Tokens of a part of a vocabulary by the index of beginnings."""
    of: dict[str, tuple[list[int], list[int]]] = {}
    bounds: dict[str, int] = {}
    for i, r in enumerate(rows):
        string, pattern = needed(r["pattern"]), r["pattern"]
        whole = re.fullmatch(r"\\b[A-Za-z0-9](?:[A-Za-z0-9 ]*[A-Za-z0-9])?\\b", pattern) is not None  # a word, or words, and nothing else
        of.setdefault(string, ([], []))[whole].append(i)
        # whether a match begins where a word does, and whether the string is the whole match and ends a word
        own = bool(re.match(r"\\b[A-Za-z0-9]", pattern)) + 2 * bool(re.fullmatch(r"(\\b)?[A-Za-z0-9 ]*[A-Za-z0-9]\\b", pattern))
        bounds[string] = bounds.get(string, 3) & own
    always = sum(of.pop("", ([], [])), [])
    strings = sorted(of)
    text, number = F.col(text_col), lambda h: F.shiftright(h, 1)
    hits = texts.select(F.col(id_col), text.alias("_text"), occurring(text, strings, [bounds[s] for s in strings]).alias("_hits"))
    table = lambda lists: F.from_json(F.lit(json.dumps(lists)), "array<array<int>>")
    words, others, every = table([of[s][1] for s in strings]), table([of[s][0] for s in strings]), table([sum(of[s], []) for s in strings])
    surely = lambda h: h % 2 == 1
    # a word that surely stands there needs no pattern; what is left runs its own
    settled = F.flatten(F.transform(F.filter("_hits", surely), lambda h: F.get(words, number(h))))
    open_ = F.concat(F.flatten(F.transform("_hits", lambda h: F.when(surely(h), F.get(others, number(h))).otherwise(F.get(every, number(h))))), F.lit(always).cast("array<int>") if always else F.array().cast("array<int>"))
    patterns, tokens = table_of([K.FLAGS + begun(r["pattern"]) for r in rows]), table_of([r["token"] for r in rows])
    stated = F.concat(settled, F.filter(open_, lambda i: F.rlike(F.col("_text"), F.get(patterns, i))))
    return hits.select(id_col, F.explode(F.array_distinct(F.transform(stated, lambda i: F.get(tokens, i)))).alias("token"))


def normalise_requirements(requirements: Column, vocabulary: dict[str, tuple[str, ...]] = K.VOCABULARY) -> Column:
    """Trimmed requirements as canonical tokens where the vocabulary knows them; others stay as they are."""
    known = F.create_map(*(F.lit(x) for t in vocabulary for x in (t.lower(), t)))
    mapped = F.transform(F.filter(F.transform(requirements, strip), lambda r: r != ""), lambda r: F.coalesce(F.try_element_at(known, F.lower(r)), r))
    return F.array_sort(F.array_distinct(mapped))


def sections(description: Column) -> Column:
    """``struct(required, preferred)``: lines carry the bucket of the last short heading line, which itself is dropped.

    A fold over the lines of one row: no shuffle.
    """
    lines = F.split(F.regexp_replace(or_empty(description), r"\r\n|[\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n"), "\n", -1)
    none = F.array().cast("array<string>")

    def mark(line):
        head = strip(line)
        kind = F.when(has(head, K.PREFERRED_HEAD), "p").when(has(head, K.REQUIRED_HEAD), "r")
        return F.struct(line.alias("line"), F.when(F.length(head) < K.HEADING_CHARS, kind).alias("to"))

    def step(acc, x):
        add = lambda name, own: F.when(x["to"].isNull() & (acc["bucket"] == own), F.concat(acc[name], F.array(x["line"]))).otherwise(acc[name])
        return F.struct(F.coalesce(x["to"], acc["bucket"]).alias("bucket"), add("required", "r").alias("required"), add("preferred", "p").alias("preferred"))

    start = F.struct(F.lit("r").alias("bucket"), none.alias("required"), none.alias("preferred"))
    return F.aggregate(
        F.transform(lines, mark), start, step,
        lambda a: F.struct(F.array_join(a["required"], "\n").alias("required"), F.array_join(a["preferred"], "\n").alias("preferred")),
    )


def gap(required: Column, preferred: Column, mine: Column) -> Column:
    """Requirement tokens against a profile's. A token stated as required is not preferred as well; all arrays sorted."""
    preferred = F.array_except(preferred, required)
    both = F.concat(required, preferred)
    signal = lambda names: F.size(F.array_intersect(both, F.array(*map(F.lit, names))))
    back, front = signal(K.BACKEND_SIGNAL), signal(K.FRONTEND_SIGNAL)
    variant = (
        F.when((back >= front * K.DOMINANCE) & (back >= K.MIN_SIGNALS), "backend")
        .when((front >= back * K.DOMINANCE) & (front >= K.MIN_SIGNALS), "full-stack")
        .otherwise("either")
    )
    return F.struct(
        F.array_sort(F.array_intersect(required, mine)).alias("have_required"),
        F.array_sort(F.array_except(required, mine)).alias("missing_required"),
        F.array_sort(F.array_intersect(preferred, mine)).alias("have_preferred"),
        F.array_sort(F.array_except(preferred, mine)).alias("missing_preferred"),
        variant.alias("variant"), back.alias("backend_signal"), front.alias("frontend_signal"),
    )


def coverage_line(report: Column) -> Column:
    have, total = F.size(report["have_required"]), F.size(report["have_required"]) + F.size(report["missing_required"])
    stated = F.concat(F.lit("covers "), have.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" named requirements"))
    return F.when(total == 0, "no explicit technology requirements found in this posting").otherwise(stated)


def coverage_score(report: Column, confirmed: Column) -> Column:
    """``struct(total, required_covered, required_total, preferred_covered, preferred_total, level_confirmed, tier)``."""
    r, p = F.size(report["have_required"]), F.size(report["have_preferred"])
    rt, pt = r + F.size(report["missing_required"]), p + F.size(report["missing_preferred"])
    ratio = F.when(rt > 0, r / rt).otherwise(F.lit(0.0))
    weight = F.least(F.lit(1.0), rt / F.lit(float(K.MIN_EVIDENCE)))
    preferred = F.when(pt > 0, p / pt).otherwise(F.lit(0.0))
    points = K.WEIGHT_REQUIRED * ratio * weight + K.WEIGHT_PREFERRED * preferred + F.when(confirmed, float(K.WEIGHT_LEVEL)).otherwise(0.0)
    silent = (rt == 0) & (pt == 0)
    tier = (
        F.when(silent, "unscored")
        .when((rt >= K.MIN_EVIDENCE) & (r == rt) & confirmed, "exact match")
        .when(ratio >= K.STRONG_AT, "strong")
        .when(ratio >= K.PARTIAL_AT, "partial")
        .otherwise("weak")
    )
    return F.struct(
        F.when(silent, 0).otherwise(F.bround(points).cast("int")).alias("total"),
        r.alias("required_covered"), rt.alias("required_total"), p.alias("preferred_covered"), pt.alias("preferred_total"),
        confirmed.alias("level_confirmed"), tier.alias("tier"),
    )


def explain_score(score: Column) -> Column:
    of = lambda a, b, what: F.concat(score[a].cast("string"), F.lit("/"), score[b].cast("string"), F.lit(f" {what}"))
    return F.concat_ws(
        " · ",
        F.concat(F.lit("covers "), of("required_covered", "required_total", "required")),
        F.when(score["preferred_total"] > 0, of("preferred_covered", "preferred_total", "preferred")),
        F.when(score["level_confirmed"], "level confirmed").otherwise("level unverified"),
    )


def unscored_reason(score: Column, description: Column) -> Column:
    reason = F.when(strip(or_empty(description)) == "", "no_description").otherwise("no_technologies_named")
    return F.when(score["tier"] == "unscored", reason)


# --- spans of model answers ----------------------------------------------------------------------


def locate(description: Column, span: Column) -> Column:
    """``verbatim``, ``reflowed`` (equal once white space is collapsed) or ``absent``."""
    flat = collapse(span)
    return (
        F.when(or_empty(span) == "", "absent")
        .when(description.contains(span), "verbatim")
        .when((flat != "") & collapse(description).contains(flat), "reflowed")
        .otherwise("absent")
    )


def downgraded(confidence: Column) -> Column:
    return F.when(confidence == "high", "medium").otherwise("low")


def clean_years(years: Column) -> Column:
    return F.when(years.between(0, K.MAX_YEARS), years)


def clean_evidence(span: Column) -> Column:
    t = strip(or_empty(span))
    return F.when(F.length(t) < K.SPAN_MIN, "").otherwise(F.substring(t, 1, K.SPAN_MAX))
