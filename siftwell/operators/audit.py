"""Rewrite audit: ten rules over pairs of an authored bullet and its rewrite.

Bullets: doc_id, bullet_id, text, tech (array), metrics (array of struct(numbers, subject_head)), entry_start (YYYY-MM),
allowed_verbs, must_keep_verbatim. Rewrites: doc_id, bullet_id, rewritten. Each rule is a column that gives an
array of ``struct(rule, detail)``, empty when the pair passes; all run in one select over the joined pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import around, let, once, or_empty
from ..functions.tokens import tokens_in
from ..sources.folders import broadcast_small

#: Rows of a release table.
RELEASES = 10_000
_NONE = "array<struct<rule:string,detail:string>>"


def _fault(rule: str, detail: Column) -> Column:
    return F.array(F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))


def _if(condition: Column, rule: str, detail: Column) -> Column:
    return F.when(condition, _fault(rule, detail)).otherwise(F.array().cast(_NONE))


def _list(c: Column) -> Column:
    return F.array_join(F.array_sort(c), ", ")


def _declared(c: str, kind: str = "array<string>") -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def numbers_in(text: Column) -> Column:
    """Numbers a reader would take as a claim: product names' numbers are blanked first. A text without a digit has none and is only looked through."""
    # what the patterns begin with is said before their alternatives and boundaries
    cleaned = F.regexp_replace(text, K.FLAGS + r"(?=[ohpsetub])" + K.PRODUCT_NUMBERS, " ")
    found = F.regexp_extract_all(cleaned, F.lit(r"(?U)(?=\d)" + K.NUMBER), F.lit(0))
    numbers = F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, r"\.+$", "")))
    return F.when(text.rlike(r"(?U)\d"), numbers).when(text.isNotNull(), F.array().cast("array<string>"))


def introduced_tokens(tokens: Column | None = None) -> Column:
    """tokens: those of the rewrite, where they are there already."""
    new = F.array_except(tokens_in(F.col("rewritten")) if tokens is None else tokens, _declared("tech"))
    return _if(F.size(new) > 0, "v1-technology", F.concat(F.lit("introduces "), _list(new)))


def _allowed_numbers() -> Column:
    return F.array_distinct(F.flatten(F.transform(F.col("metrics"), lambda m: m["numbers"])))


def _quoted(number: Column) -> Column:
    return F.concat(F.lit(r"\Q"), number, F.lit(r"\E"))


def _near(text: Column, number: Column, subject: Column) -> Column:
    """Whether the subject stands within the window of some occurrence of the number."""
    pieces = F.split(text, _quoted(number), -1)
    starts = F.aggregate(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda acc, gap: F.struct(
            (acc["at"] + F.length(gap) + F.length(number)).cast("int").alias("at"),
            F.concat(acc["found"], F.array((acc["at"] + F.length(gap)).cast("int"))).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.exists(starts, lambda s: F.lower(around(text, s, F.length(number), K.SUBJECT_WINDOW)).contains(F.lower(subject)))


def number_problems(numbers: Column | None = None) -> Column:
    """numbers: those of the rewrite, where they are there already."""
    numbers = numbers_in(F.col("rewritten")) if numbers is None else numbers
    plain = lambda c: F.transform(c, lambda n: F.replace(n, F.lit(","), F.lit("")))
    allowed = F.coalesce(_allowed_numbers(), F.array().cast("array<string>"))
    # those allowed as they are written go by hash; the allowed ones are made plain once for the rest
    others = lambda own: F.filter(F.array_except(numbers, allowed), lambda n: ~F.array_contains(own, F.replace(n, F.lit(","), F.lit(""))))
    stated = let(let(plain(allowed), others), lambda invented: _if(F.size(invented) > 0, "v2-number", F.concat(F.lit("states "), _list(invented))))
    # the first number of a metric that stands away from its subject
    moved = F.filter(
        F.transform(
            F.col("metrics"),
            # an empty subject stands beside every number
            lambda m: F.get(F.filter(m["numbers"], lambda n: F.col("rewritten").contains(n) & ((m["subject_head"] != "") | (n == "")) & ~_near(F.col("rewritten"), n, m["subject_head"])), 0),
        ),
        lambda n: n.isNotNull(),
    )
    faults = F.transform(F.coalesce(moved, F.array().cast("array<string>")), lambda n: F.struct(F.lit("v2-subject").alias("rule"), F.concat(F.lit("moves "), n).alias("detail")))
    return F.concat(stated, faults)


def placeholders() -> Column:
    found = F.regexp_extract_all("rewritten", F.lit(rf"(?=[\[T])(?:{K.PLACEHOLDER})"), F.lit(0))
    return _if(F.size(found) > 0, "v5-placeholder", F.array_join(found, ", "))


def width() -> Column:
    delta = F.length("rewritten") - F.length("text")
    return _if(F.coalesce(delta > F.col("budget"), F.lit(False)), "v6-width", F.format_string("grew by %d", delta))


def lead_verb() -> Column:
    first = F.regexp_substr("rewritten", F.lit(K.WORD))
    verbs = _declared("allowed_verbs")
    bad = (F.size(verbs) > 0) & ~F.coalesce(F.array_contains(verbs, first), F.lit(False))
    return _if(bad, "v7-verb", F.coalesce(first, F.lit("no leading word")))


def dropped_text() -> Column:
    gone = F.filter(_declared("must_keep_verbatim"), lambda s: ~F.col("rewritten").contains(s))
    return _if(F.size(gone) > 0, "v8-must-keep", F.array_join(gone, ", "))


def reused_numbers() -> Column:
    times = lambda text, n: (F.length(text) - F.length(F.replace(text, n, F.lit("")))) / F.length(n)
    allowed = F.array_sort(F.coalesce(_allowed_numbers(), F.array().cast("array<string>")))
    more = F.filter(allowed, lambda n: (F.length(n) > 0) & (times(F.col("rewritten"), n) > times(F.col("text"), n)))
    return F.transform(more, lambda n: F.struct(F.lit("v9-borrowed-digit").alias("rule"), n.alias("detail")))


def names_in(text: Column, rest: bool = False) -> Column:
    """The distinct words of more than one letter that begin with a capital; with ``rest`` without the text's first word.

    A run of letters, apostrophes and hyphens holds one word, from its first letter to its end; so only runs whose first letter is a capital are taken out.
    """
    within = K.WORD[K.WORD.index("]") + 1 : -1]  # the class of a word's further characters
    name = rf"(?=[A-Z'’\-])(?<!{within})['’\-]*+([A-Z]{within}+)"
    first = F.regexp_substr(text, F.lit(K.WORD))
    names = F.regexp_extract_all(text, F.lit(name), F.lit(1))
    named = F.coalesce((F.length(first) > 1) & first.rlike("^[A-Z]"), F.lit(False))
    return F.array_distinct(let(names, lambda found: F.slice(found, F.when(named, 2).otherwise(1), F.size(found))) if rest else names)


def new_names(names: Column | None = None, source: Column | None = None) -> Column:
    """names and source: those of the rewrite (its first word left out) and of the text, where they are there already."""
    odd = F.array_except(names_in(F.col("rewritten"), rest=True) if names is None else names, names_in(F.col("text")) if source is None else source)
    return _if(F.size(odd) > 0, "v10-proper-noun", _list(odd))


def structure(bullets: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Bullets that are missing, invented or emptied: a full outer join by document and bullet."""
    b = bullets.select("doc_id", "bullet_id", F.lit(True).alias("_b"))
    r = rewrites.select("doc_id", "bullet_id", (~F.col("rewritten").rlike(r"(?U)\S")).alias("_r"))  # null, or whether it is blank: no text meets the join
    kind = (
        F.when(F.col("_r").isNull(), "bullet is missing from the rewrite")
        .when(F.col("_b").isNull(), "bullet was invented by the rewrite")
        .when(F.col("_r"), "bullet was emptied")
    )
    return b.join(r, ["doc_id", "bullet_id"], "full_outer").withColumn("detail", kind).where("detail is not null").select("doc_id", "bullet_id", F.lit("v4-structure").alias("rule"), "detail")


def anachronisms(pairs: DataFrame, released: DataFrame) -> DataFrame:
    """Tokens released after the role began: exploded tokens against the small release table."""
    named = pairs.where(or_empty(F.col("entry_start")) != "").select("doc_id", "bullet_id", "entry_start", F.explode(tokens_in(F.col("rewritten"))).alias("token"))
    late = named.join(broadcast_small(released, 10_000), "token").where("released > entry_start")
    return late.select("doc_id", "bullet_id", F.lit("v3-temporal").alias("rule"), F.concat_ws(" ", "token", "released").alias("detail"))


def late_tokens(tokens: Column, released: DataFrame) -> Column:
    """As :func:`anachronisms`, as a column: the release table, of at most ``RELEASES`` rows, becomes a map."""
    rows = released.limit(RELEASES + 1).collect()
    if len(rows) > RELEASES:
        raise ValueError(f"a release table of more than {RELEASES} rows is no parameter")
    if not rows:
        return F.array().cast(_NONE)
    at = F.create_map(*(F.lit(x) for r in rows for x in (r["token"], r["released"])))
    late = F.filter(tokens, lambda t: (or_empty(F.col("entry_start")) != "") & (F.try_element_at(at, t) > F.col("entry_start")))
    return F.transform(late, lambda t: F.struct(F.lit("v3-temporal").alias("rule"), F.concat_ws(" ", t, F.try_element_at(at, t)).alias("detail")))


def released_table(spark) -> DataFrame:
    return spark.range(1).select(F.explode(F.create_map(*(F.lit(x) for pair in K.RELEASED.items() for x in pair))).alias("token", "released"))


def audit(bullets: DataFrame, rewrites: DataFrame, released: DataFrame | None = None, budgets: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """All violations (doc_id, bullet_id, rule, detail). The temporal rule needs ``released``, the width rule ``budgets``.

    What is found in one text alone is found before the join, where the texts are read.
    """
    text = F.col("rewritten")
    read = rewrites.withColumns({"_tokens": once(tokens_in(text)), "_numbers": once(numbers_in(text)), "_names": once(names_in(text, rest=True))})
    pairs = bullets.withColumn("_source", once(names_in(F.col("text")))).join(read, ["doc_id", "bullet_id"])
    pairs = pairs.withColumn("budget", F.lit(None).cast("int")) if budgets is None else pairs.join(budgets, "bullet_id", "left")
    tokens = F.col("_tokens")
    rules = [introduced_tokens(tokens), number_problems(F.col("_numbers")), placeholders(), width()]
    rules += [lead_verb(), dropped_text(), reused_numbers(), new_names(F.col("_names"), F.col("_source"))] if strict else []
    rules += [] if released is None else [late_tokens(tokens, released)]
    found = pairs.select("doc_id", "bullet_id", once(F.concat(*rules)).alias("found"))
    rows = found.select("doc_id", "bullet_id", F.explode("found").alias("x")).select("doc_id", "bullet_id", "x.rule", "x.detail")
    return rows.unionByName(structure(bullets, rewrites))


def verdicts(bullets: DataFrame, violations: DataFrame) -> DataFrame:
    """doc_id, violations and passed: one violation rejects the whole document."""
    per = violations.groupBy("doc_id").agg(F.count("*").alias("n"))
    return bullets.select("doc_id").distinct().join(per, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("violations"), F.col("n").isNull().alias("passed"))
