"""Variant selection: for each set of requirements one variant per bullet, greedily by new coverage; validation of a bank.

A bank is a table of variants (bullet_id, position, variant_id, text, tech). It is a parameter whose size does
not depend on the postings, and travels as one array; each posting is one row from start to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, once
from ..functions.tokens import normalise_requirements, tokens_in
from .audit import dropped_text, introduced_tokens, number_problems


#: A bank that travels with every task has at most so many characters as JSON.
BANK_CHARS = 64 << 20


def bank_array(variants: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """One row: ``bank array<struct<bullet_id, budget, variants array<struct<position, variant_id, text, states, delta>>>>``, by bullet id.

    ``states`` are the tokens a variant's text names, computed once; ``delta`` is its growth over the baseline (position 0).
    """
    base = variants.where("position = 0").select("bullet_id", F.length("text").alias("_base"))
    sized = variants.withColumn("states", tokens_in(F.col("text"))).join(base, "bullet_id").withColumn("delta", F.length("text") - F.col("_base"))
    one = F.array_sort(F.collect_list(F.struct("position", "variant_id", "text", "states", "delta")))
    bullets = sized.groupBy("bullet_id").agg(one.alias("variants"))
    limits = bullets.select("bullet_id").withColumn("budget", F.lit(None).cast("int")) if budgets is None else budgets.select("bullet_id", F.col("budget").cast("int"))
    joined = bullets.join(limits, "bullet_id", "left").select("bullet_id", "budget", "variants")
    return joined.agg(F.array_sort(F.collect_list(F.struct("bullet_id", "budget", "variants"))).alias("bank"))


def _choose(bullet: Column, wanted: Column, covered: Column) -> Column:
    def best_of(fits: Column) -> Column:
        shortest = F.slice(F.array_sort(F.transform(bullet["variants"], lambda v: F.struct(v["delta"].alias("d"), v["position"].alias("p"), v.alias("v")))), 1, 1)
        pool = F.when(F.size(fits) > 0, fits).otherwise(F.transform(shortest, lambda x: x["v"]))
        # most new coverage first, then the authored order
        gain = lambda v: -F.size(F.array_except(F.array_intersect(v["states"], wanted), covered))
        return F.array_min(F.transform(pool, lambda v: F.struct(gain(v).alias("gain"), v["position"].alias("position"), v.alias("v"))))["v"]

    def choice(fits: Column, best: Column, states: Column) -> Column:
        return F.struct(
            bullet["bullet_id"].alias("bullet_id"), best["variant_id"].alias("variant_id"), best["text"].alias("text"), states.alias("covered"),
            F.array_sort(F.array_except(states, covered)).alias("newly_covered"), best["delta"].alias("delta_chars"), bullet["budget"].alias("budget"),
            (F.size(fits) > 0).alias("within_budget"), (best["position"] == 0).alias("is_baseline"),
        )

    fitting = F.filter(bullet["variants"], lambda v: bullet["budget"].isNull() | (v["delta"] <= bullet["budget"]))
    stated = lambda best: F.array_sort(F.array_intersect(best["states"], wanted))
    return let(fitting, lambda fits: let(best_of(fits), lambda best: let(stated(best), lambda states: choice(fits, best, states))))


_CHOICE = (
    "struct<bullet_id:string,variant_id:string,text:string,covered:array<string>,newly_covered:array<string>,delta_chars:int,budget:int,"
    "within_budget:boolean,is_baseline:boolean>"
)


def reason(choice: Column) -> Column:
    joined = lambda c: F.array_join(choice[c], ", ")
    signed = lambda c: F.format_string("%+d", choice[c])
    return (
        F.when(
            ~choice["within_budget"],
            F.concat(F.lit("no variant fits a "), signed("budget"), F.lit("-character budget; fell back to the shortest ("), signed("delta_chars"), F.lit(") rather than overflow the page")),
        )
        .when(F.size(choice["newly_covered"]) > 0, F.concat(F.lit("surfaces "), joined("newly_covered"), F.lit(", not stated by any earlier bullet")))
        .when(
            F.size(choice["covered"]) > 0,
            F.concat(F.lit("states "), joined("covered"), F.lit(", already covered earlier; no variant adds an uncovered requirement")),
        )
        .otherwise("no variant states any of this posting's requirements")
    )


def select(postings: DataFrame, bank: DataFrame, requirements: str = "requirements") -> DataFrame:
    """choices (array), covered, uncovered and overflowed (bullet ids) beside the postings' columns.

    A fold over the bank's bullets in id order inside each row: sequential in a row, parallel over rows, no shuffle
    but for the bank's one broadcast row.
    """
    if bank.select(F.coalesce(F.length(F.to_json("bank")), F.lit(0)).alias("n")).first()["n"] > BANK_CHARS:
        raise ValueError(f"a bank of more than {BANK_CHARS} characters is no parameter")
    rows = postings.join(F.broadcast(bank.select(F.col("bank").alias("_bank"))), F.lit(True)).withColumn("_wanted", normalise_requirements(F.col(requirements)))
    start = F.struct(F.array().cast("array<string>").alias("covered"), F.array().cast(f"array<{_CHOICE}>").alias("choices"))

    def step(acc, bullet):
        add = lambda c: F.struct(F.array_union(acc["covered"], c["covered"]).alias("covered"), F.concat(acc["choices"], F.array(c)).alias("choices"))
        return let(_choose(bullet, F.col("_wanted"), acc["covered"]).cast(_CHOICE), add)

    folded = rows.withColumn("_s", F.aggregate("_bank", start, step))
    over = F.transform(F.filter("_s.choices", lambda c: ~c["within_budget"]), lambda c: c["bullet_id"])
    return folded.select(
        *postings.columns, F.col("_s.choices").alias("choices"), F.array_sort("_s.covered").alias("covered"),
        F.array_sort(F.array_except("_wanted", "_s.covered")).alias("uncovered"), over.alias("overflowed"),
    )


def coverable(variants: DataFrame) -> DataFrame:
    """All tokens any variant states, in one row."""
    return variants.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(tokens_in(F.col("text")))))).alias("tokens"))


def flatten_bank(entries: DataFrame) -> DataFrame:
    """A nested bank (entries of bullets of variants) as variant rows: the bullet itself is position 0, and variants
    inherit what they do not declare."""
    bullets = entries.select(F.col("date_start").alias("entry_start"), F.explode("bullets").alias("b"))
    own = ("tech", "metrics", "allowed_verbs", "must_keep_verbatim")
    b = F.col("b")
    base = F.struct(F.lit(0).alias("position"), b["id"].alias("variant_id"), b["text"].alias("text"), *(b[c].alias(c) for c in own))
    rest = F.transform(
        b["variants"],
        lambda v, at: F.struct((at + 1).alias("position"), v["id"].alias("variant_id"), v["text"].alias("text"), *(F.coalesce(v[c], b[c]).alias(c) for c in own)),
    )
    rows = bullets.select("entry_start", b["id"].alias("bullet_id"), F.explode(F.concat(F.array(base), F.coalesce(rest, F.slice(F.array(base), 1, 0)))).alias("v"))
    return rows.select("entry_start", "bullet_id", *(f"v.{c}" for c in ("position", "variant_id", "text", *own)))


def validate_bank(variants: DataFrame) -> DataFrame:
    """Violations (rule, variant_id, detail) of variants against their own declarations, and duplicate ids."""
    v = variants.withColumn("rewritten", F.col("text"))
    found = once(F.array_compact(F.concat(introduced_tokens(), number_problems(), dropped_text())))  # or it would run for the rows' filter again
    own = v.select("variant_id", found.alias("found")).select("variant_id", F.explode("found").alias("x")).select(F.col("x.rule").alias("rule"), "variant_id", F.col("x.detail").alias("detail"))
    twice = variants.groupBy("variant_id").count().where("count > 1").select(F.lit("duplicate-id").alias("rule"), "variant_id", F.lit("id is not unique").alias("detail"))
    return own.unionByName(twice)
