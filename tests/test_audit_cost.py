"""The audit's rules run once a row, and their quick forms find what the plain ones say."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.functions import fixed as K
from siftwell.functions import text as X
from siftwell.functions import tokens as N
from siftwell.operators import audit, selection
from siftwell.plans import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["pipe_12_validate_bank", "rewrite_audit", "aud_11_verdicts"])
def test_rules_stand_once_in_the_plan(spark, sf, name):
    assert optimized(QUERIES[name](spark, sf)).count("v2-number") == 1


def test_once_keeps_an_expression_out_of_filters(spark):
    words = spark.range(3).select(X.once(F.split(F.col("id").cast("string"), "0")).alias("w")).select(F.explode("w"))
    assert optimized(words).count("split(") == 1 and words.count() == 4


def test_a_bank_is_read_once(spark):
    variant = "struct<id:string,text:string,tech:array<string>,metrics:array<string>,allowed_verbs:array<string>,must_keep_verbatim:array<string>"
    rows = [("2020-01", [("b", "t", ["Go"], None, None, None, [("v", "u", None, None, ["x"], None), ("w", "s", [], None, None, ["k"])]), ("c", "t", None, None, None, None, None)])]
    entries = spark.createDataFrame(rows, f"date_start string, bullets array<{variant},variants:array<{variant}>>>>")
    flat = selection.flatten_bank(entries)
    assert flat.columns == ["entry_start", "bullet_id", "position", "variant_id", "text", "tech", "metrics", "allowed_verbs", "must_keep_verbatim"]
    assert sorted(tuple(r)[1:6] for r in flat.collect()) == [("b", 0, "b", "t", ["Go"]), ("b", 1, "v", "u", ["Go"]), ("b", 2, "w", "s", []), ("c", 0, "c", "t", None)]
    assert "Union" not in optimized(flat)


def test_names_numbers_and_tokens_are_those_of_the_plain_rules(spark):
    rng = random.Random(7)
    bits = ["A", "B", "b", "-", "'", "’", " ", "É", "Foo", "bar", "1", "٣", "s3", "ſ3", "S3", ",", ".", "top 10", "utf-8", "python 3", "rıos", "ios", "K8s", "C++", "gıt", "Ça", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + ["", None]
    word = F.regexp_extract_all("t", F.lit(K.WORD), F.lit(0))
    named = lambda words: F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & w.rlike("^[A-Z]")))
    cleaned = F.regexp_replace("t", K.FLAGS + K.PRODUCT_NUMBERS, " ")
    plain_numbers = F.array_distinct(F.transform(F.regexp_extract_all(cleaned, F.lit("(?U)" + K.NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, r"\.+$", "")))
    said = [F.when(F.upper("t").contains(N.needed(p)) & X.has(F.col("t"), p), F.lit(t)) for t, ps in K.VOCABULARY.items() for p in ps]
    t = F.col("t")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(
        "t", audit.names_in(t).alias("names"), named(word).alias("names_"),
        audit.names_in(t, rest=True).alias("rest"), named(F.slice(word, F.lit(2), F.greatest(F.size(word) - 1, F.lit(0)))).alias("rest_"),
        audit.numbers_in(t).alias("numbers"), plain_numbers.alias("numbers_"),
        N.tokens_in(t).alias("tokens"), F.array_sort(F.array_distinct(F.array_compact(F.array(*said)))).alias("tokens_"),
    ).collect()
    wrong = [(r["t"], c, r[c], r[c + "_"]) for r in got for c in ("names", "rest", "numbers", "tokens") if r[c] != r[c + "_"]]
    assert not wrong, wrong[:5]
    assert any(r["names"] for r in got) and any(r["numbers"] for r in got) and any(r["tokens"] for r in got)


def test_allowed_numbers_and_blank_rewrites(spark):
    bullets = spark.createDataFrame([("d", str(i), "x", None, [(["1,000", "7"], "Kiwi")] if i < 3 else None, "2015-01", None, None) for i in range(7)],
        "doc_id string, bullet_id string, text string, tech array<string>, metrics array<struct<numbers:array<string>,subject_head:string>>, entry_start string, allowed_verbs array<string>, must_keep_verbatim array<string>")
    texts = ["kiwi 1000 7", "kiwi 1,000 8", "7 kiwi", "9", "　 \n", None]
    rewrites = spark.createDataFrame([("d", str(i), t) for i, t in enumerate(texts)], "doc_id string, bullet_id string, rewritten string")
    found = {(r["bullet_id"], r["rule"], r["detail"]) for r in audit.audit(bullets, rewrites).collect() if r["rule"] in ("v2-number", "v2-subject", "v4-structure")}
    missing = "bullet is missing from the rewrite"
    assert found == {("1", "v2-number", "states 8"), ("3", "v2-number", "states 9"), ("4", "v4-structure", "bullet was emptied"), ("5", "v4-structure", missing), ("6", "v4-structure", missing)}
    metric = lambda subject: F.array(F.struct(F.array(F.lit("7")).alias("numbers"), F.lit(subject).alias("subject_head")))
    row = spark.createDataFrame([("7 apples",)], "rewritten string")
    rules = lambda subject: [x["rule"] for x in row.withColumn("metrics", metric(subject)).select(audit.number_problems().alias("x")).first()["x"]]
    assert rules("") == [] and rules("APPLE") == [] and rules("pear") == ["v2-subject"]
