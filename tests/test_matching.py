"""Many strings and patterns in texts, against plain loops and against the single expression."""

import random

from pyspark.sql import functions as F

from siftwell.functions import literals, tokens
from siftwell.operators import paging


def test_strings_in_texts_in_one_part_and_in_many(spark, monkeypatch):
    rng = random.Random(2)
    words = ["ab", "abc", "b", "日本", "x.y", "zz", "a b", "", "ABC"]
    texts = [(i, "".join(rng.choice(["a", "b", "c", " ", "日", "本", "x", ".", "y", "z", "A", "B", "C"]) for _ in range(rng.randint(0, 30)))) for i in range(200)] + [(500, None), (None, "abc"), (501, "")]
    df = spark.createDataFrame(texts, "n long, t string").withColumns({"id": F.lit("clash"), "string": F.lit("clash")}).repartition(3)
    asked = spark.createDataFrame([(w,) for w in [*words, "abc", None]], "w string")
    want = {(str(i), w) for i, t in texts for w in words if i is not None and t and w and w in t}
    for part in (200_000, 3):
        monkeypatch.setattr(literals, "PART", part)
        got = literals.matches(df, asked, "n", "t", "w").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        assert not literals.matches(df.limit(0), asked, "n", "t", "w").collect() and not literals.matches(df, asked.limit(0), "n", "t", "w").collect()


def test_postings_by_url_read_no_more_rows_than_match(spark):
    feed = spark.createDataFrame([(i, f"https://b.example/jobs/{i}-x", f"R{i}") for i in range(300)] + [(300, None, None)], "ordinal long, url string, req_id string")
    asked = spark.createDataFrame([(f"https://a.example/{i}/?s=1",) for i in range(100, 140)] + [("https://a.example/R7",), ("https://a.example/jobs",), ("https://a.example",), (None,)], "url string")
    got = {(r["wanted"], r["ordinal"]) for r in paging.by_url(feed, asked).collect()}
    # the last part of a url without a path is its host, which no posting's url has
    assert got == {(f"https://a.example/{i}/?s=1", i) for i in range(100, 140)} | {("https://a.example/R7", 7), ("https://a.example/jobs", 0)}
    pairs = literals.matches(feed, asked.select(F.regexp_extract("url", "example/([^/]+)", 1).alias("w")), "ordinal", "url", "w")
    assert pairs.count() == 40 + 300  # each number once, and "jobs" in every url


def test_indexed_patterns_give_what_one_expression_gives(spark, monkeypatch):
    rng = random.Random(7)
    parts = ["go", "java", "c++", "node.js", "sql", "rest", "k8s", "ci", "日本", "é"]
    make = (lambda w: rf"\b{w}\b", lambda w: rf"{w}s?", lambda w: rf"\b(?:{w}|x{w})\b", lambda w: rf"\b{w}[ -]?{w}\b", lambda w: rf"{w}", lambda w: rf"\b{w} \d+", lambda w: rf"\b{w}\b|kafka|[|(]{w}")
    esc = lambda w: w.replace("+", r"\+").replace(".", r"\.")
    rows = [(f"t{rng.randint(0, 12)}", rng.choice(make)(esc(w))) for w in parts for _ in range(5)]
    words = [*parts, "Go", "JAVA", "gopher", "django", "C++", "xgo", "cargo go", "_go", "9go", "ego", "ßgo", "Ego", "nodeXjs", "rest 22", "sqls", "kafka", "|go", "ci-ci", "\n"]
    texts = [(i, rng.choice([" ", ", ", ""]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    vocabulary = spark.createDataFrame(rows + rows[:3], "token string, pattern string")
    want = sorted(map(tuple, tokens.tokens_by_join(df, vocabulary, "doc_id", "text").collect()))
    monkeypatch.setattr(tokens, "PATTERNS", 5)
    for indexed in (100_000, 9):
        monkeypatch.setattr(tokens, "INDEXED", indexed)
        assert sorted(map(tuple, tokens.tokens_by_join(df, vocabulary, "doc_id", "text").collect())) == want
    assert len(want) > 300
    assert tokens.needed(r"\ba\b|b") == "" and tokens.needed(r"\bgo(?:a|b)") == "GO" and tokens.needed("node\\.js") == "NODE.JS" and tokens.needed("ab[|]") == "AB"
