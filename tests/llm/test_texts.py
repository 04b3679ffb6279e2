"""Substring dedup, quality rules, line dedup, near-dedup, mixing: against brute force on small tables, odd rows included."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import common, line_dedup, near_dedup, pfair_mix, quality_rules, queries, substring_dedup

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return WORDS.findall((text or "").encode())


@pytest.fixture(scope="module")
def corpus():
    """Texts with shared passages, copies, near copies, repeated lines, odd separators, nulls, and a very long text."""
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "gamma", "délta", "o", "xi", "rho tau", "漢字", "𝒳", "the"]) + str(rng.randint(0, 60))
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(120)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rng.choice([0, 1, 2, 5, 12, 13, 30, 200]))]
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 10) : rng.randint(25, 40)]
        if i % 5 == 1:
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = word()
        if i % 9 == 2:
            w = ["same"] * rng.randint(10, 60)
        rows.append((i * 7, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    rows += [(1000, rows[5][1]), (1001, rows[5][1].upper()), (1002, None), (1003, ""), (1004, "  \n\t"), (1005, "one two"), (None, rows[9][1]), (None, None)]
    rows += [(1006, " ".join(word() for _ in range(30000))), (7, rows[1][1]), (14, "another text under an id that is there already " + rows[4][1])]
    return rows


def frame(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, c in more.items():
        df = df.withColumn(name, F.lit(c))
    return df


CLASH = dict(bucket=1, chunk="x", tag=None, node=2, component_id=3, text_="t", key=0, host="h", rank=0)


def test_substring_dedup_against_brute_force(spark, corpus):
    first = {}
    for i, text in corpus:
        w = split(text)
        if i is not None:
            for k in range(len(w) - 12):
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, text in corpus:
        w = split(text)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - 12):
                if first[tuple(w[k : k + 13])] < i:
                    gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter(map(tuple, substring_dedup.digest(substring_dedup.remove_repeats(frame(spark, corpus, **CLASH).repartition(5))).collect()))
    assert got == want
    assert sum(n for (_, _, n, _) in got) > 500
    assert not substring_dedup.remove_repeats(frame(spark, [])).collect()


def test_common_runs_spread_over_buckets(spark, monkeypatch):
    """A passage in every document: its runs come last as minimisers, and the result is the same."""
    rng = random.Random(5)
    license_ = " ".join(f"lic{i}" for i in range(40))
    rows = [(i, " ".join([*(f"w{rng.randint(0, 3000)}" for _ in range(30)), license_, *(f"v{rng.randint(0, 3000)}" for _ in range(20))])) for i in range(300)]
    df = frame(spark, rows)
    often = substring_dedup.common_runs(df, 4, 400)
    table = common.WordTable([common.joined(license_.encode())])
    assert set(often.tolist()) == set(substring_dedup._runs(table, 4).tolist())
    first, last, bucket = substring_dedup._super_kmers(table, 13, 4, 400, often)
    assert (first == last).all() and len(first) == 28 and len(set(bucket.tolist())) > 20
    plain = substring_dedup._super_kmers(table, 13, 4, 400, often[:0])[2]
    assert len(set(plain.tolist())) < 10
    out = Counter(map(tuple, substring_dedup.remove_repeats(df).collect()))
    monkeypatch.setattr(substring_dedup, "COMMON", 1e9)
    assert out == Counter(map(tuple, substring_dedup.remove_repeats(df).collect()))
    assert sum(r[2] >= 40 for r in out) == 299


def test_equal_hashes_of_different_windows_are_told_apart():
    table = common.WordTable([b"a b c", b"a b d", b"a b c", b"x y z"])
    at = np.flatnonzero(table.windows(3)[1])
    classes = common.window_classes(table, at, 3, np.zeros(len(table), np.uint64))
    assert classes[0] == classes[2] and len(set(classes.tolist())) == 3
    assert common.sliding_min(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]


def test_word_table_slices_long_inputs():
    texts = [common.joined(b"w%d  x" % i * 3000) for i in range(90)] + [b""]
    whole = common.WordTable(texts)
    assert len(whole) == sum(len(t.split()) for t in texts)
    for i in (0, 45, 89):
        alone = common.WordTable([texts[i]])
        assert (whole.hash[whole.base[i] : whole.base[i + 1]] == alone.hash).all()


def test_quality_statistics_against_brute_force(spark, corpus):
    want = Counter()
    for i, text in corpus:
        t, w = text or "", split(text)
        lines = [x for x in t.split("\n") if split(x)]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = [False] * len(w)
        for k in range(len(w) - 7):
            if windows[tuple(w[k : k + 8])] > 1:
                cover[k : k + 8] = [True] * 8
        failed = len(w) < 20 or 100 * sum(cover) > 30 * len(w)
        want[i, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(cover), failed] += 1
    rows = quality_rules.clean(frame(spark, corpus, **CLASH), texts=False).drop("kept", "lost_chars", *(f"lines_{r}" for r in quality_rules.LINE_RULES)).collect()
    assert Counter(map(tuple, rows)) == want


GOOD = "The harbour was quiet in the morning, and the boats lay still. Nobody had come down to the water yet, so the gulls had it all."


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        (GOOD, True), (GOOD + "\nHome | News | Sport | Weather | Contact", True), ("\n".join(["A | b | c | d | e | f"] * 3 + ["x " * 25]), False),
        (" ".join(f"w{i}$$$ v{i}&&&" for i in range(30)), False), (GOOD + "\nAll rights reserved.", True), ("la " * 60, False), (" ".join(f"word{i}" for i in range(40)) + ".", True),
        ("# Heading\n\n- a short list entry\n" + GOOD, True), ("«" + GOOD + "»", True), (None, False), ("", False),
    ],
)
def test_quality_verdicts(spark, text, kept):
    assert quality_rules.clean(frame(spark, [(1, text)])).first()["kept"] is kept


def test_navigation_and_sentence_rules_as_stated(spark):
    long = " ".join(f"word{i}" for i in range(35))
    fails = [f"Home {s} News {s} Sport {s} Contact us" for s in "|»›>·•/"] + [long, long + " costs 3.5 at www.example.com today", long + "! and so on"]
    stays = [f"The inner{s}outer ring {s} one of two {s} is open" for s in "|»›>·•/"] + [long + e for e in (".", "?", "!”", "。", " है।", "؟")] + ["short heading"]
    row = quality_rules.clean(frame(spark, [(1, "\n".join(x for pair in zip(fails + [""] * 9, stays) for x in pair))])).first()
    assert row["cleaned"].split("\n") == stays
    assert quality_rules.clean(frame(spark, [(1, "\n".join(fails[1:3] * 4))])).first()["kept"] is False


def test_cleaned_text_lacks_failed_lines(spark):
    row = quality_rules.clean(frame(spark, [(1, GOOD + "\nClick here to subscribe\n\n" + GOOD)])).first()
    assert row["cleaned"] == GOOD + "\n" + GOOD and row["lost_chars"] == 20


def test_boilerplate_by_shape_and_language(spark):
    """Notices and site phrases of four languages go, by the rule that they break; sentences about licences, rights and links stay."""
    goes = [
        "© 2021 Example Ltd", "(c) 2020 The Authors", "Copyright © 1999-2004 by the editors.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.", "// SPDX-License-Identifier: MIT", "Dieses Werk steht unter einer freien Lizenz", "Alle Rechte vorbehalten.",
        "Texte publié sous licence libre", "TOUS DROITS RÉSERVÉS", "Obra publicada bajo una licencia libre", "Todos los derechos reservados", "Lire la suite", "Haga clic aquí", "Hier klicken!",
    ]
    links = ["https://example.com/a", "See http://a.example www.b.example"]
    stays = ["She holds a driving licence and a copyright.", "Die Lizenz lag unter dem Buch.", "We met under the bridge to talk about the license.", "Read www.example.com for more of this.", "Une licence de pêche."]
    row = quality_rules.clean(frame(spark, [(1, "\n".join(goes + links + stays))])).first()
    assert row["cleaned"].split("\n") == stays
    assert (row["lines_boilerplate"], row["lines_links"], row["lines_symbols"], row["lines_unended"]) == (len(goes), len(links), 0, 0)
    long = " ".join(["word"] + [f"w{i}" for i in range(30)]) + " all rights reserved."
    assert quality_rules.clean(frame(spark, [(1, long)])).first()["cleaned"] == long
    # the hints only spare lines a search: each notice holds one
    rules = quality_rules.Rules()
    for line in map(str.lower, goes):
        found = any(re.search(n, line) for n in rules.notices)
        assert not found or any(h in line for h in rules.hints)


def test_report_of_line_rules(spark):
    df = frame(spark, [(1, GOOD + "\nClick here\nClick here"), (2, "Home · News · Sport · Weather · Contact\n$$$$ a\nClick here"), (3, None), (4, "la " * 60)])
    found = {r["rule"]: (r["lines"], r["documents"]) for r in quality_rules.report(quality_rules.clean(df)).collect()}
    assert found == {"symbols": (1, 1), "navigation": (1, 1), "boilerplate": (3, 2), "links": (0, 0), "repetition": (1, 1), "unended": (0, 0)}
    assert all(r["lines"] == r["documents"] == 0 for r in quality_rules.report(quality_rules.clean(df.limit(0))).collect())


def shingle_set(text, words):
    w = [x.lower() for x in split(text)]
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_components(rows, words, threshold):
    sets = [(i, shingle_set(t, words)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and both >= threshold * len(a | b) - 1e-12:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return find


@pytest.mark.parametrize(("words", "threshold"), [(3, 0.85), (5, 0.8)])
def test_near_dedup_against_brute_force(spark, corpus, words, threshold):
    find = brute_components(corpus, words, threshold)
    want = Counter((i, len(shingle_set(t, words)), None if i is None else find(i), i is None or find(i) == i) for i, t in corpus)
    got = Counter(map(tuple, near_dedup.classes(frame(spark, corpus, **CLASH), words, threshold).collect()))
    assert got == want
    assert any(i != c for i, _, c, _ in got)


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """A group of near copies of every distance, with blocks so small that it is cut up."""
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 4000)
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 20)
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(90)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 50)}"
        rows.append((i, " ".join(w)))
    find = brute_components(rows, 3, 0.85)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.classes(frame(spark, rows), 3, 0.85).collect()}
    assert got == {i: find(i) for i, _ in rows}
    assert 3 < len(set(got.values())) < 150


def test_linked_forest_is_exact():
    rng = np.random.default_rng(5)
    for trial in range(60):
        n, level = int(rng.integers(2, 40)), int(rng.choice([5000, 8000, 8500]))
        base = rng.choice(10_000, 40, replace=False)
        sets = []
        for _ in range(n):
            s = set(base[rng.random(40) > rng.random() * 0.4].tolist()) | set(rng.integers(0, 30, int(rng.integers(0, 6))).tolist())
            sets.append(np.array(sorted(s), np.uint64))
        label = list(range(n))

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        for a in range(n):
            for b in range(a):
                both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
                if both and 10_000 * both >= level * (len(sets[a]) + len(sets[b]) - both):
                    label[find(a)] = find(b)
        mine = list(range(n))

        def find2(x):
            while mine[x] != x:
                x = mine[x]
            return x

        for a, b in near_dedup.linked(sets, level):
            mine[find2(a)] = find2(b)
        groups = lambda f: {frozenset(x for x in range(n) if f(x) == r) for r in range(n)} - {frozenset()}
        assert groups(find) == groups(find2), trial


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    near = hashes.copy()
    near[:50] = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    far = hashes.copy()
    far[:600] = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
    rows, bands = near_dedup.band_plan(0.85)
    keys, sketch = near_dedup.signatures(np.concatenate([hashes, near, far]), np.array([0, 1000, 2000, 3000]), rows, bands)
    differ = lambda i: int(np.bitwise_count(sketch[0].view(np.uint64) ^ sketch[i].view(np.uint64)).sum())
    assert differ(1) <= near_dedup.sketch_limit(0.85) < differ(2)
    assert (keys[0] == keys[1]).any()
    assert near_dedup.band_plan(0.85) == (5, 25) and near_dedup.band_plan(0.8) == (4, 32)


def test_texts_of_one_id_are_linked(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue white black grey")
    rows = [(3, a), (5, a), (5, b), (8, b), (5, ""), (9, c), (9, c), (11, b), (11, c), (1, None)]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.classes(frame(spark, rows), 3, 0.85).collect())
    assert got == Counter([(3, 3, True), (5, 3, False), (5, 3, False), (8, 3, False), (5, 5, True), (9, 3, False), (9, 3, False), (11, 3, False), (11, 3, False), (1, 1, True)])


def test_keep_first_keeps_columns(spark):
    rows = frame(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, "x"), (None, "a b c d e f"), (4, None)], gone="clash", c0=1)
    out = near_dedup.keep_first(rows)
    assert out.columns == ["doc_id", "text", "gone", "c0"]
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3, 4]
    assert not near_dedup.keep_first(frame(spark, [])).collect()


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        host = rng.choice(["a", "a", "a", "b", "c", None])
        lines = [rng.choice(["menu", "about us", "", "  ", f"story {i}", "rare line" if i % 40 == 0 else f"x{i}"]) for _ in range(rng.randint(0, 6))]
        rows.append((i, host, "\n".join(lines) if i % 50 else None))
    pages, holders = Counter(h for _, h, _ in rows if h), defaultdict(set)
    for i, h, t in rows:
        for line in (t or "").split("\n"):
            if h and split(line):
                holders[h, line].add(i)
    common_lines = {k for k, v in holders.items() if len(v) >= 3 and len(v) > 0.02 * pages[k[0]]}
    want = {}
    for i, h, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if (h, x) not in common_lines]
        want[i] = (h, len(lines), len(lines) - len(kept), None if t is None else hashlib.sha256("\n".join(kept).encode()).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"host": F.lit("x"), "keys": F.lit(0), "salt": F.lit(1)})
    for limit in (50_000, 0):  # broadcast, and salted join
        got = {r[0]: tuple(r[1:]) for r in line_dedup.digest(df, broadcast_rows=limit).collect()}
        assert got == want
    twice = line_dedup.digest(df.unionByName(df.where("doc_id < 40"))).where("doc_id < 40").groupBy("doc_id").count().collect()
    assert all(r["count"] == 2 for r in twice)  # rows of equal id are pages of their own
    long = spark.createDataFrame([(i, "h", "x" * 300_000 + "\nown %d" % i) for i in range(5)], "doc_id long, source string, text string")
    assert sorted(r["text"] for r in line_dedup.drop_boilerplate(long).collect()) == [f"own {i}" for i in range(5)]
    out = line_dedup.drop_boilerplate(df)
    assert out.columns[:6] == df.columns and out.count() == 300
    assert not line_dedup.drop_boilerplate(df.limit(0)).collect()


def test_pfair_schedule_stays_within_a_block():
    k = pfair_mix.shares({"a": 5.0, "b": 3.0, "c": 0.001}, 100)
    assert sum(k.values()) == 100 and k["c"] == 1
    placed = pfair_mix.edf(k)
    seen = Counter()
    for t, (c, j) in enumerate(placed):
        assert j == seen[c] and j * 100 // k[c] <= t < -(-(j + 1) * 100 // k[c])  # released, and not late
        seen[c] += 1
        assert all(abs(seen[x] - (t + 1) * k[x] / 100) < 1 for x in k)


def test_mix_is_a_whole_schedule(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 3 == 0 else rng.choice(["s1", "s2", None, "s3"]), f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"slot": F.lit("x"), "class": F.lit(1), "k": F.lit(0)})
    out = [r.asDict() for r in pfair_mix.mix(df, {"big": 0.25, "s1": 0.5, "s2": 0.2}, rest_weight=0.05, block_docs=16, period=128).collect()]
    assert sorted(r["doc_id"] for r in out) == list(range(3000))
    assert len({r["position"] for r in out}) == 3000
    slots = defaultdict(set)
    for r in out:
        slots[r["slot"]].add((r["class"], r["block"]))
        assert r["release"] <= r["slot"] < r["deadline"]
    assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    # the first phase follows the weights at every prefix
    weight = {r["class"]: r["weight"] for r in out}
    count = Counter()
    totals = Counter(c for v in slots.values() for c, _ in v)
    for t in range(len(slots)):
        count[next(iter(slots[t]))[0]] += 1
        if any(count[c] == totals[c] for c in totals):
            break
        assert all(abs(count[c] - (t + 1) * weight[c]) < 1 for c in weight)
    again = {r["doc_id"]: r["position"] for r in pfair_mix.mix(df.repartition(7), {"big": 0.25, "s1": 0.5, "s2": 0.2}, rest_weight=0.05, block_docs=16, period=128).collect()}
    assert again == {r["doc_id"]: r["position"] for r in out}


def off_by(placed, weights):
    """The largest deviation from the weights, in blocks, up to the end of the first class; slots, releases and deadlines are checked."""
    slots = {r["slot"]: r for r in placed}
    assert sorted(slots) == list(range(len(slots))) and all(r["release"] <= r["slot"] < r["deadline"] for r in placed)
    left, seen, worst, total = Counter(r["class"] for r in slots.values()), Counter(), 0, sum(weights.values())
    for t in range(len(slots)):
        seen[slots[t]["class"]] += 1
        if seen[slots[t]["class"]] == left[slots[t]["class"]]:
            break
        worst = max(worst, *(abs(seen[c] - (t + 1) * w / total) for c, w in weights.items()))
    return worst


def test_mix_keeps_to_the_weights_asked_for(spark):
    rows = [(i, "big" if i % 2 else f"s{i // 2 % 50}", "t") for i in range(12000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = {"big": 0.5, **{f"s{i}": 0.01 for i in range(50)}}
    out = pfair_mix.mix(df, weights, block_docs=2).collect()
    assert off_by(out, weights) < 1 and {r["weight"] for r in out if r["class"] == "big"} == {0.5}


def test_mix_has_a_class_for_every_source(spark, monkeypatch):
    rows = [(i, f"s{i % 299}" if i % 3 else "big", "t") for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = Counter(s for _, s, _ in rows)
    out = pfair_mix.mix(df, block_docs=1).collect()
    assert {r["class"] for r in out} == set(sizes) and len(sizes) == 300
    assert off_by(out, {c: n**0.7 for c, n in sizes.items()}) < 1
    assert len({r["slot"] for r in out}) == 9000  # blocks of one document, as asked
    monkeypatch.setattr(pfair_mix, "BROADCAST_BLOCKS", 0)  # join by shuffle
    assert {(r["doc_id"], r["position"]) for r in pfair_mix.mix(df, block_docs=1).collect()} == {(r["doc_id"], r["position"]) for r in out}


def test_registered_mix_keeps_to_its_targets(spark, sf):
    out = queries.op6_pfair_mix(spark, f"{sf}/../sf0.01").collect()
    assert off_by(out, {**queries.TARGETS, "(rest)": queries.TARGET_REST}) < 1


def test_a_source_named_like_the_rest_is_a_class(spark):
    df = spark.createDataFrame([(i, ["(rest)", "=", None][i % 3], "t") for i in range(300)], "doc_id long, source string, text string")
    out = pfair_mix.mix(df, block_docs=10).collect()
    assert len({(r["slot"]) for r in out}) == 30 and Counter(r["class"] for r in out) == {"(rest)": 200, "=": 100}
    by = defaultdict(set)
    for r in out:
        by[r["slot"]].add(r["source"])
    assert all(len(v) == 1 for v in by.values())


def test_schedule_follows_the_fluid_when_classes_end():
    rng = random.Random(4)
    for _ in range(30):
        blocks = {f"c{i}": rng.randint(0, 40) for i in range(rng.randint(1, 12))}
        weights = {c: rng.choice([0.0, 1 / 3, 1.0, rng.random() + 1e-3]) for c in blocks}
        out = list(pfair_mix.schedule(blocks, weights))
        assert [r[4] for r in out] == list(range(sum(blocks.values()))) and all(r[2] <= r[4] < r[3] for r in out)
        assert {c: [r[1] for r in out if r[0] == c] for c in blocks} == {c: list(range(n)) for c, n in blocks.items()}


def fluid_edf(blocks, weights):
    """Slots by following the fluid from event to event and taking, slot by slot, the released block that is due first."""
    names = sorted(c for c, n in blocks.items() if n)
    at, served, pieces = Fraction(0), {c: Fraction(0) for c in names}, []
    while live := [c for c in names if served[c] < blocks[c]]:
        rate = {c: Fraction(weights[c]) / sum(Fraction(weights[x]) for x in live) for c in live}
        span = min((blocks[c] - served[c]) / rate[c] for c in live)
        pieces.append((at, rate, dict(served)))
        at += span
        for c in live:
            served[c] += rate[c] * span
    when = lambda c, j: next(t + (j - s[c]) / r[c] for t, r, s in reversed(pieces) if c in r and s[c] <= j)
    following, out = dict.fromkeys(names, 0), []
    for t in range(sum(blocks.values())):
        ready = [(math.ceil(when(c, j + 1)), c, j) for c, j in following.items() if j < blocks[c] and math.floor(when(c, j)) <= t]
        due, c, j = min(ready)
        out.append((c, j, math.floor(when(c, j)), due, t))
        following[c] += 1
    return out


def test_schedule_is_the_fluids_with_the_earliest_deadline_first():
    rng = random.Random(12)
    for _ in range(60):
        blocks = {c: rng.randint(0, 14) for c in "abcdef"[: rng.randint(1, 6)]}
        weights = {c: rng.choice([1.0, 0.5, 2.0, 0.3, 7.0, 0.125]) for c in blocks}
        assert list(pfair_mix.schedule(blocks, weights)) == fluid_edf(blocks, weights)


def test_line_tables_are_as_large_as_their_lines(spark):
    """Many hosts of one boilerplate line each: a list a host, and the same result by broadcast and by a join."""
    df = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("h"), (F.col("id") % 3000).cast("string")).alias("source"), F.concat(F.lit("menu of "), (F.col("id") % 3000).cast("string"), F.lit("\ntext "), F.col("id").cast("string")).alias("text"))
    found = line_dedup.boilerplate(df.select(F.col("source").alias("host"), "text"), 0.3, 3).agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.size("keys")).alias("lists"), F.sum(F.size(F.flatten("keys"))).alias("keys")).first()
    assert tuple(found) == (3000, 3000, 3000, 3000)
    a, b = (line_dedup.digest(df, max_ratio=0.3, broadcast_rows=n) for n in (50_000, 0))
    assert a.where("n_dropped = 1 and n_lines = 2").count() == 12_000 and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    one = df.limit(600).withColumns({"source": F.lit("x"), "text": F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n"), F.lit("\nown "), F.col("doc_id").cast("string"))})
    assert line_dedup.digest(one).where("n_lines = 101 and n_dropped = 100").count() == 600


def test_operators_on_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert not substring_dedup.digest(substring_dedup.remove_repeats(df)).collect() and not quality_rules.clean(df, texts=False).collect()
    assert not near_dedup.classes(df).collect() and not line_dedup.digest(df).collect()


def test_mix_order_and_empty(spark):
    df = spark.createDataFrame([(i, f"s{i % 4}", "t") for i in range(500)] + [(7, None, None), (None, "s1", "x")], "doc_id long, source string, text string")
    out = pfair_mix.in_mix_order(df, block_docs=8)
    assert out.columns == df.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, df.collect()))
    assert not pfair_mix.in_mix_order(df.limit(0)).collect() and not pfair_mix.mix(df.limit(0)).collect()
