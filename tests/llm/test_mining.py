"""Hard negatives, phrases and packing against brute force on small tables, odd rows included."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm import bin_completion, collocations, hard_negatives


def test_strassen_is_exact():
    rng = np.random.default_rng(0)
    for m, d, n in ((1, 1, 1), (3, 0, 5), (33, 17, 40), (64, 64, 64), (70, 33, 129), (0, 4, 7), (100, 65, 31)):
        a, b = rng.integers(-300, 300, (m, d)), rng.integers(-300, 300, (n, d))
        for leaf in (1, 2, 16):
            assert (hard_negatives.strassen(a, b, leaf) == a @ b.T).all()
    a, b = rng.integers(-(1 << 27), 1 << 27, (40, 48)), rng.integers(-(1 << 27), 1 << 27, (40, 48))
    want = a.astype(object) @ b.astype(object).T
    assert (hard_negatives.strassen(a, b, 2) == want).all() and (hard_negatives.products(a * 64, b) == want * 64).all()


def brute_negatives(rows, anchors, scale=256):
    codes = [(i, y, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v, y in rows if None not in (i, y, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, y, a in {c for c in codes if anchors(c[0])}:
        scored = {(-sum(p * q for p, q in zip(a, b)), j, z == y) for j, z, b in codes if j != i and len(b) == len(a)}
        for s, j, same in sorted(x for x in scored if x[2])[:5]:
            window = sorted((t, k) for t, k, alike in scored if not alike and -80 * s <= -100 * t <= -100 * s)[:5]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(window)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in base[i % 6 if i % 4 else 0]], rng.randint(0, 3)) for i in range(700)]
    rows += [(1000 + i, list(base[0]), i % 2) for i in range(60)]  # equal vectors: ties
    rows += [(7, rows[7][1], rows[7][2]), (50, rows[50][1], rows[50][2]), (50, rows[51][1], 3), (1003, list(base[1]), 1)]  # repeated ids
    rows += [(2000, None, 1), (2050, [1.0, None], 1), (2100, [float("nan")] * 20, 1), (2150, [float("inf")] * 20, 1), (2200, list(base[0]), None), (None, list(base[0]), 1)]
    rows += [(3000, [1.0, 2.0], 1), (3001, [1.0, 2.5], 1), (3002, [1.0, 2.25], 2), (3050, [], 1), (3051, [], 1), (3052, [], 2), (3100, [0.0] * 20, 1), (3150, [-3.0] * 20, 1)]
    rows += [(3200, [1e7, 2.0, 3.0], 1), (3201, [1e6, 2.0, 3.0], 1), (3202, [0.9e6, 2.0, 3.0], 2)]  # products that leave no room in 64 bits
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit(1), "tag": F.lit("x"), "slot": F.lit(None), "scores": F.lit(2)})
    want = brute_negatives(rows, lambda i: i % 50 == 0)
    assert len(want) > 100
    for block, group, tile in ((16_384, 1 << 18, 4096), (5, 100, 64)):
        monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", block)
        monkeypatch.setattr(hard_negatives, "CANDIDATE_GROUP", group)
        monkeypatch.setattr(hard_negatives, "_COLUMNS", tile)
        got = hard_negatives.mine(df.repartition(3), F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, got.collect())) == want
    assert not hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).collect()


PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [WORD.findall(p) for p in PIECE.split(low)]


def brute_phrases(rows, min_count, depth, best, percent):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for w in pieces_of(text):
            totals[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    counts["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        common = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        scored = []
        for p, a in common.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in common.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(scored)[:best])]
    return sorted(out)


def test_index_counts_phrases_both_ways():
    rng = random.Random(1)
    for _ in range(40):
        ids = np.array([0, *(rng.choice([0, 1, 1, 2, 3, 4]) for _ in range(rng.randint(1, 80))), 0])
        top = int(ids.max())
        if not top:
            continue
        index = collocations.Index.of(ids, 4)
        text = ids.tolist()
        want = [Counter(tuple(text[i : i + k]) for i in range(len(text) - k + 1) if 0 not in text[i : i + k]) for k in (1, 2, 3, 4)]
        for turns in ((True, True, True), (False, False, False), (True, False, True), (False, True, False)):
            found = index.words()
            for k, left in zip(range(4), (*turns, None)):
                assert {tuple(w): n for w, n in zip(found.words.tolist(), found.count.tolist()) if n} == want[k]
                # both directions hold the same phrase: what follows and precedes agrees with the text
                found = index.extend(found, left) if left is not None else found


def test_long_texts_are_cut_without_losing_phrases():
    rng = random.Random(2)
    for size in (8, 20, 57):
        for _ in range(60):
            text = "".join(rng.choice(["a ", "b ", "cc ", "ddddddddddddddd ", ". ", "\t", "  ", "\n", "e"]) for _ in range(rng.randint(0, 80)))
            want, got = Counter(), Counter()
            for w in pieces_of(text):
                want.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
            parts = list(collocations._segments(text, size, 3))
            for part, weight in parts:
                for w in pieces_of(part.decode()):
                    for k in (1, 2, 3):
                        for i in range(len(w) - k + 1):
                            got[tuple(w[i : i + k])] += weight
            assert {p: n for p, n in got.items() if n} == want, text


def test_collocations_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["new", "New", "york", "the", "of", "été", "漢字", "x\x1cy", "a\x00b", "\xa0", "𝒳", "#"]) if rng.random() < 0.7 else f"w{rng.randint(0, 300)}"
    glue = lambda: rng.choice([" ", " ", " ", " ", "\t", "  ", ", ", ". ", "\n", "!?", "\x0b"])
    rows = [(rng.choice(["en", "en", "en", "de", None, ""]), "".join(word() + glue() for _ in range(rng.randint(0, 120)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), ("fr", " \t .,"), ("de", "ja wohl " * 3000), ("de", "machine learning model. " * 40), ("xx", "one pair of words")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("x"), "shard": F.lit(1), "n": F.lit(2)})
    for percent, size, depth, best in ((50, 0, 3, 2000), (80, 700, 3, 15), (50, 3000, 4, 40)):
        want = brute_phrases(rows, 10, depth, best, percent)
        got = collocations.mine(df.repartition(5), max_words=depth, best=best, absorb_percent=percent, shard_bytes=size)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 40
    assert not collocations.mine(df.limit(0)).collect()


@pytest.fixture(scope="module")
def words_file():
    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer(words_file):
    t = Tokenizer.from_file(words_file)
    t.encode_special_tokens = True
    return t


def test_parts_of_words_have_the_ids_of_whole_texts(words_file, tokenizer, monkeypatch):
    with open(words_file, encoding="utf-8") as file:
        tokens = bin_completion.Tokens(file.read(), kept=50)  # forgets again and again
    rng = random.Random(0)
    chars = list("abIHJTWYhjtwyéÉß.,'’s\"!-_ \t\n\xa0̱̌́̇İ×÷Σς漢😀019²½\x85\x1c\x0b<|>") + ["'s", "'re", "n't", "<|endoftext|>", "don't ", "HE'LL "]
    monkeypatch.setattr(bin_completion, "SLICE_BYTES", 40)
    for _ in range(150):
        texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(1, 6))]
        got = defaultdict(list)
        for held in bin_completion._slices([x.encode() for x in texts]):
            ids, ends = tokens.encode([t for _, t, _ in held])
            for (row, _, _), own in zip(held, np.split(ids, ends[:-1])):
                got[row] += own.tolist()
        for i, text in enumerate(texts):
            assert got[i] == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def check_packing(counts, packing):
    cap, used = len(counts) - 1, Counter()
    for filling, n in packing:
        assert n > 0 and sum(x * k for x, k in filling) <= cap
        for x, k in filling:
            used[x] += k * n
    assert used == Counter({i: n for i, n in enumerate(counts) if n})
    return sum(n for _, n in packing)


def fewest(pieces, cap):
    """By trying everything: pieces into bins, longest first, equal rooms once."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= pieces[i]}:
            rest = list(rooms)
            rest.remove(r)
            go(i + 1, (*rest, r - pieces[i]))
        go(i + 1, (*rooms, cap - pieces[i]))

    go(0, ())
    return best[0]


def test_bin_completion_finds_the_fewest_sequences():
    rng, better = random.Random(3), 0
    for case in range(150):
        cap = rng.choice([20, 60, 100])
        pieces = [rng.randint(1 if case % 3 else cap // 4, cap if case % 2 else cap // 2 + 1) for _ in range(rng.randint(0, 10))]
        counts = [pieces.count(i) for i in range(cap + 1)]
        greedy, found = check_packing(counts, bin_completion.best_fit(counts := np.array(counts))), check_packing(counts, bin_completion.complete(counts))
        assert bin_completion.lower_bound(counts) <= found == fewest(pieces, cap)
        better += found < greedy
    # best fit takes 4 sequences here, completion 3
    hard = np.bincount([44, 6, 24, 24, 23, 22, 21, 26, 50, 26, 24, 8][:11], minlength=101)
    assert check_packing(hard, bin_completion.complete(hard)) == fewest(np.repeat(np.arange(101), hard).tolist(), 100)
    assert better


def test_bin_completion_on_many_pieces():
    rng = np.random.default_rng(1)
    for draw in (lambda: rng.integers(1, 2049, 200_000), lambda: rng.integers(600, 1100, 50_000), lambda: np.minimum(2048, rng.geometric(0.003, 100_000)), lambda: np.full(10_001, 2), lambda: rng.choice([1025, 700, 323, 5], 5_000)):
        counts = np.bincount(draw(), minlength=2049)
        greedy, found = check_packing(counts, bin_completion.best_fit(counts)), check_packing(counts, bin_completion.complete(counts, steps=3000))
        assert bin_completion.lower_bound(counts) <= found <= greedy


def test_fillings_do_not_dominate_each_other():
    counts = np.bincount([30, 30, 20, 10, 10, 7, 3], minlength=61)
    assert bin_completion.fillings(counts, 30) == [((30, 1),)]
    assert all(sum(x * k for x, k in f) <= 47 for f in bin_completion.fillings(counts, 47))
    assert bin_completion.fillings(counts, 47)[0] == ((30, 1), (10, 1), (7, 1))
    assert bin_completion._dominates(((30, 1),), ((20, 1), (10, 1))) and not bin_completion._dominates(((20, 1), (10, 1)), ((30, 1),))


def test_packing_against_the_library(spark, tokenizer, words_file, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["The", "quick", "brown", "don't", "été", "漢字", "x9", "."]) for _ in range(rng.choice([0, 1, 3, 20, 60, 300])))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1002, "one two"), (1002, "three"), (None, "no id"), (1003, "long text " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "n": F.lit(1), "_part": F.lit(2), "piece": F.lit(None)})
    monkeypatch.setattr(bin_completion, "SLICE_BYTES", 5000)
    got = bin_completion.pack(df.repartition(3), words_file, capacity=64, with_ids=True).collect()
    want = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            own = ids[start : start + 64]
            want[i, piece, start, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)), tuple(own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.token_ids)) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 64
    counts = np.bincount([r.length for r in got], minlength=65)
    assert bin_completion.lower_bound(counts) <= len(sequences) <= sum(n for _, n in bin_completion.best_fit(counts))
    assert not bin_completion.pack(df.limit(0), words_file).collect()
