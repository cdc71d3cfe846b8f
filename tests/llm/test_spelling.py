import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tracekiln.llm import spelling

from .data import awkward, docs


def edit_one(a, b):
    """Whether exactly one code point inserted, deleted or replaced turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    x, y = sorted((a, b), key=len)
    k = next((i for i in range(len(x)) if x[i] != y[i]), len(x))
    return x[k:] == y[k + 1:] or (len(x) == len(y) and x[k + 1:] == y[k + 1:])


def brute(counts, ratio=10):
    """word -> (form, root, n, n_near, form_n) by comparing all pairs."""
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if edit_one(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= ratio * n else None, n, len(near))
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, counts[form] if form else None))
    return rows


def grouped(spark, counts, **how):
    df = spark.createDataFrame([(1, w, n, "x") for w, n in counts.items()], "key int, word string, n int, form string")
    return {tuple(r) for r in spelling.group_variants(df, **how).collect()}


def variants(rng, word, alphabet, edits):
    for _ in range(edits):
        k = rng.randrange(len(word))
        kind = rng.randrange(3)
        word = word[:k] + (rng.choice(alphabet) if kind else "") + word[k + (kind != 1):]
    return word


@pytest.mark.parametrize("alphabet, entries", [("ab", 4), ("ab", 1000), ("abcde", 20), ("aeinrst", 200), ("éxß", 1)])
def test_matches_brute_force(spark, alphabet, entries):
    rng = random.Random(alphabet + str(entries))
    bases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(7, 12))) for _ in range(40)]
    counts = {}
    for _ in range(700):
        w = variants(rng, rng.choice(bases), alphabet, rng.randint(0, 3))
        if len(w) >= 7:
            counts[w] = rng.choice([1, 2, 3, 20, 30, 30, 400, 5000])
    assert grouped(spark, counts, entries=entries) == brute(counts)


def test_long_words(spark):
    """Around the lengths at which windows are rounded, and far beyond."""
    rng = random.Random(5)
    counts = {}
    for size in (60, 62, 63, 64, 65, 126, 127, 128, 129, 255, 256, 1000, 30_000):
        base = "".join(rng.choice("abc") for _ in range(size))
        for _ in range(14 if size < 30_000 else 3):
            counts[variants(rng, base, "abc", rng.randint(0, 2))] = rng.randint(1, 50)
    counts["a" * 127] = counts["a" * 128] = counts["a" * 63] = counts["a" * 64] = counts["a" * 65] = 3
    assert grouped(spark, counts) == brute(counts)


def test_chain_and_ties(spark):
    counts = {"abcdefg": 1, "abcdefh": 10, "abcdeeh": 100, "abcddeh": 1000, "abccdeh": 10_000, "bbccdeh": 100_000, "bbccddh": 1_000_000,
              "bbccdda": 10_000_000, "zzzzzzza": 5, "zzzzzzzb": 50, "zzzzzzzc": 50}
    got = grouped(spark, counts)
    assert got == brute(counts)
    assert {r[0]: r[2] for r in got}["abcdefg"] == "bbccdda"
    assert {r[0]: r[1] for r in got}["zzzzzzza"] == "zzzzzzzb"


def test_one_large_list(spark):
    """Thousands of words that agree but for two neighbouring places."""
    letters = [chr(c) for c in range(0xC0, 0x100)]
    counts = {f"thing{a}{b}less": 2 + (i * j) % 7 for i, a in enumerate(letters[:40]) for j, b in enumerate(letters[:40])}
    got = grouped(spark, counts)
    assert len(got) == 1600 and all(r[4] == 78 for r in got)


def test_decomposition_keeps_a_gram():
    """Whatever the dictionary, every edit leaves a gram of a word of seven code points."""
    rng = np.random.default_rng(1)
    points = rng.integers(97, 100, (500, 7)).astype(np.uint64)
    grams = {q: np.unique(spelling._codes(points, q)) for q in (2, 3)}
    for known in (grams, {2: grams[2][::2], 3: np.zeros(0, np.uint64)}, {2: grams[2], 3: grams[3][::3]}):
        empty = spelling._merge_keys(points[:1] * 0 + 7, {2: np.zeros(0, np.uint64), 3: np.zeros(0, np.uint64)})
        assert next(empty)[1].shape == (1, 15)
        for _, keys in spelling._merge_keys(points, known):
            _, n = np.unique(keys, return_counts=True)
            assert n.max() < 500


def count_brute(rows):
    found = Counter()
    for d, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                found[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
                run = ""
    return {(w, n) for w, n in found.items() if len(w) >= 7 and n >= 2}


def test_word_counts(spark):
    rng = random.Random(2)
    words = ["Straße", "ÀÉÎõüabc", "international", "ZürichĀbern", "x×÷yabcde", "naïveté", "don't", "ABCDEFGHIJ", "İstanbul", "😀emoticon"]
    rows = [(i, rng.choice(" \n\t-").join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(120)]
    rows += [(r[0], r[1]) for r in awkward()] + [(5, None), (6, ""), (7, "abcdefgh " * 200_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, n int")
    assert {tuple(r) for r in spelling.count_words(df).collect()} == count_brute(rows)


def test_nothing(spark):
    assert grouped(spark, {}) == set()
    assert grouped(spark, {"short": 3, "another": 2}) == {("another", None, "another", 2, 0, None)}
    df = spark.createDataFrame([(None, 3), ("another", 2)], "word string, n bigint")
    assert spelling.group_variants(df).count() == 1
    assert spelling.count_words(docs(spark, [])).collect() == []
