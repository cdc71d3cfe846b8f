import random
import re
from collections import Counter

import numpy as np
import pytest

from tracekiln.llm import collocations

from .data import awkward, docs


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
        yield re.findall("[^ \t]+", piece)


def counted(rows):
    f = Counter()
    for lang, text in rows:
        for w in pieces(text):
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    f["und" if lang is None else lang, " ".join(w[i:i + n]), n] += 1
    return f


def brute(rows, least, share=80, first=2000):
    f = counted(rows)
    n = Counter()
    for (lang, _, k), c in f.items():
        n[lang] += c if k == 1 else 0
    get = {(lang, p): c for (lang, p, _), c in f.items()}
    found = {(lang, p): a for (lang, p, k), a in f.items() if k > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in found.items():
        w = p.split(" ")
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                s = lang, " ".join(w[i:i + k])
                longer[s] = max(longer[s], a)
    out = {}
    for (lang, p), a in found.items():
        if longer[lang, p] and 100 * longer[lang, p] >= share * a:
            continue
        w = p.split(" ")
        cuts = []
        for k in range(1, len(w)):
            left, right = get[lang, " ".join(w[:k])], get[lang, " ".join(w[k:])]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, p.encode(), left, right))
    return {(lang, rank, p.decode(), -a, left, right, n[lang], -score)
            for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1)}


def corpus(seed, rows, words=12):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "ÀB", "x-y", "漢字", "a'b", "😀", "naïve", "state", "art", "\x1cq", "ID"][:words]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\x0b", ";\r"]
    out = []
    for _ in range(rows):
        text = "".join((rng.choice(vocabulary) if rng.random() < .7 else "state of the art" if rng.random() < .5 else f"w{rng.randint(0, 300)}")
                       + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "de", None, "und", ""]), text))
    return out


@pytest.mark.parametrize("seed, least", [(1, 3), (2, 7), (3, 30)])
def test_matches_brute_force(spark, seed, least):
    rows = corpus(seed, 250) + [("en", None), (None, ""), ("xx", " . \n"), ("yy", "one"), ("yy", "same words " * 40)]
    df = spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, phrase string, n int")
    got = {tuple(r) for r in collocations.collocations(df, least=least).collect()}
    assert got == brute(rows, least) and len(got) > 10


def test_parts_of_long_texts_and_small_summaries(spark, monkeypatch):
    """Texts cut into parts, many summaries, many hash partitions."""
    monkeypatch.setattr(collocations, "BUFFER", 300)
    monkeypatch.setattr(collocations, "HELD", 500)
    monkeypatch.setattr(collocations, "HELD_WORDS", 20)
    monkeypatch.setattr(collocations, "HELD_PHRASES", 20)
    monkeypatch.setattr(collocations, "PARTITION_MASS", 1000)
    rows = corpus(4, 60) + [("en", " ".join(t for _, t in corpus(5, 150))), ("en", "no end " * 500), ("en", "x" * 3000)]
    assert set(collocated_here(rows, 5)) == brute(rows, 5)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in collocations.collocations(df, least=5).collect()} == brute(rows, 5)


def collocated_here(rows, least):
    """The buffers' n-grams counted without Spark: each once, whatever the cuts."""
    every = np.full(1, (1 << 64) - 1, np.uint64)
    texts = [("und" if lang is None else lang, (t or "").encode().translate(collocations.CLEAN)) for lang, t in rows]
    f = Counter()
    for data, starts, langs, stops in collocations._buffers(iter(texts)):
        for n, keys, _, a, b in collocations._grams(data, starts, langs, stops, every):
            f.update([" ".join(x for x in data[i:j].decode().split(" ") if x) for i, j in zip(a, b)])
    want = Counter()
    for (_, p, k), c in counted(rows).items():
        if k > 1:
            want[p] += c
    assert f == want
    return brute(rows, least)


@pytest.mark.parametrize("seed", range(6))
def test_merged_summaries_keep_every_frequent_key(seed):
    rng = np.random.default_rng(seed)
    stream = (rng.zipf(1.3, 20_000) % 5000).astype(np.uint32)
    least = int(rng.choice([20, 50, 300]))
    capacity = len(stream) // least + 1
    total, error = (np.zeros(0, np.uint32), np.zeros(0, np.int64)), 0
    for part in np.array_split(stream, int(rng.integers(1, 60))):
        keys, counts = collocations.unpacked(collocations.packed(*np.unique(part, return_counts=True)))
        *total, cut = collocations.merged([tuple(total), (keys, counts)], capacity)
        error += cut
    assert error < least and len(total[0]) <= capacity
    true = dict(zip(*map(np.ndarray.tolist, np.unique(stream, return_counts=True))))
    held = dict(zip(total[0].tolist(), total[1].tolist()))
    assert all(held.get(k, 0) <= n <= held.get(k, 0) + error for k, n in true.items())
    assert all(k in held for k, n in true.items() if n >= least)


def test_large_counters_are_packed():
    keys, counts = np.arange(5, dtype=np.uint32), np.array([1, 254, 255, 256, 1 << 40])
    got = collocations.unpacked(collocations.packed(keys, counts))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts.tolist()


def test_exact_scores(spark):
    """Ties after flooring go to the shortest first part; a phrase inside a longer one with 80 percent goes."""
    rows = [("en", "a b c. " * 8 + "a b. " * 2 + "b c. " * 3)]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = {tuple(r) for r in collocations.collocations(df, least=2).collect()}
    assert got == brute(rows, 2) and {r[2] for r in got} == {"a b c", "b c"}


def test_awkward_documents(spark):
    rows = awkward()
    got = {tuple(r) for r in collocations.collocations(docs(spark, rows), least=3, first=50).collect()}
    assert got == brute([(r[2], r[1]) for r in rows], 3, first=50)
    assert collocations.collocations(docs(spark, [])).collect() == []
