import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tracekiln.llm import jaccard_join
from tracekiln.llm.components import components

from .data import awkward, doc, docs, edited, prose


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute(rows):
    """(id, class, group, links) of each row by comparing all sets."""
    key = lambda d: (d is None, d or 0)
    sets = defaultdict(list)
    for d, t in rows:
        if shingle_set(t):
            sets[shingle_set(t)].append(d)
    every = list(sets)
    by = defaultdict(set)
    for k, s in enumerate(every):
        for x in s:
            by[x].add(k)
    links, root = defaultdict(int), list(range(len(every)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(every):
        for b in {k for x in s for k in by[x] if k > a}:
            shared = len(s & every[b])
            if 5 * shared >= 4 * (len(s) + len(every[b]) - shared):
                links[a] += len(sets[every[b]])
                links[b] += len(sets[s])
                root[find(a)] = find(b)
    group = {}
    for k, s in enumerate(every):
        group[find(k)] = min([*sets[s], *([group[find(k)]] if find(k) in group else [])], key=key)
    out = []
    number = {s: k for k, s in enumerate(every)}
    for d, t in rows:
        s = shingle_set(t)
        out.append((d, d, d, 0) if not s else (d, min(sets[s], key=key), group[find(number[s])], len(sets[s]) - 1 + links[number[s]]))
    return sorted(out, key=repr)


def family(rng):
    rows, i = [], 0
    for n in (6, 12, 30, 80, 200):
        for _ in range(6):
            base = prose(rng, n)
            for _ in range(rng.randint(1, 8)):
                rows.append((i, edited(rng, base, rng.choice([0, 0, 1, 1, 2, max(1, n // 40), n // 20]))))
                i += 1
    passage = prose(rng, 40)
    rows += [(1000 + k, prose(rng, 60) + " " + passage + " " + prose(rng, 60)) for k in range(60)]      # a passage that many share
    return rows


def got(spark, rows, **how):
    df = jaccard_join.similarity_join(docs(spark, [doc(d, t) for d, t in rows]), **how)
    return sorted(map(tuple, df.select("doc_id", "class_id", "group_id", "n_links").collect()), key=repr)


def test_matches_brute_force(spark):
    rows = family(random.Random(18)) + [r[:2] for r in awkward()]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("small, depth, block", [(4, 3, 2000), (30, 5, 200_000)])
def test_large_groups(spark, monkeypatch, small, depth, block):
    """A group of near copies larger than any bucket, in several blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "DEPTH", depth)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    rng = random.Random(19)
    base = prose(rng, 100)
    rows = [(i, edited(rng, base, rng.randint(0, 3))) for i in range(150)] + [(500 + i, prose(rng, 50)) for i in range(40)]
    assert got(spark, rows) == brute(rows)


def candidates(spark, rows):
    df = docs(spark, [doc(d, t) for d, t in rows])
    known = jaccard_join.describe(df, "doc_id", "text").where("cid is not null").selectExpr("cid", "sig", "doc_id").dropDuplicates(["cid"])
    edges = jaccard_join.candidate_edges(known.select("cid", "sig"), 0.8, 0.999)
    return known, [r["count"] for r in components(edges).groupBy("root").count().collect()]


@pytest.mark.parametrize("block", [16, 1024])
def test_shared_passage_links_nothing(spark, monkeypatch, block):
    """Documents that share a passage of half their length meet in large buckets and stay apart there; near copies among them are found."""
    monkeypatch.setattr(jaccard_join, "SMALL", 10)
    monkeypatch.setattr(jaccard_join, "SIGNATURE_BLOCK", block)
    rng = random.Random(23)
    passage = prose(rng, 60)
    rows = [(i, passage + " " + prose(rng, 60)) for i in range(160)]
    rows += [(500 + i, edited(rng, rows[3][1], 1)) for i in range(30)]
    assert got(spark, rows) == brute(rows)
    _, sizes = candidates(spark, rows)
    assert max(sizes) <= 35


def test_large_bucket_connects_what_brute_force_connects(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SIGNATURE_BLOCK", 8)
    rng = np.random.default_rng(24)
    bases = rng.integers(0, 1 << 32, (6, 64), dtype=np.uint64).astype("<u4")
    sigs = []
    for n in range(90):
        s = bases[n % 6].copy()
        s[rng.choice(64, rng.integers(0, 30), replace=False)] = rng.integers(0, 1 << 32)
        sigs.append(s)
    rows = [(bytes([n]), s.tobytes()) for n, s in enumerate(sigs)]
    df = spark.createDataFrame([(bytearray(c), bytearray(s)) for c, s in rows], "cid binary, sig binary")
    whole = df.selectExpr("bigint(1) as key", "bigint(90) as n", "cid")

    def groups(edges):
        return {bytes(r.node): bytes(r.root) for r in components(edges).collect()}

    want = groups(jaccard_join._similar_in_buckets(whole.select("key", "cid"), df, 0.6))
    assert groups(jaccard_join._similar_in_large(whole, df, 0.6)) == want and len(set(want.values())) > 1


def test_depths_are_queries_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 10)
    joins, stored = {}, jaccard_join.common.stored

    def counting(df, label):
        joins[label] = max(joins.get(label, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return stored(df, label)

    monkeypatch.setattr(jaccard_join.common, "stored", counting)
    rng = random.Random(8)
    base = prose(rng, 60)
    candidates(spark, [(k, edited(rng, base, 2)) for k in range(30)])
    assert joins["candidate-edges"] == 0                        # a union of tables written before
    assert "depth-edges" in joins


def test_one_of_each_group(spark):
    rows = [doc(d, t) for d, t in family(random.Random(20))] + awkward()
    df = docs(spark, rows)
    kept = jaccard_join.one_of_each_group(df).collect()
    want = brute([r[:2] for r in rows])
    groups = {g for (d, c, g, n), r in zip(want, want)}
    texts = [(r.doc_id, r.text) for r in kept]
    with_words = [t for t in texts if shingle_set(t[1])]
    assert len(with_words) == len(set(with_words))
    wordless = [r[:2] for r in rows if not shingle_set(r[1])]
    assert sorted(map(repr, (t for t in texts if not shingle_set(t[1])))) == sorted(map(repr, wordless))
    assert {d for d, _ in texts} == groups
    assert len(kept) == len(with_words) + len(wordless)
    sets = [shingle_set(t) for _, t in with_words]                # no two that stay are similar
    assert not any(len(x & y) * 5 >= len(x | y) * 4 for i, x in enumerate(sets) for y in sets[:i])
    assert kept[0].__fields__ == df.columns


def test_nothing(spark):
    assert got(spark, []) == [] and jaccard_join.one_of_each_group(docs(spark, [])).collect() == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 1, 1, 0), (2, 2, 2, 0)]


def test_runs_reach_the_recall():
    for depth in range(1, 6):
        runs = jaccard_join.runs_for(0.8, depth, 0.999)
        assert 1 - (1 - jaccard_join.chance(0.8, depth)) ** runs >= 0.999
    assert jaccard_join.chance(0.8, 1) == pytest.approx(0.75 * 0.8 + 0.25 * 0.96)


def test_components(spark):
    rng = random.Random(21)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(40)] + [(200, i) for i in range(201, 260)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    df = spark.createDataFrame([*edges, (7, 7), (None, 3)], "a bigint, b bigint")
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.root for r in components(df).collect()} == {x: find(x) for x in linked}
    assert components(df.limit(0)).collect() == []
