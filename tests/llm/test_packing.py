import random
from collections import Counter, defaultdict

from tracekiln.llm import packing


def naive(pieces, capacity):
    """Best fit by looking at every bin."""
    bins, placed = [], []
    for n, s, c in pieces:
        fits = [(b["free"], i) for i, b in enumerate(bins) if b["free"] >= n and b["free"] > 0 and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        if fits:
            b = min(fits)[1]
        else:
            bins.append({"free": capacity, "s": set(), "c": set()})
            b = len(bins) - 1
        placed.append((b, capacity - bins[b]["free"]))
        bins[b]["free"] -= n
        bins[b]["s"].add(s)
        bins[b]["c"].add(c)
    return placed


def test_best_fit_equals_naive():
    rng = random.Random(5)
    for _ in range(30):
        pieces = sorted(((rng.randint(1, 64), rng.choice([None, *range(6)]), rng.choice([None, *range(30)])) for _ in range(300)), key=lambda x: -x[0])
        assert packing.best_fit(pieces, 64) == naive(pieces, 64)


def check(spark, rows, capacity, shard):
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, source string, cluster string, bin_id int, shard int")
    got = packing.pack(df, capacity, shard).collect()
    total = Counter()
    bins = defaultdict(list)
    for r in got:
        total[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
    want = Counter()
    for d, n, *_ in rows:
        want[d] += max(0, n or 0)
    assert total == want
    by = defaultdict(list)
    for d, n, s, c, *_ in rows:
        by[d].append((s, c))
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: (r.bin_offset, r.n_tokens)):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= capacity
        for k in (0, 1):
            seen = [by[r.doc_id][0][k] for r in members if len(by[r.doc_id]) == 1]
            seen = [x for x in seen if x is not None]
            assert len(seen) == len(set(seen))
    return got


def test_bins_hold(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 300), "hot" if i % 3 else f"s{rng.randint(0, 20)}", f"c{rng.randint(0, 300)}", 0, 0) for i in range(1500)]
    got = check(spark, rows, 128, 400)
    again = check(spark, rows[::-1], 128, 400)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_awkward_rows(spark):
    check(spark, [(1, None, None, None, 0, 0), (2, 0, "a", None, 0, 0), (3, -5, "a", "c", 0, 0), (None, 7, "a", "c", 0, 0), (4, 100_000, "a", "c", 0, 0),
                  (5, 10, "a", "c", 0, 0), (5, 10, "a", "c", 0, 0), (6, 64, "a", "d", 0, 0)], 64, 100)
    check(spark, [], 64, 100)


def test_lengths(spark):
    from .data import awkward, docs
    got = packing.with_lengths(docs(spark, awkward())).collect()
    want = Counter((r[0], len((r[1] or "").split()) + 1) for r in awkward())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
