import math
import random

import numpy as np
import pytest

from tracekiln.llm import mtree


def brute(rows, k=10, every=100):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, tuple(math.floor(x * 1024) for x in v)] = None
    out = []
    for q, x in good:
        if q % every == 0:
            best = sorted({(-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(y) == len(x)})[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, score int, v int")
    return sorted(map(tuple, mtree.top_k(df, **how).collect()))


def test_matches_brute_force(spark):
    rng = np.random.default_rng(16)
    centers = rng.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in (centers[i % 6] + 0.2 * rng.normal(size=12)) / 4]) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [rows[5], rows[5]]               # equal vectors, repeated rows
    rows += [(3000, None), (3100, [None] * 12), (3200, [math.nan] * 12), (3300, [math.inf] + [0.0] * 11), (None, rows[1][1]),
             (3400, []), (3500, [1.0, 2.0]), (3501, [-1.0, 0.5]), (-100, rows[3][1]), (3600, [0.0] * 12)]
    assert run(spark, rows) == brute(rows)


def test_small_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 3.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, rows[:1]) == []


@pytest.mark.parametrize("spread", [1, 40])
def test_tree_is_exact_and_prunes(spread):
    rng = np.random.default_rng(17)
    centers = rng.integers(-400, 400, (40, 8)) * spread
    data = np.unique(centers[rng.integers(0, 40, 6000)] + rng.integers(-20, 20, (6000, 8)), axis=0)
    tree = mtree.MTree(data)
    queries = data[rng.integers(0, len(data), 20)]
    scores, rows, asked = tree.search(queries, 5, np.full(20, -np.inf))
    exact = queries @ data.T
    for q in range(20):
        best = sorted((-int(s), i) for i, s in enumerate(exact[q]))[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores[q], rows[q])] == best
    alone = tree.search(queries[:1], 5, np.full(1, -np.inf))[2]
    assert alone < len(data) / 2                                                            # most vectors are never looked at


def test_products_beyond_doubles():
    a = np.array([[2 ** 40, 1]]); b = np.array([[2 ** 14, 1], [2 ** 14, 2]])
    assert mtree._dots(a, b).tolist() == [[2 ** 54 + 1, 2 ** 54 + 2]]
    random.seed(0)
