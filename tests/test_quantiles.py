"""Exact quantiles by pivots, and the schema report: skewed values and keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracekiln.operators import profile as PR


def linear(values, p):
    x = sorted(values)
    at = (len(x) - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    return round(x[lo] + (x[hi] - x[lo]) * (at - lo), 6)


def given(seed):
    rng = random.Random(seed)
    out = {"outlier": [*range(3000), 3e12], "one": [5.0], "same": [7.0] * 500, "two": [1.0, 9.0], "tiny": [x * 1e-9 for x in range(2000)] + [-1e9],
           "hot": [2.0] * 4000 + [rng.random() for _ in range(800)], None: [rng.gauss(0, 1) for _ in range(700)],
           "steps": [rng.randint(0, 6) * 1.0 for _ in range(999)], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200) for _ in range(1200)]}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_quantiles_of_skewed_values(spark, seed):
    data = given(seed)
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("outlier", None), ("none", None)], "k string, v double")
    got = {r.k: r for r in PR.quantile_linear(df, "v", [0.0, 0.1, 0.5, 0.9, 0.99, 1.0], ["k"]).collect()}
    index = {r.k: r for r in PR.quantile_index(df, "v", [(1, 10), (1, 2), (99, 100)], ["k"]).collect()}
    assert set(got) == set(index) == set(data)
    for k, vs in data.items():
        assert got[k].n == index[k].n == len(vs)
        for p in (0.0, 0.1, 0.5, 0.9, 0.99, 1.0):
            assert got[k][f"q{int(p * 100)}"] == pytest.approx(linear(vs, p), rel=1e-9), (k, p)
        for num, den in ((1, 10), (1, 2), (99, 100)):
            assert index[k][f"p{num * 100 // den}"] == sorted(vs)[len(vs) * num // den], (k, num)
    whole = PR.quantile_index(df, "v", [(1, 2)]).first()
    every = sorted(v for vs in data.values() for v in vs)
    assert (whole.n, whole.p50) == (len(every), every[len(every) // 2])


def test_intervals_hold_few_values(spark):
    """One value 10^9 times the others: only a small share of the distinct values is ordered."""
    df = spark.createDataFrame([(float(i),) for i in range(20_000)] + [(2e13,)], "v double")
    kept = PR._counts_at(df, "v", [], lambda n: [F.floor(n / 2)])
    assert 0 < kept.count() <= 3 * 20_000 / PR.PIVOTS


def test_schema_report(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1, "y": 2}, [1]), (1, None, {"y": 2, "x": 1}, []), (None, "a" * 100_000, None, [1]), (2, "a", {}, None)],
                               "n int, `odd name` string, m map<string,int>, l array<int>")
    got = {r.column: (r.type, r.non_null, r.nulls, r.distinct) for r in PR.schema_report(df).collect()}
    assert got == {"n": ("int", 3, 1, 2), "odd name": ("string", 3, 1, 2), "m": ("map<string,int>", 3, 1, 2), "l": ("array<int>", 3, 1, 2)}
    plan = PR.schema_report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    empty = PR.schema_report(df.limit(0)).collect()
    assert len(empty) == 4 and all(r[2:] == (0, 0, 0) for r in empty)


def test_values_of_texts_are_not_worked_out_again_at_each_pivot(spark):
    """The filter on a value's interval stays above the aggregate that counts the values."""
    from tracekiln.functions.text import word_count
    texts = spark.createDataFrame([(" ".join("x" * (i % 40 + 1)),) for i in range(200)], "t string")
    words = texts.select(word_count(F.col("t")).alias("words"))
    got = PR.quantile_linear(words, "words", [0.5, 0.9])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter " in line and "split(" in line and "subquery" in line]
    assert [tuple(r) for r in got.collect()] == [(200, 20.5, 36.1)]
