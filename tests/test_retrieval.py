"""Exact top-k with block pairs ruled out by centres and radii."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracekiln.operators import retrieval as K


def vectors(seed, clusters, each, dims=24, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = np.repeat(centres, each, axis=0) + rng.normal(scale=spread / np.sqrt(dims) * 5, size=(clusters * each, dims))
    return x * rng.uniform(0.1, 9, (len(x), 1))


def tables(spark, x, q, groups=2):
    c = spark.createDataFrame([(i, v.tolist(), f"g{i % groups}") for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label string")
    unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    d = spark.createDataFrame([(i, v.tolist(), f"g{i % groups}") for i, v in enumerate(unit)], "query_id bigint, qvec array<double>, query_group string")
    return d, c


def brute(x, q, k, groups=None):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    s = unit(q) @ unit(x).T
    out = {}
    for i in range(len(q)):
        ids = [j for j in range(len(x)) if groups is None or j % groups == i % groups]
        out[i] = sorted(ids, key=lambda j: (-round(s[i, j], 9), j))[:k]
    return out


def ids_of(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


@pytest.mark.parametrize("by", [None, "label"])
def test_clustered_vectors(spark, by):
    x, q = vectors(1, 12, 60, spread=0.02), vectors(1, 12, 10, spread=0.02) * 1.7
    d, c = tables(spark, x, q)
    got = ids_of(K.topk_similar(d, c, k=5, partition=by, query_rows=15, corpus_rows=40))
    assert got == brute(x, q, 5, 2 if by else None)
    qb, cb, keys = K._sides(d, c, "embedding", "vec_id", by, 15, 40)
    assert qb.count() >= 2 and cb.count() >= 12
    pairs = K.block_pairs(qb, cb, keys, 5)
    assert pairs.where("joined").count() < pairs.count() / 2


def test_scattered_zero_and_equal_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[5] = x[17] = x[250] = 0
    x[30:60] = x[30]
    q = np.concatenate([rng.normal(size=(20, 6)), x[30:31], np.zeros((1, 6)), -x[30:31]])
    d, c = tables(spark, x, q)
    d = d.withColumn("qvec", F.when(F.col("query_id") == 21, F.array(*[F.lit(0.0)] * 6)).otherwise(F.col("qvec")))
    assert ids_of(K.topk_similar(d, c, k=7, query_rows=4, corpus_rows=20)) == brute(x, q, 7)
    assert ids_of(K.topk_similar(d, c, k=1000, query_rows=4, corpus_rows=20)) == brute(x, q, 1000)


def test_one_cell_holds_most_vectors(spark):
    x = np.concatenate([vectors(5, 1, 900, spread=0.01), vectors(6, 10, 10)])
    q = vectors(5, 1, 30, spread=0.01)
    d, c = tables(spark, x, q)
    qb, cb, keys = K._sides(d, c, "embedding", "vec_id", None, 10, 50)
    assert cb.agg(F.max("n")).first()[0] <= 110 and qb.agg(F.max("n")).first()[0] <= 30
    assert ids_of(K.topk_similar(d, c, k=4, query_rows=10, corpus_rows=50)) == brute(x, q, 4)


def test_nulls_and_nothing(spark):
    d, c = tables(spark, vectors(7, 2, 5), vectors(8, 1, 3))
    none = c.withColumn("embedding", F.lit(None).cast("array<double>"))
    assert K.topk_similar(d, none, k=3).collect() == []
    assert K.topk_similar(d.limit(0), c, k=3).collect() == []
    mixed = c.unionByName(none.withColumn("vec_id", F.col("vec_id") + 100))
    assert ids_of(K.topk_similar(d, mixed, k=3)) == ids_of(K.topk_similar(d, c, k=3))
