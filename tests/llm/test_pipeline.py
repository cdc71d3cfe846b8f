"""The pipeline's stages on a small corpus with planted cases, and as a whole."""

import random

import pytest

import __spark_entry__ as E
import corpus_pipeline

from .data import awkward, doc, edited, prose
from .test_decontaminate import brute as contained
from .test_jaccard_join import brute as joined
from .test_jaccard_join import shingle_set
from .test_line_dedup import brute as deduped
from .test_toxicity import corpus

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    rng = random.Random(30)
    rows, labels = corpus(500, seed=31)
    rows = [r[:5] for r in rows]
    items = [(i, prose(rng, rng.randint(12, 60))) for i in range(20)]
    base = [r[1] for r in rows[:40]]
    line = prose(rng, 20)
    rows += [(1000 + i, rng.choice(base), "en", "s", 1) for i in range(40)]                              # copies
    rows += [(1100 + i, edited(rng, prose(random.Random(i % 5), 150), 1), "en", f"s{i % 3}", 1) for i in range(25)]   # near copies
    rows += [(1200 + i, prose(rng, 30) + "\n" + edited(rng, line, i % 2) + "\n" + prose(rng, 30), None, None, 1) for i in range(20)]
    rows += [(1300 + i, prose(rng, 50) + " " + t + " " + prose(rng, 50), "en", "s", 1) for i, t in items]
    rows += [r[:5] for r in awkward()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    clean = corpus_pipeline.common.stored(stages["toxicity"](spark, docs, sf_dir), "t")
    assert clean.columns == COLUMNS
    kept = {r.doc_id for r in clean.collect()}
    toxic = [i for i, y in labels.items() if y]
    assert sum(i in kept for i in toxic) <= 0.1 * len(toxic)
    assert sum(i not in kept for i, y in labels.items() if not y) <= 0.05 * len(labels)

    lines = corpus_pipeline.common.stored(stages["line dedup"](spark, clean, sf_dir), "t")
    assert lines.columns == COLUMNS
    before = [(r.doc_id, r.text) for r in clean.collect()]
    hashes = {r.text: r.h for r in clean.selectExpr("text", "xxhash64(text) h").collect()}
    want = [(d, new) for (d, new), (_, old) in zip(deduped(before, hashes), before)
            if new is None or new.strip() or new == old]
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in lines.collect() if (r.doc_id, r.text) not in set(before))

    alone = corpus_pipeline.common.stored(stages["n-gram Jaccard join"](spark, lines, sf_dir), "t")
    assert alone.columns == COLUMNS
    given = [(r.doc_id, r.text) for r in lines.collect()]
    groups = joined(given)
    got = [(r.doc_id, r.text) for r in alone.collect()]
    assert sorted(repr(x) for x in got if not shingle_set(x[1])) == sorted(repr(x) for x in given if not shingle_set(x[1]))
    members = {(d, g) for d, _, g, _ in groups}
    assert {d for d, t in got} == {g for _, g in members}

    safe = corpus_pipeline.common.stored(stages["benchmark decontamination"](spark, alone, sf_dir), "t")
    assert safe.columns == COLUMNS
    assert rows_of(safe.select("doc_id", "text")) == sorted((x for x in got if not contained([x], items)), key=repr)
    assert len(got) - safe.count() >= len(items)

    packed = stages["best-fit packing"](spark, safe, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in safe.collect()}
    assert sum(r.n_tokens for r in packed) == sum(len((r.text or "").split()) + 1 for r in safe.collect())


def test_run(spark, sf_dir):
    once, again = (corpus_pipeline.run(spark, sf_dir).collect() for _ in range(2))
    assert once and sorted(map(tuple, once), key=repr) == sorted(map(tuple, again), key=repr)
    assert E.queries()["pipeline"] is corpus_pipeline.run


def test_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_clashing_columns(spark, sf_dir):
    """Other columns, whatever their names, change nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    from pyspark.sql import functions as F
    names = ["th", "cid", "key", "line", "pos", "first", "score", "n", "sig", "shard", "h1", "late", "id", "kept", "n_lines", "cluster"]
    wide = docs.select("*", *[F.lit(1).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        a, b = stage(spark, docs, sf_dir), stage(spark, wide, sf_dir)
        assert a.columns == b.columns == COLUMNS, name
        assert rows_of(a) == rows_of(b), name
