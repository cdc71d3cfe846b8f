"""The registered queries on the generated tables."""

import zlib

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tracekiln.llm import queries
from tracekiln.oracle.compare import compare

from .test_packing import check


def test_registered():
    found = E.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in found) == 1
    assert set(queries.oracle_sql()) <= set(found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    got = compare(queries.queries()[name](spark, SF_SMALL), queries.oracle_sql()[name], SF_SMALL)
    assert got["match"] and got["types_match"], got


def test_toxicity_query(spark):
    rows = queries.op1_toxicity(spark, SF_SMALL).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} == ids and len(rows) == len(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_query(spark):
    rows = queries.op12_quality(spark, SF_SMALL).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} == ids and len(rows) == len(ids)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_jaccard_query(spark):
    from .test_jaccard_join import brute
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op7_jaccard_join(spark, SF_SMALL).collect())) == brute(docs) or \
        sorted(map(tuple, queries.op7_jaccard_join(spark, SF_SMALL).collect())) == sorted(brute(docs))


def test_warc_query(spark):
    import base64
    import hashlib
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    first = {}
    for i, p in sorted(pages):
        first.setdefault(p, i)
    want = sorted((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit",
                   None if first[p] == i else first[p]) for i, p in pages)
    assert sorted(map(tuple, queries.op6_warc(spark, SF_SMALL).collect())) == want


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op3_chat_format(spark, SF_SMALL).collect()}
    n = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id").distinct().count()
    assert len(got) == n + 1 and got[-7].n_turns == 2 and got[-7].loss_chars == len(queries.PLANTED)


def test_packing_query(spark):
    from tracekiln.llm import common, packing
    rows = packing.with_lengths(common.table(spark, SF_SMALL, "documents")).collect()
    check(spark, [(r.doc_id, r.n_tokens, r.source, r.cluster, 0, 0) for r in rows], 2048, 4096)


def test_token_query(spark):
    rows = sorted(map(tuple, queries.op10_token_store(spark, SF_SMALL).select("doc_id", "start", "n_tokens").collect()))
    at = 0
    for _, start, n in rows:
        assert start == at
        at += n
