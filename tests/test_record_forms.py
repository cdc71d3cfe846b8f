"""Packing by range blocks, markdown by records, replies and messages by VARIANT, tail scan, dependency rounds."""

import glob
import random

from pyspark.sql import functions as F

from tracekiln.functions import answers as A
from tracekiln.operators import curate as C
from tracekiln.operators import evaluate as EV
from tracekiln.sources import readers as RD
from tracekiln.streaming import votes as ST


def test_packing_of_sparse_ids(spark):
    rng = random.Random(1)
    ids = [rng.randint(-2**63, 2**63 - 1) for _ in range(3000)] + [5] * 4 + [-2**63, 2**63 - 1]
    rows = [(i, rng.randint(0, 50)) for i in ids]
    df = spark.createDataFrame(rows, "id bigint, n bigint")
    got = C.pack_sequences(df, "id", "n", 100, 3, shard=F.pmod("id", F.lit(3)), block_rows=200)
    at, want = {}, set()
    for i, n in sorted(rows):
        s = i % 3
        want.add((i, n, s, at.get(s, 0), at.get(s, 0) // 100))
        at[s] = at.get(s, 0) + n
    assert {tuple(r) for r in got.collect()} == want
    sizes = got.select(F.spark_partition_id().alias("p")).count()
    assert sizes == len(rows)
    named = C.pack_sequences(df.select(F.md5(F.col("id").cast("string")).alias("id"), "n"), "id", "n", 100, 2, block_rows=500)
    assert named.count() == len(rows) and named.agg(F.max("offset") > 0).first()[0]
    assert C.pack_sequences(df.limit(0), "id", "n", 100, 3).collect() == []


def test_large_markdown_file_is_read_by_many_tasks(spark, tmp_path):
    body = "x" * 2000
    (tmp_path / "all.md").write_text("".join(f"## Problem {k}\n\n**Subject:** S{k % 3} | **MOHS:** {k}M | **Source:** here\n\n### Original\n{body}\n\n### Adapted\nB\n\n"
                                             f"**Answer:** `{k}`\n\n---\n" for k in range(1, 1500)))
    (tmp_path / "odd.md").write_text("# Title\n2024 is no section\n### Problem 7 is none either\n## Problem 2000\r\nno fields\r\n## Problems\nstill 2000\n## Problem 2001")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        rows = RD.parse_problem_markdown(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 8
        got = {r.number: r for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted(got) == [*range(1, 1500), 2000, 2001]
    assert all(got[k].answer == k and got[k].mohs == k and got[k].original == body and got[k].subject == f"S{k % 3}" for k in range(1, 1500))
    assert got[2000].answer is None


def test_reply_fields(spark):
    given = ['{"answer_correct": true, "reasoning_valid": false, "score": 0.5}', 'so ```json\n{"score": 1}\n``` ok', '{"score": "high", "answer_correct": null}',
             "{broken", "{a} {b}", "", None, "[1]", '{"score": 0.3, "more": {"score": 9}}', '{"answer_correct": "true"}']
    df = spark.createDataFrame([(t,) for t in given], "t string")
    got = [tuple(r) for r in df.select(A.parse_json_reply("t", A.JUDGE_FIELDS).alias("r")).select("r.*").collect()]
    none = (False, False, False, 0.0)
    assert got == [(True, True, False, 0.5), (True, False, False, 1.0), (True, False, False, 0.0), none, none, none, none, none,
                   (True, False, False, 0.3), (True, True, False, 0.0)]


def test_messages_column_round_trip(spark, tmp_path):
    rows = [(1, 0.5, [("user", 'a "b"\n'), ("assistant", "é 漢")]), (2, 0.25, []), (3, 0.5, None)]
    df = spark.createDataFrame(rows, "id int, accuracy double, messages array<struct<role string, content string>>")
    RD.write_curated(df, f"{tmp_path}/c.parquet")
    back = RD.messages_of(RD.read_any(spark, f"{tmp_path}/c.parquet"))
    assert sorted((r.id, r.accuracy, None if r.messages is None else [tuple(m) for m in r.messages]) for r in back.collect()) == rows


def test_tail_scan_equals_its_definition(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        text = "".join(rng.choice(["\\boxed{", "}", "{", "12", "7,1", " ", "xyz" * 30, "final answer is 9", "ab"]) for _ in range(rng.randint(0, 60)))
        rows += [(k, i, text[8 * i:8 * i + 8]) for i in range(-(-len(text) // 8))]
    df = spark.createDataFrame(rows, "k int, pos int, chunk string")
    of = {}
    for k, i, c in rows:
        of.setdefault(k, []).append(c)
    tails = [(k, i, "".join(cs[max(0, i - 31):i + 1])) for k, cs in of.items() for i in range(len(cs)) if "}" in cs[i]]
    scanned = spark.createDataFrame(tails, "k int, pos int, tail string").select("k", "pos", A.boxed_int_scan("tail").alias("a")).where("a is not null")
    want = {}
    for r in sorted(scanned.collect()):
        want.setdefault(r.k, (r.k, r.pos, r.a))
    got = {tuple(r) for r in ST.tail_scan(df, ["k"], "pos", "chunk").collect()}
    assert got == set(want.values()) and len(got) > 10


def test_solved_lemmas_are_written_once(spark):
    n = 25
    lemmas = spark.createDataFrame([(1, i) for i in range(n)] + [(2, 0), (2, 1)], "problem_id bigint, lemma_id bigint")
    edges = spark.createDataFrame([(1, i, i - 1) for i in range(1, n)] + [(2, 0, 1), (2, 1, 0)], "problem_id bigint, lemma_id bigint, dep bigint")
    folder = spark.conf.get("spark.checkpoint.dir").replace("file://", "")
    before = set(glob.glob(f"{folder}/solved-*"))
    got = {(r.problem_id, r.lemma_id): (r.level, r.cyclic) for r in EV.lemma_levels(lemmas, edges).collect()}
    assert got == {(1, i): (i, False) for i in range(n)} | {(2, 0): (None, True), (2, 1): (None, True)}
    written = [spark.read.parquet(p).count() for p in set(glob.glob(f"{folder}/solved-*")) - before]
    assert written == [n]


def test_operators_have_queries():
    import inspect

    from tracekiln.plans import q_answers, q_curation
    assert all(x in inspect.getsource(q_curation.b9_b10_b11_b12_length_and_gold) for x in ("drop_overlong(", "broken_gold_rate("))
    assert "token_entropy(" in inspect.getsource(q_answers.d22_token_entropy) and "python_stats(" in inspect.getsource(q_answers.d23_python_stats)
    assert all(x in inspect.getsource(q_answers.d24_nested_messages) for x in ("get_problem(", "get_solution("))
    assert "seeded_shuffle(" in inspect.getsource(q_curation.c5_seeded_shuffle)
