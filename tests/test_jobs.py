"""User-level jobs compose and run; streaming equals its batch twin."""

from pyspark.sql import functions as F

from tracekiln.plans import jobs
from tracekiln.sources import fixtures as FX
from tracekiln.sources.tables import read_table
from tracekiln.streaming import votes as ST

from .conftest import SF_SMALL


def test_jobs_run(spark):
    a, p, s = FX.attempts(spark, SF_SMALL), FX.problems(spark, SF_SMALL), FX.judge_scores(spark, SF_SMALL)
    pairs, stats = jobs.mine_pairs(a, p, s, "two_way")
    st = stats.first()
    assert st["pairs"] == pairs.count() and st["pairs"] + st["skipped"] == st["problems"]
    ev = jobs.vote_and_evaluate(a)
    assert ev["accuracy"].first()["n"] == p.count()
    prof = jobs.profile_corpus(read_table(spark, SF_SMALL, "documents"), "text", "source")
    assert prof["quality"].first()["n"] > 0


def test_stream_equals_batch(spark):
    tables = jobs.stream_votes(spark, SF_SMALL, 4)
    dec = tables["early_stop"] \
        .select("question_id", "answer", "decided_attempt")
    batch = ST.early_stop_batch(read_table(spark, SF_SMALL, "events"), 4) \
        .select("question_id", "answer", "decided_attempt")
    assert sorted(map(tuple, dec.collect())) == sorted(map(tuple, batch.collect()))
    votes = tables["running_vote"].select("question_id", "answer", "votes")
    ev = ST.attempt_events(read_table(spark, SF_SMALL, "events")).where(F.col("answer").isNotNull())
    b = ev.groupBy("question_id", "answer").agg(F.count("*").alias("votes"))
    assert sorted(map(tuple, votes.collect())) == sorted(map(tuple, b.collect()))


def order(spark, lemmas, edges):
    from tracekiln.operators import evaluate as EV
    lem = spark.createDataFrame(lemmas, "problem_id bigint, lemma_id bigint")
    edg = spark.createDataFrame(edges, "problem_id bigint, lemma_id bigint, dep bigint")
    rows = EV.dependency_order(lem, edg).collect()
    return {p: [r.lemma_id for r in sorted(rows, key=lambda r: r.position) if r.problem_id == p] for p in {r.problem_id for r in rows}}, \
        {r.problem_id for r in rows if r.cyclic}


def test_dependency_order_by_hand(spark):
    lemmas = [(p, i) for p in range(1, 7) for i in range(5)]
    edges = [(1, 0, 4), (1, 1, 4),                  # 4 first frees 0 and 1
             (2, 0, 3), (2, 1, 2),                  # 2 leaves the queue before 3, so 1 enters before 0
             (3, 4, 0), (3, 3, 4), (3, 2, 3), (3, 1, 2),    # a chain
             (4, 1, 2), (4, 2, 1),                  # a cycle: all by id
             (5, 2, 99), (5, 2, 1), (5, 2, 1),      # unknown and repeated dependencies
             (6, 0, 1), (6, 0, 4)]                  # waits for the later of two
    got, cyclic = order(spark, lemmas, edges)
    assert got == {1: [2, 3, 4, 0, 1], 2: [2, 3, 4, 1, 0], 3: [0, 4, 3, 2, 1], 4: [0, 1, 2, 3, 4], 5: [0, 1, 3, 4, 2], 6: [1, 2, 3, 4, 0]}
    assert cyclic == {4}


def test_long_chain_is_not_cut(spark):
    got, cyclic = order(spark, [(1, i) for i in range(12)], [(1, i, i + 1) for i in range(11)])
    assert got == {1: list(range(11, -1, -1))} and not cyclic
