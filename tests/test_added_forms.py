"""Forms that SURVEY names and that had no query: hand-made cases."""

from pyspark.sql import functions as F

from tracekiln.operators import pairs as P
from tracekiln.operators import profile as PR
from tracekiln.operators import votes as V
from tracekiln.streaming import votes as ST


def test_missing_attempt_is_an_error(spark):
    a = spark.createDataFrame([(1, 0, "\\boxed{5}", "5"), (1, 1, "\\boxed{6}", "5"), (2, 0, "\\boxed{5}", "5")],
                              "problem_id bigint, attempt_id bigint, response string, gold string")
    p = spark.createDataFrame([(1, "q", ""), (2, "q", "")], "problem_id bigint, problem string, gold_solution string")
    s = spark.createDataFrame([], "problem_id bigint, attempt_id bigint, score double")
    for f in (P.pairs_two_way, P.pairs_by_score):
        rows = {r.problem_id: r for r in f(a, p, s).collect()}
        assert rows[1].outcome == "pair" and rows[2].outcome == "error" and rows[2].chosen is None
        r = P.pair_stats(f(a, p, s), errors=True).first()
        assert (r.pairs, r.skipped, r.errors, r.problems) == (1, 0, 1, 2)


def test_entropy_weights_differ(spark):
    a = spark.createDataFrame([(1, 0, 5, 0.0), (1, 1, 6, 1e-9), (1, 2, 6, 1e-9)], "problem_id bigint, attempt_id bigint, answer bigint, entropy double")
    assert V.entropy_vote(a).first().score == 2e9
    assert abs(V.entropy_vote(a, variant="sum").first().score - 1e9) < 1


def test_schedules(spark):
    got = spark.createDataFrame([("simple",), ("medium",), ("hard",), ("odd",), (None,)], "c string").select(ST.complexity_budget("c")).collect()
    assert [r[0] for r in got] == [60, 180, 480, 180, 180]
    ev = spark.createDataFrame([(i, i, 1.0, '{"k": 1}', f"2024-01-01 00:00:0{i}") for i in (1, 2, 3)],
                               "event_id bigint, user_id bigint, value double, props string, t string").withColumn("ts", F.to_timestamp_ntz("t"))
    rows = ST.even_deadlines(ev).orderBy("idx").collect()
    assert [r.cutoff_s for r in rows] == [900 + 5500, 900 + 11000, 17400]


def test_top_answers_and_turns(spark):
    d = spark.createDataFrame([(x,) for x in (3, 3, 2, 2, 7, 100000, None)], "a bigint")
    assert [tuple(r) for r in PR.top_answers(d, "a", 2).collect()] == [(2, 2), (3, 2)]
    m = spark.createDataFrame([(1,)] * 2 + [(2,)] * 4, "conv_id bigint")
    r = PR.turn_quantiles(m).first()
    assert (r.q50, r.min, r.max, r.mean, r.le_2, r.le_4) == (3.0, 2, 4, 3.0, 1, 2)


def test_queries_call_the_operators():
    import inspect

    import bench
    from tracekiln.plans import q_answers, q_scoring
    assert "success_flag(" in inspect.getsource(q_answers.d25_bound_answer)
    assert "early_stop_point(a)" in inspect.getsource(q_scoring.g8_early_stop_four)
    assert '"BENCH_WARM", "3"' in inspect.getsource(bench.main)
