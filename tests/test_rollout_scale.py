"""Rollouts at scale: what is eight times the documents is neither written, shuffled nor scored twice."""

import random

from pyspark.sql import functions as F

from tracekiln import catalog
from tracekiln.functions import answers as A
from tracekiln.operators import rewards as R
from tracekiln.plans import jobs
from tracekiln.sources import fixtures as FX
from tracekiln.streaming import votes as ST

from .conftest import SF_SMALL


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attempts_are_not_written(spark):
    assert not [f for f in FX.attempts(spark, SF_SMALL).inputFiles() if "/attempts-" in f]


def test_cascade_runs_each_pattern_once(spark):
    rows = [(r"so \boxed{ 1,234 } and \boxed{x}", 1234, "boxed"), ("The Answer is 12. equals 7", 12, "text_pattern"),
            ("answer: 123456 it equals 45", 45, "text_pattern"), ("x = 9 ", 9, "text_pattern"), ("this is 31 .", 31, "text_pattern"),
            ("a 4\nb 77 c\nd", 77, "last_int"), ("12 here\n\na\nb\nc\nd\ne", None, None), ("none", None, None), ("", None, None), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, value long, source string")
    got = df.select("i", "t", A.answer_cascade(F.col("t")).alias("a"))
    assert optimized(got).count("regexp_extract_all") <= 7          # boxes, five phrases, lines
    assert [(r.a.value, r.a.source) for r in sorted(got.collect())] == [r[1:] for r in rows]


def test_number_scan_equals_the_reference_pattern(spark):
    rng = random.Random(5)
    texts = [("".join(rng.choice("a.1 23Z{}-é") for _ in range(rng.randrange(30))),) for _ in range(3000)]
    found = [F.regexp_extract_all("t", F.lit(p), 1) for p in (A.PLAIN_NUMBER_RE, A.PLAIN_NUMBER_SCAN)]
    assert spark.createDataFrame(texts, "t string").where(found[0] != found[1]).count() == 0


def test_scored_rollouts_are_scored_once(spark):
    attempts = spark.createDataFrame([(p, a, "5", "x" * 350 + r" \boxed{%d}" % (a % 3 + 4), 0.5) for p in range(4) for a in range(8)],
                                     "problem_id long, attempt_id long, gold string, response string, entropy double")
    problems = spark.createDataFrame([(p, "step 3 gives 4 " * 9) for p in range(4)], "problem_id long, gold_solution string")
    s = jobs.score_rollouts(attempts, problems)
    assert "regexp" not in optimized(s)
    assert sorted((r.correct, r.reward) for r in s.where("problem_id = 0").collect())[-1] == (True, 1.0) and s.count() == 32


def test_step_words_are_sought_in_long_wrong_answers_only(spark):
    long = "therefore " + "x" * 250
    df = spark.createDataFrame([(1, long + r" \boxed{5}", "5"), (2, long + r" \boxed{6}", "5"), (3, long, "5"), (4, r"thus \boxed{6}", "5")],
                               "i int, response string, gold string")
    assert [(r.i, r._steps) for r in sorted(R.response_facts(df).select("i", "_steps").collect())] == [(1, None), (2, True), (3, None), (4, None)]


def test_entropy_needs_one_shuffle(spark):
    p = catalog.queries()["d22_token_entropy"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert p.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_tail_scan_of_near_chunks_only(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(["word ", "é\n", "}", r"\boxed{%d}" % rng.randrange(200), "final answer is 7 "] + ["long text without "] * 20)
                         for _ in range(rng.randrange(120)))) for i in range(60)] + [(60, ""), (61, None), (62, r"\boxed{5}" + "y" * 5000)]
    df = spark.createDataFrame(texts, "i long, t string")
    whole = df.select("i", F.posexplode(F.regexp_extract_all("t", F.lit("(?s).{1,16}"), 0)).alias("pos", "chunk"))
    near = ST.chunks_near_braces(df, ["i"], "t")
    want = sorted(map(tuple, ST.tail_scan(whole, ["i"], "pos", "chunk").collect()))
    assert sorted(map(tuple, ST.tail_scan(near, ["i"], "pos", "chunk").collect())) == want and len(want) > 20
    assert near.where("i = 62").count() == 1 and near.exceptAll(whole).count() == 0
