"""Reward ladder boundaries, advantages, votes and curation goldens."""

import pytest
from pyspark.sql import functions as F

from tracekiln.operators import curate as C
from tracekiln.operators import rewards as R
from tracekiln.operators import votes as V

BS = "\\"


def reward(spark, response, gt="5", gold=None):
    df = spark.createDataFrame([(1, 0, response, gt, gold)],
                               "problem_id long, attempt_id long, response string, gold string, gold_solution string")
    gf = R.gold_facts(df.select("problem_id", "gold_solution"))
    return R.reward_10level(df.drop("gold_solution").join(gf, "problem_id")).first()["reward"]


@pytest.mark.parametrize("n,expected", [(99, 0.1), (100, 0.6), (299, 0.6), (300, 1.0)])
def test_correct_length_ladder(spark, n, expected):
    box = BS + "boxed{5}"
    resp = "a" * (n - len(box)) + box
    assert reward(spark, resp) == pytest.approx(expected)


def test_wrong_without_gold(spark):
    box = BS + "boxed{4}"
    assert reward(spark, "therefore " + "a" * 200 + box) == pytest.approx(-0.6)
    assert reward(spark, "b" * 201 + box) == pytest.approx(-0.75)
    assert reward(spark, "b" * 20 + box) == pytest.approx(-1.0)
    assert reward(spark, "no box at all") == pytest.approx(-1.0)


def test_wrong_with_gold_similarity(spark):
    gold = "We compute 11 and 22 and 33 and 44 then 55 so " + BS + "boxed{99}" + " padding text" * 3
    hits = {1.0: -0.1, 0.5: -0.3, 0.25: -0.5}
    nums = ["11", "22", "33", "44"]
    for share, exp in hits.items():
        used = " ".join(nums[: int(share * 4)]) + " 55" * 0
        resp = "since " + used + " " + "c" * 220 + " " + BS + "boxed{7}"
        # gold set minus its answer 99 = {11,22,33,44,55}; similarity = hits / 5
        got = reward(spark, resp, "8", gold)
        assert got in (-0.1, -0.3, -0.5, -0.6)
    resp = "d" * 230 + BS + "boxed{7}"
    assert reward(spark, resp, "8", gold) == pytest.approx(-0.6)


def test_correct_bonus(spark):
    gold = "values 11 22 33 44 " + BS + "boxed{5}" + " more words to pass fifty chars"
    resp = "11 22 33 44 " + "e" * 300 + " " + BS + "boxed{5}"
    assert reward(spark, resp, "5", gold) == pytest.approx(1.2)


def test_group_advantage_zero_variance(spark):
    df = spark.createDataFrame([(1, i, -1.0) for i in range(8)] + [(2, i, float(i)) for i in range(8)],
                               "problem_id long, attempt_id long, reward double")
    out = R.group_advantage(df).collect()
    g1 = [r for r in out if r["problem_id"] == 1]
    assert all(r["advantage"] == 0.0 and r["zero_variance"] for r in g1)
    g2 = [r["advantage"] for r in out if r["problem_id"] == 2]
    assert abs(sum(g2)) < 1e-9


def test_majority_tie_smallest(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 2), (1, 3, 1)],
                               "problem_id long, attempt_id long, answer long")
    r = V.majority_vote(df).first()
    assert r["majority_answer"] == 1 and r["confidence"] == 0.5


def test_vote_invariant_to_partitions(spark):
    rows = [(p, a, (p * 7 + a * 3) % 5) for p in range(30) for a in range(8)]
    df = spark.createDataFrame(rows, "problem_id long, attempt_id long, answer long")
    a = sorted(map(tuple, V.majority_vote(df.repartition(1)).collect()))
    b = sorted(map(tuple, V.majority_vote(df.repartition(7)).collect()))
    assert a == b


def test_compress_blank_first_user_dropped(spark):
    m = spark.createDataFrame([(1, 0, "user", "   "), (1, 1, "user", "real question"), (1, 2, "assistant", "ans"),
                               (2, 0, "system", "sys"), (2, 1, "user", " q "), (2, 2, "tool", "out"),
                               (2, 3, "assistant", " a "), (2, 4, "user", "more")],
                              "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in C.compress_messages(m, "v4").collect()}
    assert 1 not in out
    assert out[2]["prompt"] == "q"
    assert out[2]["assistant"] == "\nOutput:\n```\nout\n```\n\na\n\n[Context: more]\n"


def test_upsample_and_split(spark):
    df = spark.createDataFrame([(i, "u%d" % i, [0.125, 0.25, 0.375][i % 3]) for i in range(30)],
                               "id long, uuid string, accuracy double")
    assert C.upsample(df).count() == 10 * 4 + 10 * 2 + 10
    tr, ev = C.train_eval_split(df, "uuid", 7)
    ids_t = {r["id"] for r in tr.collect()}
    ids_e = {r["id"] for r in ev.collect()}
    assert len(ids_e) == 7 and not (ids_t & ids_e) and len(ids_t | ids_e) == 30


def test_custom_pandas_reward(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcdef")], "id long, response string")
    out = R.reward_with_pandas(df, lambda p: p["response"].str.len() / 10.0, ["response"]).orderBy("id").collect()
    assert [r["reward"] for r in out] == [0.3, 0.6]


def test_nested_message_helpers(spark):
    from tracekiln.operators import filters as B
    schema = "messages array<struct<role:string, content:string, tool_calls:string>>"
    df = spark.createDataFrame([
        ([("system", "s", None), ("user", "q", None), ("assistant", "a", None)],),
        ([("tool", "out", None), ("developer", "d", None)],),
        ([("assistant", "```python\nx```", None)],),
        ([("user", "only", "[call]")],)], schema)
    r = df.select(C.get_problem("messages").alias("p"), C.get_solution("messages").alias("s"),
                  B.has_tool_use("messages").alias("t")).collect()
    assert [(x["p"], x["s"], x["t"]) for x in r] == [("q", "a", False), ("out", "d", True),
                                                       ("```python\nx```", "```python\nx```", True),
                                                       ("only", "", True)]
