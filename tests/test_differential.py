"""D1, D2 and D12 on written-out cases: text, expected box, gold, expected match."""

import pytest
from pyspark.sql import functions as F

from tracekiln.functions import answers as A
from tracekiln.operators import rewards as R

BS = "\\"
BOX = BS + "boxed"

CASES = [
    (f"so {BOX}{{42}}", "42", "42", True),
    (f"so {BOX} {{42}}", "42", "42.0", True),
    (f"{BOX} {{1}} then {BOX}{{2}}", "2", "2", True),               # the form without a blank goes first
    (f"{BOX}{{1}} then {BOX}{{2}}", "1", "2", False),
    (f"{BOX}{{{BS}frac{{1}}{{2}}}}", f"{BS}frac{{1}}{{2}}", "0.5", True),
    (f"{BOX}{{{BS}frac{{1}}{{2}}}}", f"{BS}frac{{1}}{{2}}", "1/2", True),
    (f"{BOX}{{{BS}text{{Yes}}}}", f"{BS}text{{Yes}}", "yes", True),
    (f"{BOX}{{ 7 }}", "7", "7.000", True),
    (f"{BOX}{{$7$}}", "$7$", "7", True),
    (f"{BOX}{{1 000}}", "1 000", "1000", True),
    (f"{BOX}{{a{{b}}c}}", "a{b}c", "abc", False),
    (f"{BOX}{{unclosed", None, "1", False),
    (f"{BOX}{{}}", "", "1", False),
    ("no box", None, "1", False),
    ("", None, "", False),
    (None, None, "1", False),
    (f"{BOX}{{1}}", "1", None, False),
    (f"{BOX}{{0.0000001}}", "0.0000001", "0", True),
    (f"{BOX}{{1e3}}", "1e3", "1000", True),
    (f"{BOX}{{3/0}}", "3/0", "3", False),
    (f"{BOX}{{{BS}left(1,2{BS}right)}}", f"{BS}left(1,2{BS}right)", "(1,2)", True),
    (f"{BOX}{{-5}}", "-5", "5", False),
    (f"{BOX}{{x + 1}}", "x + 1", "X+1", True),
]


def test_first_box_and_match(spark):
    df = spark.createDataFrame([(i, t, g) for i, (t, _, g, _) in enumerate(CASES)], "i long, t string, g string")
    df = A.add_answers_match(A.add_boxed_first(df, F.col("t"), "p"), F.col("p"), F.col("g"), "ok")
    for r in df.collect():
        assert (r.p, r.ok) == (CASES[r.i][1], CASES[r.i][3]), CASES[r.i]


THINK, END = '<parameter name="think">', "</parameter>"


@pytest.mark.parametrize("text, spoken", [
    (f"{THINK}a\nb{END}c", "c"), (f"a{THINK}b{END}c{THINK}d{END}e", "ace"), (f"{THINK}open", f"{THINK}open"),
    ("<think>x</think>y", "<think>x</think>y"), ("", "")])
def test_think_blocks(spark, text, spoken):
    assert spark.createDataFrame([(text,)], "t string").select(A.strip_think(F.col("t"))).first()[0] == spoken


def test_judged_reward_reads_after_the_think_block(spark):
    said = f"{THINK}{BOX}{{9}}{END} so {BOX}{{42}}" + " " * 400
    df = spark.createDataFrame([(1, said, "42", "")], "problem_id long, response string, gold string, gold_solution string")
    none = spark.createDataFrame([], "key string, reasoning_class string")
    r = R.reward_judged(df, none).first()
    assert (r.pred, r.correct, r.reward) == ("42", True, 0.6)
    gold = "a proof of some length " * 20
    df = spark.createDataFrame([(1, said, "42", gold)], "problem_id long, response string, gold string, gold_solution string")
    assert R.reward_judged(df, none).first().reward == 0.1
