"""Hand-written golden cases (FIXTURES.md section 4) for the answer functions."""

import pytest
from pyspark.sql import functions as F

from tracekiln.functions import answers as A

BS = "\\"


def one(spark, col_fn, *vals, schema=None):
    n = len(vals)
    schema = schema or ", ".join(f"c{i} string" for i in range(n))
    df = spark.createDataFrame([tuple(vals)], schema)
    return df.select(col_fn(*[F.col(f"c{i}") for i in range(n)]).alias("r")).first()["r"]


@pytest.mark.parametrize("text,first,last", [
    (BS + "boxed{" + BS + "frac{a+b}{c}} x " + BS + "boxed{7}", BS + "frac{a+b}{c}", "7"),
    (BS + "boxed{1", None, None),
    (BS + "boxed {9}", "9", None),
    ("no box here", None, None),
    (BS + "boxed{ 12 }", "12", "12"),
    (BS + "boxed{$5$}", "$5$", "5"),
])
def test_boxed_first_and_last(spark, text, first, last):
    assert one(spark, A.extract_boxed_first, text) == first
    assert one(spark, A.extract_boxed_last, text) == last
    df = spark.createDataFrame([(text,)], "t string")
    staged = A.add_boxed_first(df, F.col("t"), "p").first()["p"]
    assert staged == first


@pytest.mark.parametrize("pred,gt,expected", [
    ("42.0", "42", True), (" 42 ", "42", True), ("$42$", "42", True), (BS + "text{42}", "42", True),
    ("0.5", "1/2", True), ("1/4", "0.25", True), (BS + "frac{1}{2}", "0.5", True),
    ("0.333", "1/3", False), ("1/0", "1", False), (None, "1", False), ("x+1", "x + 1", True),
    ("7", "8", False), ("0.0000001", "0", True), ("0", "0.0000001", False),
])
def test_answers_match(spark, pred, gt, expected):
    assert one(spark, A.answers_match, pred, gt) is expected
    df = spark.createDataFrame([(pred, gt)], "p string, g string")
    assert A.add_answers_match(df, F.col("p"), F.col("g"), "ok").first()["ok"] is expected


def test_extract_numbers(spark):
    t = "12abc x5 3.50 " + BS + "frac{1}{2} 7."
    got = one(spark, A.extract_numbers, t)
    assert sorted(got) == sorted([1.0, 3.5, 0.5, 2.0, 7.0])


def test_boxed_int_scan(spark):
    assert one(spark, A.boxed_int_scan, "so " + BS + "boxed{1,234} and " + BS + "boxed{56}") == 56
    assert one(spark, A.boxed_int_scan, BS + "boxed{123456} The final answer is 77") == 77
    assert one(spark, A.boxed_int_scan, "nothing") is None


def test_answer_cascade(spark):
    r = one(spark, A.answer_cascade, "We get that the answer is 12.\nSo")
    assert (r["value"], r["source"]) == (12, "text_pattern")
    r = one(spark, A.answer_cascade, "x " + BS + "boxed{abc} " + BS + "boxed{3.9}")
    assert (r["value"], r["source"]) == (3, "boxed")
    r = one(spark, A.answer_cascade, "line one\nvalue 123 then 45")
    assert (r["value"], r["source"]) == (45, "last_int")


def test_eval_extract_and_normalize(spark):
    assert one(spark, A.eval_extract, BS + "boxed{1,000}") == 1000
    assert one(spark, A.eval_extract, BS + "boxed{-3}") is None
    assert one(spark, A.normalize_answer, " $ " + BS + "left( 3.00 " + BS + "right) $ ") == "(3.00)"
    assert one(spark, A.normalize_answer, "4.000") == "4"


def test_token_entropy_nested_matches_long_form(spark):
    import math
    rows = [([{"a": math.log(0.25), "b": math.log(0.75)}, {}, {"x": 0.0}],)]
    df = spark.createDataFrame(rows, "lp array<map<string,double>>")
    got = df.select(A.token_entropy(F.col("lp")).alias("h")).first()["h"]
    expected = ((-(0.25 * math.log2(0.25) + 0.75 * math.log2(0.75))) + 0.0) / 2
    assert abs(got - expected) < 1e-12
    empty = spark.createDataFrame([([],)], "lp array<map<string,double>>")
    assert empty.select(A.token_entropy(F.col("lp")).alias("h")).first()["h"] == float("inf")


def test_resolve_answer_variants(spark):
    df = spark.createDataFrame([("abc", "x " + BS + "boxed{12} y " + BS + "boxed{zz}")], "e string, s string")
    any_valid = df.select(A.resolve_answer(["e"], F.col("s")).alias("r")).first()["r"]
    last_only = df.select(A.resolve_answer(["e"], F.col("s"), any_valid_boxed=False).alias("r")).first()["r"]
    assert (any_valid["value"], any_valid["source"]) == (12, "boxed_in_solution")
    assert last_only["value"] is None
