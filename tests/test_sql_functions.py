"""The SQL functions give what the Column functions give, row by row, and plan no Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracekiln.functions import answers as A
from tracekiln.functions import sql as Q
from tracekiln.sources import readers as RD

PIECES = ["\\boxed{", "\\boxed {", "}", "{", "\\frac{1}{2}", "\\frac{3}{0}", "\\text{", "\\left", "\\right", "$", "12", "1,234", "0012", "99999", "100000", "3.50",
          ".0", "5.000", "-7", "1/2", "1/0", "6/4", " ", "\n", "\t", "x", "Final answer is ", "FINAL  ANSWER is 42", "**Lemma 1**: - ", "**lemma 22** a",
          "- ", "1e3", "nan", "²", "é", "10000000000000000000000000000000000000000000", "'", '"', "\\", "a12", "12b", "\\boxed{7}", "\\boxed{ 1,024 }", "\\boxed {a{b}c}", "\\boxed{$x$}"]


def texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(n)] + [None, "", " "]


@pytest.fixture(scope="module")
def rows(spark):
    Q.register(spark)
    rng = random.Random(9)
    a = texts(1)
    simple = ["1/2", "0.5", "\\frac{1}{2}", "\\frac{2}{4}", "3", "3.0", "$3$", "three", " Three", "0", "1e-7", "\\text{ab}", "ab", "1/0", None, ""]
    pairs = [(rng.choice(simple), rng.choice(simple)) for _ in range(300)] + list(zip(a, texts(2)))
    return spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "id int, p string, g string").repartition(3).cache()


@pytest.mark.parametrize("name, column", [("boxed_first", A.extract_boxed_first), ("boxed_last", A.extract_boxed_last), ("boxed_int", A.boxed_int_scan),
                                          ("normalize_answer", A.normalize_answer), ("to_number", A.to_number), ("last_int", A.last_int_in_output)])
def test_scalar(spark, rows, name, column):
    got = spark.sql(f"SELECT id, p, trace_{name}(p) AS s FROM {{rows}}", rows=rows).withColumn("c", column(F.col("p")))
    assert [tuple(r) for r in got.where("not s <=> c").collect()] == []
    assert got.where("s is not null").count() > 10


@pytest.mark.parametrize("name, column", [("answers_match", A.answers_match), ("check_simple", A.check_simple)])
def test_pairs(spark, rows, name, column):
    got = spark.sql(f"SELECT id, p, g, trace_{name}(p, g) AS s FROM {{rows}}", rows=rows).withColumn("c", column(F.col("p"), F.col("g")))
    assert [tuple(r) for r in got.where("not s <=> c").collect()] == []
    assert got.where("s").count() > 20


def test_table_functions(spark, rows):
    got = spark.sql("SELECT id, n.number FROM {rows}, LATERAL trace_numbers(p) n", rows=rows)
    want = rows.select("id", F.explode(A.extract_numbers(F.col("p"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 50
    got = spark.sql("SELECT id, l.lemma_no, l.statement, l.verification_plan FROM {rows}, LATERAL trace_lemmas(p) l", rows=rows)
    want = rows.select("id", F.posexplode(RD.parse_lemmas(F.col("p"))).alias("i", "l")).selectExpr("id", "i + 1", "l.statement", "l.verification_plan")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_in_conditions_and_groups_without_python(spark, rows):
    got = spark.sql("SELECT trace_boxed_int(p) AS answer, count(*) AS n FROM {rows} WHERE trace_boxed_int(p) > 5 GROUP BY trace_boxed_int(p) ORDER BY 1", rows=rows)
    assert got.count() >= 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "regexp_extract_all" in plan


def test_registering_again_and_other_names(spark):
    assert Q.register(spark) == Q.register(spark)
    assert "my_boxed_int" in Q.register(spark, "my_")
    assert spark.sql("SELECT my_boxed_int(r'so \\boxed{1,024}')").first()[0] == 1024
