"""A hot key holding a third of all rows: results stay exact and whole."""

import statistics
from collections import Counter

from pyspark.sql import functions as F

from tracekiln.operators import curate as C
from tracekiln.operators import rewards as R
from tracekiln.operators import votes as V


def _rows():
    rows = []
    for a in range(3000):                       # problem 0: one third of all rows
        rows.append((0, a, (a * 7) % 11, float((a * 13) % 5)))
    for p in range(1, 1501):
        for a in range(4):
            rows.append((p, a, (p + a) % 3, float((p * a) % 4)))
    return rows


def test_hot_key_votes_and_advantage(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "problem_id long, attempt_id long, answer long, reward double")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {r["problem_id"]: r for r in V.majority_vote(df.repartition(parts)).collect()}
        hot = Counter(r[2] for r in rows if r[0] == 0)
        top = max(hot.values())
        assert got[0]["majority_answer"] == min(a for a, c in hot.items() if c == top)
        assert got[0]["valid_votes"] == 3000 and len(got) == 1501
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    adv = R.group_advantage(df).where("problem_id = 0").agg(F.sum("advantage").alias("s"), F.count("*").alias("n")).first()
    assert adv["n"] == 3000 and abs(adv["s"]) < 1e-6
    mean = statistics.mean(r[3] for r in rows if r[0] == 0)
    sd = statistics.stdev(r[3] for r in rows if r[0] == 0)
    one = R.group_advantage(df).where("problem_id = 0 AND attempt_id = 1").first()
    assert abs(one["advantage"] - (rows[1][3] - mean) / sd) < 1e-9


def test_hot_key_top1(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "problem_id long, attempt_id long, answer long, reward double") \
        .withColumn("uid", F.concat(F.col("problem_id").cast("string"), F.lit(":"), F.col("attempt_id").cast("string")))
    best = C.best_per_problem(df, F.col("problem_id"), [F.col("reward"), F.col("attempt_id")], "uid", "uid").collect()
    assert len(best) == 1501
    assert "0:0" in {r["uid"] for r in best}
