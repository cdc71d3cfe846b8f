"""File-based sources: column detection, solution files, lemma markdown,
pairs sink, dataset card, lemma parsing."""

import os
import tempfile

from pyspark.sql import functions as F

from tracekiln.sources import readers as RD


def test_detect_columns():
    cols = ["Problem", "question", "expected_answer", "Answer", "generation"]
    assert RD.detect_columns(cols, "last") == {"question": "question", "answer": "Answer", "solution": "generation"}
    assert RD.detect_columns(cols, "first") == {"question": "Problem", "answer": "expected_answer",
                                                "solution": "generation"}


def test_read_solution_files(spark):
    root = tempfile.mkdtemp(prefix="sol-", dir=os.environ.get("TMPDIR", "/tmp"))
    os.makedirs(f"{root}/q1")
    open(f"{root}/q1/00-00120-42.txt", "w").write("text A")
    open(f"{root}/q1/01-00300.txt", "w").write("text B")
    open(f"{root}/q1/01-00300.ids", "w").write("1 2 3")
    rows = sorted(tuple(r) for r in RD.read_solution_files(spark, root).collect())
    assert rows == [("q1", 0, 120, "42", "text A"), ("q1", 1, 300, None, "text B")]


LEMMA_MD = """# Title

---

## Problem 1: NAME (Topic)
**ID:** 0e644e | **Answer:** 336

### Problem Statement
Text.

### Lemma Decomposition

**Lemma 1 (Angles):** From the statement, ABC holds.
- *Verification:* Use the law of cosines.

**Lemma 2 (Power):** Use power of a point.
- *Verification:* Compute XB times XA.

---

## Problem 2: OTHER
**ID:** 26de63 | **Answer:** 7

**Lemma 1 (Only):** Single claim.
- *Verification:* Check it.
"""


def test_parse_lemma_markdown(spark):
    d = tempfile.mkdtemp(prefix="lem-", dir=os.environ.get("TMPDIR", "/tmp"))
    open(f"{d}/lemmas.md", "w").write(LEMMA_MD)
    rows = sorted((r["number"], r["problem_id"], r["answer"], r["lemma_no"], r["title"], r["statement"], r["verification"])
                  for r in RD.parse_lemma_markdown(spark, d).collect())
    assert rows[0] == (1, "0e644e", 336, 1, "Angles", "From the statement, ABC holds.", "Use the law of cosines.")
    assert rows[1][3:5] == (2, "Power") and rows[2][:5] == (2, "26de63", 7, 1, "Only")


def test_parse_lemmas_column(spark):
    df = spark.createDataFrame([("**Lemma 1**: first claim\n- detail a\n**Lemma 2**: second\nplan b",), ("none",)], "t string")
    out = [r["l"] for r in df.select(RD.parse_lemmas("t").alias("l")).collect()]
    assert [x["statement"] for x in out[0]] == ["first claim", "second"]
    assert out[0][1]["verification_plan"] == "plan b"
    assert out[1][0]["statement"] == "Solve the problem directly"


def test_write_pairs_and_card(spark):
    d = tempfile.mkdtemp(prefix="pairs-", dir=os.environ.get("TMPDIR", "/tmp"))
    pairs = spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string")
    RD.write_pairs(pairs, f"{d}/pairs")
    assert spark.read.json(f"{d}/pairs").count() == 1
    df = spark.createDataFrame([("a", 0.125, "```x``` \\boxed{1} w w"), ("b", 0.25, "plain")],
                               "src string, acc double, t string")
    card = RD.dataset_card(df, "src", "acc", "t")
    assert card["content"].first()["boxed_share"] == 0.5
    assert card["sources"].count() == 2


def test_migrate_idempotent(spark):
    df = spark.createDataFrame([(1, ("5", None))], "id long, reward_model struct<ground_truth:string, gold_solution:string>")
    m = RD.migrate_reward_struct(df)
    assert m.first()["extra_info"]["gold_solution"] == ""
    assert RD.migrate_reward_struct(m).schema == m.schema


def test_flatten_metadata_pushes_down(spark):
    d = tempfile.mkdtemp(prefix="meta-", dir=os.environ.get("TMPDIR", "/tmp"))
    df = spark.createDataFrame([(1, {"reason_high_with_tool": (0.125,)}), (2, {"reason_low_no_tool": (0.5,)})],
                               "id long, metadata map<string, struct<accuracy:double>>")
    flat = RD.flatten_metadata(df)
    assert [r["acc_high_with_tool"] for r in flat.orderBy("id").collect()] == [0.125, None]
    flat.write.mode("overwrite").parquet(f"{d}/t")
    q = spark.read.parquet(f"{d}/t").where("acc_high_with_tool > 0 AND acc_high_with_tool < 0.5").select("id")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(acc_high_with_tool), GreaterThan(acc_high_with_tool,0.0)" in plan
    assert [r["id"] for r in q.collect()] == [1]


def test_card_query_returns_every_value(spark):
    from tracekiln import catalog
    from .conftest import SF_SMALL
    rows = catalog.queries()["a8_dataset_card_values"](spark, SF_SMALL).collect()
    got = {(r.card, r.value): r.amount for r in rows}
    assert {v for c, v in got if c == "content"} == {"code", "boxed", "sympy", "python"}
    assert all(0 < got["content", v] < 1 for v in ("code", "boxed", "sympy", "python"))
    assert got["words", "p50"] < got["words", "p90"]
    assert abs(sum(a for (c, _), a in got.items() if c == "sources") - 100) < 1e-4
