"""Derived views over the driver tables (FIXTURES.md section 3).

The driver tables hold invented prose with no answers, boxes or rollouts, so
the trace-curation operators run on deterministic views derived from them:
every derived row is a pure function of base-table columns and an md5-based
32-bit hash, so the views grow with the tables, need no shuffle to build
(``explode(sequence)`` is per row), and the SQL oracle rebuilds them exactly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .tables import read_table

ATTEMPTS_PER_PROBLEM = 8
# Judge reasoning classes, in the reference's order.
REASONING_CLASSES = ["complete", "correct_approach_incomplete",
                     "correct_approach_wrong_execution", "adjacent_approach",
                     "wrong_approach", "memorized", "incoherent"]
BS = "\\"


def H(e: Column) -> Column:
    """32-bit hash of a string expression as bigint (first 8 hex digits of md5)."""
    return F.conv(F.substring(F.md5(e), 1, 8), 16, 10).cast("bigint")


def _k(prefix: str, *cols: Column) -> Column:
    parts = [F.lit(prefix)]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(":"))
        parts.append(c.cast("string"))
    return F.concat(*parts)


def keyed_documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Documents that have an id."""
    return read_table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", *cols)


def keyed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def as_table(df: DataFrame, sf_dir: str, name: str) -> DataFrame:
    """A view as the table a user would have: written once per application to
    the shared folder, then only read."""
    spark = df.sparkSession
    at = (spark.sparkContext.applicationId, sf_dir, name)
    if at not in _WRITTEN:
        path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _WRITTEN[at] = path
    return spark.read.parquet(_WRITTEN[at])


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One problem per document: id, uuid, problem text, gold solution, source, accuracy on the k/8 grid, expected answer."""
    d = keyed_documents(spark, sf_dir, "text")
    i = F.col("doc_id")
    f = H(_k("f:", i)) % 8
    g = H(_k("g:", i))
    expected = (F.when(f == 0, F.lit("3.5")).when(f == 1, F.lit("x+1"))
                .when(f == 2, (g % 900000).cast("string")).when(f == 3, F.lit("-7"))
                .otherwise((g % 100000).cast("string")))
    return d.select(
        i.alias("problem_id"),
        F.md5(_k("u:", i)).alias("uuid"),
        F.col("text").alias("problem"),
        F.col("text").alias("gold_solution"),
        F.when(H(_k("s:", i)) % 6 == 0, F.lit("aops")).otherwise(F.lit("stackflow")).alias("data_source"),
        F.when(H(_k("m:", i)) % 10 == 0, F.lit(None).cast("double"))
         .otherwise((H(_k("t:", i)) % 9).cast("double") / F.lit(8.0)).alias("acc_high_tool"),
        expected.alias("expected_answer"),
    )


def _spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (id and text) in files enough for all cores; fewer files are dealt out and written once."""
    d = keyed_documents(spark, sf_dir, "text")
    cores = spark.sparkContext.defaultParallelism
    return d if len(d.inputFiles()) >= cores else as_table(d.repartition(cores, "doc_id"), sf_dir, "documents")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rollouts per document: its whole text, rotated by a hash-chosen
    number of characters, and a hash-chosen answer suffix.  A view: eight times the
    documents are neither written nor shuffled."""
    d = _spread_documents(spark, sf_dir)
    a = d.select("doc_id", "text",
                 F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ATTEMPTS_PER_PROBLEM - 1).cast("bigint"))).alias("attempt_id"))
    i = F.col("doc_id")
    ik = _k("", i, F.col("attempt_id"))
    G = (H(_k("g:", i)) % 100000).cast("string")
    w = H(F.concat(F.lit("w:"), ik)) % 8
    x = (H(F.concat(F.lit("x:"), ik)) % 5).cast("string")
    two_g = (H(_k("g:", i)) % 100000 * 2).cast("string")
    suffix = (F.when(w == 0, F.lit(""))
              .when(w == 1, F.concat(F.lit(" the answer is "), G))
              .when(w == 2, F.concat(F.lit(f" {BS}boxed{{"), G, F.lit(".0}")))
              .when(w == 3, F.concat(F.lit(f" {BS}boxed{{{BS}text{{"), G, F.lit("}}")))
              .when(w == 4, F.concat(F.lit(f" {BS}boxed{{{BS}frac{{"), two_g, F.lit("}{2}}")))
              .when(w == 5, F.concat(F.lit(f" {BS}boxed{{"), x, F.lit("}")))
              .when(w == 6, F.concat(F.lit(f" {BS}boxed{{7}} then {BS}boxed {{$"), G, F.lit("$}")))
              .otherwise(F.concat(F.lit(f" {BS}boxed{{"), G, F.lit("}"))))
    n = (H(F.concat(F.lit("l:"), ik)) % 600).cast("int")
    return a.select(
        i.alias("problem_id"),
        F.col("attempt_id"),
        G.alias("gold"),
        F.concat(F.col("text").substr(n + 1, F.length("text")), F.col("text").substr(F.lit(1), n), suffix).alias("response"),
        ((H(F.concat(F.lit("e:"), ik)) % 4000 + 1).cast("double") / F.lit(1000.0)).alias("entropy"),
    )


def messages_tir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in long form with tool turns and tool artefacts: every
    assistant turn whose hash is 0 mod 3 becomes a ``tool`` turn; a hash picks a
    suffix (code fence, traceback, error, boxed answer or nothing)."""
    c = keyed_conversations(spark, sf_dir)
    k = _k("", F.col("conv_id"), F.col("turn"))
    r = H(F.concat(F.lit("r:"), k)) % 3
    s = H(F.concat(F.lit("c:"), k)) % 6
    a = (H(F.concat(F.lit("a:"), k)) % 50).cast("string")
    suffix = (F.when(s == 0, F.lit("\n```python\nprint(1)\n```"))
              .when(s == 1, F.lit("\nTraceback (most recent call last)"))
              .when(s == 2, F.lit(" Error: bad input"))
              .when(s == 3, F.concat(F.lit(f" {BS}boxed{{"), a, F.lit("}")))
              .otherwise(F.lit("")))
    return c.select(
        "conv_id", "turn",
        F.when((F.col("role") == "assistant") & (r == 0), F.lit("tool")).otherwise(F.col("role")).alias("role"),
        F.concat(F.col("text"), suffix).alias("text"),
    )


def trajectory_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header row per conversation: uuid, source, accuracy, tools, answer."""
    c = keyed_conversations(spark, sf_dir).select("conv_id").distinct()
    i = F.col("conv_id")
    return c.select(
        i,
        F.md5(_k("u:", i)).alias("uuid"),
        F.when(H(_k("s:", i)) % 6 == 0, F.lit("aops")).otherwise(F.lit("stackflow")).alias("data_source"),
        F.when(H(_k("m:", i)) % 10 == 0, F.lit(None).cast("double"))
         .otherwise((H(_k("t:", i)) % 9).cast("double") / F.lit(8.0)).alias("accuracy"),
        (H(_k("n:", i)) % 3).alias("n_tools"),
        (H(_k("g:", i)) % 1000).cast("string").alias("expected_answer"),
    )


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External-judge scores per attempt; one in five is missing."""
    a = attempts(spark, sf_dir).select("problem_id", "attempt_id")
    ik = _k("", F.col("problem_id"), F.col("attempt_id"))
    return (a.where(H(F.concat(F.lit("k:"), ik)) % 5 != 0)
            .select("problem_id", "attempt_id",
                    ((H(F.concat(F.lit("j:"), ik)) % 11).cast("double") / F.lit(10.0)).alias("score")))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts tagged with an evaluation round (1..3)."""
    return attempts(spark, sf_dir).withColumn("round", F.col("attempt_id") % 3 + 1)


def logprobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form top-2 token log-probabilities: 4 positions per attempt."""
    a = attempts(spark, sf_dir).select("problem_id", "attempt_id")
    a = a.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("pos"))
    p = (H(_k("p:", F.col("problem_id"), F.col("attempt_id"), F.col("pos"))) % 99 + 1).cast("double") / F.lit(100.0)
    a = a.withColumn("p", p)
    return a.select("problem_id", "attempt_id", "pos",
                    F.explode(F.array(
                        F.struct(F.lit("a").alias("token"), F.ln("p").alias("logprob")),
                        F.struct(F.lit("b").alias("token"), F.ln(F.lit(1.0) - F.col("p")).alias("logprob")),
                    )).alias("t")).select("problem_id", "attempt_id", "pos", "t.token", "t.logprob")


def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six lemmas per problem (ids 0..5)."""
    d = keyed_documents(spark, sf_dir).select(F.col("doc_id").alias("problem_id"))
    return d.select("problem_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint"))).alias("lemma_id"))


def lemma_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency edges ``dep -> lemma_id``: forward edges i<j by hash; one
    problem in 20 gets a back edge 5 -> 0 (cycle), one in 20 a dependency on
    an unknown lemma 99."""
    d = keyed_documents(spark, sf_dir).select(F.col("doc_id").alias("problem_id"))
    pairs = d.select("problem_id",
                     F.explode(F.sequence(F.lit(0), F.lit(5))).alias("dep")) \
             .select("problem_id", "dep",
                     F.explode(F.sequence(F.col("dep") + 1, F.lit(6))).alias("lemma_id")) \
             .where(F.col("lemma_id") <= 5) \
             .select("problem_id", F.col("dep").cast("bigint"), F.col("lemma_id").cast("bigint"))
    fwd = pairs.where(H(_k("e:", F.col("problem_id"), F.col("dep"), F.col("lemma_id"))) % 3 == 0)
    back = d.where(H(_k("c:", F.col("problem_id"))) % 20 == 0).select(
        "problem_id", F.lit(5).cast("bigint").alias("dep"), F.lit(0).cast("bigint").alias("lemma_id"))
    unknown = d.where(H(_k("v:", F.col("problem_id"))) % 20 == 0).select(
        "problem_id", F.lit(99).cast("bigint").alias("dep"), F.lit(3).cast("bigint").alias("lemma_id"))
    return fwd.unionByName(back).unionByName(unknown)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge verdicts keyed by the C18 cache key of (gold solution, response):
    three keys in four are judged; the class is picked by hash."""
    return as_table(_verdicts(spark, sf_dir), sf_dir, "verdicts")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = attempts(spark, sf_dir).select("problem_id", F.md5("response").alias("r"))
    p = problems(spark, sf_dir).select("problem_id", F.md5("gold_solution").alias("g"))
    k = a.join(p, "problem_id").select(F.md5(F.concat("g", F.lit("||"), "r")).alias("key")).distinct()
    classes = F.array(*[F.lit(c) for c in REASONING_CLASSES])
    return (k.where(H(F.concat(F.lit("vk:"), F.col("key"))) % 4 != 0)
             .select("key", F.element_at(classes, (H(F.concat(F.lit("vc:"), F.col("key"))) % 7 + 1).cast("int"))
                     .alias("reasoning_class")))
