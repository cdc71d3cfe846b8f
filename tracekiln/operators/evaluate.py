"""Evaluation metrics over attempts (G9-G13, G15, G16) and curriculum tiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .votes import majority_vote

# Curriculum stages by accuracy (k/8 grid), hardest first.
TIER_BY_ACCURACY = {0.125: 1, 0.25: 2, 0.375: 3}
TIER_LABEL = {1: "hardest", 2: "hard", 3: "easiest-hard"}
UPSAMPLE_WEIGHTS = {0.125: 4, 0.25: 2, 0.375: 1}


def curriculum_tier(acc) -> F.Column:
    """0.125 -> 1, 0.25 -> 2, 0.375 -> 3, anything else null."""
    a = F.col(acc) if isinstance(acc, str) else acc
    out = None
    for v, t in TIER_BY_ACCURACY.items():
        out = F.when(a == v, F.lit(t)) if out is None else out.when(a == v, F.lit(t))
    return out


def accuracy(df: DataFrame, correct: str = "correct", gold: str = "gold", by: list | None = None) -> DataFrame:
    """Correct / total over rows that have a gold answer (others skipped)."""
    d = df.where(F.col(gold).isNotNull())
    return d.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.sum(F.col(correct).cast("int")).cast("bigint").alias("n_correct"),
        F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def pass_at_k(n, c, k: int) -> F.Column:
    """Unbiased pass@k = 1 - C(n-c, k)/C(n, k) as a product in doubles:
    1 - prod_{i=n-c+1..n} (1 - k/i); 1.0 when n - c < k."""
    n, c = (F.col(x) if isinstance(x, str) else x for x in (n, c))
    seq = F.sequence(n - c + 1, n)
    prod = F.aggregate(seq, F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - F.lit(float(k)) / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - prod)


def pass_maj_at_k(df: DataFrame, k: int, key: str = "problem_id", correct: str = "correct",
                  answer: str = "answer", gold_int: str = "gold_int", order: str = "attempt_id") -> DataFrame:
    """Per problem n, c, pass@k and maj@k (majority of the first k
    attempts equals the gold)."""
    per = df.groupBy(key).agg(F.count("*").alias("n"),
                              F.sum(F.col(correct).cast("int")).alias("c"),
                              F.first(gold_int, ignorenulls=True).alias("_gold"))
    w = Window.partitionBy(key).orderBy(F.col(order).asc())
    firstk = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
    maj = majority_vote(firstk, key, answer, order).select(key, "majority_answer")
    j = per.join(maj, key, "left")
    return j.select(key, F.col("n").cast("bigint").alias("n"), F.col("c").cast("bigint").alias("c"),
                    F.round(pass_at_k(F.col("n"), F.col("c"), k), 6).alias(f"pass_at_{k}"),
                    F.coalesce(F.col("majority_answer") == F.col("_gold"), F.lit(False)).alias(f"maj_at_{k}"))


def confidence_breakdown(df: DataFrame, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """Accuracy inside the high (>= 0.7) and low (< 0.4) confidence bands."""
    band = (F.when(F.col(confidence) >= 0.7, F.lit("high"))
             .when(F.col(confidence) < 0.4, F.lit("low")).otherwise(F.lit("mid")))
    return df.groupBy(band.alias("band")).agg(
        F.count("*").alias("n"),
        F.sum(F.col(correct).cast("int")).cast("bigint").alias("n_correct"),
        F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def difficulty_from_rollouts(df: DataFrame, key: str = "problem_id", correct: str = "correct",
                             rollouts: int = 8) -> DataFrame:
    """accuracy = correct / rollouts per problem, then the C7 tier."""
    per = df.groupBy(key).agg(F.sum(F.col(correct).cast("int")).cast("bigint").alias("n_correct"),
                              F.count("*").alias("n_attempts"))
    acc = F.col("n_correct").cast("double") / F.lit(float(rollouts))
    return per.withColumn("accuracy", acc).withColumn("tier", curriculum_tier(acc))


def round_progress(df: DataFrame, round_col: str = "round", correct: str = "correct") -> DataFrame:
    """Accuracy per round and the gain over the previous round (the
    window runs over the already-aggregated round table)."""
    per = df.groupBy(round_col).agg(F.count("*").alias("n"),
                                    F.avg(F.col(correct).cast("double")).alias("acc"))
    w = Window.orderBy(round_col)
    return per.select(round_col, F.col("n").cast("bigint"), F.round("acc", 6).alias("accuracy"),
                      F.round(F.col("acc") - F.lag("acc").over(w), 6).alias("gain"))


def lemma_verified_ratio(df: DataFrame, key: str = "problem_id", code_ok: str = "code_ok",
                         has_code: str = "has_code", proof: str = "proof") -> DataFrame:
    """verified = code ran OK, or (no code) a proof longer than 100 chars."""
    ver = F.when(F.col(has_code), F.col(code_ok)).otherwise(F.length(proof) > 100)
    return df.groupBy(key).agg(
        F.sum(F.coalesce(ver, F.lit(False)).cast("int")).cast("bigint").alias("verified"),
        F.count("*").alias("total"),
        F.round(F.avg(F.coalesce(ver, F.lit(False)).cast("double")), 6).alias("verified_ratio"))


def _solved_lemmas(lemmas: DataFrame, edges: DataFrame, key: str, node: str, dep: str) -> DataFrame:
    """``key, node, level, place``: 0 without (known) dependencies, else 1 + max level
    of them; ``place`` is the position in first-in-first-out dependency order.  Nodes on or behind a
    cycle have neither.  Unknown dependencies are ignored, repeated edges count once.

    A round solves the nodes all of whose dependencies are solved, over all problems at once, until
    a round adds nothing, so the rounds are the longest chain.  In a
    first-in-first-out queue a node enters when its last dependency leaves, so all nodes of
    a level come before the next level, in the order of their last dependency's place, then
    of id.  Each round's new rows are appended to a table in the shared folder and read back, so a solved row is
    written once, and a lost executor reads files."""
    known = (edges.select(key, node, dep).distinct().join(lemmas.select(key, F.col(node).alias(dep)), [key, dep], "left_semi")
             .join(lemmas.select(key, node), [key, node], "left_semi"))
    n_dep = known.groupBy(key, node).agg(F.count("*").alias("_ndeps"))
    first = lemmas.select(key, node).distinct().join(n_dep, [key, node], "left_anti")
    by_id = Window.partitionBy(key).orderBy(node)
    path = f"{ensure_checkpoint_dir(lemmas.sparkSession).rstrip('/')}/solved-{uuid.uuid4().hex}"
    new = first.select(key, node, F.lit(0).alias("level"), (F.row_number().over(by_id) - 1).alias("place"))
    schema = new.schema
    n = 0
    while True:
        new.write.mode("append").parquet(path)
        solved = lemmas.sparkSession.read.schema(schema).parquet(path)
        n, before_n = solved.count(), n
        if n == before_n:
            return solved
        before = solved.select(key, F.col(node).alias(dep), F.col("level").alias("_dl"), F.col("place").alias("_dp"))
        ready = (known.join(solved.select(key, node), [key, node], "left_anti").join(before, [key, dep])
                 .groupBy(key, node).agg(F.count("*").alias("_n"), F.max("_dl").alias("_dl"), F.max("_dp").alias("_dp"))
                 .join(n_dep, [key, node]).where("_n = _ndeps"))
        taken = solved.groupBy(key).agg(F.count("*").alias("_taken"))
        turn = Window.partitionBy(key).orderBy("_dp", node)
        new = ready.join(taken, key).select(key, node, (F.col("_dl") + 1).alias("level"),
                                            (F.row_number().over(turn) - 1 + F.col("_taken")).cast("int").alias("place"))


def _with_order(lemmas: DataFrame, edges: DataFrame, key: str, node: str, dep: str) -> DataFrame:
    """Every node with its level, and its order: that of the queue, or by id in a
    problem that has a cycle."""
    out = lemmas.select(key, node).distinct().join(_solved_lemmas(lemmas, edges, key, node, dep), [key, node], "left")
    cyclic = out.groupBy(key).agg(F.max(F.col("level").isNull()).alias("problem_cyclic"))
    return out.join(cyclic, key)


def lemma_levels(lemmas: DataFrame, edges: DataFrame, key: str = "problem_id",
                 node: str = "lemma_id", dep: str = "dep") -> DataFrame:
    """Topological level of each lemma (null and ``cyclic`` on or behind a
    cycle) and ``level_order``: by level, then id; by id alone in a problem with a cycle."""
    out = _with_order(lemmas, edges, key, node, dep)
    w = Window.partitionBy(key).orderBy(F.when(~F.col("problem_cyclic"), F.col("level")), node)
    return out.select(key, node, "level", F.col("level").isNull().alias("cyclic"), F.row_number().over(w).alias("level_order"))


def dependency_order(lemmas: DataFrame, edges: DataFrame, key: str = "problem_id",
                     node: str = "lemma_id", dep: str = "dep") -> DataFrame:
    """G15 as a work list: ``position`` in first-in-first-out dependency order; a
    problem with a cycle (``cyclic``) is in id order."""
    out = _with_order(lemmas, edges, key, node, dep)
    by_id = Window.partitionBy(key).orderBy(node)
    return out.select(key, node, F.when(F.col("problem_cyclic"), F.row_number().over(by_id) - 1).otherwise(F.col("place")).alias("position"),
                      F.col("problem_cyclic").alias("cyclic"))
