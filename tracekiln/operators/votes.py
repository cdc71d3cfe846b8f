"""Vote aggregation over attempts.

Every vote is two aggregations: per (problem, answer) -- partial+final, so
a hot problem is pre-aggregated map-side before the shuffle -- then a pick over
the (problem, answer) table, which has at most #answers rows per problem.  No
per-problem list of attempts is ever collected.

Ties (undefined in the reference) get total orders: majority -> smallest
answer; weighted votes -> earliest first arrival (lowest attempt id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def answer_counts(df: DataFrame, key: str = "problem_id", answer: str = "answer",
                  order: str = "attempt_id", weight=None, valid=None) -> DataFrame:
    """(key, answer) -> votes, weighted score, first arrival.  Null answers
    (and answers failing ``valid``) are not votes.

    The null/validity test lives inside the aggregate (``count(answer)``, then
    ``votes > 0``): a filter on a computed answer would be pushed below the
    projection and re-evaluate the extraction expression in the predicate."""
    w = F.lit(1.0) if weight is None else weight
    a = F.col(answer)
    if valid is not None:
        a = F.when(valid, a)
        w = F.when(valid, w)
    return (df.groupBy(key, answer)
              .agg(F.count(a).alias("votes"),
                   F.sum(w).alias("score"),
                   F.min(order).alias("first_arrival"))
              .where(F.col("votes") > 0))


def _pick(counts: DataFrame, key: str, answer: str, order_cols) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order_cols)
    return counts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def majority_vote(df: DataFrame, key: str = "problem_id", answer: str = "answer",
                  order: str = "attempt_id") -> DataFrame:
    """G1 + G2: per problem the most frequent non-null answer (ties -> the
    smallest), its votes, valid votes and confidence = winner / valid (0.0 if
    there is no valid answer).  Problems with no answer at all keep a row.

    One chain: per (problem, answer) counts (null answers form a 0-vote group,
    so every problem survives), then one per-problem aggregate that picks the
    winner with ``max_by(answer, (votes, -answer))`` -- no second branch over
    the input, no join."""
    a = F.col(answer)
    counts = df.groupBy(key, answer).agg(F.count(a).alias("votes"))
    pick = F.when(F.col("votes") > 0, F.struct(F.col("votes"), -a))
    per = counts.groupBy(key).agg(
        F.max_by(a, pick).alias("majority_answer"),
        F.max(F.when(F.col("votes") > 0, F.col("votes"))).alias("winner_votes"),
        F.sum("votes").alias("valid_votes"))
    return per.select(
        key, "majority_answer",
        F.coalesce("winner_votes", F.lit(0)).cast("bigint").alias("winner_votes"),
        F.coalesce("valid_votes", F.lit(0)).cast("bigint").alias("valid_votes"),
        F.coalesce(F.round(F.col("winner_votes") / F.col("valid_votes"), 6), F.lit(0.0)).alias("confidence"))


def entropy_weight(entropy, floor: float = 1e-9, variant: str = "max") -> F.Column:
    """G3 weight: 1/max(e, 1e-9) (or 1/(e + 1e-9)); infinite entropy -> 0."""
    e = F.col(entropy) if isinstance(entropy, str) else entropy
    base = F.greatest(e, F.lit(floor)) if variant == "max" else e + F.lit(floor)
    return F.when(e == float("inf"), F.lit(0.0)).otherwise(F.lit(1.0) / base)


def weighted_vote(df: DataFrame, weight, key: str = "problem_id", answer: str = "answer",
                  order: str = "attempt_id", valid=None) -> DataFrame:
    """G3/G4 shape: highest summed weight; ties -> earliest first arrival.
    No valid answer -> no row (the caller decides the fallback)."""
    counts = answer_counts(df, key, answer, order, weight, valid)
    win = _pick(counts, key, answer, [F.col("score").desc(), F.col("first_arrival").asc()])
    return win.select(key, F.col(answer).alias("voted_answer"), "votes",
                      F.round("score", 6).alias("score"))


def entropy_vote(df: DataFrame, entropy: str = "entropy", variant: str = "max", **kw) -> DataFrame:
    """G3 with either weight."""
    return weighted_vote(df, entropy_weight(entropy, variant=variant), **kw)


def verified_vote(df: DataFrame, verified: str = "verified_count", total: str = "total_lemmas",
                  answer: str = "answer", hi: int = 99999, **kw) -> DataFrame:
    """Weight verified/total + 0.1, answers outside 0..hi ignored."""
    wgt = F.coalesce(F.col(verified), F.lit(0)) / F.coalesce(F.col(total), F.lit(1)) + F.lit(0.1)
    return weighted_vote(df, wgt, answer=answer, valid=F.col(answer).between(0, hi), **kw)


def magnitude_scores(df: DataFrame, key: str = "problem_id", answer: str = "answer",
                     order: str = "attempt_id") -> DataFrame:
    """G5 table: per answer, score = ln(1.25 + |v|) x count."""
    return add_magnitude(answer_counts(df, key, answer, order), answer)


def add_magnitude(counts: DataFrame, answer: str = "answer") -> DataFrame:
    return counts.withColumn("score", F.log(F.lit(1.25) + F.abs(F.col(answer))) * F.col("votes"))


def magnitude_vote(df: DataFrame, key: str = "problem_id", answer: str = "answer",
                   order: str = "attempt_id") -> DataFrame:
    """G5 + G6: winner by tuple max (score, votes, value) and the decision
    rule top > max(1, total/(2+ln(1+total))) and (one candidate or lead > 1).
    Windows run over the small (problem, answer) table only."""
    return magnitude_decision(magnitude_scores(df, key, answer, order), key, answer)


def magnitude_decision(s: DataFrame, key: str = "problem_id", answer: str = "answer") -> DataFrame:
    """G5 + G6 from the table of ``magnitude_scores`` (or a running one)."""
    allw = Window.partitionBy(key)
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("votes").desc(), F.col(answer).desc())
    s = s.withColumn("_total", F.sum("score").over(allw)).withColumn("_cands", F.count("*").over(allw)) \
         .withColumn("_rn", F.row_number().over(w)).where("_rn <= 2")
    j = s.groupBy(key).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(answer))).alias("voted_answer"),
        F.max(F.when(F.col("_rn") == 1, F.col("score"))).alias("top_score"),
        F.max(F.when(F.col("_rn") == 2, F.col("score"))).alias("second_score"),
        F.first("_total").alias("total_score"), F.first("_cands").alias("candidates"))
    thr = F.greatest(F.lit(1.0), F.col("total_score") / (F.lit(2.0) + F.log(F.lit(1.0) + F.col("total_score"))))
    decided = (F.col("top_score") > thr) & ((F.col("candidates") == 1) |
                                           (F.col("top_score") - F.col("second_score") > 1))
    return j.select(key, "voted_answer", F.round("top_score", 6).alias("top_score"),
                    F.round("total_score", 6).alias("total_score"),
                    F.col("candidates").cast("bigint").alias("candidates"),
                    F.coalesce(decided, F.lit(False)).alias("decided"))


def vote_table(df: DataFrame, weight=None, key: str = "problem_id", answer: str = "answer",
               order: str = "attempt_id") -> DataFrame:
    """Answer, votes, score rounded to 3, rank by score (dense ties share)."""
    c = answer_counts(df, key, answer, order, weight)
    w = Window.partitionBy(key).orderBy(F.round("score", 3).desc())
    return c.select(key, answer, "votes", F.round("score", 3).alias("score"),
                    F.rank().over(w).alias("rank"))


def early_stop_point(df: DataFrame, k: int = 4, key: str = "problem_id", answer: str = "answer",
                     order: str = "attempt_id") -> DataFrame:
    """The arrival at which some answer first reaches ``k`` votes (null
    if none does), and the majority over the attempts up to that point.

    The k-th vote of each (problem, answer) is ``row_number() = k``, which
    Spark plans as a partial WindowGroupLimit before the shuffle."""
    df = df.select(key, order, answer)
    w = Window.partitionBy(key, answer).orderBy(F.col(order).asc())
    kth = df.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") == k) & F.col(answer).isNotNull())
    stop = kth.groupBy(key).agg(F.min(order).alias("stop_at"))
    base = df.join(stop, key, "left")
    kept = base.where(F.col("stop_at").isNull() | (F.col(order) <= F.col("stop_at")))
    maj = majority_vote(kept, key, answer, order)
    used = kept.groupBy(key).agg(F.count("*").alias("attempts_used"), F.first("stop_at").alias("stop_at"))
    return maj.join(used, key).select(key, "stop_at", F.col("attempts_used").cast("bigint"),
                                      "majority_answer", "winner_votes")


def attempt_selection(refine_answer, first_answer) -> F.Column:
    """The final refine answer, else the first answer."""
    return F.coalesce(refine_answer, first_answer)
