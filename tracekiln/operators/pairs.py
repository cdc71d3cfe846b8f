"""Preference-pair mining.

Decisions are made on narrow per-attempt facts (correct, judge score) pivoted
per problem by conditional aggregation; the chosen/rejected texts are joined
back by (problem, attempt) afterwards, so only ids and flags shuffle for the
decision and each text moves once.  Every problem gets a row with an
``outcome`` (pair / skip / error) so the counters (E10) are one ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from .curate import prompt_wrap

GOLD_FALLBACK = ("The answer is \\boxed{", "}.")


def _gold_text(gold_solution, gt):
    return F.coalesce(F.when(F.coalesce(F.length(gold_solution), F.lit(0)) > 0, gold_solution),
                      F.concat(F.lit(GOLD_FALLBACK[0]), gt, F.lit(GOLD_FALLBACK[1])))


def attempt_facts(attempts: DataFrame, key: str = "problem_id", response: str = "response",
                  gt: str = "gold") -> DataFrame:
    """Per attempt: D3 prediction and D13 simple check."""
    return attempts.select(key, "attempt_id",
                           A.check_simple(A.extract_boxed_last(F.col(response)), F.col(gt)).alias("ok"))


def _materialise(dec: DataFrame, attempts: DataFrame, problems: DataFrame, key: str,
                 response: str, gt: str) -> DataFrame:
    """Texts of the decided pairs: chosen_id -1 means the gold solution.  The attempts' texts meet the
    decision by problem and are picked in one aggregate, so each moves once."""
    text = lambda which: F.max(F.when(F.col("attempt_id") == F.col(which), F.col(response)))
    picked = (attempts.select(key, "attempt_id", response, gt).join(dec, key)
              .groupBy(key, "outcome", "chosen_id", "rejected_id")
              .agg(text("chosen_id").alias("_ch"), text("rejected_id").alias("_rj"), F.max(gt).alias(gt)))
    d = picked.join(problems.select(key, prompt_wrap(F.col("problem")).alias("prompt"), "gold_solution"), key)
    chosen = F.when(F.col("chosen_id") == -1, _gold_text(F.col("gold_solution"), F.col(gt))).otherwise(F.col("_ch"))
    return d.select(key, "outcome", "chosen_id", "rejected_id", "prompt",
                    F.when(F.col("outcome") == "pair", chosen).alias("chosen"),
                    F.when(F.col("outcome") == "pair", F.col("_rj")).alias("rejected"))


def pairs_vs_gold(attempts: DataFrame, problems: DataFrame, key: str = "problem_id",
                  response: str = "response", gt: str = "gold", attempt: int = 0) -> DataFrame:
    """E7 (round 1): one attempt per problem; wrong -> (gold, attempt),
    correct -> skip."""
    f = attempt_facts(attempts.where(F.col("attempt_id") == attempt), key, response, gt)
    dec = f.select(key,
                   F.when(F.col("ok"), F.lit("skip")).otherwise(F.lit("pair")).alias("outcome"),
                   F.when(~F.col("ok"), F.lit(-1).cast("bigint")).alias("chosen_id"),
                   F.when(~F.col("ok"), F.col("attempt_id")).alias("rejected_id"))
    return _materialise(dec, attempts.where(F.col("attempt_id") == attempt), problems, key, response, gt)


def _pivot_two(f: DataFrame, key: str, a: int, b: int, cols: list) -> DataFrame:
    aggs = []
    for c in cols:
        aggs.append(F.max(F.when(F.col("attempt_id") == a, F.col(c))).alias(f"{c}_a"))
        aggs.append(F.max(F.when(F.col("attempt_id") == b, F.col(c))).alias(f"{c}_b"))
    return f.where(F.col("attempt_id").isin(a, b)).groupBy(key).agg(*aggs)


def pairs_two_way(attempts: DataFrame, problems: DataFrame, scores: DataFrame, key: str = "problem_id",
                  response: str = "response", gt: str = "gold", a: int = 0, b: int = 1,
                  margin: float = 0.2) -> DataFrame:
    """E8 (rounds 2-3): a ok / b wrong -> (a, b) and vice versa; both wrong
    -> (gold, a); both ok -> judge scores (missing 1.0), pair if |diff| >=
    margin, else skip; an attempt missing -> error."""
    attempts = attempts.where(F.col("attempt_id").isin(a, b))       # only these two count
    f = attempt_facts(attempts, key, response, gt).join(
        scores.select(key, "attempt_id", "score"), [key, "attempt_id"], "left")
    p = _pivot_two(f, key, a, b, ["ok", "score"])
    oka, okb = F.col("ok_a"), F.col("ok_b")
    sa, sb = F.coalesce(F.col("score_a"), F.lit(1.0)), F.coalesce(F.col("score_b"), F.lit(1.0))
    both_ok_pair = oka & okb & (F.abs(sa - sb) >= margin)
    la, lb = F.lit(a).cast("bigint"), F.lit(b).cast("bigint")
    outcome = (F.when(oka.isNull() | okb.isNull(), F.lit("error")).when(oka & okb & ~both_ok_pair, F.lit("skip"))
               .otherwise(F.lit("pair")))
    chosen = (F.when(oka & ~okb, la).when(okb & ~oka, lb).when(~oka & ~okb, F.lit(-1).cast("bigint"))
               .when(both_ok_pair, F.when(sa > sb, la).otherwise(lb)))
    rejected = (F.when(oka & ~okb, lb).when(okb & ~oka, la).when(~oka & ~okb, la)
                 .when(both_ok_pair, F.when(sa > sb, lb).otherwise(la)))
    ids = [F.when(outcome == "pair", x) for x in (chosen, rejected)]
    dec = p.select(key, outcome.alias("outcome"), ids[0].alias("chosen_id"), ids[1].alias("rejected_id"))
    return _materialise(dec, attempts, problems, key, response, gt)


def pairs_by_score(attempts: DataFrame, problems: DataFrame, scores: DataFrame, key: str = "problem_id",
                   response: str = "response", gt: str = "gold", a: int = 0, b: int = 1,
                   low: float = 0.3, close: float = 0.1) -> DataFrame:
    """Missing score -> 1/0 from our own check; both < low -> (gold,
    worse); |diff| < close -> skip; else the winner; an attempt missing -> error."""
    attempts = attempts.where(F.col("attempt_id").isin(a, b))       # only these two count
    f = attempt_facts(attempts, key, response, gt).join(
        scores.select(key, "attempt_id", "score"), [key, "attempt_id"], "left")
    f = f.withColumn("s", F.coalesce(F.col("score"), F.when(F.col("ok"), F.lit(1.0)).otherwise(F.lit(0.0))))
    p = _pivot_two(f, key, a, b, ["s"])
    sa, sb = F.col("s_a"), F.col("s_b")
    la, lb = F.lit(a).cast("bigint"), F.lit(b).cast("bigint")
    both_low = (sa < low) & (sb < low)
    too_close = ~both_low & (F.abs(sa - sb) < close)
    outcome = F.when(sa.isNull() | sb.isNull(), F.lit("error")).when(too_close, F.lit("skip")).otherwise(F.lit("pair"))
    chosen = F.when(both_low, F.lit(-1).cast("bigint")).when(~too_close, F.when(sa > sb, la).otherwise(lb))
    rejected = (F.when(both_low, F.when(sa <= sb, la).otherwise(lb))
                 .when(~too_close, F.when(sa > sb, lb).otherwise(la)))
    ids = [F.when(outcome == "pair", x) for x in (chosen, rejected)]
    dec = p.select(key, outcome.alias("outcome"), ids[0].alias("chosen_id"), ids[1].alias("rejected_id"))
    return _materialise(dec, attempts, problems, key, response, gt)


def pair_stats(pairs: DataFrame, by: list | None = None, errors: bool = False) -> DataFrame:
    """Pairs / skipped per round (or overall); with ``errors`` also the rows that could not be judged."""
    more = [F.count(F.when(F.col("outcome") == "error", 1)).alias("errors")] if errors else []
    return pairs.groupBy(*(by or [])).agg(
        F.count(F.when(F.col("outcome") == "pair", 1)).alias("pairs"),
        F.count(F.when(F.col("outcome") == "skip", 1)).alias("skipped"), *more,
        F.count("*").alias("problems"))
