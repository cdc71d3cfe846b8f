"""Reward scoring of rollouts.

Plan shape for ``score_rollouts``: gold facts are computed once per *problem*
(regexes over the long gold text run once, not once per rollout), joined to
the rollouts on the problem key, then one facts projection per rollout feeds
a single ``when`` ladder.  Group statistics are a partial+final aggregate
joined back, which AQE's skew-join can split when one problem is hot; a window
over the group would pin a hot problem to one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from .filters import is_valid_gold

# The judged-reward table (answer correct / wrong x class) and
# the 3-level reward, as in the reference.
JUDGED_TABLE = {
    "complete": (1.0, 0.4),
    "correct_approach_incomplete": (0.7, 0.25),
    "correct_approach_wrong_execution": (0.5, 0.2),
    "adjacent_approach": (0.6, 0.15),
    "wrong_approach": (0.1, 0.05),
    "memorized": (0.05, 0.0),
    "incoherent": (0.05, 0.0),
}
REWARD_3LEVEL = {"correct": 1.0, "wrong": -0.5, "no_box": -1.0}


def gold_facts(problems: DataFrame, key: str = "problem_id", gold: str = "gold_solution") -> DataFrame:
    """Per problem: gold validity and the gold step-number set (D15 minus the
    gold's own final answer).  Narrow output; the gold text is not carried on."""
    g = F.col(gold)
    p = problems.select(key, gold).withColumn("_gold_valid", is_valid_gold(g))
    p = A.add_boxed_first(p, g, "_gold_final")
    p = p.withColumn("_final_v", F.round(A.to_double(A.normalize_answer(F.col("_gold_final"))), 4)) \
         .withColumn("_nums", F.when(F.col("_gold_valid"), A.extract_numbers(g)))
    nums, final_v = F.col("_nums"), F.col("_final_v")
    step_nums = F.when(final_v.isNull(), nums).otherwise(F.array_except(nums, F.array(final_v)))
    return p.select(F.col(key), F.col("_gold_valid").alias("gold_valid"), step_nums.alias("gold_numbers"))


def response_facts(df: DataFrame, response: str = "response", gt: str = "gold") -> DataFrame:
    """What E2 needs of a response, per row: ``pred, correct, response_len, _steps, _numbers``.  With these the
    text can stay behind before any join."""
    r = F.col(response)
    facts = A.add_boxed_first(df, r, "pred").withColumn("response_len", F.length(r))
    facts = A.add_answers_match(facts, F.col("pred"), F.col(gt), "correct")
    # step words count for long wrong answers only
    asked = (F.col("response_len") > 200) & F.col("pred").isNotNull()
    return facts.withColumns({"_steps": F.when(asked & ~F.col("correct"), A.has_step_words(r)), "_numbers": F.when(asked, A.extract_numbers(r))})


def reward_10level(df: DataFrame, response: str = "response", gt: str = "gold",
                   gold_valid: str = "gold_valid", gold_numbers: str = "gold_numbers",
                   out: str = "reward") -> DataFrame:
    """E2.  Adds ``pred, correct, response_len, sim, reward``."""
    return reward_from_facts(response_facts(df, response, gt), gold_valid, gold_numbers, out)


def reward_from_facts(facts: DataFrame, gold_valid: str = "gold_valid", gold_numbers: str = "gold_numbers", out: str = "reward") -> DataFrame:
    """E2 of ``response_facts`` joined with ``gold_facts``: adds ``sim, reward``."""
    gv = F.coalesce(F.col(gold_valid), F.lit(False))
    need_sim = gv & (F.col("response_len") > 200) & F.col("pred").isNotNull()
    gold_set = F.col(gold_numbers)
    inter = F.size(F.array_intersect(gold_set, F.col("_numbers")))
    sim = F.when(need_sim, F.when(F.size(gold_set) > 0, inter / F.size(gold_set)).otherwise(F.lit(0.0)))
    facts = facts.withColumn("sim", sim.cast("double"))
    n, ok, s, steps = F.col("response_len"), F.col("correct"), F.coalesce(F.col("sim"), F.lit(0.0)), F.col("_steps")
    ladder = (F.when(F.col("pred").isNull(), -1.0)
              .when(ok & (n < 100), 0.1)
              .when(ok & (n < 300), 0.6)
              .when(ok & gv & (s > 0.5), F.lit(1.0) + F.lit(0.2) * s)
              .when(ok, 1.0)
              .when(gv & (n > 200) & (s >= 0.7), -0.1)
              .when(gv & (n > 200) & (s >= 0.4), -0.3)
              .when(gv & (n > 200) & (s >= 0.1) & steps, -0.5)
              .when(gv & (n > 200), -0.6)
              .when((n > 200) & steps, -0.6)
              .when(n > 200, -0.75)
              .otherwise(-1.0))
    return facts.withColumn(out, ladder.cast("double")).drop("_steps", "_numbers")


def reward_3level(df: DataFrame, response: str = "response", gt: str = "gold",
                  out: str = "reward") -> DataFrame:
    """+1 correct, -0.5 wrong with a boxed answer, -1 no box."""
    d = A.add_answers_match(A.add_boxed_first(df, F.col(response), "pred"), F.col("pred"), F.col(gt), "_ok")
    return d.withColumn(out, F.when(F.col("pred").isNull(), REWARD_3LEVEL["no_box"])
                        .when(F.col("_ok"), REWARD_3LEVEL["correct"])
                        .otherwise(REWARD_3LEVEL["wrong"]).cast("double")).drop("_ok")


def judged_rule_table(spark) -> DataFrame:
    """The 14-row (class, answer_correct) -> reward table; broadcast-sized."""
    rows = []
    for cls, (ok, bad) in JUDGED_TABLE.items():
        rows.append((cls, True, ok))
        rows.append((cls, False, bad))
    return spark.createDataFrame(rows, "reasoning_class string, answer_correct boolean, judged_reward double")


def judge_key(gold_md5, solution) -> F.Column:
    """C18 cache key over whole texts: md5(md5(gold) || '||' || md5(solution))."""
    return F.md5(F.concat(gold_md5, F.lit("||"), F.md5(solution)))


def judge_inputs(problems: DataFrame, key: str = "problem_id", gold: str = "gold_solution") -> DataFrame:
    """Per problem, the only gold facts E3 needs: validity and the
    hash that enters the cache key -- so the long gold text is scanned once
    per problem and never joined to the rollouts."""
    g = F.col(gold)
    return problems.select(key, is_valid_gold(g).alias("gold_valid"), F.md5(g).alias("gold_md5"))


def reward_judged(df: DataFrame, verdicts: DataFrame, response: str = "response",
                  gt: str = "gold", gold: str = "gold_solution", out: str = "reward",
                  gold_valid: str | None = None, gold_md5: str | None = None) -> DataFrame:
    """E3.  ``verdicts(key, reasoning_class)`` is the judge's table keyed by
    C18; our own answer match overrides the judge's correctness; a missing
    verdict counts as ``wrong_approach``; an unknown class with a correct
    answer gives 0.05 (the reference returns None there).  The answer is read
    after the think block is removed (D2); lengths are of the whole response.  Pass
    ``gold_valid``/``gold_md5`` (see ``judge_inputs``) to avoid carrying
    the gold text."""
    spark = df.sparkSession
    r = F.col(response)
    d = A.add_boxed_first(df.withColumn("_spoken", A.strip_think(r)), F.col("_spoken"), "pred").drop("_spoken")
    d = A.add_answers_match(d, F.col("pred"), F.col(gt), "correct")
    ok_col = F.col(gold_valid) if gold_valid else is_valid_gold(F.col(gold))
    gold_hash = F.col(gold_md5) if gold_md5 else F.md5(F.col(gold))
    d = (d.withColumn("response_len", F.length(r))
           .withColumn("_gold_ok", ok_col)
           .withColumn("_key", judge_key(gold_hash, r)))
    v = verdicts.select(F.col("key").alias("_key"), F.col("reasoning_class").alias("_cls")).dropDuplicates(["_key"])
    d = d.join(v, "_key", "left")
    rules = judged_rule_table(spark)
    d = d.withColumn("_cls", F.coalesce(F.col("_cls"), F.lit("wrong_approach")))
    d = d.join(F.broadcast(rules), (d["_cls"] == rules["reasoning_class"]) & (d["correct"] == rules["answer_correct"]), "left")
    ok, n = F.col("correct"), F.col("response_len")
    ladder = (F.when(F.col("pred").isNull(), 0.0)
              .when(n < 400, F.when(ok, 0.05).otherwise(0.0))
              .when(~F.col("_gold_ok"), F.when(ok, 0.6).otherwise(0.05))
              .otherwise(F.coalesce(F.col("judged_reward"), F.when(ok, 0.05).otherwise(0.0))))
    return (d.withColumn(out, ladder.cast("double"))
             .drop("_key", "_gold_ok", "reasoning_class", "answer_correct", "judged_reward")
             .withColumnRenamed("_cls", "judge_class"))


def group_stats(df: DataFrame, group: str = "problem_id", reward: str = "reward") -> DataFrame:
    """Per group: n, mean, sample std, distinct rewards (partial+final aggregate)."""
    return df.groupBy(group).agg(
        F.count(reward).alias("n"),
        F.avg(reward).alias("reward_mean"),
        F.stddev_samp(reward).alias("reward_std"),
        F.min(reward).alias("reward_min"),
        F.max(reward).alias("reward_max"),
    )


def group_advantage(df: DataFrame, group: str = "problem_id", reward: str = "reward",
                    out: str = "advantage") -> DataFrame:
    """(r - mean) / std within the group; std 0 or undefined -> 0 and
    ``zero_variance`` = true.  Stats aggregate + equi-join back (skew-splittable)."""
    st = group_stats(df, group, reward).select(group, "reward_mean", "reward_std", "reward_min", "reward_max")
    j = df.join(st, group)
    zero = F.col("reward_min") == F.col("reward_max")
    adv = F.when(zero | F.col("reward_std").isNull() | (F.col("reward_std") == 0), F.lit(0.0)) \
           .otherwise((F.col(reward) - F.col("reward_mean")) / F.col("reward_std"))
    return j.withColumn(out, adv).withColumn("zero_variance", zero).drop("reward_min", "reward_max")


def zero_variance_groups(df: DataFrame, group: str = "problem_id", reward: str = "reward",
                         tier: str | None = None) -> DataFrame:
    """E5: per tier (or overall) the number of groups whose rewards all agree."""
    per = df.groupBy(group, *( [tier] if tier else [] )).agg(
        (F.min(reward) == F.max(reward)).alias("zero_var"))
    keys = [tier] if tier else []
    return per.groupBy(*keys).agg(
        F.count("*").alias("groups"),
        F.sum(F.col("zero_var").cast("int")).cast("bigint").alias("zero_variance_groups"),
        F.round(F.avg(F.col("zero_var").cast("double")), 6).alias("zero_variance_share"))


def reward_monitor(df: DataFrame, step: str = "step", reward: str = "reward",
                   kl: str | None = None, kl_max: float = 0.5) -> DataFrame:
    """Mean and std per step with alerts (std > 0 wanted, kl < kl_max)."""
    aggs = [F.count(reward).alias("n"), F.round(F.avg(reward), 6).alias("reward_mean"),
            F.round(F.stddev_samp(reward), 6).alias("reward_std")]
    if kl:
        aggs.append(F.round(F.avg(kl), 6).alias("kl_mean"))
    out = df.groupBy(step).agg(*aggs)
    out = out.withColumn("alert_no_variance", F.coalesce(F.col("reward_std"), F.lit(0.0)) == 0)
    if kl:
        out = out.withColumn("alert_kl", F.col("kl_mean") >= kl_max)
    return out


def reward_with_pandas(df: DataFrame, fn, cols: list[str], out: str = "reward") -> DataFrame:
    """A user's own Python reward: ``fn(pandas.DataFrame) ->
    pandas.Series`` over ``cols``, run as a vectorised ``pandas_udf`` on
    Arrow batches.  None of the built-in rewards needs it."""
    @F.pandas_udf("double")
    def _udf(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(fn(batch), dtype="float64")

    return df.withColumn(out, _udf(F.struct(*[F.col(c) for c in cols])))
