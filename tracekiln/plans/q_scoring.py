"""Registered queries: rewards, advantages, votes and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import evaluate as EV
from ..operators import rewards as R
from ..operators import votes as V
from ..oracle import sqlfn as S
from ..oracle.fixtures_sql import with_views
from ..sources import fixtures as FX
from . import jobs
from .registry import register


def _correct(df, response="response", gold="gold"):
    """Adds ``pred`` (D1) and ``correct`` (D12 vs gold), staged."""
    return A.add_answers_match(A.add_boxed_first(df, F.col(response), "pred"), F.col("pred"), F.col(gold), "correct")


def _gold_set_sql(g):
    final_v = f"round({S.num(S.d9(S.d1(g)))}, 4)"
    nums = S.d15(g)
    return f"(CASE WHEN {final_v} IS NULL THEN {nums} ELSE list_filter({nums}, lambda v: v <> {final_v}) END)"


def scored_cte() -> str:
    """CTEs ``gf``, ``f``, ``f2``, ``scored``: per-rollout E2 reward (oracle side)."""
    ladder = """CASE WHEN pred IS NULL THEN -1.0
      WHEN correct AND response_len < 100 THEN 0.1
      WHEN correct AND response_len < 300 THEN 0.6
      WHEN correct AND gv AND coalesce(sim, 0) > 0.5 THEN 1.0 + 0.2 * sim
      WHEN correct THEN 1.0
      WHEN gv AND response_len > 200 AND coalesce(sim, 0) >= 0.7 THEN -0.1
      WHEN gv AND response_len > 200 AND coalesce(sim, 0) >= 0.4 THEN -0.3
      WHEN gv AND response_len > 200 AND coalesce(sim, 0) >= 0.1 AND steps THEN -0.5
      WHEN gv AND response_len > 200 THEN -0.6
      WHEN response_len > 200 AND steps THEN -0.6
      WHEN response_len > 200 THEN -0.75
      ELSE -1.0 END"""
    return f"""gf AS (
  SELECT problem_id, {S.valid_gold('gold_solution')} AS gold_valid,
         CASE WHEN {S.valid_gold('gold_solution')} THEN {_gold_set_sql('gold_solution')} END AS gold_numbers
  FROM problems),
f AS (
  SELECT a.problem_id, a.attempt_id, a.gold, a.response, a.entropy, coalesce(g.gold_valid, false) AS gv, g.gold_numbers,
         {S.d1('a.response')} AS pred, length(a.response) AS response_len, {S.has_steps('a.response')} AS steps
  FROM attempts a LEFT JOIN gf g ON a.problem_id = g.problem_id),
f2 AS (
  SELECT *, {S.d12('pred', 'gold')} AS correct,
         CASE WHEN gv AND response_len > 200 AND pred IS NOT NULL THEN
           CASE WHEN len(gold_numbers) > 0
                THEN cast(len(list_intersect(gold_numbers, {S.d15('response')})) AS double) / len(gold_numbers)
                ELSE 0.0 END END AS sim
  FROM f),
scored AS (SELECT *, cast({ladder} AS double) AS reward FROM f2)"""


_SCORED = with_views("problems", "attempts", extra=scored_cte())


@register("e2_reward_10level", _SCORED + """SELECT problem_id, attempt_id, pred, correct, response_len,
  round(sim, 6) AS sim, round(reward, 6) AS reward FROM scored""")
def e2_reward_10level(spark, sf):
    facts = R.response_facts(FX.attempts(spark, sf)).drop("response")
    s = R.reward_from_facts(facts.join(R.gold_facts(FX.problems(spark, sf)), "problem_id", "left"))
    return s.select("problem_id", "attempt_id", "pred", "correct", "response_len",
                    F.round("sim", 6).alias("sim"), F.round("reward", 6).alias("reward"))


@register("e1_reward_3level", with_views("attempts") + f"""SELECT problem_id, attempt_id,
  cast(CASE WHEN {S.d1('response')} IS NULL THEN -1.0 WHEN {S.d12(S.d1('response'), 'gold')} THEN 1.0 ELSE -0.5 END AS double) AS reward
FROM attempts""")
def e1_reward_3level(spark, sf):
    s = R.reward_3level(FX.attempts(spark, sf))
    return s.select("problem_id", "attempt_id", "reward")


_ADV = _SCORED.rstrip() + """, st AS (
  SELECT problem_id, avg(reward) AS m, stddev_samp(reward) AS sd, min(reward) AS lo, max(reward) AS hi
  FROM scored GROUP BY problem_id)
SELECT s.problem_id, s.attempt_id, round(s.reward, 6) AS reward,
  round(CASE WHEN st.lo = st.hi OR st.sd IS NULL OR st.sd = 0 THEN 0.0 ELSE (s.reward - st.m) / st.sd END, 6) AS advantage,
  st.lo = st.hi AS zero_variance
FROM scored s JOIN st ON s.problem_id = st.problem_id"""


@register("e4_group_advantage", _ADV)
def e4_group_advantage(spark, sf):
    s = jobs.score_rollouts(FX.attempts(spark, sf), FX.problems(spark, sf))
    return s.select("problem_id", "attempt_id", F.round("reward", 6).alias("reward"),
                    F.round("advantage", 6).alias("advantage"), "zero_variance")


_ZV = _SCORED.rstrip() + """, pp AS (
  SELECT s.problem_id, min(s.reward) = max(s.reward) AS zv, any_value(p.data_source) AS data_source
  FROM scored s JOIN problems p ON s.problem_id = p.problem_id GROUP BY s.problem_id)
SELECT data_source, count(*) AS groups, cast(sum(cast(zv AS integer)) AS bigint) AS zero_variance_groups,
  round(avg(cast(zv AS double)), 6) AS zero_variance_share
FROM pp GROUP BY data_source"""


@register("e5_zero_variance_groups", _ZV)
def e5_zero_variance_groups(spark, sf):
    p = FX.problems(spark, sf).select("problem_id", "data_source")
    s = jobs.score_rollouts(FX.attempts(spark, sf), FX.problems(spark, sf)).join(p, "problem_id")
    return R.zero_variance_groups(s, "problem_id", "reward", tier="data_source")


_MON = _SCORED.rstrip() + """
SELECT attempt_id AS step, count(reward) AS n, round(avg(reward), 6) AS reward_mean,
  round(stddev_samp(reward), 6) AS reward_std, round(avg(entropy), 6) AS kl_mean,
  coalesce(round(stddev_samp(reward), 6), 0) = 0 AS alert_no_variance, round(avg(entropy), 6) >= 0.5 AS alert_kl
FROM scored GROUP BY attempt_id"""


@register("e6_reward_monitor", _MON)
def e6_reward_monitor(spark, sf):
    """E6 with the rollout index standing in for the training step and the
    entropy column for the KL term."""
    s = jobs.score_rollouts(FX.attempts(spark, sf), FX.problems(spark, sf)) \
        .withColumnRenamed("attempt_id", "step")
    return R.reward_monitor(s, "step", "reward", kl="entropy")


# ------------------------------------------------------------------ votes
_ANS = with_views("attempts", extra=f"ans AS (SELECT problem_id, attempt_id, entropy, {S.d4('response')} AS answer FROM attempts)")

_MAJ_CTE = """cnt AS (SELECT problem_id, answer, count(*) AS votes FROM ans WHERE answer IS NOT NULL GROUP BY problem_id, answer),
tot AS (SELECT problem_id, sum(votes) AS valid_votes FROM cnt GROUP BY problem_id),
win AS (SELECT problem_id, answer AS majority_answer, votes AS winner_votes FROM (
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, answer ASC) AS rn FROM cnt) WHERE rn = 1),
maj AS (
  SELECT k.problem_id, w.majority_answer, coalesce(w.winner_votes, 0) AS winner_votes,
         cast(coalesce(t.valid_votes, 0) AS bigint) AS valid_votes,
         coalesce(round(cast(w.winner_votes AS double) / t.valid_votes, 6), 0.0) AS confidence
  FROM (SELECT DISTINCT problem_id FROM ans) k LEFT JOIN win w ON k.problem_id = w.problem_id
  LEFT JOIN tot t ON k.problem_id = t.problem_id)"""


@register("g1_g2_majority_vote", _ANS.rstrip() + ",\n" + _MAJ_CTE + "\nSELECT * FROM maj")
def g1_g2_majority_vote(spark, sf):
    a = FX.attempts(spark, sf).withColumn("answer", A.boxed_int_scan(F.col("response")))
    return V.majority_vote(a)


_WVOTE = """, wc AS (SELECT problem_id, answer, count(*) AS votes, sum({w}) AS score, min(attempt_id) AS fa
  FROM ans WHERE answer IS NOT NULL GROUP BY problem_id, answer)
SELECT problem_id, answer AS voted_answer, votes, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, fa ASC) AS rn FROM wc) WHERE rn = 1"""


@register("g3_entropy_vote", _ANS.rstrip() + _WVOTE.format(
    w="CASE WHEN entropy = 'inf'::double THEN 0.0 ELSE 1.0 / greatest(entropy, 1e-9) END"))
def g3_entropy_vote(spark, sf):
    a = FX.attempts(spark, sf).withColumn("answer", A.boxed_int_scan(F.col("response")))
    return V.entropy_vote(a)


@register("g3_entropy_vote_sum", _ANS.rstrip() + _WVOTE.format(
    w="CASE WHEN entropy = 'inf'::double THEN 0.0 ELSE 1.0 / (entropy + 1e-9) END"))
def g3_entropy_vote_sum(spark, sf):
    """G3 with the weight 1/(e + 1e-9)."""
    a = FX.attempts(spark, sf).withColumn("answer", A.boxed_int_scan(F.col("response")))
    return V.entropy_vote(a, variant="sum")


_VER = with_views("attempts", extra=f"""ans AS (
  SELECT problem_id, attempt_id,
         CASE WHEN {S.d4('response')} BETWEEN 0 AND 99999 THEN {S.d4('response')} END AS answer,
         cast(('0x'||substr(md5('v:'||cast(problem_id AS varchar)||':'||cast(attempt_id AS varchar)),1,8)) AS bigint) % 7 AS verified_count,
         6 AS total_lemmas
  FROM attempts)""")


@register("g4_verified_vote", _VER.rstrip() + _WVOTE.format(w="cast(verified_count AS double) / total_lemmas + 0.1"))
def g4_verified_vote(spark, sf):
    """G4 with a per-attempt verified-lemma count (hash 0..6 of 6 lemmas)."""
    a = FX.attempts(spark, sf)
    a = a.withColumn("answer", A.boxed_int_scan(F.col("response"))) \
         .withColumn("verified_count", FX.H(FX._k("v:", F.col("problem_id"), F.col("attempt_id"))) % 7) \
         .withColumn("total_lemmas", F.lit(6))
    return V.verified_vote(a)


_MAG = _ANS.rstrip() + """, mc AS (SELECT problem_id, answer, count(*) AS votes, ln(1.25 + abs(answer)) * count(*) AS score
  FROM ans WHERE answer IS NOT NULL GROUP BY problem_id, answer),
rk AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, votes DESC, answer DESC) AS rn FROM mc),
top2 AS (SELECT problem_id, max(CASE WHEN rn = 1 THEN answer END) AS voted_answer,
  max(CASE WHEN rn = 1 THEN score END) AS top_score, max(CASE WHEN rn = 2 THEN score END) AS second_score
  FROM rk WHERE rn <= 2 GROUP BY problem_id),
tt AS (SELECT problem_id, sum(score) AS total_score, count(*) AS candidates FROM mc GROUP BY problem_id)
SELECT t.problem_id, t.voted_answer, round(t.top_score, 6) AS top_score, round(tt.total_score, 6) AS total_score,
  tt.candidates,
  coalesce(t.top_score > greatest(1.0, tt.total_score / (2 + ln(1 + tt.total_score)))
           AND (tt.candidates = 1 OR t.top_score - t.second_score > 1), false) AS decided
FROM top2 t JOIN tt ON t.problem_id = tt.problem_id"""


@register("g5_g6_magnitude_vote", _MAG)
def g5_g6_magnitude_vote(spark, sf):
    a = FX.attempts(spark, sf).withColumn("answer", A.boxed_int_scan(F.col("response")))
    return V.magnitude_vote(a)


_VT = _ANS.rstrip() + """, c AS (SELECT problem_id, answer, count(*) AS votes, sum(cast(1 AS double)) AS score FROM ans
  WHERE answer IS NOT NULL GROUP BY problem_id, answer)
SELECT problem_id, answer, votes, round(score, 3) AS score,
  rank() OVER (PARTITION BY problem_id ORDER BY round(score, 3) DESC) AS rank FROM c"""


@register("g7_vote_table", _VT)
def g7_vote_table(spark, sf):
    a = FX.attempts(spark, sf).withColumn("answer", A.boxed_int_scan(F.col("response")))
    return V.vote_table(a)


_ES = _ANS.rstrip() + """, kth AS (SELECT problem_id, min(attempt_id) AS stop_at FROM (
    SELECT *, row_number() OVER (PARTITION BY problem_id, answer ORDER BY attempt_id) AS rn
    FROM ans WHERE answer IS NOT NULL) WHERE rn = 2 GROUP BY problem_id),
kept AS (SELECT a.*, k.stop_at FROM ans a LEFT JOIN kth k ON a.problem_id = k.problem_id
  WHERE k.stop_at IS NULL OR a.attempt_id <= k.stop_at),
cnt AS (SELECT problem_id, answer, count(*) AS votes FROM kept WHERE answer IS NOT NULL GROUP BY problem_id, answer),
win AS (SELECT problem_id, answer AS majority_answer, votes AS winner_votes FROM (
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, answer ASC) AS rn FROM cnt) WHERE rn = 1),
used AS (SELECT problem_id, count(*) AS attempts_used, any_value(stop_at) AS stop_at FROM kept GROUP BY problem_id)
SELECT u.problem_id, u.stop_at, u.attempts_used, w.majority_answer, coalesce(w.winner_votes, 0) AS winner_votes
FROM used u LEFT JOIN win w ON u.problem_id = w.problem_id"""


@register("g8_early_stop_point", _ES)
def g8_early_stop_point(spark, sf):
    """G8 with k = 2 (the fixture's eight attempts rarely agree four times)."""
    a = FX.attempts(spark, sf).withColumn("answer", A.boxed_int_scan(F.col("response")))
    return V.early_stop_point(a, k=2)


@register("g8_early_stop_four", _ES.replace("WHERE rn = 2 GROUP BY", "WHERE rn = 4 GROUP BY"))
def g8_early_stop_four(spark, sf):
    """G8 at the operator's k = 4."""
    a = FX.attempts(spark, sf).withColumn("answer", A.boxed_int_scan(F.col("response")))
    return V.early_stop_point(a)


_CORR = with_views("attempts", extra=f"""cr AS (SELECT problem_id, attempt_id, gold, entropy,
  {S.d12(S.d1('response'), 'gold')} AS correct FROM attempts)""")


@register("g9_accuracy", _CORR.rstrip() + """
SELECT count(*) AS n, cast(sum(cast(correct AS integer)) AS bigint) AS n_correct,
  round(avg(cast(correct AS double)), 6) AS accuracy FROM cr WHERE gold IS NOT NULL""")
def g9_accuracy(spark, sf):
    return EV.accuracy(_correct(FX.attempts(spark, sf)))


_PK = with_views("attempts", extra=f"""ans AS (SELECT problem_id, attempt_id, gold, {S.d4('response')} AS answer,
  {S.d12(S.d1('response'), 'gold')} AS correct FROM attempts)""").rstrip() + """,
per AS (SELECT problem_id, count(*) AS n, cast(sum(cast(correct AS integer)) AS bigint) AS c, any_value(cast(gold AS bigint)) AS g
  FROM ans GROUP BY problem_id),
fk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY attempt_id) AS rn FROM ans) WHERE rn <= 4),
cnt AS (SELECT problem_id, answer, count(*) AS votes FROM fk WHERE answer IS NOT NULL GROUP BY problem_id, answer),
win AS (SELECT problem_id, answer AS majority_answer FROM (
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, answer ASC) AS rn FROM cnt) WHERE rn = 1)
SELECT p.problem_id, p.n, cast(p.c AS bigint) AS c,
  round(CASE WHEN p.n - p.c < 4 THEN 1.0 WHEN p.c = 0 THEN 0.0
        ELSE 1.0 - list_reduce(list_transform(range(p.n - p.c + 1, p.n + 1), lambda i: 1.0 - 4.0 / i), lambda x, y: x * y) END, 6) AS pass_at_4,
  coalesce(w.majority_answer = p.g, false) AS maj_at_4
FROM per p LEFT JOIN win w ON p.problem_id = w.problem_id"""


@register("g10_pass_maj_at_k", _PK)
def g10_pass_maj_at_k(spark, sf):
    a = FX.attempts(spark, sf)
    a = _correct(a.withColumn("answer", A.boxed_int_scan(F.col("response")))) \
        .withColumn("gold_int", F.col("gold").cast("bigint"))
    return EV.pass_maj_at_k(a, 4)


_CB = _ANS.rstrip() + ",\n" + _MAJ_CTE + """, g AS (SELECT DISTINCT problem_id, cast(gold AS bigint) AS gold FROM attempts),
mm AS (SELECT m.*, coalesce(m.majority_answer = g.gold, false) AS correct FROM maj m JOIN g ON m.problem_id = g.problem_id)
SELECT CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence < 0.4 THEN 'low' ELSE 'mid' END AS band,
  count(*) AS n, cast(sum(cast(correct AS integer)) AS bigint) AS n_correct, round(avg(cast(correct AS double)), 6) AS accuracy
FROM mm GROUP BY 1"""


@register("g11_confidence_breakdown", _CB)
def g11_confidence_breakdown(spark, sf):
    a = FX.attempts(spark, sf).withColumn("answer", A.boxed_int_scan(F.col("response")))
    m = V.majority_vote(a)
    g = FX.attempts(spark, sf).select("problem_id", F.col("gold").cast("bigint").alias("gold")).dropDuplicates(["problem_id"])
    mm = m.join(g, "problem_id").withColumn(
        "correct", F.coalesce(F.col("majority_answer") == F.col("gold"), F.lit(False)))
    return EV.confidence_breakdown(mm)


_G12 = _CORR.rstrip() + """, per AS (SELECT problem_id, cast(sum(cast(correct AS integer)) AS bigint) AS n_correct,
  count(*) AS n_attempts FROM cr GROUP BY problem_id)
SELECT problem_id, n_correct, n_attempts, cast(n_correct AS double) / 8 AS accuracy,
  cast(CASE cast(n_correct AS double) / 8 WHEN 0.125 THEN 1 WHEN 0.25 THEN 2 WHEN 0.375 THEN 3 END AS bigint) AS tier
FROM per"""


@register("g12_difficulty_from_rollouts", _G12)
def g12_difficulty_from_rollouts(spark, sf):
    return EV.difficulty_from_rollouts(_correct(FX.attempts(spark, sf)))


_G13 = with_views("rounds", extra=f"""cr AS (SELECT round, {S.d12(S.d1('response'), 'gold')} AS correct FROM rounds)""").rstrip() + """,
per AS (SELECT round, count(*) AS n, avg(cast(correct AS double)) AS acc FROM cr GROUP BY round)
SELECT round, n, round(acc, 6) AS accuracy, round(acc - lag(acc) OVER (ORDER BY round), 6) AS gain FROM per"""


@register("g13_round_progress", _G13)
def g13_round_progress(spark, sf):
    return EV.round_progress(_correct(FX.rounds(spark, sf)))


_FLAG = _SCORED.rstrip() + """, sa AS (SELECT *, """ + S.d4("response") + """ AS answer FROM scored),
per AS (SELECT problem_id, count(*) AS n_attempts, cast(sum(cast(correct AS integer)) AS bigint) AS n_correct,
  round(avg(reward), 6) AS reward_mean, round(stddev_samp(reward), 6) AS reward_std,
  min(reward) = max(reward) AS zero_variance FROM sa GROUP BY problem_id),
ans AS (SELECT problem_id, answer FROM sa),
""" + _MAJ_CTE + """
SELECT p.*, round(cast(p.n_correct AS double) / 8, 6) AS accuracy,
  cast(CASE cast(p.n_correct AS double) / 8 WHEN 0.125 THEN 1 WHEN 0.25 THEN 2 WHEN 0.375 THEN 3 END AS bigint) AS tier,
  m.majority_answer, m.winner_votes, m.valid_votes, m.confidence
FROM per p LEFT JOIN maj m ON p.problem_id = m.problem_id"""


@register("rollout_report", _FLAG)
def rollout_report(spark, sf):
    """Flagship: accuracy tier, reward, zero-variance flag and majority answer per problem."""
    return jobs.rollout_report(FX.attempts(spark, sf), FX.problems(spark, sf))
