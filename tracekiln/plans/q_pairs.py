"""Registered queries: judged reward (E3) and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate as C
from ..operators import pairs as P
from ..operators import rewards as R
from ..oracle import sqlfn as S
from ..oracle.fixtures_sql import with_views
from ..sources import fixtures as FX
from .registry import ORACLE, register

_RULES = ", ".join(f"('{c}', true, {ok}), ('{c}', false, {bad})" for c, (ok, bad) in R.JUDGED_TABLE.items())

# every third rollout opens with a think block that holds a box of its own
_THOUGHT = '<parameter name="think">so \\boxed{9}</parameter> '

_E3 = with_views("problems", "attempts", "verdicts", extra=f"""
spoken AS (SELECT *, CASE WHEN attempt_id % 3 = 0 THEN '{_THOUGHT}' ELSE '' END || response AS said FROM attempts),
f AS (SELECT a.problem_id, a.attempt_id, a.response, a.gold,
             {S.d1("regexp_replace(a.said, '(?s)<parameter name=" + chr(34) + "think" + chr(34) + ">.*?</parameter>', '', 'g')")} AS pred,
             length(a.said) AS len, {S.valid_gold('p.gold_solution')} AS gok,
             md5(md5(p.gold_solution) || '||' || md5(a.said)) AS key
      FROM spoken a JOIN problems p ON a.problem_id = p.problem_id),
f2 AS (SELECT *, {S.d12('pred', 'gold')} AS correct FROM f),
j AS (SELECT f2.*, coalesce(v.reasoning_class, 'wrong_approach') AS cls FROM f2 LEFT JOIN verdicts v ON f2.key = v.key),
rules(rc, ac, rw) AS (VALUES {_RULES}),
jr AS (SELECT j.*, rules.rw FROM j LEFT JOIN rules ON j.cls = rules.rc AND j.correct = rules.ac)""") + """
SELECT problem_id, attempt_id, cls AS judge_class,
  CAST(CASE WHEN pred IS NULL THEN 0.0
       WHEN len < 400 THEN CASE WHEN correct THEN 0.05 ELSE 0.0 END
       WHEN NOT gok THEN CASE WHEN correct THEN 0.6 ELSE 0.05 END
       ELSE coalesce(rw, CASE WHEN correct THEN 0.05 ELSE 0.0 END) END AS double) AS reward
FROM jr"""


@register("e3_reward_judged", _E3)
def e3_reward_judged(spark, sf):
    thought = F.when(F.col("attempt_id") % 3 == 0, F.lit(_THOUGHT)).otherwise(F.lit(""))
    a = (FX.attempts(spark, sf).withColumn("response", F.concat(thought, "response"))
         .join(R.judge_inputs(FX.problems(spark, sf)), "problem_id"))
    r = R.reward_judged(a, FX.verdicts(spark, sf), gold_valid="gold_valid", gold_md5="gold_md5")
    return r.select("problem_id", "attempt_id", "judge_class", "reward")


_PREFIX_SQL = S.q(C.PROMPT_PREFIX.replace("\n", "<NL>")).replace("<NL>", "' || chr(10) || '")


def _facts_cte() -> str:
    return f"""fa AS (SELECT problem_id, attempt_id, {S.d13(S.d3('response'), 'gold')} AS ok FROM attempts)"""


def _mat_sql() -> str:
    return f"""mat AS (
  SELECT d.problem_id, d.outcome, d.chosen_id, d.rejected_id, {_PREFIX_SQL} || p.problem AS prompt,
    CASE WHEN d.outcome = 'pair' THEN
      CASE WHEN d.chosen_id = -1 THEN
        CASE WHEN coalesce(length(p.gold_solution), 0) > 0 THEN p.gold_solution
             ELSE '{chr(92)}boxed{{' || g.gold || '}}.' END
      ELSE ca.response END END AS chosen,
    CASE WHEN d.outcome = 'pair' THEN ra.response END AS rejected
  FROM dec d JOIN problems p ON d.problem_id = p.problem_id
  JOIN (SELECT DISTINCT problem_id, gold FROM attempts) g ON d.problem_id = g.problem_id
  LEFT JOIN attempts ca ON ca.problem_id = d.problem_id AND ca.attempt_id = d.chosen_id
  LEFT JOIN attempts ra ON ra.problem_id = d.problem_id AND ra.attempt_id = d.rejected_id)"""


_OUT = """SELECT problem_id, outcome, chosen_id, rejected_id, md5(prompt) AS prompt_md5,
  md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5 FROM mat"""


def _out(df):
    return df.select("problem_id", "outcome", "chosen_id", "rejected_id", F.md5("prompt").alias("prompt_md5"),
                     F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


_E7 = with_views("problems", "attempts", extra=_facts_cte() + """,
dec AS (SELECT problem_id, CASE WHEN ok THEN 'skip' ELSE 'pair' END AS outcome,
               CASE WHEN NOT ok THEN cast(-1 AS bigint) END AS chosen_id,
               CASE WHEN NOT ok THEN attempt_id END AS rejected_id FROM fa WHERE attempt_id = 0),
""" + _mat_sql()) + _OUT


@register("e7_pairs_vs_gold", _E7.replace("'\\boxed{' || g.gold", "'The answer is \\boxed{' || g.gold"))
def e7_pairs_vs_gold(spark, sf):
    return _out(P.pairs_vs_gold(FX.attempts(spark, sf), FX.problems(spark, sf)))


_PIV = """pv AS (SELECT f.problem_id,
  max(CASE WHEN f.attempt_id = 0 THEN f.ok END) AS ok_a, max(CASE WHEN f.attempt_id = 1 THEN f.ok END) AS ok_b,
  max(CASE WHEN f.attempt_id = 0 THEN s.score END) AS score_a, max(CASE WHEN f.attempt_id = 1 THEN s.score END) AS score_b
  FROM fa f LEFT JOIN judge_scores s ON f.problem_id = s.problem_id AND f.attempt_id = s.attempt_id
  WHERE f.attempt_id IN (0, 1) GROUP BY f.problem_id)"""

_E8 = with_views("problems", "attempts", "judge_scores", extra=_facts_cte() + ",\n" + _PIV + """,
pv2 AS (SELECT *, coalesce(score_a, 1.0) AS sa, coalesce(score_b, 1.0) AS sb FROM pv),
dec AS (SELECT problem_id,
  CASE WHEN ok_a AND ok_b AND NOT abs(sa - sb) >= 0.2 THEN 'skip' ELSE 'pair' END AS outcome,
  cast(CASE WHEN ok_a AND NOT ok_b THEN 0 WHEN ok_b AND NOT ok_a THEN 1 WHEN NOT ok_a AND NOT ok_b THEN -1
       WHEN abs(sa - sb) >= 0.2 THEN CASE WHEN sa > sb THEN 0 ELSE 1 END END AS bigint) AS chosen_id,
  cast(CASE WHEN ok_a AND NOT ok_b THEN 1 WHEN ok_b AND NOT ok_a THEN 0 WHEN NOT ok_a AND NOT ok_b THEN 0
       WHEN abs(sa - sb) >= 0.2 THEN CASE WHEN sa > sb THEN 1 ELSE 0 END END AS bigint) AS rejected_id
  FROM pv2),
""" + _mat_sql()) + _OUT


@register("e8_pairs_two_way", _E8.replace("'\\boxed{' || g.gold", "'The answer is \\boxed{' || g.gold"))
def e8_pairs_two_way(spark, sf):
    return _out(P.pairs_two_way(FX.attempts(spark, sf), FX.problems(spark, sf), FX.judge_scores(spark, sf)))


_E9 = with_views("problems", "attempts", "judge_scores", extra=_facts_cte() + """,
fs AS (SELECT f.problem_id, f.attempt_id, coalesce(s.score, CASE WHEN f.ok THEN 1.0 ELSE 0.0 END) AS sc
       FROM fa f LEFT JOIN judge_scores s ON f.problem_id = s.problem_id AND f.attempt_id = s.attempt_id),
pv AS (SELECT problem_id, max(CASE WHEN attempt_id = 0 THEN sc END) AS sa, max(CASE WHEN attempt_id = 1 THEN sc END) AS sb
       FROM fs WHERE attempt_id IN (0, 1) GROUP BY problem_id),
pv2 AS (SELECT *, sa < 0.3 AND sb < 0.3 AS both_low FROM pv),
pv3 AS (SELECT *, NOT both_low AND abs(sa - sb) < 0.1 AS too_close FROM pv2),
dec AS (SELECT problem_id, CASE WHEN too_close THEN 'skip' ELSE 'pair' END AS outcome,
  cast(CASE WHEN both_low THEN -1 WHEN NOT too_close THEN CASE WHEN sa > sb THEN 0 ELSE 1 END END AS bigint) AS chosen_id,
  cast(CASE WHEN both_low THEN CASE WHEN sa <= sb THEN 0 ELSE 1 END
            WHEN NOT too_close THEN CASE WHEN sa > sb THEN 1 ELSE 0 END END AS bigint) AS rejected_id FROM pv3),
""" + _mat_sql()) + _OUT


@register("e9_pairs_by_score", _E9.replace("'\\boxed{' || g.gold", "'The answer is \\boxed{' || g.gold"))
def e9_pairs_by_score(spark, sf):
    return _out(P.pairs_by_score(FX.attempts(spark, sf), FX.problems(spark, sf), FX.judge_scores(spark, sf)))


_E10 = _E8.replace(_OUT, "") + """, allp AS (
  SELECT 'two_way' AS policy, outcome FROM mat
  UNION ALL SELECT 'vs_gold', CASE WHEN ok THEN 'skip' ELSE 'pair' END FROM fa WHERE attempt_id = 0)
SELECT policy, count(*) FILTER (WHERE outcome = 'pair') AS pairs, count(*) FILTER (WHERE outcome = 'skip') AS skipped,
  count(*) AS problems FROM allp GROUP BY policy"""


@register("e10_pair_stats", _E10.replace("'\\boxed{' || g.gold", "'The answer is \\boxed{' || g.gold"))
def e10_pair_stats(spark, sf):
    a, p, s = FX.attempts(spark, sf), FX.problems(spark, sf), FX.judge_scores(spark, sf)
    two = P.pairs_two_way(a, p, s).select(F.lit("two_way").alias("policy"), "outcome")
    one = P.pairs_vs_gold(a, p).select(F.lit("vs_gold").alias("policy"), "outcome")
    return P.pair_stats(two.unionByName(one), ["policy"])


@register("e10_pair_errors", with_views("problems", "attempts", "judge_scores", extra=_facts_cte() + """,
here AS (SELECT * FROM fa WHERE attempt_id <> 1 OR problem_id % 5 <> 0),
sc AS (SELECT f.*, coalesce(s.score, 1.0) AS s2, coalesce(s.score, CASE WHEN f.ok THEN 1.0 ELSE 0.0 END) AS s3
  FROM here f LEFT JOIN judge_scores s ON f.problem_id = s.problem_id AND f.attempt_id = s.attempt_id WHERE f.attempt_id IN (0, 1)),
two AS (SELECT problem_id, count(*) AS k, bool_and(ok) AS both_ok, max(s2) - min(s2) AS d2, max(s3) AS top, max(s3) - min(s3) AS d3
  FROM sc GROUP BY problem_id),
allp AS (SELECT 'two_way' AS policy, CASE WHEN k < 2 THEN 'error' WHEN both_ok AND d2 < 0.2 THEN 'skip' ELSE 'pair' END AS outcome FROM two
  UNION ALL SELECT 'by_score', CASE WHEN k < 2 THEN 'error' WHEN top >= 0.3 AND d3 < 0.1 THEN 'skip' ELSE 'pair' END FROM two)
SELECT policy, count(*) FILTER (WHERE outcome = 'pair') AS pairs, count(*) FILTER (WHERE outcome = 'skip') AS skipped,
  count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) AS problems FROM allp GROUP BY policy"""))
def e10_pair_errors(spark, sf):
    """E10 with its error counter: every fifth problem has lost its second attempt."""
    a, p, s = FX.attempts(spark, sf), FX.problems(spark, sf), FX.judge_scores(spark, sf)
    a = a.where((F.col("attempt_id") != 1) | (F.col("problem_id") % 5 != 0))
    two = P.pairs_two_way(a, p, s).select(F.lit("two_way").alias("policy"), "outcome")
    one = P.pairs_by_score(a, p, s).select(F.lit("by_score").alias("policy"), "outcome")
    return P.pair_stats(two.unionByName(one), ["policy"], errors=True)


@register("a9_write_pairs", "SELECT prompt_md5, chosen_md5, rejected_md5 FROM (" + ORACLE["e7_pairs_vs_gold"] + ") WHERE outcome = 'pair'")
def a9_write_pairs(spark, sf):
    """Pairs as JSON lines, read back."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources import readers as RD
    path = f"{ensure_checkpoint_dir(spark)}/roundtrip/a9_{uuid.uuid4().hex}.jsonl"
    pairs = P.pairs_vs_gold(FX.attempts(spark, sf), FX.problems(spark, sf))
    RD.write_pairs(pairs.where("outcome = 'pair'"), path)
    back = RD.read_any(spark, path)
    return back.select(F.md5("prompt").alias("prompt_md5"), F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))
