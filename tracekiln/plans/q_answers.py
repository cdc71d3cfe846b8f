"""Registered queries for answer extraction and equivalence (D family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import sql as SQ
from ..oracle import sqlfn as S
from ..oracle.fixtures_sql import with_views
from ..sources import fixtures as FX
from .registry import register

_ATT = with_views("attempts")


@register("d1_extract_boxed_first", _ATT + f"SELECT problem_id, attempt_id, {S.d1('response')} AS pred FROM attempts")
def d1_extract_boxed_first(spark, sf):
    a = FX.attempts(spark, sf)
    return A.add_boxed_first(a, F.col("response"), "pred").select("problem_id", "attempt_id", "pred")


@register("d3_extract_boxed_last", _ATT + f"SELECT problem_id, attempt_id, {S.d3('response')} AS pred_last FROM attempts")
def d3_extract_boxed_last(spark, sf):
    a = FX.attempts(spark, sf)
    return a.select("problem_id", "attempt_id", A.extract_boxed_last(F.col("response")).alias("pred_last"))


@register("d4_boxed_int_scan", _ATT + f"SELECT problem_id, attempt_id, {S.d4('response')} AS answer FROM attempts")
def d4_boxed_int_scan(spark, sf):
    a = FX.attempts(spark, sf)
    return a.select("problem_id", "attempt_id", A.boxed_int_scan(F.col("response")).alias("answer"))


def _last_word_int(x: str, digits: str = "+") -> str:
    """last ``\\b(\\d{digits})\\b`` via a greedy prefix (RE2 has no \\b on
    the Python definition; ASCII word characters here)."""
    pat = rf"^[\s\S]*(?:^|[^0-9A-Za-z_])([0-9]{digits})(?:$|[^0-9A-Za-z_])"
    return f"nullif(regexp_extract({x}, {S.q(pat)}, 1), '')"


def _d5_sql(x: str):
    boxed = f"regexp_extract_all({x}, {S.q(S.BOXED)}, 1)"
    clean = "replace(" + S.strip("m") + ", ',', '')"
    vals = (f"list_filter(list_transform(list_reverse({boxed}), lambda m: "
            f"{S.trunc_in_range(S.num(clean))}), lambda v: v IS NOT NULL)")
    vb = f"{vals}[1]"
    pats = [r"(?:the\s+)?answer\s+is\s+([0-9]+)", r"answer:\s*([0-9]+)", r"= ([0-9]+)\s*$",
            r"equals?\s+([0-9]+)", r"is\s+([0-9]+)\s*\."]
    phrase = []
    for p in pats:
        m = S.last_match(f"lower({x})", p)
        d = f"try_cast({m} AS decimal(38,0))"
        phrase.append(f"(CASE WHEN {d} >= 0 AND {d} <= 99999 THEN cast({d} AS bigint) END)")
    vp = "coalesce(" + ", ".join(phrase) + ")"
    lines = f"string_split({S.strip(x)}, chr(10))"
    tail = f"list_reverse(list_slice({lines}, greatest(len({lines}) - 4, 1), len({lines})))"
    lv = (f"list_filter(list_transform({tail}, lambda ln: try_cast({_last_word_int('ln', '{1,5}')} AS bigint)), "
          f"lambda v: v IS NOT NULL)[1]")
    return vb, vp, lv


def _d5_query():
    vb, vp, lv = _d5_sql("response")
    return with_views("attempts", extra=f"c AS (SELECT problem_id, attempt_id, {vb} AS vb, {vp} AS vp, {lv} AS vl FROM attempts)") + """
SELECT problem_id, attempt_id,
       coalesce(vb, vp, vl) AS value,
       CASE WHEN vb IS NOT NULL THEN 'boxed' WHEN vp IS NOT NULL THEN 'text_pattern'
            WHEN vl IS NOT NULL THEN 'last_int' END AS source
FROM c"""


@register("d5_answer_cascade", _d5_query())
def d5_answer_cascade(spark, sf):
    a = FX.attempts(spark, sf)
    c = a.select("problem_id", "attempt_id", A.answer_cascade(F.col("response")).alias("c"))
    return c.select("problem_id", "attempt_id", "c.value", "c.source")


def _d7_sql(x: str) -> str:
    raw = f"regexp_replace({S.strip(S.last_match(x, S.BOXED))}, '[$,\\t\\n\\v\\f\\r ]', '', 'g')"
    fr = r"^\\frac\{([0-9]+)\}\{([0-9]+)\}"
    num = f"try_cast(regexp_extract({raw}, {S.q(fr)}, 1) AS decimal(38,0))"
    den = f"try_cast(regexp_extract({raw}, {S.q(fr)}, 2) AS decimal(38,0))"
    return (f"(CASE WHEN regexp_matches({raw}, {S.q(fr)}) THEN "
            f"(CASE WHEN {den} <> 0 AND {num} % {den} = 0 THEN cast({num} / {den} AS bigint) END) "
            f"ELSE {S.trunc_in_range(S.num(raw), 0, 999999)} END)")


@register("d7_eval_extract", _ATT + f"SELECT problem_id, attempt_id, {_d7_sql('response')} AS eval_answer FROM attempts")
def d7_eval_extract(spark, sf):
    a = FX.attempts(spark, sf)
    return a.select("problem_id", "attempt_id", A.eval_extract(F.col("response")).alias("eval_answer"))


def _d8_sql(x: str) -> str:
    m = f"list_extract(list_filter(regexp_extract_all({x}, 'oxed\\{{(.*?)\\}}', 1), lambda t: t <> ''), -1)"
    v = f"try_cast({m} AS decimal(38,0))"
    return (f"(CASE WHEN regexp_matches({m}, '^[\\t\\n\\v\\f\\r ]*[+-]?[0-9]+[\\t\\n\\v\\f\\r ]*$') "
            f"AND {v} >= 0 AND {v} <= 99999 THEN cast({v} AS bigint) END)")


@register("d8_stream_boxed", _ATT + f"SELECT problem_id, attempt_id, {_d8_sql('response')} AS stream_answer FROM attempts")
def d8_stream_boxed(spark, sf):
    a = FX.attempts(spark, sf)
    return a.select("problem_id", "attempt_id", A.stream_boxed(F.col("response")).alias("stream_answer"))


_NORM_SQL = _ATT + f""", p AS (SELECT problem_id, attempt_id, gold, {S.d1('response')} AS pred FROM attempts)
SELECT problem_id, attempt_id, {S.d9('pred')} AS pred_norm, {S.d10(S.d9('pred'))} AS pred_number,
       {S.d9('gold')} AS gold_norm FROM p"""


@register("d9_d10_normalize_to_number", _NORM_SQL.replace(_ATT + ",", _ATT.rstrip() + ",", 1))
def d9_d10_normalize_to_number(spark, sf):
    a = A.add_boxed_first(FX.attempts(spark, sf), F.col("response"), "pred")
    n = a.withColumn("pred_norm", A.normalize_answer(F.col("pred")))
    return n.select("problem_id", "attempt_id", "pred_norm",
                    A.to_number(F.col("pred_norm")).alias("pred_number"),
                    A.normalize_answer(F.col("gold")).alias("gold_norm"))


_MATCH_SQL = _ATT.rstrip() + f""", p AS (SELECT problem_id, attempt_id, gold, {S.d1('response')} AS pred, {S.d3('response')} AS pred_last FROM attempts)
SELECT problem_id, attempt_id, {S.d12('pred', 'gold')} AS correct, {S.d12('pred_last', 'gold')} AS correct_last,
       {S.d13('pred_last', 'gold')} AS simple_match FROM p"""


@register("d12_answers_match", _MATCH_SQL)
def d12_answers_match(spark, sf):
    """D11-D13 on every rollout: first-boxed and last-boxed answers vs gold."""
    a = FX.attempts(spark, sf)
    a = A.add_boxed_first(a, F.col("response"), "pred") \
        .withColumn("pred_last", A.extract_boxed_last(F.col("response")))
    a = A.add_answers_match(a, F.col("pred"), F.col("gold"), "correct")
    a = A.add_answers_match(a, F.col("pred_last"), F.col("gold"), "correct_last")
    return a.select("problem_id", "attempt_id", "correct", "correct_last",
                    A.check_simple(F.col("pred_last"), F.col("gold")).alias("simple_match"))


_EXP_SQL = with_views("problems", "attempts").rstrip() + f""", g AS (SELECT DISTINCT problem_id, gold FROM attempts)
SELECT p.problem_id, p.expected_answer, {S.d12('p.expected_answer', 'g.gold')} AS matches_gold,
       {S.d10(S.d9('p.expected_answer'))} AS expected_number
FROM problems p JOIN g ON p.problem_id = g.problem_id"""


@register("d12_expected_vs_gold", _EXP_SQL)
def d12_expected_vs_gold(spark, sf):
    """D12 on mixed answer forms (3.5, x+1, -7, large ints) vs the integer gold."""
    p = FX.problems(spark, sf).select("problem_id", "expected_answer")
    g = FX.attempts(spark, sf).select("problem_id", "gold").dropDuplicates(["problem_id"])
    j = A.add_answers_match(p.join(g, "problem_id"), F.col("expected_answer"), F.col("gold"), "matches_gold")
    return j.select("problem_id", "expected_answer", "matches_gold",
                    A.to_number(A.normalize_answer(F.col("expected_answer"))).alias("expected_number"))


def _d14_sql(x):
    raw = f"replace(replace({S.strip(S.last_match(x, S.BOXED))}, ',', ''), ' ', '')"
    d = S.num(raw)
    iv = f"(CASE WHEN {d} > -9.2e18 AND {d} < 9.2e18 THEN cast(trunc({d}) AS bigint) END)"
    kind = f"(CASE WHEN {raw} IS NULL THEN 'none' WHEN {iv} IS NOT NULL THEN 'integer' ELSE 'string' END)"
    return kind, iv


_K, _IV = _d14_sql("response")


@register("d14_answer_type", _ATT + f"SELECT {_K} AS kind, count(*) AS n, count(DISTINCT {_IV}) AS distinct_values FROM attempts GROUP BY 1")
def d14_answer_type(spark, sf):
    a = FX.attempts(spark, sf).select(A.answer_type(F.col("response")).alias("t"))
    return a.groupBy(F.col("t.kind").alias("kind")).agg(F.count("*").alias("n"),
                                                         F.countDistinct("t.value").alias("distinct_values"))


@register("l_sql_functions", with_views("attempts", extra=f"p AS (SELECT *, {S.d1('response')} AS pred FROM attempts)") + f"""
SELECT problem_id, attempt_id, pred, {S.d4('response')} AS boxed_int, {S.d9('pred')} AS normalized, {S.d12('pred', 'gold')} AS correct FROM p""")
def l_sql_functions(spark, sf):
    """2.L: the answer functions called from SQL (D1, D4, D9, D12), inlined by Catalyst."""
    SQ.register(spark)
    return spark.sql("""SELECT problem_id, attempt_id, pred, trace_boxed_int(response) AS boxed_int, trace_normalize_answer(pred) AS normalized,
      trace_answers_match(pred, gold) AS correct FROM (SELECT *, trace_boxed_first(response) AS pred FROM {a})""", a=FX.attempts(spark, sf))


@register("l_sql_table_functions", with_views("problems") + f"""SELECT problem_id, count(*) AS n, round(sum(v), 6) AS total
FROM (SELECT problem_id, unnest({S.d15('gold_solution')}) AS v FROM problems) GROUP BY problem_id""")
def l_sql_table_functions(spark, sf):
    """2.L: a table function (D15) in a lateral join."""
    SQ.register(spark)
    return spark.sql("""SELECT problem_id, count(*) AS n, round(sum(v.number), 6) AS total
      FROM {p}, LATERAL trace_numbers(gold_solution) v GROUP BY problem_id""", p=FX.problems(spark, sf))


_D15_SQL = with_views("problems") + f"""SELECT problem_id, list_sort({S.d15('gold_solution')}) AS numbers
FROM problems"""


@register("d15_extract_numbers", _D15_SQL)
def d15_extract_numbers(spark, sf):
    p = FX.problems(spark, sf)
    return p.select("problem_id", F.array_sort(A.extract_numbers(F.col("gold_solution"))).alias("numbers"))


def _gold_set_sql(g):
    final_v = f"round({S.num(S.d9(S.d1(g)))}, 4)"
    nums = S.d15(g)
    return f"(CASE WHEN {final_v} IS NULL THEN {nums} ELSE list_filter({nums}, lambda v: v <> {final_v}) END)"


_D16_SQL = with_views("problems", "attempts").rstrip() + f""", g AS (
  SELECT problem_id, {_gold_set_sql('gold_solution')} AS gset,
         {S.depth_words('gold_solution')} AS depth_words FROM problems),
r AS (SELECT a.problem_id, a.attempt_id, g.gset, g.depth_words,
             len(list_intersect(g.gset, {S.d15('a.response')})) AS hits
      FROM attempts a JOIN g ON a.problem_id = g.problem_id)
SELECT problem_id, attempt_id,
       CASE WHEN len(gset) > 0 THEN round(cast(hits AS double) / len(gset), 6) ELSE 0.0 END AS sim,
       CASE WHEN len(gset) > 0 THEN round(least(1.0, cast(hits AS double) / depth_words), 6) ELSE 0.0 END AS depth
FROM r"""


@register("d16_step_similarity", _D16_SQL)
def d16_step_similarity(spark, sf):
    p = FX.problems(spark, sf).select(
        "problem_id", "gold_solution",
        A.extract_numbers(F.col("gold_solution")).alias("gnums"),
        A.extract_boxed_first(F.col("gold_solution")).alias("gfinal"))
    a = FX.attempts(spark, sf).select("problem_id", "attempt_id",
                                      A.extract_numbers(F.col("response")).alias("rnums"))
    j = a.join(p, "problem_id")
    s = j.select("problem_id", "attempt_id",
                 A.step_similarity(F.col("rnums"), F.col("gnums"), F.col("gfinal"), F.col("gold_solution")).alias("s"))
    return s.select("problem_id", "attempt_id", F.round("s.sim", 6).alias("sim"), F.round("s.depth", 6).alias("depth"))


_MT = with_views("messages_tir")


def _d17_sql(x):
    py = f"regexp_extract({x}, '```python[\\t\\n\\v\\f\\r ]*\\n([\\s\\S]*?)```', 1)"
    anyf = f"regexp_extract({x}, '```[0-9A-Za-z_]*[\\t\\n\\v\\f\\r ]*\\n([\\s\\S]*?)```', 1)"
    return f"(CASE WHEN {py} <> '' THEN {S.strip(py)} WHEN {anyf} <> '' THEN {S.strip(anyf)} END)"


def _d18_sql(x):
    m = _last_word_int(x)
    d = f"try_cast({m} AS decimal(38,0))"
    return f"(CASE WHEN {d} >= 0 AND {d} <= 99999 THEN cast({d} AS bigint) END)"


@register("d17_d18_code_and_last_int", _MT + f"SELECT conv_id, turn, {_d17_sql('text')} AS code, {_d18_sql('text')} AS last_int FROM messages_tir")
def d17_d18_code_and_last_int(spark, sf):
    m = FX.messages_tir(spark, sf)
    return m.select("conv_id", "turn", A.extract_code(F.col("text")).alias("code"),
                    A.last_int_in_output(F.col("text")).alias("last_int"))


_D22_SQL = with_views("logprobs") + """, per_token AS (
  SELECT problem_id, attempt_id, pos, sum(CASE WHEN exp(logprob) > 0 THEN -exp(logprob) * log2(exp(logprob)) ELSE 0 END) AS h
  FROM logprobs GROUP BY problem_id, attempt_id, pos)
SELECT problem_id, attempt_id, round(avg(h), 6) AS entropy, count(*) AS tokens
FROM per_token GROUP BY problem_id, attempt_id"""


@register("d22_token_entropy", _D22_SQL.replace("\n, per_token", ", per_token").replace("WITH ", "WITH ", 1))
def d22_token_entropy(spark, sf):
    """D22 on long-form log-probabilities: -sum p log2 p per token, mean per attempt."""
    rows = FX.logprobs(spark, sf).repartition("problem_id", "attempt_id")         # one shuffle serves both aggregates
    maps = rows.groupBy("problem_id", "attempt_id", "pos").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("token").cast("string"), "logprob"))).alias("m"))       # a token's few alternatives
    per = maps.groupBy("problem_id", "attempt_id").agg(F.collect_list("m").alias("ms"), F.count("*").alias("tokens"))
    return per.select("problem_id", "attempt_id", F.round(A.token_entropy("ms"), 6).alias("entropy"), "tokens")


_D23_SQL = _MT + """SELECT conv_id,
  count(*) FILTER (WHERE role = 'tool') AS python_calls,
  count(*) FILTER (WHERE role = 'tool' AND (starts_with(text, '[ERROR]') OR contains(text, 'Traceback') OR contains(text, 'Error:'))) AS python_errors
FROM messages_tir GROUP BY conv_id"""


@register("d23_python_stats", _D23_SQL)
def d23_python_stats(spark, sf):
    """Tool calls and tool errors per conversation (conditional counts)."""
    from ..operators import profile as PR
    return PR.python_stats(FX.messages_tir(spark, sf))


_D24_SQL = """SELECT conv_id,
  coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), arg_min(text, turn)) AS problem,
  coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'),
           CASE WHEN count(*) > 1 THEN arg_max(text, turn) ELSE '' END) AS solution
FROM conversations GROUP BY conv_id"""


@register("d24_problem_solution", _D24_SQL)
def d24_problem_solution(spark, sf):
    """D24 in long form: first user turn (else first turn) and first assistant
    turn (else last turn when there are two or more)."""
    from ..sources.tables import read_table
    c = read_table(spark, sf, "conversations")
    first_user = F.min_by(F.when(F.col("role") == "user", F.col("text")),
                          F.when(F.col("role") == "user", F.col("turn")))
    first_asst = F.min_by(F.when(F.col("role") == "assistant", F.col("text")),
                          F.when(F.col("role") == "assistant", F.col("turn")))
    return c.groupBy("conv_id").agg(
        F.coalesce(first_user, F.min_by("text", "turn")).alias("problem"),
        F.coalesce(first_asst, F.when(F.count("*") > 1, F.max_by("text", "turn")).otherwise(F.lit(""))).alias("solution"))


@register("d24_nested_messages", _D24_SQL)
def d24_nested_messages(spark, sf):
    """D24 on conversations with their messages nested, as trajectory files have them."""
    from ..operators import curate as C
    from ..sources.tables import read_table
    nested = read_table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return nested.select("conv_id", C.get_problem("m").alias("problem"), C.get_solution("m").alias("solution"))


_D25_SQL = _ATT + f"""SELECT problem_id, attempt_id,
  CASE WHEN {S.d4('response')} IS NULL OR {S.d4('response')} < 0 OR {S.d4('response')} > 99999 THEN 0
       ELSE {S.d4('response')} END AS bounded,
  (coalesce({S.d4('response')}, 0) <> 0 AND entropy < 0.5) AS success
FROM attempts"""


@register("d25_bound_answer", _D25_SQL)
def d25_bound_answer(spark, sf):
    """Bounded answer (null/out of range -> 0) and the success flag with
    1 - entropy standing in for confidence."""
    a = FX.attempts(spark, sf).withColumn("answer", A.boxed_int_scan(F.col("response")))
    return a.select("problem_id", "attempt_id", A.bound_answer(F.col("answer")).alias("bounded"),
                    A.success_flag(F.col("answer"), 1 - F.col("entropy")).alias("success"))
