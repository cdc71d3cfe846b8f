"""DuckDB statement of the derived views (FIXTURES.md section 3).

Each oracle query starts with ``WITH <views>`` built here; the base tables are
the driver's pre-registered views.  Written independently of the Spark
builders so that a mismatch shows up in the correctness check.
"""

from __future__ import annotations

BS = "\\"


def H(e: str) -> str:
    return f"cast(('0x'||substr(md5({e}),1,8)) as bigint)"


def s(col: str) -> str:
    return f"cast({col} as varchar)"


_ID = s("doc_id")
_IK = f"{s('doc_id')}||':'||{s('attempt_id')}"
_CK = f"{s('conv_id')}||':'||{s('turn')}"

VIEWS: dict[str, str] = {}

VIEWS["problems"] = f"""
problems AS (
  SELECT doc_id AS problem_id,
         md5('u:'||{_ID}) AS uuid,
         text AS problem,
         text AS gold_solution,
         CASE WHEN {H("'s:'||" + _ID)} % 6 = 0 THEN 'aops' ELSE 'stackflow' END AS data_source,
         CASE WHEN {H("'m:'||" + _ID)} % 10 = 0 THEN NULL
              ELSE cast({H("'t:'||" + _ID)} % 9 AS double) / cast(8 AS double) END AS acc_high_tool,
         CASE {H("'f:'||" + _ID)} % 8
              WHEN 0 THEN '3.5' WHEN 1 THEN 'x+1'
              WHEN 2 THEN cast({H("'g:'||" + _ID)} % 900000 AS varchar)
              WHEN 3 THEN '-7'
              ELSE cast({H("'g:'||" + _ID)} % 100000 AS varchar) END AS expected_answer
  FROM documents)"""

VIEWS["attempts"] = f"""
attempts_base AS (
  SELECT doc_id, text, cast(unnest(range(0, 8)) AS bigint) AS attempt_id FROM documents),
attempts AS (
  SELECT doc_id AS problem_id, attempt_id,
         cast({H("'g:'||" + _ID)} % 100000 AS varchar) AS gold,
         substr(text, cast({H("'l:'||" + _IK)} % 600 AS integer) + 1) ||
         substr(text, 1, cast({H("'l:'||" + _IK)} % 600 AS integer)) ||
         CASE {H("'w:'||" + _IK)} % 8
           WHEN 0 THEN ''
           WHEN 1 THEN ' the answer is ' || cast({H("'g:'||" + _ID)} % 100000 AS varchar)
           WHEN 2 THEN ' {BS}boxed{{' || cast({H("'g:'||" + _ID)} % 100000 AS varchar) || '.0}}'
           WHEN 3 THEN ' {BS}boxed{{{BS}text{{' || cast({H("'g:'||" + _ID)} % 100000 AS varchar) || '}}}}'
           WHEN 4 THEN ' {BS}boxed{{{BS}frac{{' || cast({H("'g:'||" + _ID)} % 100000 * 2 AS varchar) || '}}{{2}}}}'
           WHEN 5 THEN ' {BS}boxed{{' || cast({H("'x:'||" + _IK)} % 5 AS varchar) || '}}'
           WHEN 6 THEN ' {BS}boxed{{7}} then {BS}boxed {{$' || cast({H("'g:'||" + _ID)} % 100000 AS varchar) || '$}}'
           ELSE ' {BS}boxed{{' || cast({H("'g:'||" + _ID)} % 100000 AS varchar) || '}}'
         END AS response,
         cast({H("'e:'||" + _IK)} % 4000 + 1 AS double) / cast(1000 AS double) AS entropy
  FROM attempts_base)"""

VIEWS["messages_tir"] = f"""
messages_tir AS (
  SELECT conv_id, turn,
         CASE WHEN role = 'assistant' AND {H("'r:'||" + _CK)} % 3 = 0 THEN 'tool' ELSE role END AS role,
         text || CASE {H("'c:'||" + _CK)} % 6
                   WHEN 0 THEN chr(10) || '```python' || chr(10) || 'print(1)' || chr(10) || '```'
                   WHEN 1 THEN chr(10) || 'Traceback (most recent call last)'
                   WHEN 2 THEN ' Error: bad input'
                   WHEN 3 THEN ' {BS}boxed{{' || cast({H("'a:'||" + _CK)} % 50 AS varchar) || '}}'
                   ELSE '' END AS text
  FROM conversations)"""

_CV = s("conv_id")
VIEWS["trajectory_meta"] = f"""
trajectory_meta AS (
  SELECT conv_id,
         md5('u:'||{_CV}) AS uuid,
         CASE WHEN {H("'s:'||" + _CV)} % 6 = 0 THEN 'aops' ELSE 'stackflow' END AS data_source,
         CASE WHEN {H("'m:'||" + _CV)} % 10 = 0 THEN NULL
              ELSE cast({H("'t:'||" + _CV)} % 9 AS double) / cast(8 AS double) END AS accuracy,
         {H("'n:'||" + _CV)} % 3 AS n_tools,
         cast({H("'g:'||" + _CV)} % 1000 AS varchar) AS expected_answer
  FROM (SELECT DISTINCT conv_id FROM conversations))"""

_PK = f"{s('problem_id')}||':'||{s('attempt_id')}"
VIEWS["judge_scores"] = f"""
judge_scores AS (
  SELECT problem_id, attempt_id,
         cast({H("'j:'||" + _PK)} % 11 AS double) / cast(10 AS double) AS score
  FROM attempts WHERE {H("'k:'||" + _PK)} % 5 <> 0)"""

VIEWS["rounds"] = """
rounds AS (SELECT *, attempt_id % 3 + 1 AS round FROM attempts)"""

VIEWS["logprobs"] = f"""
logprobs_base AS (
  SELECT problem_id, attempt_id, cast(unnest(range(0, 4)) AS bigint) AS pos FROM attempts),
logprobs_p AS (
  SELECT *, cast({H("'p:'||" + _PK + "||':'||" + s('pos'))} % 99 + 1 AS double) / cast(100 AS double) AS p
  FROM logprobs_base),
logprobs AS (
  SELECT problem_id, attempt_id, pos, 'a' AS token, ln(p) AS logprob FROM logprobs_p
  UNION ALL
  SELECT problem_id, attempt_id, pos, 'b' AS token, ln(1 - p) AS logprob FROM logprobs_p)"""

VIEWS["lemmas"] = """
lemmas AS (SELECT doc_id AS problem_id, cast(unnest(range(0, 6)) AS bigint) AS lemma_id FROM documents)"""

_PD = s("problem_id")
VIEWS["lemma_edges"] = f"""
lemma_pairs AS (
  SELECT a.problem_id, a.lemma_id AS dep, b.lemma_id AS lemma_id
  FROM lemmas a JOIN lemmas b ON a.problem_id = b.problem_id AND a.lemma_id < b.lemma_id),
lemma_edges AS (
  SELECT problem_id, dep, lemma_id FROM lemma_pairs
  WHERE {H("'e:'||" + _PD + "||':'||" + s('dep') + "||':'||" + s('lemma_id'))} % 3 = 0
  UNION ALL
  SELECT doc_id, cast(5 AS bigint), cast(0 AS bigint) FROM documents WHERE {H("'c:'||" + _ID)} % 20 = 0
  UNION ALL
  SELECT doc_id, cast(99 AS bigint), cast(3 AS bigint) FROM documents WHERE {H("'v:'||" + _ID)} % 20 = 0)"""

VIEWS["verdicts"] = f"""
verdict_keys AS (
  SELECT DISTINCT md5(md5(p.gold_solution) || '||' || md5(a.response)) AS key
  FROM attempts a JOIN problems p ON a.problem_id = p.problem_id),
verdicts AS (
  SELECT key, ['complete', 'correct_approach_incomplete', 'correct_approach_wrong_execution',
               'adjacent_approach', 'wrong_approach', 'memorized', 'incoherent'][{H("'vc:'||key")} % 7 + 1] AS reasoning_class
  FROM verdict_keys WHERE {H("'vk:'||key")} % 4 <> 0)"""

DEPENDS = {
    "verdicts": ["attempts", "problems"],
    "judge_scores": ["attempts"],
    "rounds": ["attempts"],
    "logprobs": ["attempts"],
    "lemma_edges": ["lemmas"],
}


def with_views(*names: str, extra: str | None = None) -> str:
    """``WITH`` clause holding the named views (and their dependencies), plus
    optional extra CTE text appended after them."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [VIEWS[n].strip() for n in order]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
