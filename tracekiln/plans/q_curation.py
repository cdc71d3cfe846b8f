"""Registered queries: filters and curation (B, C families) on trajectories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import problem_key, word_count
from ..operators import curate as C
from ..operators import filters as B
from ..oracle import sqlfn as S
from ..oracle.fixtures_sql import with_views
from ..sources import fixtures as FX
from . import jobs
from .registry import register

NL = "chr(10)"


def wc_sql(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '{S.WS}+'), lambda w: w <> ''))"


def compress_sql(src: str, mode: str = "v4") -> str:
    """CTEs cm_m, cm_fu, cm_parts, comp (conv_id, prompt, assistant)."""
    if mode == "v4":
        content, role = S.strip("coalesce(text, '')"), S.strip("coalesce(role, '')")
        keep, where, ctx = "AND content <> ''", f"WHERE {role} <> ''", "'[Context: '"
        ok = "prompt IS NOT NULL AND prompt <> '' AND np > 0"
    else:
        content, role = "coalesce(text, '')", "coalesce(role, '')"
        keep, where, ctx = "", "", "'[Additional context: '"
        ok = "prompt IS NOT NULL AND np > 0"
    return f"""cm_m AS (SELECT conv_id, turn, {role} AS role, {content} AS content FROM {src} {where}),
cm_fu AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'user') AS fu FROM cm_m GROUP BY conv_id),
cm_parts AS (
  SELECT m.conv_id, m.turn, m.role, m.content, f.fu,
    CASE WHEN m.role = 'assistant' {keep} THEN m.content
         WHEN m.role = 'tool' {keep} THEN {NL} || 'Output:' || {NL} || '```' || {NL} || m.content || {NL} || '```' || {NL}
         WHEN m.role = 'user' AND m.turn > f.fu {keep} THEN {NL} || {ctx} || m.content || ']' || {NL} END AS part
  FROM cm_m m JOIN cm_fu f ON m.conv_id = f.conv_id),
comp_all AS (
  SELECT conv_id, max(CASE WHEN role = 'user' AND turn = fu THEN content END) AS prompt, count(part) AS np,
         string_agg(part, {NL} ORDER BY turn) AS assistant
  FROM cm_parts GROUP BY conv_id),
comp AS (SELECT conv_id, prompt, assistant FROM comp_all WHERE {ok})"""


@register("c1_compress_v4", with_views("messages_tir", extra=compress_sql("messages_tir", "v4")) +
          "SELECT conv_id, prompt, assistant FROM comp")
def c1_compress_v4(spark, sf):
    return C.compress_messages(FX.messages_tir(spark, sf), "v4")


@register("c2_compress_v1", with_views("messages_tir", extra=compress_sql("messages_tir", "v1")) +
          "SELECT conv_id, prompt, assistant FROM comp")
def c2_compress_v1(spark, sf):
    return C.compress_messages(FX.messages_tir(spark, sf), "v1")


@register("c3_word_and_char_counts", with_views("messages_tir", extra=compress_sql("messages_tir", "v4")) + f"""
, ch AS (SELECT conv_id, cast(sum(coalesce(length(text), 0)) AS bigint) AS traj_chars FROM messages_tir GROUP BY conv_id)
SELECT c.conv_id, {wc_sql('c.assistant')} AS n_words, ch.traj_chars
FROM comp c JOIN ch ON c.conv_id = ch.conv_id""")
def c3_word_and_char_counts(spark, sf):
    m = FX.messages_tir(spark, sf)
    comp = C.compress_messages(m, "v4").select("conv_id", word_count(F.col("assistant")).alias("n_words"))
    return comp.join(C.trajectory_chars(m), "conv_id")


def _curated_sql() -> str:
    hard = "(accuracy > 0 AND accuracy < 0.5)"
    intans = (f"(regexp_matches(expected_answer, '^{S.WS}*[+-]?[0-9]+{S.WS}*$') AND "
              f"try_cast({S.strip('expected_answer')} AS decimal(38,0)) BETWEEN 0 AND 99999)")
    return with_views("messages_tir", "trajectory_meta", extra=f"""
mf AS (SELECT * FROM trajectory_meta WHERE coalesce({hard}, false) AND coalesce({intans}, false)),
msel AS (SELECT * FROM messages_tir WHERE conv_id IN (SELECT conv_id FROM mf)),
{compress_sql('msel', 'v4')},
cj AS (SELECT c.*, {wc_sql('c.assistant')} AS n_words, md5({S.strip("coalesce(c.prompt, '')")}) AS problem_key,
              m.uuid, m.data_source, m.accuracy, m.n_tools, m.expected_answer
       FROM comp c JOIN mf m ON c.conv_id = m.conv_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_key ORDER BY n_words, uuid) AS rn FROM cj)
         WHERE rn = 1),
curated AS (SELECT conv_id, prompt, assistant, n_words, problem_key, uuid, data_source, accuracy, n_tools,
  expected_answer, cast(CASE accuracy WHEN 0.125 THEN 1 WHEN 0.25 THEN 2 WHEN 0.375 THEN 3 END AS bigint) AS tier
  FROM best)""")


@register("c4_curate_sft", _curated_sql() + "SELECT * FROM curated")
def c4_curate_sft(spark, sf):
    """The v4 curated set, one row per problem."""
    return jobs.curate_sft(FX.trajectory_meta(spark, sf), FX.messages_tir(spark, sf))


@register("c5_c6_train_eval_split", _curated_sql() + """
, ord AS (SELECT conv_id, md5('42:' || uuid) AS o FROM curated),
ev AS (SELECT conv_id FROM ord ORDER BY o LIMIT 5)
SELECT conv_id, CASE WHEN conv_id IN (SELECT conv_id FROM ev) THEN 'eval' ELSE 'train' END AS split FROM curated""")
def c5_c6_train_eval_split(spark, sf):
    cur = jobs.curate_sft(FX.trajectory_meta(spark, sf), FX.messages_tir(spark, sf))
    # the split reads its input twice, so it gets the curated ids as a table
    cur = FX.as_table(cur.select("conv_id", "uuid"), sf, "curated-ids")
    tr, ev = C.train_eval_split(cur, "uuid", 5, seed=42)
    return tr.select("conv_id", F.lit("train").alias("split")).unionByName(
        ev.select("conv_id", F.lit("eval").alias("split")))


@register("c5_seeded_shuffle", _curated_sql() + """
SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || uuid)) AS place FROM curated""")
def c5_seeded_shuffle(spark, sf):
    """The whole curated set in its shuffled order; places over the sorted partitions' counts."""
    cur = jobs.curate_sft(FX.trajectory_meta(spark, sf), FX.messages_tir(spark, sf)).select("conv_id", "uuid")
    rows = C.seeded_shuffle(cur, "uuid", 42).select("conv_id", F.monotonically_increasing_id().alias("_i"))
    rows = FX.as_table(rows.withColumn("_part", F.shiftright("_i", 33)), sf, "shuffled-ids")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_c")).select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return rows.join(counts, "_part").select("conv_id", (F.col("_before") + F.col("_i").bitwiseAND((1 << 33) - 1) + 1).alias("place"))


@register("c7_c9_c10_upsample_plan", _curated_sql() + """
SELECT accuracy, count(*) AS n,
  cast(CASE accuracy WHEN 0.125 THEN 4 WHEN 0.25 THEN 2 ELSE 1 END AS bigint) AS weight,
  count(*) * cast(CASE accuracy WHEN 0.125 THEN 4 WHEN 0.25 THEN 2 ELSE 1 END AS bigint) AS rows_after
FROM curated GROUP BY accuracy""")
def c7_c9_c10_upsample_plan(spark, sf):
    cur = jobs.curate_sft(FX.trajectory_meta(spark, sf), FX.messages_tir(spark, sf))
    return C.upsample_plan(cur)


@register("c9_upsample", _curated_sql() + """
SELECT conv_id, tier, unnest(range(1, CASE accuracy WHEN 0.125 THEN 4 WHEN 0.25 THEN 2 ELSE 1 END + 1)) AS copy_no FROM curated""")
def c9_upsample(spark, sf):
    """Rows repeated by tier weight (copy number kept to make rows distinct)."""
    cur = jobs.curate_sft(FX.trajectory_meta(spark, sf), FX.messages_tir(spark, sf))
    return C.upsample(cur, copy_no="copy_no").select("conv_id", "tier", "copy_no")


@register("c8_raft_stages", with_views("messages_tir", "trajectory_meta", extra=f"""
mf AS (SELECT * FROM trajectory_meta WHERE coalesce(accuracy, 1.0) < 0.5 AND coalesce(n_tools > 0, false)),
mm AS (SELECT * FROM messages_tir WHERE conv_id IN (SELECT conv_id FROM mf)),
tu AS (SELECT conv_id FROM mm GROUP BY conv_id
       HAVING bool_or(role IN ('tool', 'ipython') OR contains(coalesce(text, ''), '```python') OR contains(coalesce(text, ''), '```py'))),
ch AS (SELECT conv_id, cast(sum(coalesce(length(text), 0)) AS bigint) AS traj_chars FROM messages_tir
       WHERE conv_id IN (SELECT conv_id FROM tu) GROUP BY conv_id),
fu AS (SELECT conv_id, arg_min(text, turn) AS problem FROM messages_tir WHERE role = 'user' GROUP BY conv_id),
base AS (SELECT m.*, ch.traj_chars, fu.problem FROM mf m JOIN ch ON m.conv_id = ch.conv_id JOIN fu ON m.conv_id = fu.conv_id WHERE fu.problem IS NOT NULL),
s1 AS (SELECT *, 1 AS stage FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(problem, '') ORDER BY traj_chars, uuid) AS rn FROM base) WHERE rn = 1),
s2 AS (SELECT *, 2 AS stage FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(problem, '') ORDER BY traj_chars, uuid) AS rn
       FROM base WHERE lower(coalesce(data_source, '')) = 'aops') WHERE rn = 1)""") +
          """SELECT conv_id, uuid, data_source, accuracy, traj_chars, cast(stage AS bigint) AS stage FROM s1
UNION ALL SELECT conv_id, uuid, data_source, accuracy, traj_chars, cast(stage AS bigint) AS stage FROM s2""")
def c8_raft_stages(spark, sf):
    r = jobs.raft_stages(FX.trajectory_meta(spark, sf), FX.messages_tir(spark, sf))
    return r.select("conv_id", "uuid", "data_source", "accuracy", "traj_chars", "stage")


@register("c11_sample_per_group", with_views("problems") + """SELECT problem_id, data_source FROM (
  SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY md5('42:' || uuid)) AS rn FROM problems) WHERE rn <= 5""")
def c11_sample_per_group(spark, sf):
    p = FX.problems(spark, sf)
    return C.sample_per_group(p, "data_source", 5, C.seeded_order(42, "uuid")).select("problem_id", "data_source")


def _think_sql(sol: str, exp: str) -> str:
    s = S.strip(sol)
    tail_re = r"(\\\[?\s*\\boxed\{[^}]+\}\s*\\\]?\s*)$"
    tail = f"regexp_extract({s}, {S.q(tail_re)}, 1)"
    reasoning = f"(CASE WHEN {tail} <> '' THEN {S.strip(f'regexp_replace({s}, {S.q(tail_re)}, {S.q(chr(39)*0)})')} ELSE {s} END)"
    inner = f"regexp_extract({tail}, {S.q(r'\\boxed\{([^}]+)\}')}, 1)"
    boxed = (f"(CASE WHEN {tail} <> '' THEN {S.q(chr(92) + 'boxed{')} || {inner} || '}}' "
             f"ELSE {S.q(chr(92) + 'boxed{')} || {exp} || '}}' END)")
    return f"'<think>' || {NL} || {reasoning} || {NL} || '</think>' || {NL} || {NL} || {boxed}"


@register("c12_think_reformat", with_views("attempts") + f"""SELECT problem_id, attempt_id,
  md5({_think_sql('response', 'gold')}) AS reformatted_md5, length({_think_sql('response', 'gold')}) AS reformatted_len FROM attempts""")
def c12_think_reformat(spark, sf):
    a = FX.attempts(spark, sf).withColumn("_r", C.think_reformat(F.col("response"), F.col("gold")))
    return a.select("problem_id", "attempt_id", F.md5("_r").alias("reformatted_md5"),
                    F.length("_r").alias("reformatted_len"))


_ROLE_SQL = """CASE WHEN coalesce(role, 'user') IN ('system', 'user', 'assistant', 'tool', 'developer') THEN coalesce(role, 'user')
  WHEN role IN ('tool_call', 'function_call') THEN 'assistant'
  WHEN role IN ('tool_response', 'function', 'ipython') THEN 'tool' ELSE 'user' END"""


@register("c13_c15_chat_format", with_views("messages_tir") + f"""SELECT conv_id,
  string_agg('<|' || ({_ROLE_SQL}) || '|>' || {NL} || coalesce(text, ''), {NL} ORDER BY turn) AS formatted
FROM messages_tir GROUP BY conv_id""")
def c13_c15_chat_format(spark, sf):
    return C.chat_format(FX.messages_tir(spark, sf))


@register("c14_prompt_wrap", with_views("problems") + f"""SELECT problem_id,
  md5({S.q(C.PROMPT_PREFIX.replace(chr(10), '<NL>'))} || problem) AS prompt_md5 FROM problems""".replace("<NL>", "' || chr(10) || '"))
def c14_prompt_wrap(spark, sf):
    p = FX.problems(spark, sf)
    return p.select("problem_id", F.md5(C.prompt_wrap(F.col("problem"))).alias("prompt_md5"))


@register("c16_assistant_mask_spans", with_views("messages_tir", extra=f"""
r AS (SELECT conv_id, turn, {_ROLE_SQL} AS role, text FROM messages_tir),
l AS (SELECT conv_id, turn, role, length('<|' || role || '|>' || {NL} || coalesce(text, '')) AS len FROM r),
s AS (SELECT *, sum(len + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS e FROM l)""") +
          """SELECT conv_id, turn, role, cast(e - len AS bigint) AS start, cast(e AS bigint) AS "end", role = 'assistant' AS train FROM s
WHERE conv_id IN (SELECT conv_id FROM s WHERE role = 'assistant')""")
def c16_assistant_mask_spans(spark, sf):
    return C.assistant_mask_spans(FX.messages_tir(spark, sf))


@register("c17_pack_sequences", """SELECT doc_id, n_chars AS length, shard,
  cast(sum(n_chars) OVER (PARTITION BY shard ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_chars AS bigint) AS "offset",
  cast(floor((sum(n_chars) OVER (PARTITION BY shard ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_chars) / 4096) AS bigint) AS bin
FROM (SELECT doc_id, n_chars, doc_id % 4 AS shard FROM documents)""")
def c17_pack_sequences(spark, sf):
    """C17 over document lengths with max_len 4096 and 4 shards (shard =
    doc_id mod 4 here so the oracle can recompute it; the default shard is a
    hash of the id)."""
    from ..sources.tables import read_table
    d = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    p = C.pack_sequences(d, "doc_id", "n_chars", 4096, 4, shard=F.col("doc_id") % 4)
    return p.select("doc_id", "length", "shard", "offset", "bin")


@register("c18_judge_requests", with_views("problems", "attempts", "verdicts") + """SELECT DISTINCT
  md5(md5(p.gold_solution) || '||' || md5(a.response)) AS key
FROM attempts a JOIN problems p ON a.problem_id = p.problem_id
WHERE md5(md5(p.gold_solution) || '||' || md5(a.response)) NOT IN (SELECT key FROM verdicts)""")
def c18_judge_requests(spark, sf):
    a = FX.attempts(spark, sf).join(FX.problems(spark, sf).select("problem_id", "gold_solution"), "problem_id")
    return C.judge_requests(a, FX.verdicts(spark, sf)).select("key")


@register("b_filter_flags", with_views("trajectory_meta", "messages_tir") + f"""
, tu AS (SELECT conv_id, bool_or(role IN ('tool', 'ipython') OR contains(coalesce(text, ''), '```python')
                                  OR contains(coalesce(text, ''), '```py')) AS has_tool_use FROM messages_tir GROUP BY conv_id)
SELECT m.conv_id,
  coalesce(m.accuracy > 0 AND m.accuracy < 0.5, false) AS hard_v4,
  coalesce(coalesce(m.accuracy, 1.0) < 0.5, false) AS hard_raft,
  coalesce(regexp_matches(m.expected_answer, '^{S.WS}*[+-]?[0-9]+{S.WS}*$') AND try_cast({S.strip('m.expected_answer')} AS decimal(38,0)) BETWEEN 0 AND 999, false) AS answer_ok,
  m.data_source = 'aops' AS is_aops, coalesce(m.n_tools > 0, false) AS tools_defined, tu.has_tool_use
FROM trajectory_meta m JOIN tu ON m.conv_id = tu.conv_id""".replace("\n, tu AS", ", tu AS", 1))
def b_filter_flags(spark, sf):
    """B1 B2 B4 B6 B7 B8 as flags per trajectory."""
    m = FX.trajectory_meta(spark, sf)
    tu = B.tool_use_by_conversation(FX.messages_tir(spark, sf))
    return m.join(tu, "conv_id").select(
        "conv_id",
        B.is_hard(F.col("accuracy")).alias("hard_v4"),
        B.is_hard(F.col("accuracy"), exclude_zero=False, missing=1.0).alias("hard_raft"),
        B.answer_in_range(F.col("expected_answer"), "strict", 0, 999).alias("answer_ok"),
        B.by_source(F.col("data_source"), "aops").alias("is_aops"),
        B.has_tools_defined(F.col("n_tools")).alias("tools_defined"),
        "has_tool_use")


_POLICY_SQL = with_views("problems") + f"""SELECT problem_id, expected_answer,
  coalesce(regexp_matches(expected_answer, '^{S.WS}*[+-]?[0-9]+{S.WS}*$') AND try_cast({S.strip('expected_answer')} AS decimal(38,0)) BETWEEN 0 AND 99999, false) AS p_strict,
  coalesce({S.num('expected_answer')} = floor({S.num('expected_answer')}) AND {S.num('expected_answer')} BETWEEN 0 AND 99999, false) AS p_integral,
  coalesce({S.num('expected_answer')} BETWEEN 0 AND 99999, false) AS p_float,
  coalesce({S.num(f"regexp_replace({S.strip('expected_answer')}, '[, ]', '', 'g')")} > -1 AND {S.num(f"regexp_replace({S.strip('expected_answer')}, '[, ]', '', 'g')")} < 100000, false) AS p_trunc,
  coalesce(regexp_matches({S.strip('expected_answer')}, '^-*[0-9]+$') AND try_cast({S.strip('expected_answer')} AS decimal(38,0)) BETWEEN 0 AND 999, false) AS p_signed_digits,
  CASE WHEN {S.num('expected_answer')} > -9.2e18 AND {S.num('expected_answer')} < 9.2e18 THEN cast(cast(trunc({S.num('expected_answer')}) AS bigint) AS varchar) END AS clean_int
FROM problems"""


@register("b4_b5_answer_policies", _POLICY_SQL)
def b4_b5_answer_policies(spark, sf):
    p = FX.problems(spark, sf)
    e = F.col("expected_answer")
    return p.select("problem_id", "expected_answer",
                    B.answer_in_range(e, "strict").alias("p_strict"),
                    B.answer_in_range(e, "integral").alias("p_integral"),
                    B.answer_in_range(e, "float").alias("p_float"),
                    B.answer_in_range(e, "trunc").alias("p_trunc"),
                    B.answer_in_range(e, "signed_digits").alias("p_signed_digits"),
                    B.clean_int_answer(e).alias("clean_int"))


@register("b9_b10_b11_b12_length_and_gold", with_views("problems") + f"""SELECT acc_high_tool AS accuracy, count(*) AS n,
  round(avg(cast(NOT {S.valid_gold('gold_solution')} AS double)), 6) AS broken_share,
  cast(sum(cast(length(gold_solution) > 100 AS integer)) AS bigint) AS longer_than_100,
  cast(sum(cast(ceil({wc_sql('gold_solution')} * 1.3) <= 2048 AS integer)) AS bigint) AS within_2048_tokens
FROM problems GROUP BY acc_high_tool""")
def b9_b10_b11_b12_length_and_gold(spark, sf):
    p = FX.problems(spark, sf).select(F.col("acc_high_tool").alias("accuracy"), "gold_solution")
    broken = B.broken_gold_rate(p)
    longer = p.groupBy("accuracy").agg(F.sum(B.min_text_len(F.col("gold_solution"), 100).cast("int")).cast("bigint").alias("longer_than_100"))
    within = B.drop_overlong(p, B.token_estimate(F.col("gold_solution")), 2048).groupBy("accuracy").agg(F.count("*").alias("within_2048_tokens"))
    same = lambda d: d.withColumnRenamed("accuracy", "_a")
    return (broken.join(same(longer), F.col("accuracy").eqNullSafe(F.col("_a"))).drop("_a")
            .join(same(within), F.col("accuracy").eqNullSafe(F.col("_a")), "left").drop("_a")
            .fillna(0, ["within_2048_tokens"]))


@register("b13_rejection_sample", with_views("attempts", extra=f"""
ok AS (SELECT problem_id, attempt_id, length(response) AS response_len FROM attempts WHERE {S.d12(S.d1('response'), 'gold')})""") +
          """SELECT problem_id, attempt_id, response_len FROM (
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY response_len, attempt_id) AS rn FROM ok) WHERE rn = 1""")
def b13_rejection_sample(spark, sf):
    return B.rejection_sample(FX.attempts(spark, sf)).select("problem_id", "attempt_id", "response_len")
