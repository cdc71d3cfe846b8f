"""Registered queries: retrieval (K1-K3), answer resolution (D6) and JSON
replies (D20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import retrieval as K
from ..oracle import sqlfn as S
from ..oracle.fixtures_sql import with_views
from ..sources import fixtures as FX
from ..sources.tables import read_table
from .q_curation import wc_sql
from .registry import register

_EMB = """e AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS v FROM embeddings),
nv AS (SELECT vec_id, label, CASE WHEN sqrt(list_sum(list_transform(v, lambda y: y * y))) > 0
        THEN list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) END AS v FROM e),
ex AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e),
cm AS (SELECT label, pos, avg(x) AS x FROM ex GROUP BY label, pos),
cv AS (SELECT label, list(x ORDER BY pos) AS v FROM cm GROUP BY label),
c AS (SELECT cast(label AS bigint) AS query_id, label AS query_group,
        list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS q FROM cv)"""


@register("k1_topk_similar", f"""WITH {_EMB},
s AS (SELECT c.query_id, nv.vec_id, list_dot_product(c.q, nv.v) AS score FROM c, nv),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def k1_topk_similar(spark, sf):
    """K1: the five vectors closest to each domain centroid (exact inner
    product on normalised vectors)."""
    emb = read_table(spark, sf, "embeddings")
    r = K.topk_similar(K.centroids(emb), emb, k=5)
    return r.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@register("k2_topk_by_domain", f"""WITH {_EMB},
s AS (SELECT c.query_id, nv.vec_id, list_dot_product(c.q, nv.v) AS score FROM c JOIN nv ON c.query_group = nv.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def k2_topk_by_domain(spark, sf):
    """K2: the same, with a separate index per domain (label)."""
    emb = read_table(spark, sf, "embeddings")
    r = K.topk_similar(K.centroids(emb), emb, k=5, partition="label")
    return r.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_PARSE = S.trunc_in_range(S.num(f"replace({S.strip('cast(expected_answer AS varchar)')}, ',', '')"))
_WORDS = f"list_filter(regexp_split_to_array(coalesce(gold_solution, ''), '{S.WS}+'), lambda w: w <> '')"


@register("k3_rag_corpus", with_views("problems") + f"""SELECT problem_id, {_PARSE} AS answer_int,
  md5(array_to_string({_WORDS}, ' ')) AS rag_md5
FROM problems WHERE {_PARSE} IS NOT NULL AND {wc_sql('gold_solution')} >= 20""")
def k3_rag_corpus(spark, sf):
    r = K.rag_corpus(FX.problems(spark, sf), "expected_answer", "gold_solution")
    return r.select("problem_id", "answer_int", F.md5("rag_text").alias("rag_md5"))


def _d6_sql():
    boxed = f"regexp_extract_all(gold_solution, {S.q(S.BOXED)}, 1)"
    clean = "replace(replace(" + S.strip("m") + ", ',', ''), ' ', '')"
    vb = (f"list_filter(list_transform(list_reverse({boxed}), lambda m: {S.trunc_in_range(S.num(clean))}), "
          f"lambda v: v IS NOT NULL)[1]")
    return with_views("problems", extra=f"r AS (SELECT problem_id, {_PARSE} AS vf, {vb} AS vb FROM problems)") + """
SELECT problem_id, coalesce(vf, vb) AS value,
  CASE WHEN vf IS NOT NULL THEN 'expected_answer' WHEN vb IS NOT NULL THEN 'boxed_in_solution' END AS source FROM r"""


@register("d6_resolve_answer", _d6_sql())
def d6_resolve_answer(spark, sf):
    p = FX.problems(spark, sf).select("problem_id", A.resolve_answer(["expected_answer"], F.col("gold_solution")).alias("r"))
    return p.select("problem_id", "r.value", "r.source")


_D6_LAST = with_views("problems", extra=f"r AS (SELECT problem_id, {_PARSE} AS vf, {_PARSE.replace('expected_answer', 'bl')} AS vb FROM "
                      f"(SELECT *, regexp_extract_all(gold_solution, {S.q(S.BOXED)}, 1)[-1] AS bl FROM problems))") + """
SELECT problem_id, coalesce(vf, vb) AS value, CASE WHEN vf IS NOT NULL THEN 'expected_answer' WHEN vb IS NOT NULL THEN 'boxed' END AS source FROM r"""


@register("d6_resolve_last_boxed", _D6_LAST)
def d6_resolve_last_boxed(spark, sf):
    """D6's second variant: only the last boxed answer counts."""
    p = FX.problems(spark, sf).select("problem_id", A.resolve_answer(["expected_answer"], F.col("gold_solution"), any_valid_boxed=False).alias("r"))
    return p.select("problem_id", "r.value", "r.source")


@register("d20_parse_json_reply", """SELECT event_id,
  coalesce(try_cast(json_extract_string(regexp_extract(replace(replace('Verdict: ```json' || chr(10) || props || chr(10) || '``` done',
    '```json', ''), '```', ''), '(?s)\\{.*\\}', 0), '$.k') AS bigint), -1) AS k FROM events""")
def d20_parse_json_reply(spark, sf):
    """D20 on judge-style replies: each event's JSON wrapped in prose and a
    json fence; the field falls back to -1 when unparsable."""
    ev = read_table(spark, sf, "events")
    reply = F.concat(F.lit("Verdict: ```json\n"), F.col("props"), F.lit("\n``` done"))
    return ev.select("event_id", A.parse_json_reply(reply, {"k": ("bigint", -1)})["k"].alias("k"))


# a whole fenced reply, one field of three, a cut one, no JSON between braces, prose, a field of another type
_JUDGE = """CASE event_id % 6 WHEN 0 THEN 'Verdict: ```json' || chr(10) || '{"answer_correct": ' || c || ', "reasoning_valid": true, "score": 0.' || s || '}' || chr(10) || '``` done'
  WHEN 1 THEN '{"answer_correct": ' || c || '}' WHEN 2 THEN '{"answer_correct": ' || c || ', "score": 0.' WHEN 3 THEN 'it {is} not'
  WHEN 4 THEN 'no verdict' ELSE '{"answer_correct": "perhaps", "reasoning_valid": null, "score": 0.' || s || '}' END"""


@register("d20_judge_replies", f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 'true' ELSE 'false' END AS c,
  lpad(cast(user_id % 100 AS varchar), 2, '0') AS s FROM events),
b AS (SELECT event_id, regexp_extract(replace(replace({_JUDGE}, '```json', ''), '```', ''), '(?s)\\{{.*\\}}', 0) AS body FROM r),
j AS (SELECT event_id, CASE WHEN body <> '' AND json_valid(body) THEN body END AS body FROM b)
SELECT event_id, body IS NOT NULL AS parsed, coalesce(try_cast(json_extract_string(body, '$.answer_correct') AS boolean), false) AS answer_correct,
  coalesce(try_cast(json_extract_string(body, '$.reasoning_valid') AS boolean), false) AS reasoning_valid,
  coalesce(try_cast(json_extract_string(body, '$.score') AS double), 0.0) AS score FROM j""")
def d20_judge_replies(spark, sf):
    """D20 on judge replies with three fields: whole, fenced, partial, cut, invalid ones and prose, each a row."""
    ev = (read_table(spark, sf, "events").withColumn("c", F.when(F.col("event_id") % 5 < 2, "true").otherwise("false"))
          .withColumn("s", F.lpad((F.col("user_id") % 100).cast("string"), 2, "0")))
    return ev.select("event_id", A.parse_json_reply(F.expr(_JUDGE), A.JUDGE_FIELDS).alias("r")).select("event_id", "r.*")
