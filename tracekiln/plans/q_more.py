"""Registered queries: remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import filters as B
from ..operators import profile as PR
from ..operators import votes as V
from ..oracle import sqlfn as S
from ..oracle.fixtures_sql import H as HS
from ..oracle.fixtures_sql import with_views
from ..sources import fixtures as FX
from ..sources import readers as RD
from .q_answers import _d5_sql
from .q_sources import _a4_sql, _render_section_spark, _scratch
from .registry import register

_ID = "cast(problem_id AS varchar)"


@register("b3_acc_for_split", with_views("problems") + f"""SELECT problem_id,
  CASE WHEN {HS(chr(39) + 'sp:' + chr(39) + '||' + _ID)} % 2 = 0 THEN 'medium' ELSE 'high' END AS split,
  CASE WHEN {HS(chr(39) + 'sp:' + chr(39) + '||' + _ID)} % 2 = 0
       THEN cast({HS(chr(39) + 't2:' + chr(39) + '||' + _ID)} % 9 AS double) / cast(8 AS double)
       ELSE acc_high_tool END AS accuracy
FROM problems""")
def b3_acc_for_split(spark, sf):
    """B3 over a config-keyed metadata map (high and medium tool accuracy)."""
    p = FX.problems(spark, sf)
    i = F.col("problem_id")
    acc2 = (FX.H(FX._k("t2:", i)) % 9).cast("double") / F.lit(8.0)
    meta = F.create_map(F.lit("reason_high_with_tool"), F.struct(F.col("acc_high_tool").alias("accuracy")),
                        F.lit("reason_medium_with_tool"), F.struct(acc2.alias("accuracy")))
    split = F.when(FX.H(FX._k("sp:", i)) % 2 == 0, F.lit("medium")).otherwise(F.lit("high"))
    d = p.select("problem_id", meta.alias("metadata"), split.alias("split"))
    return d.select("problem_id", "split", B.acc_for_split(F.col("metadata"), F.col("split")).alias("accuracy"))


_THINK = f"""'<parameter name="think">' || response || '</parameter>' || CASE WHEN attempt_id % 2 = 0 THEN ' {chr(92)}boxed{{' || gold || '}}' ELSE '' END"""


_SPOKEN = f"""regexp_replace({_THINK}, '(?s)<parameter name="think">.*?</parameter>', '', 'g')"""


@register("d2_strip_think", with_views("attempts", extra=f"t AS (SELECT problem_id, attempt_id, {_SPOKEN} AS s FROM attempts)") +
          f"SELECT problem_id, attempt_id, {S.d1('s')} AS pred FROM t")
def d2_strip_think(spark, sf):
    """Reasoning inside think tags is removed before D1, so only an
    answer after the closing tag counts."""
    a = FX.attempts(spark, sf)
    t = F.concat(F.lit('<parameter name="think">'), F.col("response"), F.lit("</parameter>"),
                 F.when(F.col("attempt_id") % 2 == 0, F.concat(F.lit(" \\\\boxed{".replace("\\\\", "\\")), F.col("gold"), F.lit("}")))
                  .otherwise(F.lit("")))
    s = a.select("problem_id", "attempt_id", A.strip_think(t).alias("s"))
    return A.add_boxed_first(s, F.col("s"), "pred").select("problem_id", "attempt_id", "pred")


@register("g14_attempt_selection", with_views("attempts", extra=f"ans AS (SELECT problem_id, attempt_id, {S.d4('response')} AS answer FROM attempts)") + """
SELECT problem_id, coalesce(max(CASE WHEN attempt_id = 1 THEN answer END), max(CASE WHEN attempt_id = 0 THEN answer END)) AS selected
FROM ans GROUP BY problem_id""")
def g14_attempt_selection(spark, sf):
    """The refine attempt's answer (attempt 1), else the first attempt's."""
    a = FX.attempts(spark, sf).withColumn("answer", A.boxed_int_scan(F.col("response")))
    p = a.groupBy("problem_id").agg(F.max(F.when(F.col("attempt_id") == 1, F.col("answer"))).alias("refine"),
                                    F.max(F.when(F.col("attempt_id") == 0, F.col("answer"))).alias("first"))
    return p.select("problem_id", V.attempt_selection(F.col("refine"), F.col("first")).alias("selected"))


@register("a5_normalise_string_cols", with_views("problems") + """SELECT problem_id,
  coalesce(cast(acc_high_tool AS varchar), '') AS acc_high_tool, coalesce(expected_answer, '') AS expected_answer
FROM problems""")
def a5_normalise_string_cols(spark, sf):
    p = FX.problems(spark, sf).select("problem_id", "acc_high_tool", "expected_answer")
    return RD.normalise_string_cols(p, ["acc_high_tool", "expected_answer"])


_vb, _vp, _vl = _d5_sql("response")


@register("f26_rag_options", with_views("attempts", extra=f"c AS (SELECT {_vb} AS vb, {_vp} AS vp, {_vl} AS vl FROM attempts)") + """,
s AS (SELECT CASE WHEN vb IS NOT NULL THEN 'boxed' WHEN vp IS NOT NULL THEN 'text_pattern'
                  WHEN vl IS NOT NULL THEN 'last_int' END AS source FROM c)
SELECT count(*) FILTER (WHERE source = 'boxed') AS conservative,
  count(*) FILTER (WHERE source IN ('boxed', 'text_pattern')) AS medium,
  count(*) FILTER (WHERE source IS NOT NULL) AS aggressive, count(*) AS n FROM s""".replace("\n,\ns AS", ",\ns AS", 1))
def f26_rag_options(spark, sf):
    a = FX.attempts(spark, sf).select(A.answer_cascade(F.col("response"))["source"].alias("source"))
    return PR.rag_options(a, "source")


@register("f27_corpus_by_subject", "SELECT subject, mohs, count(*) AS n FROM (" + _a4_sql() + ") GROUP BY subject, mohs")
def f27_corpus_by_subject(spark, sf):
    """F27 over the eval corpus parsed from markdown (A4)."""
    from ..sources.tables import read_table
    path = _scratch(spark, "f27")
    b = read_table(spark, sf, "benchmark")
    b.select(_render_section_spark(b).alias("value")).repartition(4).write.mode("overwrite").text(path)
    m = RD.parse_problem_markdown(spark, path)
    return PR.corpus_by_subject(m)


_CFG_KEYS = ["reason_high_with_tool", "reason_medium_with_tool", "reason_low_no_tool"]


def _meta_map(p):
    i = F.col("problem_id")
    acc = {"reason_high_with_tool": F.col("acc_high_tool")}
    for k in _CFG_KEYS[1:]:
        acc[k] = (FX.H(FX._k(f"{k}:", i)) % 9).cast("double") / F.lit(8.0)
    parts = []
    for k in _CFG_KEYS:
        parts += [F.lit(k), F.struct(acc[k].alias("accuracy"))]
    return F.create_map(*parts)


_F3_SQL = with_views("problems") + """, m AS (
  SELECT 'reason_high_with_tool' AS config, acc_high_tool AS acc FROM problems
  UNION ALL SELECT 'reason_medium_with_tool', cast(""" + HS("'reason_medium_with_tool:'||" + _ID) + """ % 9 AS double) / cast(8 AS double) FROM problems
  UNION ALL SELECT 'reason_low_no_tool', cast(""" + HS("'reason_low_no_tool:'||" + _ID) + """ % 9 AS double) / cast(8 AS double) FROM problems)
SELECT config, count(*) AS n, min(acc) AS min, round(quantile_cont(acc, 0.5), 6) AS median, round(avg(acc), 6) AS mean,
  max(acc) AS max, count(*) FILTER (WHERE acc < 0.5) AS hard, count(*) FILTER (WHERE acc >= 0.5) AS easy
FROM m WHERE acc IS NOT NULL GROUP BY config"""


@register("f3_accuracy_stats_by_config", _F3_SQL)
def f3_accuracy_stats_by_config(spark, sf):
    """F3 in its map form: explode a config-keyed metadata map and compute
    the statistics per config key in one aggregate."""
    p = FX.problems(spark, sf)
    e = p.select(F.explode(_meta_map(p)).alias("config", "v")).select("config", F.col("v.accuracy").alias("acc"))
    return PR.accuracy_stats(e, "config", "acc")
