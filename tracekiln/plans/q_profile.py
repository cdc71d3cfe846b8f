"""Registered queries: corpus profiling (F family) over documents, problems,
attempts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import word_count
from ..operators import filters as B
from ..operators import profile as PR
from ..oracle import sqlfn as S
from ..oracle.fixtures_sql import with_views
from ..sources import fixtures as FX
from ..sources.tables import read_table
from .q_curation import wc_sql
from .registry import register


def _docs(spark, sf):
    return read_table(spark, sf, "documents")


@register("f1_value_share", """SELECT source, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY source""")
def f1_value_share(spark, sf):
    return PR.value_share(_docs(spark, sf), "source")


@register("f1_top_languages", """SELECT lang, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 3""")
def f1_top_languages(spark, sf):
    """F1 with top-k (a top-k report: the limit is the feature)."""
    return PR.value_share(_docs(spark, sf), "lang", top=3)


@register("f2_accuracy_hist", with_views("problems") +
          "SELECT round(acc_high_tool, 3) AS accuracy, count(*) AS n FROM problems GROUP BY 1")
def f2_accuracy_hist(spark, sf):
    return PR.accuracy_hist(FX.problems(spark, sf), "acc_high_tool")


@register("f3_accuracy_stats", with_views("problems") + """SELECT data_source, count(*) AS n, min(acc_high_tool) AS min,
  round(quantile_cont(acc_high_tool, 0.5), 6) AS median, round(avg(acc_high_tool), 6) AS mean, max(acc_high_tool) AS max,
  count(*) FILTER (WHERE acc_high_tool < 0.5) AS hard, count(*) FILTER (WHERE acc_high_tool >= 0.5) AS easy
FROM problems WHERE acc_high_tool IS NOT NULL GROUP BY data_source""")
def f3_accuracy_stats(spark, sf):
    return PR.accuracy_stats(FX.problems(spark, sf), "data_source", "acc_high_tool")


@register("f4_crosstab", with_views("problems") + """SELECT data_source,
  count(*) FILTER (WHERE d = 'hard') AS hard, count(*) FILTER (WHERE d = 'easy') AS easy,
  count(*) FILTER (WHERE d = 'unknown') AS unknown
FROM (SELECT data_source, CASE WHEN acc_high_tool IS NULL THEN 'unknown' WHEN acc_high_tool < 0.5 THEN 'hard' ELSE 'easy' END AS d
      FROM problems) GROUP BY data_source""")
def f4_crosstab(spark, sf):
    p = FX.problems(spark, sf)
    d = F.when(F.col("acc_high_tool").isNull(), "unknown").when(F.col("acc_high_tool") < 0.5, "hard").otherwise("easy")
    return PR.crosstab(p.withColumn("d", d), "data_source", "d", ["hard", "easy", "unknown"])


_DEPTHS = ["high", "medium", "low"]


@register("f4_accuracy_depth", with_views("problems").rstrip() + f""",
x AS (SELECT round(acc_high_tool, 3) AS accuracy,
  {_DEPTHS}[cast(('0x'||substr(md5('depth:'||cast(problem_id AS varchar)),1,8)) AS bigint) % 3 + 1] AS d FROM problems)
SELECT accuracy, """ + ", ".join(f"count(*) FILTER (WHERE d = '{x}') AS {x}" for x in _DEPTHS) + " FROM x GROUP BY accuracy")
def f4_accuracy_depth(spark, sf):
    """accuracy x reasoning depth (dealt to problems by hash)."""
    depth = F.element_at(F.array(*[F.lit(x) for x in _DEPTHS]), (FX.H(FX._k("depth:", F.col("problem_id"))) % 3 + 1).cast("int"))
    p = FX.problems(spark, sf).select(F.round("acc_high_tool", 3).alias("accuracy"), depth.alias("d"))
    return PR.crosstab(p, "accuracy", "d", _DEPTHS)



def _d14(x):
    raw = f"replace(replace({S.strip(S.last_match(x, S.BOXED))}, ',', ''), ' ', '')"
    d = S.num(raw)
    iv = f"(CASE WHEN {d} > -9.2e18 AND {d} < 9.2e18 THEN cast(trunc({d}) AS bigint) END)"
    kind = f"(CASE WHEN {raw} IS NULL THEN 'none' WHEN {iv} IS NOT NULL THEN 'integer' ELSE 'string' END)"
    return kind, iv


_K, _V = _d14("response")


@register("f5_answer_breakdown", with_views("attempts", extra=f"t AS (SELECT {_K} AS kind, {_V} AS v FROM attempts)") +
          """SELECT count(*) AS n, count(*) FILTER (WHERE kind = 'integer') AS integer,
  count(*) FILTER (WHERE kind = 'integer' AND v BETWEEN 0 AND 99999) AS valid,
  count(*) FILTER (WHERE kind = 'integer' AND NOT v BETWEEN 0 AND 99999) AS out_of_range,
  count(*) FILTER (WHERE kind = 'string') AS string, count(*) FILTER (WHERE kind = 'none') AS none FROM t""")
def f5_answer_breakdown(spark, sf):
    return PR.answer_breakdown(FX.attempts(spark, sf), "response")


_BUCKETS = ", ".join(f"count(*) FILTER (WHERE a BETWEEN {lo} AND {hi}) AS b_{lo}_{hi}" for lo, hi in PR.ANSWER_BUCKETS)


@register("f6_answer_buckets", with_views("attempts", extra=f"x AS (SELECT {S.d4('response')} AS a FROM attempts)") +
          f"""SELECT {_BUCKETS}, count(*) FILTER (WHERE a > 10000) AS gt_10000, count(*) FILTER (WHERE a > 50000) AS gt_50000,
  count(a) AS n_valid, count(DISTINCT a) AS distinct_answers FROM x WHERE a BETWEEN 0 AND 99999""")
def f6_answer_buckets(spark, sf):
    a = FX.attempts(spark, sf).select(A.boxed_int_scan(F.col("response")).alias("answer"))
    return PR.answer_buckets(a, "answer")


@register("f6_top_answers", with_views("attempts", extra=f"x AS (SELECT {S.d4('response')} AS answer FROM attempts)") +
          "SELECT answer, count(*) AS n FROM x WHERE answer BETWEEN 0 AND 99999 GROUP BY answer ORDER BY n DESC, answer LIMIT 20")
def f6_top_answers(spark, sf):
    """the 20 most common answers (a top-k report: the limit is the feature)."""
    a = FX.attempts(spark, sf).select(A.boxed_int_scan(F.col("response")).alias("answer"))
    return PR.top_answers(a, "answer")


@register("f7_length_buckets", f"""SELECT CASE WHEN w = 0 THEN 'empty' WHEN w <= 19 THEN 'tiny' WHEN w <= 99 THEN 'short'
  WHEN w <= 499 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n
FROM (SELECT {wc_sql('text')} AS w FROM documents) GROUP BY 1""")
def f7_length_buckets(spark, sf):
    return PR.length_buckets(_docs(spark, sf), "text", "words")


@register("f7_char_buckets", """SELECT CASE WHEN length(text) <= 199 THEN 'lt_200' WHEN length(text) <= 999 THEN 'lt_1k'
  WHEN length(text) <= 2999 THEN 'lt_3k' ELSE 'ge_3k' END AS bucket, count(*) AS n FROM documents GROUP BY 1""")
def f7_char_buckets(spark, sf):
    return PR.length_buckets(_docs(spark, sf), "text", "chars")


_QPROBS = [(1, 10), (1, 4), (1, 2), (3, 4), (9, 10)]


@register("f8_quantile_index", f"""WITH w AS (SELECT lang, {wc_sql('text')} AS words FROM documents),
r AS (SELECT lang, words, row_number() OVER (PARTITION BY lang ORDER BY words) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM w)
SELECT lang, any_value(n) AS n, """ + ", ".join(
    f"min(words) FILTER (WHERE i = floor(n * {a} / {b})) AS p{a * 100 // b}" for a, b in _QPROBS) + " FROM r GROUP BY lang")
def f8_quantile_index(spark, sf):
    """F8 (ii) sorted[floor(n p)] of document word counts per language."""
    d = _docs(spark, sf).select("lang", word_count(F.col("text")).alias("words"))
    return PR.quantile_index(d, "words", _QPROBS, by=["lang"])


@register("f8_quantile_linear", f"""SELECT lang, count(words) AS n, """ + ", ".join(
    f"round(quantile_cont(words, {p}), 6) AS q{int(p * 100)}" for p in (0.5, 0.9)) +
          f" FROM (SELECT lang, {wc_sql('text')} AS words FROM documents) GROUP BY lang")
def f8_quantile_linear(spark, sf):
    d = _docs(spark, sf).select("lang", word_count(F.col("text")).alias("words"))
    return PR.quantile_linear(d, "words", [0.5, 0.9], by=["lang"])


@register("f9_cdf_counts", """SELECT count(*) AS n, round(avg(cast(n_chars <= 1000 AS double)), 6) AS le_1000,
  round(avg(cast(n_chars <= 4096 AS double)), 6) AS le_4096, round(avg(cast(n_chars <= 16384 AS double)), 6) AS le_16384
FROM documents""")
def f9_cdf_counts(spark, sf):
    return PR.cdf_counts(_docs(spark, sf), "n_chars", [1000, 4096, 16384])


@register("f10_role_distribution", "SELECT role, count(*) AS n FROM conversations GROUP BY role")
def f10_role_distribution(spark, sf):
    return PR.role_distribution(read_table(spark, sf, "conversations"))


@register("f10_turn_stats", """SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS role_sequence
FROM conversations GROUP BY conv_id""")
def f10_turn_stats(spark, sf):
    return PR.turn_stats(read_table(spark, sf, "conversations"))


_TURNS = (0.1, 0.25, 0.5, 0.75, 0.9)


@register("f10_turn_quantiles", "SELECT count(*) AS n, " + ", ".join(
    f"round(quantile_cont(turns, {p}), 6) AS q{int(p * 100)}" for p in _TURNS) + ", min(turns) AS min, max(turns) AS max, round(avg(turns), 6) AS mean, " +
          ", ".join(f"count(*) FILTER (WHERE turns <= {n}) AS le_{n}" for n in (2, 4, 6, 8, 10, 12, 16, 20, 30)) +
          " FROM (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)")
def f10_turn_quantiles(spark, sf):
    return PR.turn_quantiles(read_table(spark, sf, "conversations"))


def _anyc(x, words, lower=False):
    return "(" + " OR ".join(f"contains({x}, {S.q(w.lower() if lower else w)})" for w in words) + ")"


@register("f11_quality_flags", f"""SELECT count(*) AS n, count(*) FILTER (WHERE w < 20) AS too_short,
  count(*) FILTER (WHERE w < 5) AS just_answer,
  count(*) FILTER (WHERE {_anyc('lower(text)', PR.QUALITY_STEP_WORDS)}) AS has_steps,
  count(*) FILTER (WHERE {_anyc('text', PR.QUALITY_MATH_SYMBOLS)}) AS has_math,
  count(*) FILTER (WHERE {_anyc('lower(text)', PR.QUALITY_PROOF_WORDS)}) AS has_proof
FROM (SELECT text, {wc_sql('text')} AS w FROM documents)""")
def f11_quality_flags(spark, sf):
    return PR.quality_flags(_docs(spark, sf), "text")


@register("f12_problem_flags", with_views("problems") + """SELECT count(*) AS n,
  count(*) FILTER (WHERE contains(lower(problem), 'find')) AS has_find,
  count(*) FILTER (WHERE contains(lower(problem), 'compute')) AS has_compute,
  count(*) FILTER (WHERE contains(lower(problem), 'determine')) AS has_determine,
  count(*) FILTER (WHERE contains(lower(problem), 'prove')) AS has_prove,
  count(*) FILTER (WHERE contains(problem, '$') OR contains(problem, chr(92))) AS has_latex,
  count(*) FILTER (WHERE contains(lower(problem), 'boxed')) AS asks_boxed FROM problems""")
def f12_problem_flags(spark, sf):
    return PR.problem_flags(FX.problems(spark, sf), "problem")


@register("f13_content_flags", with_views("messages_tir") + """SELECT count(*) AS n,
  round(avg(cast(contains(text, '```') AS double)), 6) AS code_share,
  round(avg(cast(contains(text, chr(92) || 'boxed') AS double)), 6) AS boxed_share,
  round(avg(cast(contains(lower(text), 'sympy') AS double)), 6) AS sympy_share,
  round(avg(cast(contains(lower(text), 'python') AS double)), 6) AS python_share FROM messages_tir""")
def f13_content_flags(spark, sf):
    return PR.content_flags(FX.messages_tir(spark, sf), "text")


def _classify_sql(x, taxonomy):
    parts = []
    for i, (name, kws) in enumerate(taxonomy.items()):
        score = " + ".join(f"cast(contains(lower({x}), {S.q(k)}) AS integer)" for k in kws)
        parts.append(f"{{'s': {score}, 'o': {-i}, 'd': '{name}'}}")
    best = f"list_max([{', '.join(parts)}])"
    return f"(CASE WHEN ({best}).s > 0 THEN ({best}).d ELSE 'other' END)"


@register("f14_classify_domain", f"""SELECT domain, domain_small, count(*) AS n FROM (
  SELECT {_classify_sql('text', PR.DOMAIN_KEYWORDS)} AS domain, {_classify_sql('text', PR.DOMAIN_KEYWORDS_SMALL)} AS domain_small
  FROM documents) GROUP BY domain, domain_small""")
def f14_classify_domain(spark, sf):
    d = _docs(spark, sf)
    return d.groupBy(PR.classify_domain(F.col("text")).alias("domain"),
                     PR.classify_domain(F.col("text"), PR.DOMAIN_KEYWORDS_SMALL).alias("domain_small")) \
            .agg(F.count("*").alias("n"))


_MORE = {"sequences": PR.DOMAIN_KEYWORDS_SEQUENCES, "functional": PR.DOMAIN_KEYWORDS_FUNCTIONAL, "usable": PR.DOMAIN_KEYWORDS_USABLE}


@register("f14_more_taxonomies", "SELECT sequences, functional, usable, count(*) AS n FROM (SELECT " + ", ".join(
    f"{_classify_sql('text', kws)} AS {name}" for name, kws in _MORE.items()) + " FROM documents) GROUP BY ALL")
def f14_more_taxonomies(spark, sf):
    """F14 with the other three taxonomies."""
    d = _docs(spark, sf)
    return d.groupBy(*[PR.classify_domain(F.col("text"), kws).alias(name) for name, kws in _MORE.items()]) \
            .agg(F.count("*").alias("n"))


def _tech_sql(x, techniques=PR.TECHNIQUES):
    hits = [f"CASE WHEN {_anyc(x, kws, lower=True)} THEN '{name}' END" for name, kws in techniques.items()]
    return f"list_filter([{', '.join(hits)}], lambda t: t IS NOT NULL)"


_TECH = with_views("messages_tir").replace("WITH ", "", 1).rstrip() + f""",
tech AS (SELECT conv_id, turn, {_classify_sql('text', PR.DOMAIN_KEYWORDS)} AS domain,
  {_tech_sql("lower(text)")} AS techniques FROM messages_tir)"""


@register("f15_f16_technique_by_domain", "WITH " + _TECH + """, e AS (SELECT domain, unnest(techniques) AS technique FROM tech),
c AS (SELECT domain, technique, count(*) AS count FROM e GROUP BY domain, technique)
SELECT domain, technique, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY count DESC, technique) AS rank FROM c) WHERE rank <= 8""")
def f15_f16_technique_by_domain(spark, sf):
    d = FX.messages_tir(spark, sf)
    t = d.select(PR.classify_domain(F.col("text")).alias("domain"),
                 PR.detect_techniques(F.col("text")).alias("techniques"))
    return PR.technique_by_domain(t, "domain", "techniques", 8).select("domain", "technique", "count", "rank")


@register("f17_cooccurrence", "WITH " + _TECH + """SELECT technique, count(*) AS n FROM (
  SELECT unnest(techniques) AS technique FROM tech WHERE list_contains(techniques, 'python_computation'))
WHERE technique <> 'python_computation' GROUP BY technique""".replace("WITH tech", "WITH tech", 1).replace(")SELECT", ")\nSELECT"))
def f17_cooccurrence(spark, sf):
    d = FX.messages_tir(spark, sf)
    t = d.select(PR.detect_techniques(F.col("text")).alias("techniques"))
    return PR.cooccurrence(t, "techniques", "python_computation")


_PARSE_INT = (f"{S.trunc_in_range(S.num(f'''replace({S.strip('expected_answer')}, ',', '')'''))}")


@register("f18_exclusion_funnel", with_views("problems") + f"""SELECT
  CASE WHEN {_PARSE_INT} IS NULL THEN 'no_valid_integer_answer'
       WHEN {wc_sql('gold_solution')} < 20 THEN 'empty_or_tiny_solution'
       WHEN NOT {_anyc('gold_solution', PR.FUNNEL_MATH_SYMBOLS)} THEN 'no_math_content'
       ELSE 'usable' END AS reason, count(*) AS n FROM problems GROUP BY 1""")
def f18_exclusion_funnel(spark, sf):
    p = FX.problems(spark, sf)
    rules = [("no_valid_integer_answer", A.parse_int_answer(F.col("expected_answer")).isNotNull()),
             ("empty_or_tiny_solution", word_count(F.col("gold_solution")) >= 20),
             ("no_math_content", PR._any_contains(F.col("gold_solution"), PR.FUNNEL_MATH_SYMBOLS))]
    return PR.exclusion_funnel(p, rules)


@register("f19_filter_ladder", with_views("trajectory_meta") + f"""SELECT count(*) AS step_0_input,
  count(*) FILTER (WHERE coalesce(accuracy > 0 AND accuracy < 0.5, false)) AS step_1_hard,
  count(*) FILTER (WHERE coalesce(accuracy > 0 AND accuracy < 0.5, false) AND coalesce(n_tools > 0, false)) AS step_2_tools,
  count(*) FILTER (WHERE coalesce(accuracy > 0 AND accuracy < 0.5, false) AND coalesce(n_tools > 0, false)
                   AND data_source = 'aops') AS step_3_aops FROM trajectory_meta""")
def f19_filter_ladder(spark, sf):
    m = FX.trajectory_meta(spark, sf)
    return PR.filter_ladder(m, [("hard", B.is_hard(F.col("accuracy"))),
                                ("tools", B.has_tools_defined(F.col("n_tools"))),
                                ("aops", B.by_source(F.col("data_source"), "aops"))])


@register("f20_difficulty_buckets", with_views("problems") + """SELECT CASE WHEN acc_high_tool IS NULL THEN 'no_metadata'
  WHEN acc_high_tool > 0.875 THEN 'very_easy' WHEN acc_high_tool > 0.625 THEN 'easy' WHEN acc_high_tool > 0.375 THEN 'medium'
  WHEN acc_high_tool > 0.125 THEN 'hard' ELSE 'very_hard' END AS bucket, count(*) AS n FROM problems GROUP BY 1""")
def f20_difficulty_buckets(spark, sf):
    p = FX.problems(spark, sf)
    return p.groupBy(PR.difficulty_bucket(F.col("acc_high_tool")).alias("bucket")).agg(F.count("*").alias("n"))


@register("f21_source_stats", f"""WITH w AS (SELECT source, {wc_sql('text')} AS words FROM documents),
r AS (SELECT source, words, row_number() OVER (PARTITION BY source ORDER BY words) - 1 AS i,
             count(*) OVER (PARTITION BY source) AS n FROM w)
SELECT source, count(*) AS n, round(avg(words), 6) AS mean_words, min(words) FILTER (WHERE i = floor(n / 2)) AS median_words
FROM r GROUP BY source""")
def f21_source_stats(spark, sf):
    d = _docs(spark, sf).select("source", word_count(F.col("text")).alias("words"))
    return PR.source_stats(d, "source", "words")


@register("f22_schema_report", """SELECT 'doc_id' AS "column", 'bigint' AS type, count(doc_id) AS non_null,
  count(*) - count(doc_id) AS nulls, count(DISTINCT doc_id) AS "distinct" FROM labels
UNION ALL SELECT 'quality', 'int', count(quality), count(*) - count(quality), count(DISTINCT quality) FROM labels
UNION ALL SELECT 'toxic', 'int', count(toxic), count(*) - count(toxic), count(DISTINCT toxic) FROM labels""")
def f22_schema_report(spark, sf):
    return PR.schema_report(read_table(spark, sf, "labels"))


@register("f23_compare_datasets", """WITH a AS (SELECT d.lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE l.quality = 1 GROUP BY d.lang),
b AS (SELECT d.lang, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0 GROUP BY d.lang)
SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS docs_a, coalesce(b.n, 0) AS docs_b,
  coalesce(b.n, 0) - coalesce(a.n, 0) AS diff FROM a FULL OUTER JOIN b ON a.lang = b.lang""")
def f23_compare_datasets(spark, sf):
    """high- vs low-quality labelled documents, compared language by language."""
    d = _docs(spark, sf).join(read_table(spark, sf, "labels"), "doc_id")
    return PR.compare_datasets(d.where("quality = 1"), d.where("quality = 0"), "lang", "docs")


@register("f24_overlap", """WITH a AS (SELECT md5(text) AS h FROM documents), b AS (SELECT md5(text) AS h FROM benchmark),
ka AS (SELECT DISTINCT h FROM a), kb AS (SELECT DISTINCT h FROM b)
SELECT (SELECT count(*) FROM ka) AS keys_a, (SELECT count(*) FROM kb) AS keys_b,
  (SELECT count(*) FROM ka JOIN kb ON ka.h = kb.h) AS common,
  (SELECT count(*) FROM ka) = (SELECT count(*) FROM ka JOIN kb ON ka.h = kb.h)
    AND (SELECT count(*) FROM kb) = (SELECT count(*) FROM ka JOIN kb ON ka.h = kb.h) AS same_keys,
  (SELECT count(*) FROM (SELECT h FROM a EXCEPT ALL SELECT h FROM b)) = 0
    AND (SELECT count(*) FROM (SELECT h FROM b EXCEPT ALL SELECT h FROM a)) = 0 AS identical""")
def f24_overlap(spark, sf):
    """exact-text overlap between the benchmark and the document corpus."""
    a = _docs(spark, sf).select(F.md5("text").alias("h"))
    b = read_table(spark, sf, "benchmark").select(F.md5("text").alias("h"))
    return PR.overlap(a, b, "h")


@register("f25_numeric_answer_stats", with_views("problems") + f"""SELECT count({S.num('expected_answer')}) AS numeric,
  count(*) FILTER (WHERE {S.num('expected_answer')} IS NULL) AS non_numeric, min({S.num('expected_answer')}) AS min,
  max({S.num('expected_answer')}) AS max, round(avg({S.num('expected_answer')}), 6) AS mean,
  count(*) FILTER (WHERE {S.num('expected_answer')} = floor({S.num('expected_answer')})) AS integral FROM problems""")
def f25_numeric_answer_stats(spark, sf):
    return PR.numeric_answer_stats(FX.problems(spark, sf), "expected_answer")


@register("f28_label_change_report", with_views("problems", "attempts") + """SELECT
  NOT (p.expected_answer IS NOT DISTINCT FROM g.gold) AS changed, count(*) AS n
FROM problems p JOIN (SELECT DISTINCT problem_id, gold FROM attempts) g ON p.problem_id = g.problem_id GROUP BY 1""")
def f28_label_change_report(spark, sf):
    """expected answer vs the rollout gold (the relabelled answer)."""
    g = FX.attempts(spark, sf).select("problem_id", "gold").dropDuplicates(["problem_id"])
    j = FX.problems(spark, sf).join(g, "problem_id")
    return PR.label_change_report(j, "expected_answer", "gold")


@register("f15_short_list", f"""SELECT technique, count(*) AS n FROM (
  SELECT unnest({_tech_sql('lower(text)', PR.TECHNIQUES_SHORT)}) AS technique FROM documents) GROUP BY technique""")
def f15_short_list(spark, sf):
    """F15 with the shorter technique list."""
    t = _docs(spark, sf).select(F.explode(PR.detect_techniques(F.col("text"), PR.TECHNIQUES_SHORT)).alias("technique"))
    return t.groupBy("technique").agg(F.count("*").alias("n"))
