"""Registered queries: sources and sinks (A family) as round trips through
the shared checkpoint folder, and lemma graphs (G15, G16)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..oracle import sqlfn as S
from ..oracle.fixtures_sql import H as HS
from ..oracle.fixtures_sql import with_views
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as FX
from ..sources import readers as RD
from ..sources.tables import read_table
from . import jobs
from .q_curation import _curated_sql, wc_sql
from .registry import register


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "roundtrip", f"{name}_{uuid.uuid4().hex}")


@register("a1_read_trajectories", with_views("trajectory_meta") +
          "SELECT conv_id, data_source AS split, accuracy FROM trajectory_meta")
def a1_read_trajectories(spark, sf):
    """A1: splits written to separate paths, read back by name (a missing
    split is skipped with a warning)."""
    base = _scratch(spark, "a1")
    m = FX.trajectory_meta(spark, sf)
    for s in ("aops", "stackflow"):
        m.where(F.col("data_source") == s).write.mode("overwrite").parquet(f"{base}/{s}")
    t = RD.read_trajectories(spark, {"aops": f"{base}/aops", "stackflow": f"{base}/stackflow",
                                     "medium": f"{base}/missing"})
    return t.select("conv_id", "split", "accuracy")


@register("a2_a7_curated_roundtrip", _curated_sql() +
          "SELECT conv_id, accuracy, n_words, md5(assistant) AS assistant_md5 FROM curated WHERE accuracy = 0.125")
def a2_a7_curated_roundtrip(spark, sf):
    """A7 write partitioned by accuracy, A2 read back; the tier filter prunes
    partitions (PartitionFilters in the scan)."""
    path = _scratch(spark, "a7") + ".parquet"
    cur = jobs.curate_sft(FX.trajectory_meta(spark, sf), FX.messages_tir(spark, sf))
    RD.write_curated(cur, path, "accuracy", messages=None)
    back = RD.read_any(spark, path).where(F.col("accuracy") == 0.125)
    return back.select("conv_id", "accuracy", "n_words", F.md5("assistant").alias("assistant_md5"))


@register("a2_a7_messages_json", _curated_sql() + """
, m AS (SELECT conv_id, 'Problem ' || conv_id || chr(10) || 'Say "why", briefly' AS question, assistant FROM curated)
SELECT fmt, conv_id, 2::bigint AS n_messages, 'user' AS first_role, md5(question) AS question_md5, md5(assistant) AS answer_md5
FROM m, (VALUES ('csv'), ('jsonl'), ('parquet')) f(fmt)""")
def a2_a7_messages_json(spark, sf):
    """The curated table with its messages as JSON, and the same as JSON lines and CSV; A2 reads all three, fields by VARIANT."""
    base = _scratch(spark, "a7m")
    cur = jobs.curate_sft(FX.trajectory_meta(spark, sf), FX.messages_tir(spark, sf))
    question = F.concat(F.lit("Problem "), F.col("conv_id").cast("string"), F.lit('\nSay "why", briefly'))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    cur = cur.select("conv_id", "accuracy", F.array(message("user", question), message("assistant", F.col("assistant"))).alias("messages"))
    RD.write_curated(cur, f"{base}.parquet", "accuracy")
    written = RD.read_any(spark, f"{base}.parquet").select("conv_id", "messages")
    written.write.json(f"{base}.jsonl")
    RD.write_problem_csv(written, f"{base}.csv")
    out = None
    for fmt in ("parquet", "jsonl", "csv"):
        m = RD.messages_of(RD.read_any(spark, f"{base}.{fmt}"))
        m = m.select(F.lit(fmt).alias("fmt"), F.col("conv_id").cast("bigint").alias("conv_id"), F.size("messages").alias("n_messages"),
                     F.col("messages")[0]["role"].alias("first_role"), F.md5(F.col("messages")[0]["content"]).alias("question_md5"),
                     F.md5(F.col("messages")[1]["content"]).alias("answer_md5"))
        out = m if out is None else out.unionByName(m)
    return out


@register("a3_problem_csv_roundtrip", with_views("problems") +
          "SELECT problem_id, md5(problem) AS problem_md5, expected_answer AS answer FROM problems")
def a3_problem_csv_roundtrip(spark, sf):
    """A3: multi-line quoted CSV (id, problem, answer) written and read back."""
    path = _scratch(spark, "a3") + ".csv"
    p = FX.problems(spark, sf).select(F.col("problem_id").alias("id"), "problem", F.col("expected_answer").alias("answer"))
    RD.write_problem_csv(p, path)
    back = RD.read_problem_csv(spark, path)
    return back.select(F.col("id").cast("bigint").alias("problem_id"), F.md5("problem").alias("problem_md5"), "answer")


_SUBJECTS = ["Algebra", "Combinatorics", "Geometry", "Number Theory"]


def _render_section_spark(b):
    i = F.col("item_id").cast("string")
    subj = F.element_at(F.array(*[F.lit(x) for x in _SUBJECTS]), (FX.H(F.concat(F.lit("s:"), i)) % 4 + 1).cast("int"))
    mohs = (FX.H(F.concat(F.lit("h:"), i)) % 7).cast("string")
    ans = (FX.H(F.concat(F.lit("a:"), i)) % 100000).cast("string")
    has_ans = FX.H(F.concat(F.lit("n:"), i)) % 10 != 0
    return F.concat(
        F.lit("## Problem "), (F.col("item_id") + 1).cast("string"), F.lit("\n\n**Subject:** "), subj,
        F.lit(" | **MOHS:** "), mohs, F.lit("M | **Source:** Bench "), i, F.lit("\n\n### Original\n"), F.col("text"),
        F.lit("\n\n### Adapted\n"), F.upper("text"), F.lit("\n\n"),
        F.when(has_ans, F.concat(F.lit("**Answer:** `"), ans, F.lit("`\n\n"))).otherwise(F.lit("")), F.lit("---\n"))


def _a4_sql():
    i = "cast(item_id AS varchar)"
    subj = f"['Algebra', 'Combinatorics', 'Geometry', 'Number Theory'][{HS(chr(39) + 's:' + chr(39) + '||' + i)} % 4 + 1]"
    sec = (f"'## Problem ' || cast(item_id + 1 AS varchar) || chr(10) || chr(10) || '**Subject:** ' || {subj} || "
           f"' | **MOHS:** ' || cast({HS(chr(39) + 'h:' + chr(39) + '||' + i)} % 7 AS varchar) || 'M | **Source:** Bench ' || {i} || "
           f"chr(10) || chr(10) || '### Original' || chr(10) || text || chr(10) || chr(10) || '### Adapted' || chr(10) || "
           f"upper(text) || chr(10) || chr(10) || "
           f"CASE WHEN {HS(chr(39) + 'n:' + chr(39) + '||' + i)} % 10 <> 0 THEN '**Answer:** `' || "
           f"cast({HS(chr(39) + 'a:' + chr(39) + '||' + i)} % 100000 AS varchar) || '`' || chr(10) || chr(10) ELSE '' END || '---' || chr(10)")
    return f"""WITH r AS (SELECT substr({sec}, 12) AS sec FROM benchmark)
SELECT cast(regexp_extract(sec, '^([0-9]+)', 1) AS bigint) AS number,
  regexp_extract(sec, '\\*\\*Subject:\\*\\*[ \\t]*([^|\\n]*?)[ \\t]*(\\||\\n|$)', 1) AS subject,
  cast(regexp_extract(sec, '\\*\\*MOHS:\\*\\*[ \\t]*([0-9]+)M', 1) AS bigint) AS mohs,
  CASE WHEN regexp_extract(sec, '\\*\\*Answer:\\*\\*[ \\t\\n]*`?(-?[0-9]+)`?', 1) <> ''
       THEN cast(regexp_extract(sec, '\\*\\*Answer:\\*\\*[ \\t\\n]*`?(-?[0-9]+)`?', 1) AS bigint) END AS answer,
  md5(regexp_extract(sec, '(?s)### Original[ \\t\\n\\r\\f\\v]*\\n(.*?)\\n[ \\t\\n\\r\\f\\v]*### ', 1)) AS original_md5
FROM r"""


@register("a4_problem_markdown", _a4_sql())
def a4_problem_markdown(spark, sf):
    """A4: the benchmark rendered as ``## Problem N`` markdown files (derived
    by Spark, several files in parallel) and parsed back."""
    path = _scratch(spark, "a4")
    b = read_table(spark, sf, "benchmark")
    b.select(_render_section_spark(b).alias("value")).repartition(4).write.mode("overwrite").text(path)
    m = RD.parse_problem_markdown(spark, path)
    return m.select("number", "subject", "mohs", "answer", F.md5("original").alias("original_md5"))


@register("a4_markdown_line_ends", _a4_sql())
def a4_markdown_line_ends(spark, sf):
    """A4 with carriage returns before the line feeds, a preamble and the first section at a file's beginning."""
    path = _scratch(spark, "a4crlf")
    b = read_table(spark, sf, "benchmark")
    text = F.regexp_replace(_render_section_spark(b), r"\n", "\r\n")
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Collected problems\r\n2 files\r\n"), text)).otherwise(text)
    b.select(text.alias("value")).repartition(4).write.mode("overwrite").option("lineSep", "\r\n").text(path)
    m = RD.parse_problem_markdown(spark, path)
    return m.select("number", "subject", "mohs", "answer", F.md5(F.regexp_replace("original", r"\r\n", "\n")).alias("original_md5"))


@register("a10_migrate_reward_struct", with_views("problems") + f"""SELECT problem_id,
  expected_answer AS ground_truth,
  md5(CASE WHEN {HS(chr(39) + 'r:' + chr(39) + '||cast(problem_id AS varchar)')} % 5 = 0 THEN '' ELSE gold_solution END) AS gold_md5
FROM problems""")
def a10_migrate_reward_struct(spark, sf):
    """A10 on GRPO-shaped rows (one in five without a gold solution)."""
    p = FX.problems(spark, sf)
    g = F.when(FX.H(FX._k("r:", F.col("problem_id"))) % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("gold_solution"))
    rows = p.select("problem_id", F.struct(F.col("expected_answer").alias("ground_truth"), g.alias("gold_solution")).alias("reward_model"))
    m = RD.migrate_reward_struct(rows)
    m = RD.migrate_reward_struct(m)          # idempotent
    return m.select("problem_id", F.col("reward_model.ground_truth").alias("ground_truth"),
                    F.md5("extra_info.gold_solution").alias("gold_md5"))


def _levels_sql(final: str, rounds: int = 7) -> str:
    # the lemma fixture has six lemmas a problem, so seven rounds settle it
    parts = [with_views("lemmas", "lemma_edges").rstrip() + """,
known AS (SELECT e.* FROM lemma_edges e JOIN lemmas l ON e.problem_id = l.problem_id AND e.dep = l.lemma_id),
nd AS (SELECT l.problem_id, l.lemma_id, count(k.dep) AS ndeps FROM lemmas l
       LEFT JOIN known k ON l.problem_id = k.problem_id AND l.lemma_id = k.lemma_id GROUP BY l.problem_id, l.lemma_id),
lv0 AS (SELECT problem_id, lemma_id, 0 AS level,
        row_number() OVER (PARTITION BY problem_id ORDER BY lemma_id) - 1 AS place FROM nd WHERE ndeps = 0)"""]
    for r in range(1, rounds + 1):
        parts.append(f""",
g{r} AS (SELECT k.problem_id, k.lemma_id, count(*) AS n, max(v.level) AS mx, max(v.place) AS mp FROM known k
        JOIN lv{r - 1} v ON k.problem_id = v.problem_id AND k.dep = v.lemma_id GROUP BY k.problem_id, k.lemma_id),
lv{r} AS (SELECT * FROM lv{r - 1} UNION ALL
        SELECT g.problem_id, g.lemma_id, g.mx + 1,
          (SELECT count(*) FROM lv{r - 1} t WHERE t.problem_id = g.problem_id)
          + row_number() OVER (PARTITION BY g.problem_id ORDER BY g.mp, g.lemma_id) - 1 FROM g{r} g JOIN nd ON g.problem_id = nd.problem_id AND g.lemma_id = nd.lemma_id
        WHERE g.n = nd.ndeps AND NOT EXISTS (SELECT 1 FROM lv{r - 1} o WHERE o.problem_id = g.problem_id AND o.lemma_id = g.lemma_id))""")
    parts.append(f""",
solved AS (SELECT l.problem_id, l.lemma_id, v.level, v.place, bool_or(v.level IS NULL) OVER (PARTITION BY l.problem_id) AS pc
  FROM lemmas l LEFT JOIN lv{rounds} v ON l.problem_id = v.problem_id AND l.lemma_id = v.lemma_id)
{final} FROM solved""")
    return "".join(parts)


_BY_LEVEL = """SELECT problem_id, lemma_id, cast(level AS bigint) AS level, level IS NULL AS cyclic,
  row_number() OVER (PARTITION BY problem_id ORDER BY CASE WHEN NOT pc THEN level END, lemma_id) AS level_order"""
_BY_PLACE = """SELECT problem_id, lemma_id, cast(CASE WHEN pc THEN row_number() OVER (PARTITION BY problem_id ORDER BY lemma_id) - 1
  ELSE place END AS bigint) AS position, pc AS cyclic"""


@register("g15_lemma_levels", _levels_sql(_BY_LEVEL))
def g15_lemma_levels(spark, sf):
    return EV.lemma_levels(FX.lemmas(spark, sf), FX.lemma_edges(spark, sf)) \
        .select("problem_id", "lemma_id", "level", "cyclic", "level_order")


@register("g15_dependency_order", _levels_sql(_BY_PLACE))
def g15_dependency_order(spark, sf):
    """First-in-first-out dependency order per problem, id order on cycles."""
    return EV.dependency_order(FX.lemmas(spark, sf), FX.lemma_edges(spark, sf))


_G16 = with_views("lemmas").rstrip() + f""",
d AS (SELECT l.problem_id, l.lemma_id,
  {HS(chr(39) + 'c:' + chr(39) + '||cast(l.problem_id AS varchar)||' + chr(39) + ':' + chr(39) + '||cast(l.lemma_id AS varchar)')} % 2 = 0 AS has_code,
  {HS(chr(39) + 'o:' + chr(39) + '||cast(l.problem_id AS varchar)||' + chr(39) + ':' + chr(39) + '||cast(l.lemma_id AS varchar)')} % 3 <> 0 AS code_ok,
  CASE WHEN {HS(chr(39) + 'p:' + chr(39) + '||cast(l.problem_id AS varchar)||' + chr(39) + ':' + chr(39) + '||cast(l.lemma_id AS varchar)')} % 2 = 0 THEN doc.text ELSE '' END AS proof
  FROM lemmas l JOIN documents doc ON l.problem_id = doc.doc_id)
SELECT problem_id, cast(sum(cast(coalesce(CASE WHEN has_code THEN code_ok ELSE length(proof) > 100 END, false) AS integer)) AS bigint) AS verified,
  count(*) AS total,
  round(avg(cast(coalesce(CASE WHEN has_code THEN code_ok ELSE length(proof) > 100 END, false) AS double)), 6) AS verified_ratio
FROM d GROUP BY problem_id"""


@register("g16_lemma_verified_ratio", _G16)
def g16_lemma_verified_ratio(spark, sf):
    """G16 over the lemma fixture: code present / ran OK / proof text by hash."""
    l = FX.lemmas(spark, sf)
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("problem_id"), "text")
    k = lambda p: FX.H(FX._k(p, F.col("problem_id"), F.col("lemma_id")))
    x = l.join(d, "problem_id").select(
        "problem_id", "lemma_id", (k("c:") % 2 == 0).alias("has_code"), (k("o:") % 3 != 0).alias("code_ok"),
        F.when(k("p:") % 2 == 0, F.col("text")).otherwise(F.lit("")).alias("proof"))
    return EV.lemma_verified_ratio(x)


@register("a6_detect_columns", with_views("problems") +
          "SELECT problem_id, md5(problem) AS question_md5, expected_answer AS answer, md5(gold_solution) AS solution_md5 FROM problems")
def a6_detect_columns(spark, sf):
    """Columns under other names are found and renamed by role."""
    p = FX.problems(spark, sf).select("problem_id", F.col("problem").alias("Problem"), F.col("expected_answer").alias("Final_Answer"),
                                      F.col("gold_solution").alias("generation"))
    r = RD.rename_detected(p)
    return r.select("problem_id", F.md5("question").alias("question_md5"), "answer", F.md5("solution").alias("solution_md5"))


@register("a8_dataset_card", with_views("problems") + """
SELECT 'sources' AS card, data_source AS value, count(*) AS n FROM problems GROUP BY data_source
UNION ALL SELECT 'accuracy', coalesce(cast(round(acc_high_tool, 3) AS varchar), 'none'), count(*) FROM problems GROUP BY round(acc_high_tool, 3)
UNION ALL SELECT 'content', 'rows', count(*) FROM problems
UNION ALL SELECT 'words', 'rows', count(*) FROM problems""")
def a8_dataset_card(spark, sf):
    """The card's tables in one."""
    card = RD.dataset_card(FX.problems(spark, sf), "data_source", "acc_high_tool", "problem")
    rows = [card["sources"].select(F.lit("sources").alias("card"), F.col("data_source").alias("value"), "n"),
            card["accuracy"].select(F.lit("accuracy"), F.coalesce(F.col("accuracy").cast("string"), F.lit("none")), "n"),
            card["content"].select(F.lit("content"), F.lit("rows"), "n"), card["words"].select(F.lit("words"), F.lit("rows"), "n")]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


_CARD_TEXT = f"""problem || CASE {HS("'k:'||cast(problem_id AS varchar)")} % 5
  WHEN 0 THEN chr(10) || '```python' || chr(10) || 'import sympy' || chr(10) || '```' WHEN 1 THEN ' ' || chr(92) || 'boxed{{7}}'
  WHEN 2 THEN ' in Python' ELSE '' END"""
_CARD_SHARES = {"code": "contains(t, '```')", "boxed": "contains(t, chr(92) || 'boxed')",
                "sympy": "contains(lower(t), 'sympy')", "python": "contains(lower(t), 'python')"}


@register("a8_dataset_card_values", with_views("problems").rstrip() + f""",
x AS (SELECT data_source, acc_high_tool, {_CARD_TEXT} AS t FROM problems)
SELECT 'sources' AS card, data_source AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS amount FROM x GROUP BY data_source
UNION ALL SELECT 'accuracy', coalesce(cast(round(acc_high_tool, 3) AS varchar), 'none'), count(*), NULL FROM x GROUP BY round(acc_high_tool, 3)
""" + "".join(f"UNION ALL SELECT 'content', '{k}', count(*), round(avg(cast({c} AS double)), 6) FROM x\n" for k, c in _CARD_SHARES.items())
          + "".join(f"UNION ALL SELECT 'words', 'p{int(p * 100)}', count(*), round(quantile_cont({wc_sql('t')}, {p}), 6) FROM x\n" for p in (0.5, 0.9)))
def a8_dataset_card_values(spark, sf):
    """Every value of the card: % of a source, rows of an accuracy, content shares,
    word quantiles; the texts get code, boxed answers and library names by hash."""
    p = FX.problems(spark, sf)
    k = FX.H(FX._k("k:", F.col("problem_id"))) % 5
    p = p.withColumn("t", F.concat("problem", F.when(k == 0, F.lit("\n```python\nimport sympy\n```")).when(k == 1, F.lit(" \\boxed{7}"))
                                   .when(k == 2, F.lit(" in Python")).otherwise(F.lit(""))))
    card = RD.dataset_card(p, "data_source", "acc_high_tool", "t")
    shares = ", ".join(f"'{x}', {x}_share" for x in _CARD_SHARES)
    rows = [card["sources"].select(F.lit("sources").alias("card"), F.col("data_source").alias("value"), "n", F.col("pct").cast("double").alias("amount")),
            card["accuracy"].select(F.lit("accuracy"), F.coalesce(F.col("accuracy").cast("string"), F.lit("none")), "n", F.lit(None).cast("double")),
            card["content"].selectExpr("'content'", "n", f"stack({len(_CARD_SHARES)}, {shares}) AS (value, amount)").select("content", "value", "n", "amount"),
            card["words"].selectExpr("'words'", "n", "stack(2, 'p50', q50, 'p90', q90) AS (value, amount)").select("words", "value", "n", "amount")]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


_LEMMA_SQL = """SELECT item_id + 1 AS number, 'b' || item_id AS problem_id, item_id * 7 AS answer, 1 AS lemma_no, 'first' AS title,
  md5(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g'))) AS statement_md5, 'check ' || item_id AS verification FROM benchmark
UNION ALL SELECT item_id + 1, 'b' || item_id, item_id * 7, 2, 'second', md5('so'), '' FROM benchmark"""


@register("a12_lemma_markdown", "SELECT cast(number AS bigint) AS number, problem_id, cast(answer AS bigint) AS answer, "
          "cast(lemma_no AS bigint) AS lemma_no, title, statement_md5, verification FROM (" + _LEMMA_SQL + ")")
def a12_lemma_markdown(spark, sf):
    """The benchmark as lemma markdown files, parsed back."""
    path = _scratch(spark, "a12")
    i = F.col("item_id").cast("string")
    one_line = F.trim(F.regexp_replace("text", "[ \\t\\n]+", " "))
    sec = F.concat(F.lit("## Problem "), (F.col("item_id") + 1).cast("string"), F.lit(": title\n\n**ID:** b"), i, F.lit(" | **Answer:** "),
                   (F.col("item_id") * 7).cast("string"), F.lit("\n\n**Lemma 1 (first):** "), one_line, F.lit("\n*Verification:* check "), i,
                   F.lit("\n\n**Lemma 2 (second):** so\n*Verification:* \n"))
    read_table(spark, sf, "benchmark").select(sec.alias("value")).repartition(4).write.mode("overwrite").text(path)
    m = RD.parse_lemma_markdown(spark, path)
    return m.select("number", "problem_id", "answer", "lemma_no", "title", F.md5("statement").alias("statement_md5"), "verification")


@register("d21_parse_lemmas", with_views("problems") + f"""
SELECT problem_id, 1 AS lemma_no, CASE WHEN problem_id % 3 = 0 THEN 'Solve the problem directly' ELSE md5(problem) END AS statement,
  md5(CASE WHEN problem_id % 3 = 0 THEN 'Compute final answer' ELSE {S.strip('problem')} END) AS plan_md5 FROM problems
UNION ALL SELECT problem_id, n, 'lemma ' || n, md5('') FROM problems, range(2, 12) t(n) WHERE problem_id % 3 <> 0""")
def d21_parse_lemmas(spark, sf):
    """Eleven lemmas in a text, or none."""
    p = FX.problems(spark, sf)
    more = F.array_join(F.transform(F.sequence(F.lit(2), F.lit(11)), lambda n: F.concat(
        F.lit("**Lemma "), n.cast("string"), F.lit("**: lemma "), n.cast("string"))), "\n")
    text = F.when(F.col("problem_id") % 3 == 0, F.lit("no sections here")).otherwise(F.concat(
        F.lit("intro **Lemma 1**: - "), F.md5("problem"), F.lit("\n"), F.col("problem"), F.lit("\n"), more))
    return p.select("problem_id", F.posexplode(RD.parse_lemmas(text)).alias("i", "l")).select(
        "problem_id", (F.col("i") + 1).alias("lemma_no"), F.col("l.statement").alias("statement"), F.md5("l.verification_plan").alias("plan_md5"))
