"""Sources and sinks.

Readers take explicit formats (no try-and-see probing); text corpora are read
one file per row (``wholetext``) so many files parse in parallel; sinks write
with ``partitionBy`` where later reads filter on the column (partition
pruning for curriculum tiers).
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

log = logging.getLogger(__name__)

# Column aliases used to detect question/answer/solution columns.
COLUMN_ALIASES = {
    "question": ["question", "problem", "prompt", "input"],
    "answer": ["answer", "expected_answer", "final_answer", "target"],
    "solution": ["solution", "response", "output", "generation"],
}
# The lemma that stands for a text without any.
FALLBACK_LEMMA = ("Solve the problem directly", "Compute final answer")
FORMAT_BY_SUFFIX = {".parquet": "parquet", ".jsonl": "json", ".json": "json", ".csv": "csv"}


def read_trajectories(spark: SparkSession, paths: dict[str, str], schema=None) -> DataFrame:
    """A1: read named splits, tag each with ``split`` and union by name
    (missing columns null).  A split whose path does not exist is skipped with a
    warning, any other failure is raised; no split at all is an error."""
    parts = []
    for split, path in paths.items():
        try:
            r = spark.read.schema(schema) if schema is not None else spark.read
            df = r.parquet(path)
            df.schema  # resolve now so a missing path fails here
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("split %s skipped: %s", split, str(e).splitlines()[0])
            continue
        parts.append(df.withColumn("split", F.lit(split)))
    if not parts:
        raise FileNotFoundError(f"none of the splits could be read: {list(paths)}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A2: parquet / JSON lines / CSV chosen by suffix (or ``fmt``); a
    directory or glob of such files is read as one table."""
    if fmt is None:
        stem = path.rstrip("/").split("/")[-1].lower()
        fmt = next((f for suf, f in FORMAT_BY_SUFFIX.items() if stem.endswith(suf)), "parquet")
    if fmt == "csv":
        return read_problem_csv(spark, path)
    return spark.read.format(fmt).load(path)


def read_problem_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A3: quoted CSV with embedded newlines and doubled quotes (id, problem
    [, answer])."""
    r = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if schema:
        r = r.schema(schema)
    return r.csv(path)


def write_problem_csv(df: DataFrame, path: str) -> None:
    """CSV in the same dialect (quotes doubled) so ``read_problem_csv`` round-trips."""
    (df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def normalise_string_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """A5: null -> "" and every listed column to string."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols})


def detect_columns(columns: list[str], policy: str = "last") -> dict[str, str]:
    """Role -> column name, case-insensitive; ``last`` match wins (DPO
    scripts) or ``first`` (setup script).  Schema-time only, no job."""
    found: dict[str, str] = {}
    for col in columns:
        for role, names in COLUMN_ALIASES.items():
            if col.lower() in names and (policy == "last" or role not in found):
                found[role] = col
    return found


def rename_detected(df: DataFrame, policy: str = "last") -> DataFrame:
    m = detect_columns(df.columns, policy)
    return df.withColumnsRenamed({v: k for k, v in m.items() if v != k})


def write_curated(df: DataFrame, path: str, partition_by: str | None = "accuracy",
                  messages: str | None = "messages") -> None:
    """Parquet with nested messages as a JSON string, partitioned by the
    curriculum column so tier reads prune partitions."""
    out = df
    if messages and messages in df.columns:
        out = out.withColumn(messages, F.to_json(F.col(messages)))
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def messages_of(df: DataFrame, column: str = "messages") -> DataFrame:
    """The JSON column of ``write_curated`` as an array of (role, content), by way of VARIANT; null where it is no such JSON."""
    kept = [F.col(c) for c in df.columns if c != column]
    return df.select(*kept, F.try_variant_get(F.try_parse_json(F.col(column)), "$", "array<struct<role: string, content: string>>").alias(column))


def dataset_card(df: DataFrame, source: str, acc: str, text: str) -> dict[str, DataFrame]:
    """The card's tables as (small) DataFrames -- source shares, accuracy
    histogram, code/boxed shares, word quantiles; rendering is up to the caller."""
    from ..functions.text import word_count
    from ..operators import profile as PR
    words = df.select(word_count(F.col(text)).alias("words"))
    return {"sources": PR.value_share(df, source), "accuracy": PR.accuracy_hist(df, acc),
            "content": PR.content_flags(df, text),
            "words": PR.quantile_linear(words, "words", [0.5, 0.9])}


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Preference pairs as JSON lines."""
    pairs.select("prompt", "chosen", "rejected").write.mode("overwrite").json(path)


def migrate_reward_struct(df: DataFrame) -> DataFrame:
    """A10: add ``extra_info{gold_solution}`` from ``reward_model.gold_solution``
    (missing -> "") and keep ``reward_model``; a no-op when already present.
    Idempotent by schema; write the result to a new path."""
    names = df.columns
    if "extra_info" in names:
        fields = [f.name for f in df.schema["extra_info"].dataType.fields]
        if "gold_solution" in fields:
            return df
        return df.withColumn("extra_info", F.col("extra_info").withField(
            "gold_solution", F.coalesce(F.col("reward_model.gold_solution"), F.lit(""))))
    gold = F.lit("")
    if "reward_model" in names and "gold_solution" in [f.name for f in df.schema["reward_model"].dataType.fields]:
        gold = F.coalesce(F.col("reward_model.gold_solution"), F.lit(""))
    return df.withColumn("extra_info", F.struct(gold.alias("gold_solution")))


def read_solution_files(spark: SparkSession, root: str) -> DataFrame:
    """One text file per attempt at ``{root}/{question}/{i:02d}-{tokens:05d}[-answer].txt``;
    question, attempt number, token count and optional answer come from the
    path (token-id twin files are excluded by the glob)."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    p = F.col("_metadata.file_path")
    pat = r"/([^/]+)/(\d{2})-(\d{5})(?:-([^/.]+))?\.txt$"
    return df.select(
        F.regexp_extract(p, pat, 1).alias("question_id"),
        F.regexp_extract(p, pat, 2).cast("int").alias("attempt"),
        F.regexp_extract(p, pat, 3).cast("int").alias("tokens"),
        F.nullif(F.regexp_extract(p, pat, 4), F.lit("")).alias("answer"),
        F.col("value").alias("text"))


# ------------------------------------------------------------- markdown corpora
SECTION = "## Problem "


def _sections(spark: SparkSession, path: str) -> DataFrame:
    """``sec``: what follows each line that begins with ``## Problem ``.  The mark separates the records that the text source
    reads, so a large file is split over many tasks and no row is a whole file.  A file may begin with a section, or
    with a preamble: the only record that need not begin with a section's number."""
    t = spark.read.option("lineSep", "\n" + SECTION).text(path)
    first = F.startswith("value", F.lit(SECTION))
    return (t.select(F.when(first, F.substring("value", len(SECTION) + 1, 1 << 30)).otherwise(F.col("value")).alias("sec"))
            .where(F.col("sec").rlike(r"^\d+\s*?(\r?\n|:|$)")))


def parse_problem_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A4: ``## Problem N`` sections -> number, subject, MOHS, source,
    original, adapted, integer answer (null when missing)."""
    s = _sections(spark, path)
    sec = F.col("sec")
    ans = F.regexp_extract(sec, r"\*\*Answer:\*\*\s*`?(-?\d+)`?", 1)
    return s.select(
        F.regexp_extract(sec, r"^(\d+)", 1).try_cast("bigint").alias("number"),
        F.regexp_extract(sec, r"\*\*Subject:\*\*\s*([^|\n]*?)\s*(\||\n|$)", 1).alias("subject"),
        F.regexp_extract(sec, r"\*\*MOHS:\*\*\s*(\d+)M", 1).try_cast("bigint").alias("mohs"),
        F.regexp_extract(sec, r"\*\*Source:\*\*\s*([^\n]*?)\s*(\n|$)", 1).alias("source"),
        F.regexp_extract(sec, r"(?s)### Original\s*\n(.*?)\r?\n\s*### ", 1).alias("original"),
        F.regexp_extract(sec, r"(?s)### Adapted[^\n]*\n(.*?)\r?\n\s*\*\*Answer", 1).alias("adapted"),
        F.when(ans != "", ans.try_cast("bigint")).alias("answer"))


def parse_lemmas(text) -> Column:
    """``**Lemma n**: ...`` sections; first line is the
    statement (``- `` stripped), the rest the verification plan; no section ->
    one fallback lemma."""
    t = F.col(text) if isinstance(text, str) else text
    bodies = F.regexp_extract_all(t, F.lit(r"(?is)\*\*Lemma\s*\d+\*\*:?\s*(.+?)(?=\*\*Lemma|$)"), 1)

    def one(b):
        lines = F.split(F.regexp_replace(b, r"^\s+|\s+$", ""), "\n")
        first = F.regexp_replace(F.element_at(lines, 1), r"^[- ]+|[- ]+$", "")
        rest = F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n")
        return F.struct(first.alias("statement"), F.regexp_replace(rest, r"^\s+|\s+$", "").alias("verification_plan"))

    fallback = F.array(F.struct(F.lit(FALLBACK_LEMMA[0]).alias("statement"),
                                F.lit(FALLBACK_LEMMA[1]).alias("verification_plan")))
    return F.when(F.size(bodies) > 0, F.transform(bodies, one)).otherwise(fallback)


def parse_lemma_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``## Problem n: title`` -> id, answer, and one row per
    ``**Lemma k (title):** statement`` with its ``Verification`` line."""
    s = _sections(spark, path)
    sec = F.col("sec")
    base = s.select(
        F.regexp_extract(sec, r"^(\d+)", 1).try_cast("bigint").alias("number"),
        F.regexp_extract(sec, r"\*\*ID:\*\*\s*([^\s|*]+)", 1).alias("problem_id"),
        F.regexp_extract(sec, r"\*\*Answer:\*\*\s*(-?\d+)", 1).try_cast("bigint").alias("answer"),
        F.regexp_extract_all(sec, F.lit(r"\*\*Lemma\s*\d+[^\n]*"), 0).alias("_lem"),
        F.regexp_extract_all(sec, F.lit(r"\*Verification:\*\s*([^\n]*)"), 1).alias("_ver"))
    z = base.select("number", "problem_id", "answer", F.posexplode(F.arrays_zip("_lem", "_ver")).alias("i", "l"))
    head = F.col("l._lem")
    return z.select("number", "problem_id", "answer", (F.col("i") + 1).alias("lemma_no"),
                    F.regexp_extract(head, r"\*\*Lemma\s*\d+\s*\(([^)]*)\)", 1).alias("title"),
                    F.regexp_replace(F.regexp_extract(head, r"\*\*Lemma[^*]*\*\*\s*(.*)$", 1), r"^:\s*", "").alias("statement"),
                    F.col("l._ver").alias("verification"))


CONFIG_KEYS = [f"reason_{e}_{t}_tool" for e in ("high", "medium", "low") for t in ("with", "no")]


def flatten_metadata(df: DataFrame, metadata: str = "metadata", keys: list[str] | None = None) -> DataFrame:
    """Flatten ``map<config, struct<accuracy>>`` into ``acc_<config>`` double
    columns at write time: a map lookup does not push down into a parquet
    scan, a flat column does (B1/B2 filters then prune row groups)."""
    keys = keys or CONFIG_KEYS
    m = F.col(metadata)
    return df.withColumns({f"acc_{k[len('reason_'):]}": F.try_element_at(m, F.lit(k))["accuracy"] for k in keys})
