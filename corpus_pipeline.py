"""Corpus preparation: documents through five stages.

Toxic documents go, later near-duplicate lines go, one document of each group of near
copies stays, documents that contain benchmark items go, and the rest is
packed into sequences.  Each stage reads what the one before kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekiln.llm import common, decontaminate, jaccard_join, line_dedup, packing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches their language's threshold.
    The classifier learns from the labelled ones among ``docs``."""
    net = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, net).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later near-duplicate lines; ``n_chars`` follows.  A document that had
    words and has lost all its lines with words goes; others stay."""
    cleaned = line_dedup.dedup_lines(docs, keep=("lang", "source", "n_chars"))
    emptied = (F.trim(F.regexp_replace("text", r"\s+", " ")) == "") & (F.col("n_kept") < F.col("n_lines"))
    changed = F.col("n_kept") < F.col("n_lines")
    return (cleaned.where(~F.coalesce(emptied, F.lit(False)))
            .withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("bigint"))
            .select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a Jaccard similarity of 0.8 connects."""
    return jaccard_join.one_of_each_group(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.pack(packing.with_lengths(docs))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_contaminated), ("best-fit packing", pack_sequences)]

# The classifier, the sketches and the packing order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and reread."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
