"""Exact top-k retrieval over embedding vectors (K1-K3).

Both sides are cut into blocks of bounded size: a vector's cell is the side of each of a few fixed
random planes that it lies on, and a cell's vectors are dealt to as many blocks as they need, in K2 by domain.  A
block has a centre and a covering radius (angles), so each pair of a query block and a corpus
block has a least and a largest possible inner product.  For each query block the corpus
blocks with the largest least products that hold ``k`` vectors together give a threshold that every
query reaches; block pairs whose largest product is below it are ruled out before any vectors are
joined.  The pairs left are scored with numpy inside ``mapInArrow``; a pair returns at most ``k`` rows per query, and
``row_number() <= k`` per query merges them (WindowGroupLimit).  Nothing passes through
the driver, and neither side has a size limit.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_words, word_count
from ..session import ensure_checkpoint_dir

RESULT_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
    T.StructField("score", T.DoubleType())])


def normalise(vec) -> F.Column:
    """L2-normalised copy of an array<float|double> as array<double>."""
    v = F.transform(F.col(vec) if isinstance(vec, str) else vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def centroids(corpus: DataFrame, group: str = "label", vec: str = "embedding") -> DataFrame:
    """Per-group mean vector (distributed: posexplode + groupBy), normalised."""
    e = corpus.select(group, F.posexplode(vec).alias("pos", "x"))
    m = e.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = m.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_v"))
    return c.select(F.col(group).cast("long").alias("query_id"), F.col(group).alias("query_group"),
                    normalise(F.transform("_v", lambda s: s["x"])).alias("qvec"))


PLANES = 8              # at most: 256 cells
SLACK = 1e-7            # of angles, for rounding


def _block_table(df: DataFrame, keys: list, planes: int, rows: int, label: str) -> DataFrame:
    """``keys, block, ids, vecs, centre, radius, n``: the rows ``keys, id, v`` in blocks of about ``rows``
    vectors of the same cell, written to the shared folder (both the bounds and the join read it)."""
    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch["v"].to_pylist(), dtype=np.float64)
            normals = np.random.default_rng(7).normal(size=(planes, v.shape[1]))        # the same in every task
            cell = (v @ normals.T > 0) @ (1 << np.arange(planes))
            cell[~v.any(axis=1)] = -1                               # vectors of zeros have no direction
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    schema = ", ".join([*[f"{c} string" for c in keys], "id bigint, v array<double>, cell int"])
    dealt = df.select(*keys, "id", "v").mapInArrow(assign, schema)
    dealt = _written(dealt, label)
    sizes = dealt.groupBy(*keys, "cell").agg(F.ceil(F.count("*") / rows).cast("bigint").alias("_n"))
    blocks = (dealt.join(sizes, [*keys, "cell"]).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")))
              .groupBy(*keys, "cell", "_b").agg(F.collect_list(F.struct("id", "v")).alias("r"))
              .select(*keys, F.concat_ws(":", *keys, "cell", "_b").alias("block"), F.col("r.id").alias("ids"), F.col("r.v").alias("vecs")))

    def bounded(batches):
        for batch in batches:
            centres, radii = [], []
            for vecs in batch["vecs"].to_pylist():
                x = np.array(vecs, dtype=np.float64)
                centre = x.mean(axis=0)
                norm = np.linalg.norm(centre)
                size = np.linalg.norm(x, axis=1)
                if norm < 1e-9 or (size < 0.5).any():               # no common direction: bounds that rule out nothing
                    centres.append(centre * 0)
                    radii.append(np.pi)
                else:
                    centres.append(centre / norm)
                    radii.append(float(np.arccos(np.clip((x @ (centre / norm) / size).min(), -1, 1))) + SLACK)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tolist() for c in centres], pa.list_(pa.float64())), pa.array(radii, pa.float64()),
                                              pa.array([len(i) for i in batch["ids"].to_pylist()], pa.int64())],
                                             [*batch.schema.names, "centre", "radius", "n"])

    schema = ", ".join([*[f"{c} string" for c in keys], "block string, ids array<bigint>, vecs array<array<double>>, centre array<double>, radius double, n bigint"])
    return _written(blocks.mapInArrow(bounded, schema), label)


def _written(df: DataFrame, label: str) -> DataFrame:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_pairs(qb: DataFrame, cb: DataFrame, keys: list, k: int) -> DataFrame:
    """``q, c, joined``: all pairs of a query block and a corpus block (of the same domain), and
    whether their vectors have to be compared.  Only centres and radii are read."""
    q = qb.select(*keys, F.col("block").alias("q"), F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"))
    c = cb.select(*keys, F.col("block").alias("c"), "centre", "radius", "n")
    # the query blocks' numbers are the join key: each corpus block meets every one of its domain
    numbers = q.groupBy(*keys).agg(F.collect_list("q").alias("_all"))
    spread = c.join(numbers, keys) if keys else c.withColumn("_all", numbers.scalar())
    pairs = spread.withColumn("q", F.explode("_all")).drop("_all").join(q, [*keys, "q"])
    dot = F.aggregate(F.zip_with("centre", "q_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    wide = F.col("radius") + F.col("q_radius")
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    pairs = pairs.select("q", "c", "n", F.cos(F.least(F.lit(math.pi), angle + wide)).alias("least"), F.cos(F.greatest(F.lit(0.0), angle - wide)).alias("most"))
    by_least = Window.partitionBy("q").orderBy(F.desc("least"), "c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.when(F.sum("n").over(by_least) >= k, F.col("least"))
    threshold = F.coalesce(F.max("_reached").over(Window.partitionBy("q")), F.lit(-1.0))
    return pairs.withColumn("_reached", reached).select("q", "c", (F.col("most") + SLACK >= threshold).alias("joined"))


def topk_similar(queries: DataFrame, corpus: DataFrame, k: int = 5, vec: str = "embedding",
                 id_col: str = "vec_id", partition: str | None = None, query_rows: int = 512,
                 corpus_rows: int = 4096) -> DataFrame:
    """K1 (and K2 with ``partition``): top-k corpus rows per query by inner
    product of normalised vectors; ties by id.

    ``queries`` has ``query_id``, ``qvec`` (normalised) and, for K2, ``query_group``.  Vectors
    of a side must have one length; null vectors take no part."""
    local = _blockwise(queries, corpus, k, vec, id_col, partition, query_rows, corpus_rows)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sides(queries: DataFrame, corpus: DataFrame, vec: str, id_col: str, partition: str | None, query_rows: int, corpus_rows: int) -> tuple[DataFrame, DataFrame, list]:
    keys = ["_group"] if partition else []
    q = queries.where("qvec is not null").select(F.col("query_id").cast("bigint").alias("id"), F.col("qvec").alias("v"),
                                                 *([F.col("query_group").cast("string").alias("_group")] if partition else []))
    c = corpus.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), normalise(vec).alias("v"),
                                                    *([F.col(partition).cast("string").alias("_group")] if partition else []))
    if partition:
        q, c = q.where("_group is not null"), c.where("_group is not null")
    planes = min(PLANES, (-(-c.count() // corpus_rows)).bit_length() + 2)       # some four cells for each block that the corpus needs
    return _block_table(q, keys, planes, query_rows, "query-blocks"), _block_table(c, keys, planes, corpus_rows, "corpus-blocks"), keys


def _blockwise(queries: DataFrame, corpus: DataFrame, k: int, vec: str, id_col: str, partition: str | None, query_rows: int, corpus_rows: int) -> DataFrame:
    qb, cb, keys = _sides(queries, corpus, vec, id_col, partition, query_rows, corpus_rows)
    side = lambda d, name: d.select(F.col("block").alias(name), F.col("ids").alias(f"{name}_ids"), F.col("vecs").alias(f"{name}_vecs"))
    pairs = (block_pairs(qb, cb, keys, k).where("joined").join(side(cb, "c"), "c").join(side(qb, "q"), "q")
             .select("q_ids", "q_vecs", "c_ids", "c_vecs"))

    def score(batches):
        for batch in batches:
            for qid, qv, vid, cv in zip(*(batch.column(i) for i in range(4)), strict=True):
                qid, vid = np.array(qid.as_py(), np.int64), np.array(vid.as_py(), np.int64)
                s = np.array(qv.as_py(), dtype=np.float64) @ np.array(cv.as_py(), dtype=np.float64).T
                order = np.lexsort((np.broadcast_to(vid, s.shape), -s), axis=1)[:, :k]
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qid, n), pa.int64()), pa.array(vid[order].ravel(), pa.int64()),
                     pa.array(np.take_along_axis(s, order, 1).ravel(), pa.float64())], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(score, RESULT_SCHEMA)


def rag_corpus(df: DataFrame, answer: str, solution: str, min_words: int = 20, cut_words: int | None = None) -> DataFrame:
    """K3: rows with a valid integer answer and at least ``min_words`` words;
    the solution's words (the first ``cut_words``, if given) joined by a space."""
    from ..functions.answers import parse_int_answer
    d = df.withColumn("_ans", parse_int_answer(F.col(answer))).withColumn("_wc", word_count(F.col(solution)))
    return d.where(F.col("_ans").isNotNull() & (F.col("_wc") >= min_words)) \
            .withColumn("rag_text", first_words(F.col(solution), cut_words)) \
            .withColumnRenamed("_ans", "answer_int").drop("_wc")
