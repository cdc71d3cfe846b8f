"""Best-fit packing of documents into sequences under conflicts.

Documents longer than a sequence are cut into full sequences and a rest.  The
pieces of a shard are placed by decreasing length.  Open bins are kept in order
of their free space; each has a bitmap of the sources and one of the duplicate
clusters it holds.  The search starts at the least sufficient space and goes on
to the next larger until a bin holds neither the piece's source nor its
cluster; that is the tightest compatible bin.  If there is none, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COPIES = 10_000
SCHEMA = "doc_id bigint, piece bigint, bin_id string, bin_offset bigint, n_tokens bigint"


def best_fit(pieces: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) per piece ``(length, source, cluster)``, in the given order.

    ``source`` and ``cluster`` are numbered from 0 within the shard; None conflicts with nothing.
    """
    free: list[tuple[int, int]] = []            # (free space, bin), ascending
    sources: list[int] = []                     # bitmaps by bin
    clusters: list[int] = []
    placed = []
    for length, source, cluster in pieces:
        s = 0 if source is None else 1 << source
        c = 0 if cluster is None else 1 << cluster
        at = bisect_left(free, (length, -1))
        while at < len(free) and (sources[free[at][1]] & s or clusters[free[at][1]] & c):
            at += 1
        if at < len(free):
            space, b = free.pop(at)
        else:
            space, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        placed.append((b, capacity - space))
        if space > length:
            insort(free, (space - length, b))
    return placed


def pack(docs: DataFrame, capacity: int = 2048, shard_docs: int = 4096, id_col: str = "doc_id",
         length_col: str = "n_tokens", source_col: str | None = "source", cluster_col: str | None = "cluster") -> DataFrame:
    """``doc_id, piece, bin_id, bin_offset, n_tokens``: where each piece of each document lies.

    A bin holds at most one piece of a source and one of a duplicate cluster
    (full sequences are bins of their own).  Rows are dealt by a hash of all their values, and of the number of the copy
    among repeated rows, into shards of about ``shard_docs``, so a hot source, cluster, id (null too) or
    row spreads evenly; shards are packed independently.  The
    result depends only on the rows.  A null or non-positive length has one empty piece;
    a null source or cluster conflicts with nothing; repeated rows are packed each;
    no rows, no pieces; other columns are ignored.
    """
    common.python_workers(docs.sparkSession)
    col = lambda name, kind: F.lit(None).cast(kind) if name is None else F.col(name).cast(kind)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.greatest(F.coalesce(F.col(length_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"),
                       col(source_col, "string").alias("source"), col(cluster_col, "string").alias("cluster"))
    n_shards = max(1, -(-docs.count() // shard_docs))
    # repeated rows are counted, then numbered in two steps, so that no array is longer than COPIES
    counted = rows.groupBy("doc_id", "n", "source", "cluster").agg(F.count(F.lit(1)).alias("copies"))
    rows = (counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))))
            .withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + COPIES, F.col("copies")) - 1)))
            .select("doc_id", "n", "source", "cluster",
                    F.pmod(F.xxhash64("doc_id", "n", "source", "cluster", "copy"), F.lit(n_shards)).alias("shard")))

    def work(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        group = group.sort_by([("n", "descending"), ("doc_id", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        numbers: list[dict] = [{}, {}]
        out: list[tuple] = []
        rest: list[tuple] = []
        full = 0
        for doc, n, source, cluster in zip(*(group.column(k).to_pylist() for k in ("doc_id", "n", "source", "cluster"))):
            whole, left = divmod(n, capacity)
            for piece in range(whole):
                out.append((doc, piece, f"{shard}-f{full}", 0, capacity))
                full += 1
            if left or not n:
                ids = [None if v is None else seen.setdefault(v, len(seen)) for v, seen in zip((source, cluster), numbers)]
                rest.append((left, *ids, doc, whole))
        rest.sort(key=lambda x: -x[0])           # stable
        for (left, _, _, doc, piece), (b, at) in zip(rest, best_fit([x[:3] for x in rest], capacity)):
            out.append((doc, piece, f"{shard}-{b}", at, left))
        cols = list(zip(*out)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                    names=["doc_id", "piece", "bin_id", "bin_offset", "n_tokens"])

    return rows.groupBy("shard").applyInArrow(work, SCHEMA)


def with_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, n_tokens, source, cluster`` of documents: white-space-separated
    words and an end mark; documents with equal texts are a cluster."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), (words + 1).cast("bigint").alias("n_tokens"),
                       F.col(source_col).cast("string").alias("source"), F.md5(text).alias("cluster"))
