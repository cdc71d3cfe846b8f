"""Exact top-k inner products by best-first search in paged M-trees.

Distinct vectors are dealt to pages by their nearest routing vector; every page
is an M-tree: a node's entries are routing vectors with a covering radius and
the distance to their parent, a leaf's entries are vectors with that distance.
For a query q and a ball with centre c and radius r, no inner product in it
exceeds ``q.c + |q| r``; and ``q.c <= q.p + |q| d(c, p)`` for the parent p, so the
stored distances rule entries out before their inner products are computed.
A block of queries descends together, always into the node of the highest bound that some
query still needs.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LEAF, FANOUT, PAGE_ROWS, SAMPLE, PIVOTS, BLOCK = 128, 16, 4096, 4096, 128, 512
SLACK = 1e-9
EXACT_FLOAT, EXACT_INT = 2.0 ** 53, 2.0 ** 63


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, whatever their size (cut to 64 bits)."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < EXACT_FLOAT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < EXACT_INT:
        return a @ b.T
    big = a.astype(object) @ b.astype(object).T
    return np.clip(big, -(2 ** 63), 2 ** 63 - 1).astype(np.int64)


class MTree:
    """Bulk-loaded tree over distinct integer vectors."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.vectors = vectors
        self.floats = vectors.astype(np.float64)
        self.center = self.floats.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
        rng = np.random.default_rng(seed)
        away = self._distance(np.arange(len(vectors)), self.center)
        self.radius = float(away.max(initial=0))
        self.root = self._node(np.arange(len(vectors)), away, rng)

    def _distance(self, rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.floats[rows] - center) ** 2).sum(axis=1))

    def _node(self, rows: np.ndarray, away: np.ndarray, rng) -> tuple:
        """("leaf", rows, parent distances) or ("node", routing rows, radii, parent distances, children)."""
        if len(rows) <= LEAF:
            return "leaf", rows, away
        routing = rng.choice(len(rows), FANOUT, replace=False)
        nearest, least = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
        for k, r in enumerate(routing):
            d = self._distance(rows, self.floats[rows[r]])
            closer = d < least
            nearest[closer], least[closer] = k, d[closer]
        parts = [np.flatnonzero(nearest == k) for k in range(FANOUT)]
        used = [k for k in range(FANOUT) if len(parts[k])]
        return ("node", rows[routing[used]], np.array([least[parts[k]].max() for k in used]), away[routing[used]],
                [self._node(rows[parts[k]], least[parts[k]], rng) for k in used])

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, rows) of each query's ``k`` best vectors with a score of at least ``floor``, and the number
        of inner products computed.  Ties go to the smaller row; row -1 means none."""
        q = queries.astype(np.float64)
        norm = np.sqrt((q ** 2).sum(axis=1))
        scores = np.full((len(q), k), np.iinfo(np.int64).min)
        rows = np.full((len(q), k), -1, np.int64)
        need = floor.astype(np.float64).copy()
        asked = 0
        order = count()
        at_root = q @ self.center
        heap = [(-np.inf, next(order), self.root, np.arange(len(q)), at_root + norm * self.radius, at_root)]
        while heap:
            _, _, node, who, bound, to_parent = heapq.heappop(heap)
            live = bound + SLACK * np.abs(bound) + 1 >= need[who]
            who, to_parent = who[live], to_parent[live]
            if not len(who):
                continue
            away = node[2] if node[0] == "leaf" else node[3] + node[2]
            before = to_parent[:, None] + norm[who][:, None] * away
            entries = np.flatnonzero((before + SLACK * np.abs(before) + 1 >= need[who][:, None]).any(axis=0))
            if not len(entries):
                continue
            asked += len(who) * len(entries)
            if node[0] == "leaf":
                found = node[1][entries]
                got = _dots(queries[who], self.vectors[found])
                better = np.flatnonzero((got >= need[who][:, None]).any(axis=1))
                if not len(better):
                    continue
                who, got = who[better], got[better]
                all_scores = np.concatenate((scores[who], got), axis=1)
                all_rows = np.concatenate((rows[who], np.broadcast_to(found, got.shape)), axis=1)
                best = np.lexsort((np.where(all_rows < 0, np.iinfo(np.int64).max, all_rows), -all_scores.astype(np.float64)), axis=1) \
                    if np.abs(all_scores[all_rows >= 0]).max(initial=0) < EXACT_FLOAT else \
                    np.stack([np.array(sorted(range(s.size), key=lambda j: (-int(s[j]), r[j] if r[j] >= 0 else 2 ** 62)))
                              for s, r in zip(all_scores, all_rows)])
                best = best[:, :k]
                scores[who], rows[who] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_rows, best, 1)
                full = rows[who][:, -1] >= 0
                need[who[full]] = np.maximum(need[who[full]], scores[who[full], -1].astype(np.float64))
                continue
            to_center = q[who] @ self.floats[node[1][entries]].T
            bounds = to_center + norm[who][:, None] * node[2][entries]
            for col, e in enumerate(entries):
                heapq.heappush(heap, (-float(bounds[:, col].max()), next(order), node[4][e], who, bounds[:, col], to_center[:, col]))
        return scores, rows, asked


def _rows(vectors: list[list[int]], dim: int) -> np.ndarray:
    return np.array(vectors, np.int64).reshape(len(vectors), dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component as a double.  Rows with a null id, a
    null vector or a null or non-finite component (or one beyond 64 bits) are left out."""
    scaled = F.transform(F.col(vec_col), lambda x: x.cast("double") * F.lit(float(scale)))
    return (vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), scaled.alias("x"))
            .where("vec_id is not null and x is not null and forall(x, y -> y is not null and abs(y) < 9.2e18)")
            .select("vec_id", F.transform("x", lambda y: F.floor(y)).alias("v")).distinct())


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by
    ``every`` the ``k`` other rows of the highest integer inner product, ties to the smaller id.

    Vectors of another length than the query's take no part; repeated rows count once, the query's own id
    never.  Equal vectors are searched once: at most k + 1 of their ids can matter.  Routing vectors and a first
    lower bound per query come from a sample of ``SAMPLE`` vectors; the
    search itself covers all.  No rows, no result; other columns are ignored.
    """
    spark = vectors.sparkSession
    common.python_workers(spark)
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    same = Window.partitionBy("v").orderBy("vec_id")
    distinct = common.stored(
        rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).groupBy("v")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v")), "distinct-vectors")
    sample = [(r.v, r.ids[0]) for r in distinct.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
    by_dim = {d: _rows([v for v, _ in sample if len(v) == d], d) for d in {len(v) for v, _ in sample}}
    shared = spark.sparkContext.broadcast(by_dim)               # at most SAMPLE vectors

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot = np.zeros(b.num_rows, np.int32)
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims):
                pivots = shared.value.get(int(dim), np.zeros((0, dim)))[:PIVOTS].astype(np.float64)
                at = np.flatnonzero(dims == dim)
                if len(pivots):
                    x = _matrix(b.column(0).take(pa.array(at)), int(dim)).astype(np.float64)
                    pivot[at] = ((pivots ** 2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot)], names=["v", "ids", "dim", "pivot"])

    routed = distinct.select("v", "ids", "dim").mapInArrow(route, "v array<bigint>, ids array<bigint>, dim int, pivot int")
    routed = common.stored(routed, "routed-vectors")
    sizes = routed.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / PAGE_ROWS).cast("bigint").alias("pages"))
    paged = routed.join(F.broadcast(sizes), ["dim", "pivot"]).withColumn("page", F.pmod(F.xxhash64("v"), F.col("pages")))

    def build(key: tuple, group: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        group = group.combine_chunks()
        order = np.argsort([x[0].as_py() for x in group["ids"]], kind="stable")
        group = group.take(pa.array(order))                     # rows by smallest id: ties by row are ties by id
        tree = MTree(_matrix(group["v"].chunk(0), dim))
        return pa.table({"dim": pa.array([dim], pa.int32()), "tree": [pickle.dumps(tree)],
                         "ids": pa.array([group["ids"].to_pylist()], pa.list_(pa.list_(pa.int64())))})

    trees = common.stored(paged.groupBy("dim", "pivot", "page").applyInArrow(build, "dim int, tree binary, ids array<array<bigint>>"),
                          "mtree-pages")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("dim", F.size("v"))
    n_blocks = max(1, -(-asked.count() // BLOCK))
    blocks = (asked.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"))
              .agg(F.collect_list(F.struct("vec_id", "v")).alias("queries")))
    # a pair of page and block is a task's unit of work; a fixed number of partitions, or few bytes would be merged into few tasks
    n_pairs = max(1, trees.count() * n_blocks)
    tasks = min(n_pairs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    pairs = (trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, ["dim", "block"])
             .select("dim", "tree", "ids", "queries").repartition(tasks))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, tree, ids, queries in ((x.as_py() for x in row) for b in batches for row in zip(*b.columns)):
            tree = pickle.loads(tree)
            wanted = _rows([r["v"] for r in queries], dim)
            known = shared.value.get(dim)
            floor = np.full(len(queries), -np.inf)
            if known is not None and len(known) > k:
                floor = np.sort(_dots(wanted, known), axis=1)[:, -(k + 1)].astype(np.float64)
                floor -= SLACK * np.abs(floor)
            scores, rows_, _ = tree.search(wanted, k + 1, floor)
            out = []
            for r, s, at in zip(queries, scores.tolist(), rows_.tolist()):
                hits = [(-x, i) for x, a in zip(s, at) if a >= 0 for i in ids[a] if i != r["vec_id"]]
                out += [(r["vec_id"], i, -x) for x, i in sorted(hits)[:k]]
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
