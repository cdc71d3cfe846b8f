"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges ``a > b``.  Large star: every larger neighbour of a node is linked
    to the least of its neighbours and itself; small star: the node and its smaller neighbours."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = (edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
               .unionByName(least.select("a", F.col("m").alias("b"))))
    return out.where("a > b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: for every node of ``edges (a, b)`` the least node it is connected to.

    Every round is written to shared storage.  Ends when a round changes nothing; the rounds grow with the
    logarithm of the longest path.  Loops and null ends are ignored.
    """
    edges = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                          "edges")
    nodes = edges.select(F.col("b").alias("node")).unionByName(edges.select(F.col("a").alias("node"))).distinct()
    state = None
    for _ in range(most_rounds):
        edges = common.stored(_star(_star(edges, large=True), large=False), "edges")
        # a forest of stars when no root has a root; otherwise go on
        seen = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left") \
        .select("node", F.coalesce("root", "node").alias("root"))
