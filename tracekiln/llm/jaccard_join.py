"""N-gram Jaccard self-join of documents by chosen paths.

Documents are sets of five-word shingles; those with equal sets are one class
(copies are never paired).  A class has a MinHash signature.  In a run, every
bucket of classes is split on sampled signature positions: members that share the value
at a position fall into a common child.  A bucket of at most ``SMALL`` classes is compared
by brute force, larger ones are split again.  Those that are still large at the greatest depth
hold near copies, or documents that share a long passage.  Their members are compared with the bucket's least
member; those that agree with it are connected through it, and only the others are compared, in blocks, with
all members.  So near copies cost one comparison each, and documents whose signatures differ are not
linked.  A pair of similarity J goes on together with probability J for each
sampled position (one, or two for a quarter of the nodes), so its chance per run is known
for every depth, and there are as many runs as the target recall needs at the greatest
depth.

The brute force in buckets is on signatures and links what may be similar; the
classes that are linked, directly or not, are then all compared exactly, in
blocks of bounded size: every pair with an exact Jaccard similarity of 0.8 or
more is counted, though pairs are never written out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom, common, shingles
from .components import components

SIGNATURE = 64
NODE_SECOND = 4                 # one node in so many is split on two positions
SMALL, DEPTH = 200, 3
SIGNATURE_BLOCK = 1024          # signatures a side in a block pair of a large bucket
BLOCK_SHINGLES = 200_000
SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chance(similarity: float, depth: int) -> float:
    """Probability that a run keeps a pair of this similarity together to some
    bucket of the given depth."""
    p = 1.0
    for _ in range(depth):
        p *= similarity
        p = (1 - 1 / NODE_SECOND) * p + (1 / NODE_SECOND) * (1 - (1 - p) ** 2)
    return p


def runs_for(similarity: float, depth: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - chance(similarity, depth)))


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, part in shingles.words_of(texts):
        for words in part:
            yield np.unique(shingles.ngrams(words))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets, a row each."""
    data = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat(shingles.mix(data * s) >> np.uint64(32), starts) for s in SEEDS], 1).astype("<u4")


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, th, cid, n, sig`` per row: text hash, hash of the shingle set (null: no
    words), its size and signature."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"),
                       F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids, sizes, sigs = [], [], []
            held: list[np.ndarray] = []

            def sign() -> None:
                if held:
                    sigs.extend(r.tobytes() for r in signatures(held))
                    held.clear()

            for s in shingle_sets(b.column(2).to_pylist()):
                if len(s):
                    held.append(s)
                    cids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                else:
                    sign()
                    cids.append(None)
                    sigs.append(None)
                sizes.append(len(s))
                if sum(map(len, held)) > 1 << 17:
                    sign()
            sign()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(sigs, pa.binary())], names=["doc_id", "th", "cid", "n", "sig"])

    return rows.mapInArrow(work, "doc_id bigint, th bigint, cid binary, n bigint, sig binary")


def _at(position) -> Column:
    """Signature value at a position."""
    return F.substring("sig", position * 4 + 1, F.lit(4))


def _shared(df: DataFrame) -> DataFrame:
    """``key, n, cid`` of the keys that occur more than once in ``df (key, cid)``."""
    counts = common.stored(df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    return bloom.admitted(df, F.col("key"), counts, "key").join(counts, "key")


def _least_reachable(agree: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row it is connected to (rows are connected to themselves)."""
    n = len(agree)
    joined = agree | np.eye(n, dtype=bool)
    root = np.arange(n)
    while True:
        new = np.where(joined, root[None, :], n).min(axis=1)
        if (new == root).all():
            return root
        root = new


def _similar_in_buckets(members: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Edges (class, least class it is connected to in the bucket) over pairs whose
    signatures agree in at least ``least`` of the positions."""
    groups = members.join(sigs, "cid").select("key", F.lit(False).alias("right"), F.lit(True).alias("same"), "cid", "sig")
    return _similar_in_groups(groups, ["key"], least)


def _similar_in_groups(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    """Edges within groups of bounded size of ``rows (right, same, cid, sig)``: over all pairs of a group, or, if not
    ``same``, over pairs of a left and a right row."""
    groups = (rows.groupBy(*by).agg(F.first("same").alias("same"), F.sort_array(F.collect_list(F.struct("right", "cid", "sig"))).alias("m"))
              .select("same", "m"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1)
            flat, bounds = column.flatten(), column.offsets.to_numpy()
            rights, cids, data = (flat.field(k) for k in range(3))
            rights, cids, data = rights.to_numpy(zero_copy_only=False), cids.to_pylist(), data.to_pylist()
            lo = bounds[0]
            edges = set()
            for x, y, same in zip(bounds[:-1] - lo, bounds[1:] - lo, b.column(0).to_pylist()):
                sig = np.frombuffer(b"".join(data[x:y]), "<u4").reshape(y - x, SIGNATURE)
                left = y - x if same else int((~rights[x:y]).sum())
                others = sig if same else sig[left:]
                agree = np.zeros((y - x, y - x), bool)
                for k in range(left):
                    agree[k, 0 if same else left:] = (others == sig[k]).sum(axis=1) >= least * SIGNATURE
                root = _least_reachable(agree | agree.T)
                edges.update((cids[x + k], cids[x + r]) for k, r in enumerate(root.tolist()) if k != r)
            a, c = zip(*edges) if edges else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(c, pa.binary())], names=["a", "b"])

    return groups.mapInArrow(work, "a binary, b binary").distinct()


def _similar_in_large(large: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """As ``_similar_in_buckets``, for buckets of any size: the same classes are connected.

    A member that agrees with the bucket's least member is linked to it.  The
    others, the rest, are compared with the rest and with the linked ones in block pairs of ``SIGNATURE_BLOCK``
    signatures a side.  (Two linked members need no comparison: the least one connects them.)
    """
    # joins by bucket are salted by its size
    salts = F.ceil(F.col("n") / SIGNATURE_BLOCK).cast("int")
    every = F.explode(F.sequence(F.lit(0), salts - 1))
    heads = large.groupBy("key", "n").agg(F.min("cid").alias("head"))
    heads = (heads.join(sigs.select(F.col("cid").alias("head"), F.col("sig").alias("head_sig")), "head")
             .select("key", "head", "head_sig", every.alias("salt")))
    salted = large.select("key", "n", "cid", F.pmod(F.xxhash64("cid", F.lit("salt")), salts).cast("int").alias("salt"))
    rows = (salted.join(heads, ["key", "salt"]).join(sigs, "cid")
            .select("key", "cid", "sig", "head", "n", "salt", "head_sig"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, head = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u4").reshape(b.num_rows, SIGNATURE) for k in (2, 6))
            linked = (own == head).sum(axis=1) >= least * SIGNATURE
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(linked)],
                                             names=["key", "cid", "sig", "head", "n", "salt", "linked"])

    judged = common.stored(rows.mapInArrow(compare, "key bigint, cid binary, sig binary, head binary, n bigint, salt int, linked boolean"), "large-buckets")
    blocks = lambda linked: F.ceil(F.count_if(F.col("linked") == linked) / SIGNATURE_BLOCK).cast("int")
    sizes = (judged.groupBy("key", "n").agg(blocks(False).alias("rests"), blocks(True).alias("links")).where("rests > 0")
             .select("key", "rests", "links", every.alias("salt")))
    placed = (judged.join(sizes, ["key", "salt"])
              .withColumn("block", F.pmod(F.xxhash64("cid", F.lit("block")), F.when(F.col("linked"), F.col("links")).otherwise(F.col("rests"))).cast("int")))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rest, linked = placed.where("not linked"), placed.where("linked")
    other = rest.withColumn("other", F.explode(upto("rests")))
    among = other.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.lit(False).alias("outer"),
                         (F.col("block") > F.col("other")).alias("right"), (F.col("block") == F.col("other")).alias("same"), "cid", "sig")
    # the head itself is linked, so there is at least one block of linked ones
    to_linked = rest.withColumn("j", F.explode(upto("links"))).select(
        "key", F.col("block").alias("i"), "j", F.lit(True).alias("outer"), F.lit(False).alias("right"), F.lit(False).alias("same"), "cid", "sig")
    from_linked = linked.withColumn("i", F.explode(upto("rests"))).select(
        "key", "i", F.col("block").alias("j"), F.lit(True).alias("outer"), F.lit(True).alias("right"), F.lit(False).alias("same"), "cid", "sig")
    pairs = among.unionByName(to_linked).unionByName(from_linked)
    return (judged.where("linked and cid <> head").select(F.col("cid").alias("a"), F.col("head").alias("b")).distinct()
            .unionByName(_similar_in_groups(pairs, ["key", "outer", "i", "j"], least)))


def candidate_edges(classes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges ``a, b`` between classes that may be similar: all runs, all depths.

    Each depth's edges are written before the next depth: one query over all of them would have all their
    exchanges at work at once, and the driver would hold the tasks of each.
    """
    sigs = classes.select("cid", "sig")
    found: DataFrame | None = None

    def add(edges: DataFrame) -> DataFrame:
        edges = common.stored(edges, "depth-edges")
        return edges if found is None else found.unionByName(edges)

    rng = np.random.default_rng(5)
    # positions by which the root, which holds all classes, is split in each run
    picks = [(r, int(p)) for r in range(runs_for(threshold, DEPTH, recall))
             for p in rng.choice(SIGNATURE, 1 + (rng.random() < 1 / NODE_SECOND), replace=False)]
    keys = F.array(*[F.xxhash64(F.lit(r), F.lit(p), _at(F.lit(p))) for r, p in picks])
    level = common.stored(_shared(sigs.select("cid", F.explode(keys).alias("key")))
                          .select("key", "n", "cid"), "buckets")
    depth = 1
    while True:
        ripe = level.where(F.col("n") <= SMALL)
        found = add(_similar_in_buckets(ripe, sigs, 0.75 * threshold))
        large = level.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        if depth == DEPTH:
            found = add(_similar_in_large(large, sigs, 0.75 * threshold))
            break
        # a bucket's own positions
        first = F.pmod(F.xxhash64("key", F.lit("first")), F.lit(SIGNATURE)).cast("int")
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("key", F.lit("second")), F.lit(SIGNATURE - 1)).cast("int"), F.lit(SIGNATURE))
        two = F.pmod(F.xxhash64("key", F.lit("two")), F.lit(NODE_SECOND)) == 0
        child = lambda p: F.xxhash64("key", p, _at(p))
        split = (large.join(sigs, "cid")
                 .select("cid", F.explode(F.when(two, F.array(child(first), child(second))).otherwise(F.array(child(first)))).alias("key")))
        counts = split.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        level = common.stored(split.join(counts, "key").select("key", "n", "cid"), "buckets")
        depth += 1
    return common.stored(found.distinct(), "candidate-edges")


def _links(sets: list[np.ndarray], left: int, same: bool, threshold: tuple[int, int]) -> np.ndarray:
    """Boolean matrix: which of the first ``left`` sets are similar to which of
    the others (of all, if ``same``), by exact intersection counts."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common_code = df[code] > 1
    order = np.argsort(code[common_code], kind="stable")
    owner, code = owner[common_code][order], code[common_code][order]
    rows = np.arange(left)
    cols = rows if same else np.arange(left, len(sets))
    shared = np.zeros((len(rows), len(cols)), np.float32)
    starts = np.flatnonzero(np.diff(code, prepend=-1)) if len(code) else np.zeros(0, np.int64)
    for lo in range(0, len(starts), 2048):
        ends = starts[lo + 2048] if lo + 2048 < len(starts) else len(code)
        part = slice(starts[lo], ends)
        place = np.searchsorted(starts[lo:lo + 2048], np.arange(part.start, part.stop), side="right") - 1
        m = np.zeros((len(sets), min(2048, len(starts) - lo)), np.float32)
        m[owner[part], place] = 1
        shared += m[rows] @ m[cols].T
    num, den = threshold
    union = sizes[rows][:, None] + sizes[cols][None, :] - shared
    similar = shared * den >= union * num
    if same:
        np.fill_diagonal(similar, False)
    return similar


def exact_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: tuple[int, int], id_col: str,
                text_col: str) -> DataFrame:
    """``cid, n_classes, n_docs, b``: links of each class within its cluster and the
    least class it is connected to, a row for each block pair that holds it."""
    inside = common.stored(clusters.select(F.col("node").alias("cid"), F.col("root").alias("cluster"))
                           .join(classes.select("cid", "n", "copies", "doc_id", "th"), "cid"), "clustered")
    sizes = inside.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    pointers = inside.select("cid", "copies", "doc_id", "th", "cluster").withColumn("at", F.xxhash64("doc_id", "th"))
    texts = (docs.select(F.col(id_col).cast("bigint").alias("d"), F.xxhash64(F.col(text_col).cast("string")).alias("t"),
                         F.col(text_col).cast("string").alias("text")).withColumn("at", F.xxhash64("d", "t")))
    texts = bloom.admitted(texts, F.col("at"), pointers, "at")
    members = (texts.join(pointers, "at").where("d <=> doc_id and t = th").dropDuplicates(["cid"])
               .join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
               .groupBy("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
               .agg(F.sort_array(F.collect_list(F.struct((F.col("block") != F.least("block", "other")).alias("right"), "cid", "copies", "text"))).alias("m"))
               .select((F.col("i") == F.col("j")).alias("same"), "m"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same, group in ((s.as_py(), g.as_py()) for b in batches for s, g in zip(*b.columns)):
            left = sum(not r["right"] for r in group)
            if len(group) < 2 or not same and left in (0, len(group)):
                continue
            similar = _links(list(shingle_sets([r["text"] for r in group])), left, same, threshold)
            full = np.zeros((len(group), len(group)), bool)
            full[:left, 0 if same else left:] = similar
            full |= full.T
            copies = np.array([r["copies"] for r in group])
            root = _least_reachable(full)
            has = np.flatnonzero(full.any(axis=1))
            cids = [r["cid"] for r in group]
            yield pa.RecordBatch.from_arrays([
                pa.array([cids[k] for k in has], pa.binary()), pa.array(full[has].sum(axis=1), pa.int64()),
                pa.array(full[has] @ copies, pa.int64()), pa.array([cids[root[k]] for k in has], pa.binary())],
                names=["cid", "n_classes", "n_docs", "b"])

    return common.stored(members.mapInArrow(work, "cid binary, n_classes bigint, n_docs bigint, b binary"), "links")


def similarity_join(docs: DataFrame, threshold: tuple[int, int] = (4, 5), recall: float = 0.999, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, th, class_id, group_id, n_links, first``.

    ``class_id``: least id of the documents with the same shingle set; ``group_id``: least id that similar
    documents (Jaccard ``threshold``, a fraction, or more) connect it to; ``n_links``: other documents
    similar to it, copies included; ``th``: hash of the text; ``first``: whether the document is the group's one with the
    least id (then least hash), the same for repeated rows.  A text of fewer than five words
    is one shingle; a text without words, or null, is similar to nothing and a group of
    its own.  A null id sorts last.  No rows, no result; other columns are ignored.
    """
    spark = docs.sparkSession
    common.python_workers(spark)
    rows = common.stored(describe(docs, id_col, text_col), "shingle-sets")
    at = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "th")
    classes = common.stored(rows.where("cid is not null").groupBy("cid").agg(
        F.min(at).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .select("cid", "at.doc_id", "at.th", "at", "copies", "n", "sig"), "classes")
    edges = candidate_edges(classes, threshold[0] / threshold[1], recall)
    links = exact_links(docs, classes, components(edges), threshold, id_col, text_col)
    groups = components(links.select(F.col("cid").alias("a"), "b"))
    counted = links.groupBy("cid").agg(F.sum("n_docs").alias("n_docs"))
    # read twice: by the groups' least documents and by the join with them
    known = common.stored(classes.select("cid", "at", "copies").join(counted, "cid", "left")
                          .join(groups.withColumnRenamed("node", "cid"), "cid", "left")
                          .withColumn("root", F.coalesce("root", "cid")), "judged-classes")
    known = known.join(known.groupBy("root").agg(F.min("at").alias("group_at")), "root")
    out = rows.select("doc_id", "th", "cid", at.alias("own")).join(
        known.select("cid", "at", "group_at", (F.col("copies") - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links")), "cid", "left")
    return out.select("doc_id", "th", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("at.doc_id")).alias("class_id"),
                      F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("group_at.doc_id")).alias("group_id"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      (F.col("cid").isNull() | (F.col("own") == F.col("group_at"))).alias("first"))


def one_of_each_group(docs: DataFrame, threshold: tuple[int, int] = (4, 5), recall: float = 0.999, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the least id.
    Of repeated rows one stays; documents without words all stay."""
    judged = common.stored(similarity_join(docs, threshold, recall, id_col, text_col), "judged-documents")
    stay = (judged.where("first").groupBy(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "th").alias("__at")).agg(F.first("doc_id").alias("__id")))
    text = F.col(text_col).cast("string")
    same = Window.partitionBy("__at").orderBy(F.lit(0))
    words = text.rlike(r"(?U)\w")
    keyed = docs.withColumn("__at", F.xxhash64(F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)), F.col(id_col).isNull(), F.xxhash64(text)))
    kept = keyed.join(stay.select("__at"), "__at", "left_semi").withColumn("__row", F.row_number().over(same))
    return kept.where((F.col("__row") == 1) | ~F.coalesce(words, F.lit(False))).select(*docs.columns)
