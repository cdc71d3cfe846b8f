"""Benchmark decontamination: test items contained in documents.

An item is contained in a document if at least 0.8 of its distinct five-word shingles
occur there (an item of fewer words is one shingle).  Search by MinHash sketches
in partitions by item size: an item of at most ``u`` shingles keeps the ``k`` smallest
of its shingle hashes, ``k = floor((1 - t) u) + 1``.  A document that contains
the item misses at most ``floor((1 - t) u)`` of them, so it holds one
of any ``k``: the search loses nothing, and a long document is only asked
for the few sketched hashes.  Candidates are verified by comparing the shingles' words.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

SCHEMA = "doc_id bigint, item_id bigint, n_shared bigint, n_shingles bigint, containment double"
TABLE_BITS = 20


def _sizes(n: int) -> int:
    """Upper bound of the size partition of ``n`` shingles: powers of two."""
    return 1 << max(0, n - 1).bit_length()


class ItemIndex:
    """Sketches and shingles of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float, ngram: int = shingles.NGRAM):
        self.need: list[int] = []
        self.ids: list[int | None] = []
        self.sets: list[dict[int, tuple[str, ...]]] = []
        self.grams: list[int] = []
        sketch: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))   # words a shingle: hash: items
        # as written, 0.8 is a fraction of integers, not the nearest binary number
        t = Fraction(str(threshold))
        for item, text in items:
            words = shingles.word_list(text)
            if not words:
                continue
            g = min(ngram, len(words))
            strings = [tuple(words[i:i + g]) for i in range(len(words) - g + 1)]
            hashes = shingles.ngrams(next(shingles.words_of([text]))[1][0], ngram).tolist()
            own = dict(zip(hashes, strings))
            n, k = len(own), len(self.ids)
            bound = min(n, math.floor((1 - t) * _sizes(n)) + 1)
            for h in sorted(own)[:bound]:
                sketch[g][h].append(k)
            self.ids.append(item)
            self.sets.append(own)
            self.grams.append(g)
            self.need.append(math.ceil(t * n))
        self.by_gram = []
        for g, table in sketch.items():
            seen = np.zeros(1 << TABLE_BITS, bool)
            keys = np.array(list(table), np.uint64)
            seen[keys >> np.uint64(64 - TABLE_BITS)] = True
            self.by_gram.append((g, seen, dict(table)))

    def search(self, words: np.ndarray, text: str) -> list[tuple[int | None, int, int]]:
        """(item, shared shingles, its shingles) of every item contained in a document."""
        found = []
        spelled: list[str] | None = None
        for g, seen, table in self.by_gram:
            if len(words) < g:
                continue
            hashes = shingles.ngrams(words, g)
            near = hashes[seen[hashes >> np.uint64(64 - TABLE_BITS)]]
            candidates = {k for h in np.unique(near).tolist() if h in table for k in table[h]}
            if not candidates:
                continue
            if spelled is None:
                spelled = shingles.word_list(text)
            where = dict(zip(hashes.tolist(), range(len(hashes))))      # a hash's last place
            for k in candidates:
                shared = 0
                for h, gram in self.sets[k].items():
                    at = where.get(h)
                    if at is not None and tuple(spelled[at:at + g]) == gram:
                        shared += 1
                if shared >= self.need[k]:
                    found.append((self.ids[k], shared, len(self.sets[k])))
        return found


def _blocks(docs: DataFrame, items: DataFrame, threshold: float, item_id: str, item_text: str, block_bytes: int):
    """Broadcast indexes over the items, each over at most ``block_bytes`` of text (or one item)."""
    spark = docs.sparkSession
    common.python_workers(spark)
    wanted = (items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))
              .where("text is not null").distinct())
    size = wanted.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    n_blocks = math.ceil(1.5 * size / block_bytes) if size > block_bytes else 1
    for b in range(n_blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        yield spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in block], threshold))


def find_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id",
                      text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                      block_bytes: int = 1 << 20) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment`` for every item contained in a document.

    Items are taken in blocks of at most ``block_bytes`` of text (or one item), each broadcast and
    searched for in one pass over the documents; a larger benchmark means more
    passes.  Null or wordless texts match nothing; repeated documents
    match each, repeated items count once; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for shared in _blocks(docs, items, threshold, item_id, item_text, block_bytes):
        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = [(ids[first + k], *hit) for first, part in shingles.words_of(texts)
                       for k, words in enumerate(part) for hit in index.search(words, texts[first + k])]
                cols = list(zip(*out)) or [[]] * 4
                arrays = [pa.array(c, pa.int64()) for c in cols]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array([s / n for s, n in zip(cols[2], cols[3])], pa.float64())],
                    names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"])

        found.append(rows.mapInArrow(work, SCHEMA))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text_col: str = "text",
                      item_id: str = "item_id", item_text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """``docs`` without the rows that contain an item, one filter for each block of items."""
    for shared in _blocks(docs, items, threshold, item_id, item_text, block_bytes):
        docs = docs.where(~_contains(shared)(F.col(text_col).cast("string")))
    return docs


def _contains(shared):
    @F.pandas_udf("boolean")
    def contains(texts: pd.Series) -> pd.Series:
        given = [t if isinstance(t, str) else None for t in texts]
        return pd.Series([bool(shared.value.search(words, given[first + k]))
                          for first, part in shingles.words_of(given) for k, words in enumerate(part)], dtype=bool)

    return contains
