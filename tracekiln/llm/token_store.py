"""Token ids of documents in binary files with Elias-Fano document boundaries.

File layout (little endian)::

    magic "TKIDEF01"
    ids          n_tokens x width bytes (uint16 if the vocabulary allows, else uint32)
    doc ids      n_docs x int64, then a bitmap of null doc ids
    low bits     n_docs x l bits: the low l bits of each document's end offset
    high bits    unary coded high parts: bit (end >> l) + i is set for document i
    select table uint32 per 512 high bits: set bits before the block
    footer       counts and section lengths

Document i covers the ids ``[end(i-1), end(i))`` with ``end(-1) = 0``.  The ends
cost about ``2 + log2(n_tokens / n_docs)`` bits each; no table of 64-bit
offsets is stored.  ``select`` finds the i-th set high bit from the block table
and one 512-bit block.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, files

MAGIC = b"TKIDEF01"
FOOTER = "<QQIIQQQQ8s"     # docs, tokens, width, l, bytes of: doc ids, nulls, low, high; magic
BLOCK = 512
MARKS = ".,;:!?"
LONG_LOWER = "\u0130"                     # its lower case ends with a combining mark, which is no letter
SPLIT_SAFE = re.compile("[\x1c-\x1f]")    # str.split() breaks there, the tokenizer's \\s does not


class EliasFano:
    """Non-decreasing integers ``ends`` in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.l, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def encode(cls, ends: np.ndarray) -> EliasFano:
        ends = np.asarray(ends, dtype=np.int64)
        n, top = len(ends), int(ends[-1]) if len(ends) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.int64)
        low = np.packbits(((ends[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little")
        size = -(-((top >> low_bits) + n + 1) // BLOCK) * BLOCK
        bits = np.zeros(size, dtype=np.uint8)
        bits[(ends >> low_bits) + np.arange(n)] = 1
        counts = bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.uint32)
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ranks)

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at ``index``: block of the i-th set bit from the rank
        table, its place inside the block, then the stored low bits."""
        index = np.asarray(index, dtype=np.int64)
        if not len(index):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.ranks, index, side="right") - 1
        used, at = np.unique(block, return_inverse=True)
        width = BLOCK // 8
        bits = np.unpackbits(self.high.reshape(-1, width)[used], axis=1, bitorder="little")
        seen = np.cumsum(bits, axis=1, dtype=np.int32)
        want = index - self.ranks[block].astype(np.int64) + 1
        place = np.array([np.searchsorted(seen[a], w) for a, w in zip(at, want)], dtype=np.int64)
        value = (block * BLOCK + place - index) << self.l
        if self.l:
            bit = index[:, None] * self.l + np.arange(self.l)
            value |= ((((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64))
                      << np.arange(self.l)).sum(axis=1)
        return value


class Encoder:
    """Ids of texts by a ``tokenizers`` file.

    The tokenizer's pre-tokenizer breaks at white space, so a text's ids are
    those of its white-space-separated pieces in order.  Each distinct piece is
    encoded once by the library and remembered (at most ``keep`` pieces).  Where
    every word's last id is a word-end id, runs of letters are encoded many to a
    call and told apart by these ids.  Texts with the control characters on which
    Python and the tokenizer disagree about white space are encoded whole.
    """

    def __init__(self, path: str, end_id: int, keep: int = 1_000_000, joined: int = 200):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(True), end_id + 1)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end, self.keep, self.joined = np.array([end_id], self.dtype).tobytes(), keep, joined
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.word_end = np.zeros(size, bool)
        if suffix:
            self.word_end[[i for w, i in self.tokenizer.get_vocab(False).items() if w.endswith(suffix)]] = True
            self.marks = dict(zip(MARKS, self._encode(list(MARKS))))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_runs(self, runs: list[str]) -> None:
        """Ids of runs of letters: each is one word to the tokenizer."""
        known = self.known
        parts = [runs[lo:lo + self.joined] for lo in range(0, len(runs), self.joined)]
        for lo in range(0, len(parts), 64):
            some = parts[lo:lo + 64]
            for part, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(p) for p in some], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                ends = np.flatnonzero(self.word_end[ids]) + 1
                if len(ends) != len(part) or ends[-1] != len(ids):
                    known.update(zip(part, self._encode(part)))
                    continue
                raw, cut = ids.tobytes(), (np.concatenate(([0], ends)) * ids.itemsize).tolist()
                known.update(zip(part, [raw[x:y] for x, y in zip(cut, cut[1:])]))

    def _learn(self, pieces: Iterable[str]) -> None:
        """Ids of new pieces: letters, letters and one mark, or anything else.  Of the first two the run of
        letters is remembered as the piece it is by itself (ASCII letters in lower case)."""
        runs, marked, other = {}, {}, []
        for w in pieces:
            if not self.marks or LONG_LOWER in w:
                other.append(w)
            elif w.isalpha():
                runs[w] = w.lower() if w.isascii() else w
            elif w[-1] in self.marks and (r := w[:-1]).isalpha():
                marked[w] = r.lower() if r.isascii() else r
            else:
                other.append(w)
        known, marks = self.known, self.marks
        self._learn_runs(list(set(runs.values()).union(marked.values()).difference(known)))
        known.update(zip(runs, map(known.__getitem__, runs.values())))
        known.update((w, known[r] + marks[w[-1]]) for w, r in list(marked.items()))
        for lo in range(0, len(other), 20_000):
            known.update(zip(other[lo:lo + 20_000], self._encode(other[lo:lo + 20_000])))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        pieces = [[] if not t else None if SPLIT_SAFE.search(t) else t.split() for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        self._learn(set(chain.from_iterable(filter(None, pieces))).difference(self.known))
        get = self.known.__getitem__
        return [(self._encode([t])[0] if p is None else b"".join(map(get, p))) + self.end
                for t, p in zip(texts, pieces)]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    """One per worker process; its pieces serve every task that reuses it."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _slices(batch: pa.RecordBatch, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about ``max_bytes`` (one row at least)."""
    rows = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into files below ``path``, in ascending id order.

    Returns the manifest: ``path, first_id, n_docs, n_tokens`` and ``start``, the number of
    ids in all files before it.  Rows are range-partitioned and sorted by id
    (equal ids by text, so repeated rows all stay); a null id sorts first.  A null text counts
    as empty and holds the end id only.  No rows: no files.  Ids and boundaries
    of one file stay in one task; a file holds one range partition.
    """
    common.python_workers(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        encoder = _encoder(tokenizer, end_id)
        uri = f"{path}/part-{TaskContext.get().partitionId():06d}.ids"
        lengths, doc_ids, nulls = [], [], []
        with files.writing(uri) as out:
            out.write(MAGIC)
            for batch in (s for b in _chain(first, batches) for s in _slices(b, 8 << 20)):
                ids = encoder(batch.column(1).to_pylist())
                out.write(b"".join(ids))
                lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)) // encoder.dtype.itemsize)
                doc_ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(batch.column(0).is_null().to_numpy(zero_copy_only=False))
            doc_id, null = np.concatenate(doc_ids).astype("<i8"), np.concatenate(nulls)
            ends = np.cumsum(np.concatenate(lengths))
            ef = EliasFano.encode(ends)
            parts = [doc_id.tobytes(), np.packbits(null, bitorder="little").tobytes(), ef.low.tobytes(),
                     ef.high.tobytes(), ef.ranks.astype("<u4").tobytes()]
            for p in parts:
                out.write(p)
            out.write(struct.pack(FOOTER, len(ends), int(ends[-1]), encoder.dtype.itemsize, ef.l,
                                  *map(len, parts[:4]), MAGIC))
        yield pa.RecordBatch.from_pydict(
            {"path": [uri], "first_id": pa.array([None if null[0] else int(doc_id[0])], pa.int64()),
             "part": pa.array([TaskContext.get().partitionId()], pa.int64()),
             "n_docs": pa.array([len(ends)], pa.int64()), "n_tokens": pa.array([int(ends[-1])], pa.int64())})

    ordered = (docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
               .repartitionByRange("i").sortWithinPartitions("i", "t"))
    made = common.stored(ordered.mapInArrow(write, "path string, first_id bigint, part bigint, n_docs bigint, n_tokens bigint"),
                         "token-manifest")
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("part")


def _chain(first, rest):
    yield first
    yield from rest


class StoreFile:
    """Reader of one file: ids of any range of documents."""

    def __init__(self, uri: str):
        self.file = files.opened(uri)
        size = self.file.size()
        self.file.seek(size - struct.calcsize(FOOTER))
        (self.n_docs, self.n_tokens, width, l, b_ids, b_null, b_low, b_high, magic) = struct.unpack(FOOTER, self.file.read(struct.calcsize(FOOTER)))
        self.file.seek(0)
        if magic != MAGIC or self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        at = len(MAGIC) + self.n_tokens * width
        self.file.seek(at)
        rest = memoryview(self.file.read(size - struct.calcsize(FOOTER) - at))
        cut = np.cumsum([0, b_ids, b_null, b_low, b_high]).tolist() + [len(rest)]
        ids, null, low, high, ranks = (rest[a:b] for a, b in zip(cut, cut[1:]))
        self.doc_ids = np.frombuffer(ids, "<i8")
        self.null = np.unpackbits(np.frombuffer(null, np.uint8), count=self.n_docs, bitorder="little").astype(bool)
        self.ends = EliasFano(self.n_docs, l, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8),
                              np.frombuffer(ranks, "<u4"))

    def bounds(self, lo: int, hi: int) -> np.ndarray:
        """Offsets of documents lo..hi-1: hi - lo + 1 values."""
        first = self.ends.select(np.array([lo - 1]))[0] if lo else 0
        return np.concatenate(([first], self.ends.select(np.arange(lo, hi))))

    def ids(self, start: int, end: int) -> np.ndarray:
        self.file.seek(len(MAGIC) + start * self.dtype.itemsize)
        return np.frombuffer(self.file.read((end - start) * self.dtype.itemsize), self.dtype)


def read_store(manifest: DataFrame, docs_per_read: int = 512) -> DataFrame:
    """One row per stored document, from the files: ``doc_id, start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32`` (of its ids as little-endian
    unsigned 32-bit integers)."""
    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = StoreFile(uri)
                for lo in range(0, f.n_docs, docs_per_read):
                    hi = min(lo + docs_per_read, f.n_docs)
                    at = f.bounds(lo, hi)
                    ids = f.ids(int(at[0]), int(at[-1])).astype("<u4")
                    cuts = at - at[0]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(f.doc_ids[lo:hi], pa.int64(), mask=f.null[lo:hi]),
                        "start": pa.array(at[:-1] + start, pa.int64()),
                        "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                f.file.close()

    # about a task per file
    spread = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
