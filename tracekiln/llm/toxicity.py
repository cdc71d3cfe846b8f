"""Toxicity: a convolutional text classifier.

Words are hashed to embedding rows; filters over one, two and three words slide over the
text, and each filter's largest response (max pooling) enters a logistic layer.
The network is trained in numpy on the driver from a bounded sample of labelled
documents; Spark scores all documents with it.  Decision thresholds are
calibrated on scores of documents kept from training, one for each language.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, shingles

WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
SEGMENT = 1 << 17
FOLDS = 3
ROWS = 1 << 18           # of the embedding


class Documents:
    """Embedding rows (``buckets``) of documents: up to ``max_words`` of them in memory,
    those of further documents in a file of the driver's temp folder, read when asked for."""

    def __init__(self, max_words: int):
        self.held: list[np.ndarray | tuple[int, int]] = []      # rows, or offset and size in the file
        self.file = tempfile.TemporaryFile()
        self.room = max_words

    def append(self, rows: bytes) -> None:
        if len(rows) // 4 <= self.room:
            self.room -= len(rows) // 4
            self.held.append(np.frombuffer(rows, np.int32))
        else:
            self.held.append((self.file.seek(0, 2), len(rows)))
            self.file.write(rows)

    def pick(self, chosen: Iterable[int]) -> Documents:
        """Some of the documents, in the order of ``chosen``; the file is shared."""
        found = object.__new__(Documents)
        found.held, found.file, found.room = [self.held[k] for k in chosen], self.file, 0
        return found

    def __len__(self) -> int:
        return len(self.held)

    def __getitem__(self, k: int) -> np.ndarray:
        at = self.held[k]
        if not isinstance(at, tuple):
            return at
        self.file.seek(at[0])
        return np.frombuffer(self.file.read(at[1]), np.int32)

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[k] for k in range(len(self)))


@dataclass
class Network:
    """Embeddings (row 0 is padding), filters by width, logistic layer; ``offset``
    is the logit at which the score is 0.5, ``thresholds`` are scores by language."""

    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def buckets(self, words: np.ndarray) -> np.ndarray:
        return buckets(words, len(self.embed))

    def responses(self, ids: np.ndarray) -> list[np.ndarray]:
        """Filter responses at each position; ``ids`` end with ``PAD`` zeros."""
        x = self.embed[ids]
        n = len(ids) - PAD
        return [sum(x[j:n + j] @ f[j] for j in range(len(f))) for f in self.filters]

    def peaks(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter and its first position, a segment at a time."""
        best = where = None
        for lo in range(0, len(ids) - PAD, SEGMENT):
            z = np.concatenate(self.responses(ids[lo:lo + SEGMENT + PAD]), axis=1)
            at = z.argmax(axis=0)
            top = z[at, np.arange(z.shape[1])]
            if best is None:
                best, where = top, at
            else:
                where = np.where(top > best, at + lo, where)
                best = np.maximum(best, top)
        return best, where

    def pool(self, docs: list[np.ndarray] | Documents) -> np.ndarray:
        """Pooled features of documents (bucket ids); long ones in overlapping segments."""
        features = np.zeros((len(docs), sum(f.shape[2] for f in self.filters)), np.float32)
        held: list[tuple[int, np.ndarray, int]] = []            # document, ids, positions that start a window
        size = 0
        for k, d in enumerate(docs):
            for lo in range(0, len(d), SEGMENT):
                held.append((k, d[lo:lo + SEGMENT + PAD], min(SEGMENT, len(d) - lo)))
                size += len(held[-1][1]) + PAD
                if size > SEGMENT:
                    self._pool(held, features)
                    held, size = [], 0
        if held:
            self._pool(held, features)
        return features

    def _pool(self, held: list[tuple[int, np.ndarray, int]], features: np.ndarray) -> None:
        pad = np.zeros(PAD, np.int32)
        ids = np.concatenate([p for _, d, _ in held for p in (d, pad)])
        lengths = np.array([len(d) for _, d, _ in held])
        starts = np.cumsum(lengths + PAD) - lengths - PAD
        cuts = np.stack((starts, starts + [n for _, _, n in held]), 1).ravel()
        best = []
        for z, b in zip(self.responses(ids), self.biases):
            z = np.concatenate((z, np.full((PAD, z.shape[1]), -np.inf, np.float32)))
            best.append(np.maximum(np.maximum.reduceat(z, cuts, axis=0)[::2] + b, 0))
        np.maximum.at(features, np.array([k for k, _, _ in held]), np.concatenate(best, 1))

    def logits(self, docs: list[np.ndarray] | Documents) -> np.ndarray:
        return self.pool(docs) @ self.out + self.bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = np.empty(len(texts))
        for first, words in shingles.words_of(texts):
            found[first:first + len(words)] = self.logits([self.buckets(w) for w in words])
        return 1 / (1 + np.exp(-np.clip(found - self.offset, -60, 60)))


def buckets(words: np.ndarray, rows: int) -> np.ndarray:
    """Embedding rows of word hashes; row 0 is padding."""
    return (words % np.uint64(rows - 1)).astype(np.int32) + np.int32(1)


def _start(docs: list[np.ndarray] | Documents, labels: np.ndarray, rows: int, dims: int, per_width: int, rng) -> Network:
    """Small random weights; one embedding direction starts as the word's
    shrunk log-odds of occurring in a document labelled 1."""
    counts = np.full((2, rows), 0.0)
    for d, y in zip(docs, labels):
        counts[int(y), np.unique(d)] += 1
    n = counts.sum(axis=0)
    totals = np.array([max(1, (labels == k).sum()) for k in (0, 1)])
    odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
    embed = rng.normal(0, 0.01, (rows, dims)).astype(np.float32)
    embed[:, 0] = np.clip(odds, -3, 3) * np.minimum(1, n / 8) / 3
    embed[n == 0] = 0
    embed[0] = 0
    filters = []
    for w in WIDTHS:
        f = rng.normal(0, 0.3, (w, dims, per_width)).astype(np.float32)
        f[:, 0] = np.abs(f[:, 0]) + 0.3
        filters.append(f)
    size = per_width * len(WIDTHS)
    return Network(embed, filters, [np.zeros(per_width, np.float32) for _ in WIDTHS],
                   rng.normal(0.3, 0.1, size).astype(np.float32), -2.0)


def train(docs: list[np.ndarray] | Documents, labels: np.ndarray, rows: int = ROWS, dims: int = 8, per_width: int = 12,
          epochs: int = 5, batch: int = 32, rate: float = 0.05, seed: int = 7) -> Network:
    """Fit to documents given as ``buckets``.  Only the position of each
    filter's maximum gets a gradient, so updates touch few embedding rows."""
    rng = np.random.default_rng(seed)
    net = _start(docs, labels, rows, dims, per_width, rng)
    squares = {k: np.full(np.shape(v), 1e-6, np.float32) for k, v in
               [("embed", net.embed), ("out", net.out), *[(f"f{i}", f) for i, f in enumerate(net.filters)],
                *[(f"b{i}", b) for i, b in enumerate(net.biases)]]}
    square_bias = 1e-6
    weight = np.where(labels == 1, (len(labels) / max(1, 2 * labels.sum())) ** 0.5, 1.0)

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        squares[name] += grad * grad
        value -= rate * grad / np.sqrt(squares[name])

    pad = np.zeros(PAD, np.int32)
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // batch)):
            pooled = np.zeros((len(chosen), len(net.out)), np.float32)
            windows = np.zeros((len(chosen), len(net.out), max(WIDTHS)), np.int32)   # ids at each maximum
            lengths = np.zeros(len(chosen), bool)
            for row, k in enumerate(chosen):
                ids = np.concatenate((docs[k], pad))
                if len(ids) == PAD:
                    continue
                lengths[row] = True
                pooled[row], where = net.peaks(ids)
                windows[row] = ids[where[:, None] + np.arange(max(WIDTHS))]
            pooled = np.where(lengths[:, None], np.maximum(pooled + np.concatenate(net.biases), 0), 0)
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -30, 30)))
            error = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            back = error[:, None] * net.out * (pooled > 0)
            step("out", net.out, pooled.T @ error + 1e-4 * net.out)
            square_bias += float(error.sum()) ** 2
            net.bias -= rate * float(error.sum()) / square_bias ** 0.5
            at, rows_of, grads = 0, [], []
            for i, f in enumerate(net.filters):
                part = slice(at, at + f.shape[2])
                at += f.shape[2]
                g = back[:, part]
                grad = np.zeros_like(f)
                for j in range(len(f)):
                    ids = windows[:, part, j]
                    x = net.embed[ids]                                  # document, filter, dimension
                    grad[j] = np.einsum("df,dfe->ef", g, x)
                    rows_of.append(ids.ravel())
                    grads.append((g[:, :, None] * f[j].T).reshape(-1, f.shape[1]))
                step(f"f{i}", f, grad)
                step(f"b{i}", net.biases[i], g.sum(axis=0))
            ids, place = np.unique(np.concatenate(rows_of), return_inverse=True)
            total = np.zeros((len(ids), net.embed.shape[1]), np.float32)
            np.add.at(total, place, np.concatenate(grads))
            total[ids == 0] = 0
            squares["embed"][ids] += total * total
            net.embed[ids] -= rate * total / np.sqrt(squares["embed"][ids])
    return net


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """Threshold of the largest F1, midway between the neighbouring logits."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(labels) + 1) + labels.sum())
    k = int(f1.argmax())
    low = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + low) / 2)


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, langs: list[str | None], least: int = 20) -> None:
    """Offset over all languages; a language with at least ``least`` documents of
    each label gets its own threshold, others the common one (score 0.5)."""
    if 0 < labels.sum() < len(labels):
        net.offset = best_threshold(logits, labels)
    langs_of = np.array([x or "" for x in langs])
    for lang in np.unique(langs_of):
        own = langs_of == lang
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= least:
            net.thresholds[str(lang)] = float(1 / (1 + np.exp(net.offset - best_threshold(logits[own], labels[own]))))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_words: int = 8_000_000, seed: int = 7) -> Network:
    """Train and calibrate on at most ``max_rows`` labelled documents.

    ``docs``: ``doc_id, text, lang``; ``labels``: ``doc_id, toxic``.  The sample is the labelled ids with the
    smallest hashes.  Its documents are used whole, however long: ``max_words`` bounds the words that the
    driver keeps in memory, the others lie in a file, and training takes time in proportion to all of them.
    Equal rows count once; of ids with several texts, second texts are taken only while
    fewer than ``max_rows`` first ones exist, and so on.  The network
    learns from all of the sample; thresholds come from the scores that networks trained on two thirds
    give the other third.  Null labels are skipped, a
    document with several labels counts as toxic if one says so.  Without any label of one kind
    the scores say nothing and stay below 0.5.  ``lang`` chooses thresholds and
    is no input of a score.
    """
    common.python_workers(docs.sparkSession)
    sample = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    digest = F.md5(F.concat_ws("\0", F.coalesce("lang", F.lit("")), "text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest"))
    keys = (rows.join(F.broadcast(sample), "doc_id").select("doc_id", "y", digest.alias("digest")).distinct()
            .withColumn("place", place).where(F.col("place") <= max_rows)
            .orderBy("place", F.xxhash64("doc_id"), "doc_id").limit(max_rows).drop("place"))
    rows = (rows.withColumn("digest", digest).join(F.broadcast(keys), ["doc_id", "digest"])
            .groupBy("doc_id", "digest", "y").agg(F.first("text").alias("text"), F.first("lang").alias("lang")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [buckets(w, ROWS).tobytes() for _, part in shingles.words_of(b.column(1).to_pylist()) for w in part]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(words, pa.binary()), *b.columns[2:]],
                                             names=["doc_id", "words", "lang", "y", "digest"])

    rows = rows.select("doc_id", "text", "lang", "y", "digest")
    got = common.stored(rows.mapInArrow(hashed, "doc_id bigint, words binary, lang string, y int, digest string"), "toxicity-sample")
    words, rest_of = Documents(max_words), []
    for r in got.toLocalIterator():                             # a partition at a time
        words.append(bytes(r.words))
        rest_of.append(((r.doc_id * 2654435761) & 0xFFFFFFFF, r.doc_id, r.digest, r.y, r.lang))
    order = sorted(range(len(rest_of)), key=lambda k: rest_of[k][:3])
    words = words.pick(order)
    y = np.array([rest_of[k][3] for k in order], np.int64)
    langs = [rest_of[k][4] for k in order]
    kept = np.arange(len(words))
    parts = [kept[f::FOLDS] for f in range(FOLDS)]
    rest = [np.concatenate([p for p in parts if p is not part]) for part in parts]
    if not all(0 < y[r].sum() < len(r) for r in rest):
        net = _start([], np.zeros(0), 2, 1, 1, np.random.default_rng(seed))
        net.offset = 1.0
        return net
    logits = np.zeros(len(words), np.float64)
    for part, others in zip(parts, rest):
        net = train(words.pick(others), y[others], seed=seed)
        logits[part] = net.logits(words.pick(part))
    net = train(words, y, seed=seed)
    calibrate(net, logits, y, langs)
    return net


def score_column(docs: DataFrame, net: Network, text: Column) -> Column:
    """Score of a text column; a null or empty text scores as no words."""
    common.python_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)      # a fixed size, whatever the data

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([t if isinstance(t, str) else None for t in texts]))

    return score(text.cast("string"))


def threshold_column(net: Network, lang: Column) -> Column:
    """The score from which a document of the language is rejected."""
    if not net.thresholds:
        return F.lit(0.5)
    known = F.create_map(*[F.lit(x) for kv in net.thresholds.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(lang.cast("string"), F.lit(""))), F.lit(0.5))


def reject_toxic(docs: DataFrame, net: Network, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents whose score reaches their language's threshold."""
    return docs.where(score_column(docs, net, F.col(text_col)) < threshold_column(net, F.col(lang_col)))
