"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of every whole text is
encoded: shares of byte classes, signed hash sketches of its words and byte pairs, and a few
counts (distinct words, the commonest word, repeats of the word before) enter one tanh layer.
Gated attention weighs the passages: the weight of passage k is exp(w . (tanh(V h_k) * sigmoid(U h_k))), divided by the
document's sum of them.  The weighted mean of the encodings is scored by a logistic layer.  All
parameters are learned together, in numpy on the driver, from labels of documents; no passage has a label.

Scoring adds weights and weighted encodings up passage by passage, so a text of any length takes bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .shingles import _hash_spans, mix

PASSAGE = 64
BUFFER = 1 << 19
WORD_DIMS, PAIR_DIMS = 32, 64
FOLDS = 3
LIMIT = 30.0                   # of the attention's logits

SPACES = b"\t\n\x0b\x0c\r "
# Byte classes: each string of bytes is one; lower case, upper case, digits, beyond ASCII and all others follow.
CLASSES = [b" ", b"\t\n\x0b\x0c\r", b".", b",", b"!", b"?", b";:", b"|", b"#", b"$", b"%", b"&", b"*", b"'\"`", b"()[]{}<>", b"-_", b"/\\", b"@", b"=+~^"]
LOWER = len(CLASSES)
N_CLASSES = LOWER + 5
STATS = 8
DIMS = N_CLASSES + WORD_DIMS + PAIR_DIMS + STATS

CLASS_OF = np.full(256, LOWER + 4, np.int64)
for _k, _bytes in enumerate(CLASSES):
    CLASS_OF[list(_bytes)] = _k
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58], CLASS_OF[128:] = LOWER, LOWER + 1, LOWER + 2, LOWER + 3
IS_SPACE = np.isin(np.arange(256), list(SPACES))
WORD = re.compile(rb"[^\t\n\x0b\x0c\r ]")
PAIR = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1))
PAIR_AT, PAIR_SIGN = (PAIR % np.uint64(PAIR_DIMS)).astype(np.int64), np.where(PAIR >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def _parts(texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
    """(index, part of the text); parts of a long text end after whole passages."""
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        at = given = 0
        while len(data) - at > 2 * BUFFER:
            words = np.flatnonzero(np.diff(IS_SPACE[np.frombuffer(data, np.uint8, BUFFER, at)].astype(np.int8)) == 1)      # words' last bytes
            whole = len(words) // PASSAGE * PASSAGE
            if whole:
                yield k, data[at:at + words[whole - 1] + 1]
                given = 1
                at += int(words[whole - 1]) + 1
            elif IS_SPACE[data[at]]:
                found = WORD.search(data, at)
                at = found.start() if found else len(data)
            else:                                      # words of many thousand bytes: one part, however long
                break
        if not given or WORD.search(data, at):
            yield k, data[at:]


def passages(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, features) of all passages, many at a time.  A text without words has one passage of zeros."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for part in _parts(texts):
        if held and size + len(part[1]) > BUFFER:
            yield _features(held)
            held, size = [], 0
        held.append(part)
        size += len(part[1]) + 1
    if held:
        yield _features(held)


def _features(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"\n".join([d for _, d in held]) + b"\n", np.uint8)
    starts = np.cumsum([0, *[len(d) + 1 for _, d in held[:-1]]])
    edge = np.flatnonzero(np.diff(~IS_SPACE[raw], prepend=False, append=False))
    a, b = edge[::2], edge[1::2]
    part = np.searchsorted(starts, a, "right") - 1                     # of each word
    n_words = np.bincount(part, minlength=len(held))
    place = np.arange(len(a)) - (np.cumsum(n_words) - n_words)[part]
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(n_passages) - n_passages
    of = base[part] + place // PASSAGE                                 # passage of each word
    m = int(n_passages.sum())
    owner = np.repeat([k for k, _ in held], n_passages)
    out = np.zeros((m, DIMS), np.float64)
    if not len(a):
        return owner, out.astype(np.float32)
    words = np.bincount(of, minlength=m).astype(np.float64)
    # bytes from a passage's first word to its last one
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    last = np.append(first[1:], len(of)) - 1
    span = np.zeros(m, np.int64)
    begin = np.zeros(m, np.int64)
    begin[of[first]], span[of[first]] = a[first], b[last] - a[first]
    at = np.repeat(begin - (np.cumsum(span) - span), span) + np.arange(span.sum())
    passage = np.repeat(np.arange(m), span)
    bytes_of, safe = raw[at], np.maximum(1, words)[:, None]
    length = np.maximum(1, span)[:, None]
    out[:, :N_CLASSES] = np.bincount(passage * N_CLASSES + CLASS_OF[bytes_of], minlength=m * N_CLASSES).reshape(m, -1) / length
    pair = bytes_of[:-1].astype(np.int64) << 8 | bytes_of[1:]
    within = passage[:-1] == passage[1:]
    pair, of_pair = pair[within], passage[:-1][within]
    lo = N_CLASSES + WORD_DIMS
    out[:, lo:lo + PAIR_DIMS] = np.bincount(of_pair * PAIR_DIMS + PAIR_AT[pair], PAIR_SIGN[pair], m * PAIR_DIMS).reshape(m, -1) / np.sqrt(length)
    h = _hash_spans(raw, a, b)
    sign = np.where(h >> np.uint64(50) & np.uint64(1), 1.0, -1.0)
    out[:, N_CLASSES:lo] = np.bincount(of * WORD_DIMS + (h % np.uint64(WORD_DIMS)).astype(np.int64), sign, m * WORD_DIMS).reshape(m, -1) / np.sqrt(safe)
    key = mix(h + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, index, count = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(m)
    np.maximum.at(most, of[index], count)
    again = np.append(False, (h[1:] == h[:-1]) & (of[1:] == of[:-1]))
    size = b - a
    total = lambda x: np.bincount(of, x, m) / safe[:, 0]               # noqa: E731
    lo += PAIR_DIMS
    stats = [np.bincount(of[index], minlength=m) / safe[:, 0], most / safe[:, 0], total(again), total(np.log(size)), total(size > 20),
             total(CLASS_OF[raw[a]] == LOWER + 1), total((CLASS_OF[raw[b - 1]] < LOWER) | (CLASS_OF[raw[b - 1]] == LOWER + 4)), words / PASSAGE]
    out[:, lo:] = np.stack(stats, 1)
    return owner, out.astype(np.float32)


@dataclass
class Network:
    """``weights``: W, b (encoder), V, U, w (attention), c, d (score); ``shift`` moves the logit to where the threshold is 0.3."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    shift: float = 0.0

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.weights["W"] + self.weights["b"])

    def attention(self, h: np.ndarray) -> np.ndarray:
        """Logits of the passages' weights."""
        w = self.weights
        return np.clip((np.tanh(h @ w["V"]) / (1 + np.exp(-h @ w["U"]))) @ w["w"], -LIMIT, LIMIT)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        w = self.weights
        total, weight = np.zeros((len(texts), len(w["c"]))), np.zeros(len(texts))
        for owner, x in passages(texts):
            h = self.encode(x)
            e = np.exp(self.attention(h))
            np.add.at(weight, owner, e)
            np.add.at(total, owner, e[:, None] * h)
        return total / np.maximum(weight, 1e-300)[:, None] @ w["c"] + float(w["d"][0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.logits(texts) - self.shift, -60, 60)))


def _start(dims: int, hidden: int, gates: int, rng) -> dict[str, np.ndarray]:
    init = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)        # noqa: E731
    return {"W": init(dims, hidden), "b": np.zeros(hidden), "V": init(hidden, gates), "U": init(hidden, gates), "w": init(gates),
            "c": init(hidden), "d": np.zeros(1)}


def loss_and_gradients(weights: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean log loss of bags and its gradients.  ``x``: standardised passages, ``bag``: each one's bag (rising, every bag once at least)."""
    first = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
    h = np.tanh(x @ weights["W"] + weights["b"])
    t, s = np.tanh(h @ weights["V"]), 1 / (1 + np.exp(-h @ weights["U"]))
    raw = (t * s) @ weights["w"]
    e = np.exp(np.clip(raw, -LIMIT, LIMIT))
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    logit = z @ weights["c"] + weights["d"][0]
    p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
    loss = float((cost * -(y * np.log(np.maximum(p, 1e-12)) + (1 - y) * np.log(np.maximum(1 - p, 1e-12)))).sum() / cost.sum())
    dl = cost * (p - y) / cost.sum()
    dz = dl[:, None] * weights["c"]
    da = (dz[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first)[bag]) * (np.abs(raw) < LIMIT)
    g = de[:, None] * weights["w"]
    dt, ds = g * s * (1 - t * t), g * t * s * (1 - s)
    dh = a[:, None] * dz[bag] + dt @ weights["V"].T + ds @ weights["U"].T
    du = dh * (1 - h * h)
    return loss, {"W": x.T @ du, "b": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ dl, "d": np.array([dl.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 12, batch: int = 32, rate: float = 0.004,
          decay: float = 1e-4, seed: int = 11) -> Network:
    """Fit (Adam) to documents given as passages' features."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
    weights = _start(every.shape[1], hidden, gates, rng)
    cost = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum())) ** 0.5
    one, two, n = {k: 0 * v for k, v in weights.items()}, {k: 0 * v for k, v in weights.items()}, 0
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // batch)):
            x = (np.concatenate([bags[k] for k in chosen]) - mean) / scale
            bag = np.repeat(np.arange(len(chosen)), [len(bags[k]) for k in chosen])
            _, grads = loss_and_gradients(weights, x, bag, y[chosen], cost[chosen])
            n += 1
            for k, grad in grads.items():
                grad = grad + decay * weights[k]
                one[k] = 0.9 * one[k] + 0.1 * grad
                two[k] = 0.999 * two[k] + 0.001 * grad * grad
                weights[k] = weights[k] - rate * (one[k] / (1 - 0.9 ** n)) / (np.sqrt(two[k] / (1 - 0.999 ** n)) + 1e-8)
    return Network(mean, scale, weights)


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """Logit with the largest sum of the two labels' shares on their sides; the middle of the widest gap with that sum."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], y[order]
    below = np.cumsum(1 - y) / max(1, (1 - y).sum()) - np.cumsum(y) / max(1, y.sum())
    gap = np.append(np.diff(z), 0)
    best = np.flatnonzero((gap > 0) & (below >= below[gap > 0].max(initial=-1) - 1e-12))
    if not len(best):
        return 0.0
    k = best[gap[best].argmax()]
    return float((z[k] + z[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, max_passages: int = 400_000, threshold: float = 0.3, seed: int = 11) -> Network:
    """Train on at most ``max_rows`` labelled documents with at most ``max_passages`` passages together.

    ``docs``: ``doc_id, text``; ``labels``: ``doc_id, quality``.  The sample is the labelled ids with the smallest
    hashes; equal rows count once, and second texts of an id are taken only while first ones do not fill the
    sample.  Documents are used whole; one that does not fit into what is left of ``max_passages`` is left out, later ones are still taken.
    Null labels and ids are skipped; a document with several labels counts as good if one says so.  Scores are shifted
    so that ``threshold`` is the best cut of the scores that networks trained on two thirds give the other third.
    With labels of one kind only, every document scores 0.5; with labels but no usable document this is an error.
    """
    common.python_workers(docs.sparkSession)
    sample = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
              .where("y in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64)
                found: list[list[np.ndarray]] = [[] for _ in range(rows.num_rows)]
                for owner, x in passages(rows[1].to_pylist()):
                    for k in np.unique(owner):
                        found[k].append(x[owner == k])
                bags = [np.concatenate(f) for f in found]
                yield pa.RecordBatch.from_arrays([rows[0], rows[2], rows[3], pa.array([len(b) for b in bags], pa.int64()),
                                                  pa.array([b.tobytes() for b in bags], pa.binary())], ["doc_id", "y", "digest", "n", "bag"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = common.stored(rows.join(F.broadcast(sample.withColumn("doc_id", F.col("doc_id").cast("bigint"))), "doc_id")
                          .select("doc_id", "text", "y", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
                          .mapInArrow(encoded, "doc_id bigint, y int, digest string, n bigint, bag binary"), "quality-sample")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest"))
    keys = (found.select("doc_id", "digest", "n").distinct().withColumn("place", place).where(F.col("place") <= max_rows)
            .orderBy("place", F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect())
    left, chosen = max_passages, {}
    for r in keys:
        if r.n <= left:
            left -= r.n
            chosen[r.doc_id, r.digest] = len(chosen)
    if keys and not chosen:
        raise ValueError(f"every labelled document has more than max_passages = {max_passages} passages")
    bags: dict[int, np.ndarray] = {}
    y = np.zeros(len(chosen), np.int64)
    kept = docs.sparkSession.createDataFrame(list(chosen) or [(None, None)], "doc_id bigint, digest string")
    for r in found.join(F.broadcast(kept), ["doc_id", "digest"]).toLocalIterator():
        k = chosen[r.doc_id, r.digest]
        bags[k], y[k] = np.frombuffer(r.bag, np.float32).reshape(-1, DIMS), r.y
    bags_list = [bags[k] for k in range(len(chosen))]
    everyone = np.arange(len(y))
    parts = [everyone[f::FOLDS] for f in range(FOLDS)]
    rest = [np.setdiff1d(everyone, p) for p in parts]
    if not len(y) or not 0 < y.sum() < len(y):
        zero = {k: 0 * v for k, v in _start(DIMS, 1, 1, np.random.default_rng(seed)).items()}
        return Network(np.zeros(DIMS), np.ones(DIMS), zero)
    net = train(bags_list, y, seed=seed)
    held = np.zeros(len(y))
    if all(0 < y[r].sum() < len(r) for r in rest):
        for part, others in zip(parts, rest, strict=True):
            held[part] = _bag_logits(train([bags_list[k] for k in others], y[others], seed=seed), [bags_list[k] for k in part])
    else:
        held = _bag_logits(net, bags_list)
    net.shift = best_cut(held, y) - float(np.log(threshold / (1 - threshold)))
    return net


def _bag_logits(net: Network, bags: list[np.ndarray]) -> np.ndarray:
    found = np.zeros(len(bags))
    for k, x in enumerate(bags):
        h = net.encode(x)
        e = np.exp(net.attention(h))
        found[k] = e @ h / e.sum() @ net.weights["c"] + net.weights["d"][0]
    return found


def score_column(docs: DataFrame, net: Network, text: Column) -> Column:
    """Quality (0 to 1) of a text column; null as empty: the score of a document without words."""
    common.python_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)      # a fixed size, whatever the data

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([t if isinstance(t, str) else None for t in texts]), dtype=float)

    return score(text.cast("string"))


def score_documents(docs: DataFrame, net: Network, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row, 1 if the score reaches the threshold.  Null ids, repeated rows,
    null and empty texts are scored like others; no rows give no rows; further columns are ignored."""
    scored = docs.select(F.col(id_col).alias("doc_id"), score_column(docs, net, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
