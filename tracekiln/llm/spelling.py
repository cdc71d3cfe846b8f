"""Spelling variants by a variable-length gram index.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point.  A word's form is its commonest near word, if that is ``ratio`` times as common.

1. Gram dictionary: grams of two and three code points that hold at least ``1 / entries`` of all gram places.
   It is pruned by frequency (a gram's beginning is at least as frequent), so it has at
   most ``entries`` grams of each length, whatever the number of words, and can be sent to all tasks.
2. A word is decomposed into variable grams: at each place the longest one of the dictionary, else
   two code points; a gram that lies inside the one before is left out.
3. Affected grams: an edit at a place affects the grams that hold the place, those to the left
   whose longest match reads on to the place, and those to the right that a gram from
   before the place could take in.  The others are in both words' decompositions, counted from the same end.
   The bound is kept by place, not only as the largest number of affected grams: near words share *all*
   grams that an edit at that place leaves, so a word's lists are merged by intersection: the hash
   of the grams left is a key, and words with the same key are on each other's merged list.
   (Merging for the bare number reads lists whose length grows with the square of the words.)
   Neighbouring places mostly leave the same grams: a word of ten letters has about 13 keys.
   Words of 7 code points or more keep at least one gram at every place.
4. Words on a merged list agree but for a window of a few code points.  They are compared code point by
   code point, in the task that holds the list; only each word's number of near words and its best one leave it.
   A pair counts on the list of its first differing place alone.

Words of 64 code points and more round the window outwards, to a 32nd of their length or less, so
that they have at most about 130 keys.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import mix

SHORT, LONG = 2, 3            # lengths of grams; three is the most that leaves a gram in words of seven
LEAST = 7
ENTRIES = 1000
STEP = 1 << 20                # bytes of text split at a time
HELD_WORDS = 200_000          # distinct words counted in a task before they are passed on
CELLS = 1 << 22               # code points compared at a time
U = np.uint64

# A-Z lower-cased, other letters up to U+00FF as they are, all else blank.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 0xC0 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _runs(text: str) -> Counter:
    """Letter runs of a text (Latin-1 bytes) with their numbers, a piece at a time."""
    data = text.encode("latin-1", "replace").translate(LETTERS)
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + STEP)
        end = len(data) if end < 0 else end
        found.update(data[at:end].split())
        at = end
    return found


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, min_n: int = 2,
                drop_every: int = 31) -> DataFrame:
    """``word, n``: lower-cased letter runs of whole texts, of at least ``least`` code points and ``min_n`` occurrences.

    Where ``drop_every`` divides h = crc32 of ``<id>:<run>``, the run loses its code point
    h mod length (0: never).  Null texts have no words; a null id counts as an empty one; repeated rows count each.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if text:
                    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in _runs(text).items():
                        if len(run) < least:
                            continue
                        if drop_every:
                            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                            if h % drop_every == 0:
                                k = h % len(run)
                                run = run[:k] + run[k + 1:]
                        found[run] += n
                if len(found) > HELD_WORDS:
                    yield _word_rows(found, least)
                    found.clear()
        yield _word_rows(found, least)

    common.python_workers(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(counted, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n))


def _word_rows(found: Counter, least: int) -> pa.RecordBatch:
    kept = [(w.decode("latin-1"), n) for w, n in found.items() if len(w) >= least]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, code points) of the words of each length."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, CELLS // int(size))
        for k in range(0, len(at), step):
            part = at[k:k + step]
            yield part, np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(U)


def _codes(points: np.ndarray, q: int) -> np.ndarray:
    """The grams of q code points at each place, as numbers."""
    n = points.shape[1] - q + 1
    code = np.zeros((len(points), max(n, 0)), U)
    for j in range(q if n > 0 else 0):
        code |= points[:, j:j + n] << U(21 * j)
    return code


def gram_dictionary(words: DataFrame, entries: int = ENTRIES) -> dict[int, np.ndarray]:
    """Sorted numbers of the frequent grams by length; at most ``entries`` of each.  ``words`` has a column ``word``."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in (SHORT, LONG):
                parts = [_codes(points, q).ravel() for _, points in _by_length(batch[0].to_pylist())]
                gram, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, U), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), q, np.int32)), pa.array(gram.view(np.int64)),
                                                  pa.array(n.astype(np.int64))], ["q", "gram", "n"])

    common.python_workers(words.sparkSession)
    grams = common.stored(words.select("word").mapInArrow(counted, "q int, gram bigint, n bigint")
                          .groupBy("q", "gram").agg(F.sum("n").alias("n")), "grams")
    total = grams.where(F.col("q") == SHORT).agg(F.sum("n")).first()[0] or 0
    kept = grams.where(F.col("n") * entries >= total).select("q", "gram").toPandas()
    return {q: np.sort(kept.gram[kept.q == q].to_numpy(np.int64).view(U)) for q in (SHORT, LONG)}


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(codes.shape, bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def _rounding(size: int) -> int:
    """Exponent of the window's rounding for pairs whose longer word has so many code points."""
    return max(0, size.bit_length() - 6)


def decompose(points: np.ndarray, known: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of words of one length, for each place: number of the variable gram, its end, whether it is in the decomposition,
    up to where the longest match reads, and the length of the longest frequent gram (1: none)."""
    m, size = points.shape
    places = size - SHORT + 1
    frequent = np.ones((m, size), np.int64)
    gram = _codes(points, SHORT)
    for q in (SHORT, LONG):
        code = _codes(points, q)
        hit = _among(code, known[q])
        frequent[:, :code.shape[1]][hit] = q
        if q > SHORT:
            gram[:, :code.shape[1]] = np.where(hit, code, gram[:, :code.shape[1]])
    at = np.arange(places)
    length = np.maximum(frequent[:, :places], SHORT)
    end = at + length
    listed = np.ones((m, places), bool)
    listed[:, 1:] = end[:, 1:] > np.maximum.accumulate(end, axis=1)[:, :-1]
    reads = at + np.where(frequent[:, :places] < SHORT, SHORT, np.minimum(length + 1, LONG))
    return gram, end, listed, reads, frequent


def _merge_keys(points: np.ndarray, known: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(rounding, keys [word, edit]): edit 2i inserts before place i, edit 2i + 1 replaces or deletes place i."""
    m, size = points.shape
    gram, end, listed, reads, frequent = decompose(points, known)
    places = gram.shape[1]
    at = np.arange(places)
    hashes = mix(gram)
    left = np.zeros((m, places + 1), U)
    np.cumsum(np.where(listed, mix(hashes + at.astype(U)), U(0)), axis=1, out=left[:, 1:])
    right = np.zeros((m, size + 1), U)
    right[:, :places] = np.cumsum(np.where(listed, mix(hashes ^ mix((size - at).astype(U))), U(0))[:, ::-1], axis=1)[:, ::-1]
    # Places before lcut[i] are unaffected by edits at i, places from rcut[j] on by edits that end before j.
    # What a place's match reads, and the ends of listed grams, never fall from left to right, so each cut is a count.
    lcut = np.stack([(reads <= i).sum(axis=1) for i in range(size + 1)], axis=1)
    reach = np.arange(size) + np.minimum(frequent, LONG - 1)
    tops = np.maximum.accumulate(end, axis=1)
    rcut = np.full((m, size + 1), size)
    for j in range(size):
        rcut[:, j] = np.maximum((tops <= reach[:, j:j + 1]).sum(axis=1), j)
    for level in sorted({_rounding(size), _rounding(size + 1)}):
        a = lcut >> level << level
        b = size - (size - rcut >> level << level)
        kept_left, kept_right = np.take_along_axis(left, a, 1), np.take_along_axis(right, b, 1)
        keys = np.empty((m, 2 * size + 1), U)
        keys[:, 0::2] = mix(kept_left + U(level)) + kept_right
        keys[:, 1::2] = mix(kept_left[:, :-1] + U(level)) + kept_right[:, 1:]
        yield level, keys


KEYS = "key bigint, place bigint, word string, n bigint"


def merge_keys(words: DataFrame, known: dict[int, np.ndarray]) -> DataFrame:
    """``key, place, word, n``: the keys of each word's merged lists.  ``place`` holds the rounding and the first and last edit."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch[0].to_pylist(), batch[1].to_numpy()
            for index, points in _by_length(words):
                for level, keys in _merge_keys(points, known):
                    first = np.ones(keys.shape, bool)
                    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    row, lo = np.nonzero(first)
                    hi = np.append(lo[1:], 0) - 1
                    hi[np.append(row[1:] != row[:-1], True)] = keys.shape[1] - 1
                    step = max(1, CELLS // points.shape[1])
                    for k in range(0, len(row), step):
                        part = slice(k, k + step)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[row[part], lo[part]].view(np.int64)), pa.array(level << 56 | lo[part] << 28 | hi[part]),
                             pa.array([words[i] for i in index[row[part]]], pa.string()), pa.array(n[index[row[part]]])],
                            ["key", "place", "word", "n"])

    return words.select("word", F.col("n").cast("bigint")).mapInArrow(keyed, KEYS)


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by key as tables that end between keys, of about ``CELLS`` code points."""
    held, letters = [], 0
    for batch in batches:
        held.append(batch)
        letters += batch.num_rows * 16 + batch[2].nbytes
        if letters < CELLS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = table["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        letters = 0 if cut else -letters        # one list alone: look again when it has doubled
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near(short: np.ndarray, long: np.ndarray, sizes_short: np.ndarray, sizes_long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether one edit leads from one to the other, first differing place) of rows of padded code points."""
    differ = short != long
    first = differ.argmax(axis=1)
    one = differ.sum(axis=1) == 1
    behind = np.arange(short.shape[1] - 1) >= first[:, None]
    shifted = ~((short[:, :-1] != long[:, 1:]) & behind).any(axis=1)
    return np.where(sizes_short == sizes_long, one, shifted), first


def _compare(key: np.ndarray, place: np.ndarray, words: list[str], n: np.ndarray) -> pa.RecordBatch:
    """Near pairs within each list of one rounding: for each row its near words' number and best one."""
    rows = len(words)
    sizes = np.array([len(w) for w in words])
    width = int(sizes.max()) + 1
    points = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(rows, width)
    if points.max() < 256:
        points = points.astype(np.uint8)
    level, lo, hi = int(place[0] >> 56), place >> 28 & (1 << 28) - 1, place & (1 << 28) - 1
    found_a, found_b = [], []
    a = np.arange(rows)
    step = max(1, CELLS // width)
    for d in range(1, rows):
        a = a[a + d < rows]
        a = a[key[a] == key[a + d]]             # a row whose list ends here has no farther partner
        if not len(a):
            break
        for k in range(0, len(a), step):
            x, y = a[k:k + step], a[k:k + step] + d
            close = np.abs(sizes[x] - sizes[y]) <= 1
            x, y = x[close], y[close]
            swap = sizes[x] > sizes[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            near, i = _near(points[x], points[y], sizes[x], sizes[y])
            longer = sizes[y] > sizes[x]
            edit_x, edit_y = 2 * i + ~longer, 2 * i + 1
            near &= (lo[x] <= edit_x) & (edit_x <= hi[x]) & (lo[y] <= edit_y) & (edit_y <= hi[y])
            if level or width >= 64:
                near &= np.array([_rounding(int(s)) == level for s in sizes[y]], bool)
            found_a += [x[near], y[near]]
            found_b += [y[near], x[near]]
    if not found_a or not sum(map(len, found_a)):
        return _found([], np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    x, y = np.concatenate(found_a), np.concatenate(found_b)
    used = np.unique(y)
    rank = np.zeros(rows, np.int64)
    rank[sorted(used.tolist(), key=words.__getitem__)] = np.arange(len(used))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return _found([words[i] for i in x[at]], np.diff(np.append(at, len(x))), n[y[at]], [words[i] for i in y[at]])


FOUND = "word string, n_near bigint, best_n bigint, best string"


def _found(words: list[str], n_near: np.ndarray, best_n: np.ndarray, best: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n_near.astype(np.int64)), pa.array(best_n),
                                       pa.array(best, pa.string())], ["word", "n_near", "best_n", "best"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_lists(batches):
        key = table["key"].to_numpy()
        again = key[1:] == key[:-1]
        shared = np.append(again, False) | np.append(False, again)
        level = table["place"].to_numpy() >> 56
        for k in np.unique(level[shared]):
            part = table.filter(pa.array(shared & (level == k)))
            yield _compare(part["key"].to_numpy(), part["place"].to_numpy(), part["word"].to_pylist(), part["n"].to_numpy())


def near_words(words: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """``word, n, n_near, best_n, best``: each word's number of near words and its commonest
    one (ties: the smallest).  ``words`` has distinct words ``word`` and their numbers ``n``."""
    common.python_workers(words.sparkSession)
    known = gram_dictionary(words, entries)
    found = merge_keys(words, known).repartition("key").sortWithinPartitions("key").mapInArrow(_verified, FOUND)
    none = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("best_n"),
                        F.lit(None).cast("string").alias("best"))
    best = F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("rank"), "best"))
    return (none.unionByName(found.withColumn("n", F.lit(None).cast("bigint")))
            .groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("b"))
            .select("word", "n", "n_near", (-F.col("b.rank")).alias("best_n"), F.col("b.best").alias("best")))


def group_variants(words: DataFrame, ratio: int = 10, entries: int = ENTRIES) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word's form, and the last one of the chain of forms.

    ``words`` has distinct words of at least seven code points, ``word``, and their numbers ``n``; null
    words and shorter ones are left out, further columns too.  A word without a common enough near
    word has no form and is its own root.  No words give no rows.
    Every step of a chain multiplies n, so following doubled steps ends after five rounds at most.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: a chain of forms has to rise")
    words = common.stored(words.where(F.length("word") >= LEAST).select("word", F.col("n").cast("bigint").alias("n")), "words")
    found = common.stored(
        near_words(words, entries).withColumn("has", F.coalesce(F.col("best_n") >= F.col("n") * ratio, F.lit(False)))
        .select("word", "n", "n_near", F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n")),
        "near-words")
    links = common.stored(found.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        stepped = common.stored(links.join(onward, "root", "left"), "forms")
        moved = stepped.where("onward is not null").limit(1).count()
        links = stepped.select("word", F.coalesce("onward", "root").alias("root"))
        if not moved:
            break
    return (found.join(links, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
