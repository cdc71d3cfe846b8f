"""Phrase collocations: frequent n-grams by mergeable Misra-Gries summaries, counted exactly in a second pass.

1. Words are counted by language.  An n-gram that holds a word of fewer than ``least`` occurrences is
   not frequent; a Bloom filter of the others (at most 4 MB, beyond that it only lets more through) leaves most such n-grams out.
2. First pass: n-grams are dealt to hash partitions.  A task summarises what it has read, a
   few million n-grams at a time: a counter for each n-gram, the n-grams' number (mass), by hash partition.
   A hash partition's summaries are merged in one task: counters are added; whenever there are
   more than the capacity, floor(mass / least) + 1 with the mass of all its summaries, the largest
   one beyond it is subtracted from all and those without a rest go.  So all subtractions together are below ``least``, and
   every n-gram with ``least`` occurrences has a counter in the end.  Its hash is a candidate.
   The number of hash partitions grows with the words, a partition's mass stays about ``PARTITION_MASS``
   (one n-gram that is a third of all adds mass but one counter).
3. Second pass: n-grams that a Bloom filter of the candidates admits are counted, in the task and then by
   their texts over all tasks; whatever the filter admits in vain is too rare and goes.
4. Scores are joins among the frequent phrases.

N-grams are told apart by 64-bit hashes within a few million n-grams of one task, and by their
texts everywhere else; the first pass keeps 32 bits and the partition's number, where an equal hash can only add a candidate.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .shingles import BASE, _hash_spans, mix

LONGEST = 4
UNKNOWN = "und"
HELD = 1 << 22                # n-grams summarised at a time
HELD_WORDS = 200_000
HELD_PHRASES = 600_000
BUFFER = 1 << 20              # bytes cut into words at a time
PARTITION_MASS = 1 << 24
FILTER_WORDS = 1 << 19        # 64-bit words of a Bloom filter at most: 4 MB
U = np.uint64

# A-Z lower-cased, tabs as blanks, the bytes that end a piece as line feeds.
CLEAN = bytes(32 if c == 9 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANKED = bytes(32 if c == 10 else c for c in range(256))
ENDS = re.compile(rb"[ \n]")
WORD = re.compile(rb"[^ \n]+")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, cleaned text) of the rows with a text."""
    for batch in batches:
        for lang, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            if text:
                yield lang, text.encode("utf-8").translate(CLEAN)


def _source(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    common.python_workers(docs.sparkSession)
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)), F.col(text_col).cast("string"))


def count_words(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, phrase, f``: occurrences of every word of whole texts."""
    def rows(found: dict[str, Counter]) -> pa.RecordBatch:
        flat = [(lang, w.decode("utf-8"), n) for lang, words in found.items() for w, n in words.items()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                          ["lang", "phrase", "f"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for lang, data in _texts(batches):
            words = found.setdefault(lang, Counter())
            at = 0
            data = data.translate(BLANKED)
            while at < len(data):
                end = data.find(b" ", at + BUFFER)
                end = len(data) if end < 0 else end
                words.update(x for x in data[at:end].split(b" ") if x)
                at = end
                if sum(map(len, found.values())) > HELD_WORDS:
                    yield rows(found)
                    words.clear()
                    found = {lang: words}
        yield rows(found)

    return (_source(docs, lang_col, text_col).mapInArrow(counted, "lang string, phrase string, f bigint")
            .groupBy("lang", "phrase").agg(F.sum("f").alias("f")))


def _lang_hash(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(lang.encode("utf-8"), digest_size=8).digest(), "little"))


def _slices(data: bytes) -> Iterator[tuple[bytes, int]]:
    """(part of a text, its bytes in which n-grams may begin): a part ends with the words that complete its last n-grams."""
    at = 0
    while len(data) - at > 2 * BUFFER:
        cut = ENDS.search(data, at + BUFFER)
        if not cut:
            break
        stop = cut.start()
        end = stop
        for _ in range(LONGEST - 1):
            word = WORD.search(data, end)
            if not word:
                break
            end = word.end()
        yield data[at:end], stop - at
        at = stop
    yield data[at:], len(data) - at


def _buffers(texts: Iterator[tuple[str, bytes]]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts of its texts, their languages' hashes, ends of the bytes in which n-grams may begin)."""
    held: list[tuple[str, bytes, int]] = []
    size = 0

    def joined():
        starts = np.cumsum([0, *[len(x) + 1 for _, x, _ in held[:-1]]])
        return (b"\n".join([x for _, x, _ in held]) + b"\n", starts, np.array([_lang_hash(lang) for lang, _, _ in held], U),
                starts + np.array([n for _, _, n in held]))

    for lang, data in texts:
        for part, begins in _slices(data):
            if held and size + len(part) > BUFFER:
                yield joined()
                held, size = [], 0
            held.append((lang, part, begins))
            size += len(part) + 1
    if held:
        yield joined()


def _grams(data: bytes, starts: np.ndarray, langs: np.ndarray, stops: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, hashes, index of the text, first byte, end) of the n-grams of 2 words and more whose words a Bloom filter admits."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff((raw != 32) & (raw != 10), prepend=False, append=False))
    a, b = edge[::2], edge[1::2]
    if len(a) < 2:
        return
    of = np.searchsorted(starts, a, "right") - 1
    key = mix(_hash_spans(raw, a, b) + langs[of])
    piece = np.cumsum(raw == 10)[a]
    usable = admits(words, key)
    begins = a < stops[of]
    total, whole = key.copy(), usable.copy()
    for n in range(2, LONGEST + 1):
        if len(a) < n:
            return
        m = len(a) - n + 1
        total = total[:m] + key[n - 1:] * U(pow(BASE, 2 * n + 1, 1 << 64))
        whole = whole[:m] & usable[n - 1:] & (piece[:m] == piece[n - 1:])
        at = np.flatnonzero(whole & begins[:m])
        yield n, mix(total[at] + U(n)), of[at], a[at], b[at + n - 1]


def word_keys(words: DataFrame) -> DataFrame:
    """``key``: the hashes by which the n-grams' words are known."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = [w.encode("utf-8") for w in batch[1].to_pylist()]
                ends = np.cumsum([len(w) + 1 for w in data]) - 1
                found = _hash_spans(np.frombuffer(b" ".join(data) + b" ", np.uint8), np.append(0, ends[:-1] + 1), ends)
                found = mix(found + np.array([_lang_hash(x) for x in batch[0].to_pylist()], U))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["key"])

    return words.select("lang", "phrase").mapInArrow(keyed, "key bigint")


# ---- Bloom filter of at most FILTER_WORDS 64-bit words; a key sets four bits of one word

def _bit_places() -> tuple[int, ...]:
    return (40, 46, 52, 58)


def filter_of(keys: DataFrame) -> np.ndarray:
    """The filter of the bigint column ``key``; only its words come to the driver."""
    n = 1
    count = keys.count()
    while n < min(FILTER_WORDS, count // 2):
        n *= 2
    mark = F.lit(0).cast("bigint")
    for s in _bit_places():
        mark = mark.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("key", s).bitwiseAND(63).cast("int")))
    found = keys.select(F.col("key").bitwiseAND(n - 1).alias("at"), mark.alias("mark")).groupBy("at").agg(F.bit_or("mark").alias("mark")).toPandas()
    words = np.zeros(n, U)
    words[found["at"].to_numpy(np.int64)] = found["mark"].to_numpy(np.int64).view(U)
    return words


def admits(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mark = np.zeros(len(keys), U)
    for s in _bit_places():
        mark |= U(1) << (keys >> U(s) & U(63))
    return words[(keys & U(len(words) - 1)).astype(np.int64)] & mark == mark


# ---- Misra-Gries summaries: sorted keys with counters

def merged(parts: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The summaries' sum (keys, counters) with at most ``capacity`` counters, and what was subtracted from each."""
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint32)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
    if len(keys) <= capacity:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    stay = counts > cut
    return keys[stay], counts[stay] - cut, cut


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A summary in five bytes a counter; counters from 255 on follow at the end."""
    large = np.flatnonzero(counts >= 255)
    return b"".join([np.uint32(len(keys)).tobytes(), keys.astype(np.uint32).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(),
                     large.astype(np.uint32).tobytes(), counts[large].astype(np.int64).tobytes()])


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    keys, counts = np.frombuffer(blob, np.uint32, n, 4), np.frombuffer(blob, np.uint8, n, 4 + 4 * n).astype(np.int64)
    rest = blob[4 + 5 * n:]
    m = len(rest) // 12
    counts[np.frombuffer(rest, np.uint32, m)] = np.frombuffer(rest, np.int64, m, 4 * m)
    return keys, counts


SUMMARY = "part bigint, rank int, mass bigint, summary binary"


def _summaries(source: DataFrame, words, bits: int) -> DataFrame:
    """``part, rank, mass, summary``: of each task's n-grams, by hash partition: the mass (rank 0) and the summary (rank 1)."""
    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held) >> U(32 - bits), return_counts=True)
        part = (keys >> U(32)).astype(np.int64)
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        end = np.append(at[1:], len(keys))
        mass = np.add.reduceat(counts, at)
        blobs = [packed(keys[i:j] & U(0xFFFFFFFF), counts[i:j]) for i, j in zip(at, end, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.tile(part[at], 2)), pa.array(np.repeat([0, 1], len(at)).astype(np.int32)),
                                           pa.array(np.tile(mass, 2)), pa.array([None] * len(at) + blobs, pa.binary())],
                                          ["part", "rank", "mass", "summary"])

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for buffer in _buffers(_texts(batches)):
            for _, keys, *_ in _grams(*buffer, words.value):
                if len(keys):
                    held.append(keys)
                    size += len(keys)
            if size > HELD:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return source.mapInArrow(summarised, SUMMARY)


def _candidates(summaries: DataFrame, least: int) -> DataFrame:
    """``key``: hashes of the n-grams that may have ``least`` occurrences."""
    def rows(part: int, total: tuple[np.ndarray, np.ndarray], error: int) -> pa.RecordBatch:
        keys, counts = total
        keys = mix(U(part) << U(32) | keys[counts + error >= least].astype(U))
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        part, mass, error, total, held, size = None, 0, 0, none, [], 0

        def settle():
            nonlocal total, held, size, error
            keys, counts, cut = merged([total, *held], mass // least + 1)
            total, held, size, error = (keys, counts), [], 0, error + cut

        for batch in batches:
            for p, rank, m, blob in zip(*[batch[k].to_pylist() for k in range(4)], strict=True):
                if p != part:
                    if part is not None:
                        settle()
                        yield rows(part, total, error)
                    part, mass, error, total = p, 0, 0, none
                if rank == 0:
                    mass += m
                    continue
                held.append(unpacked(blob))
                size += len(held[-1][0])
                if size > max(1 << 20, mass // least):
                    settle()
        if part is not None:
            settle()
            yield rows(part, total, error)

    return summaries.repartition("part").sortWithinPartitions("part", "rank").mapInArrow(merge, "key bigint")


def _counted(source: DataFrame, words, candidates, bits: int, least: int) -> DataFrame:
    """``lang, phrase, words, f``: the n-grams that the candidates' filter admits and that occur ``least`` times.
    Tasks pass their numbers on in blocks by hash partition; a block holds numbers and phrases, which have no line feeds."""
    def blocks(names: dict[int, str], phrases: dict[int, tuple[int, bytes]], held: list) -> pa.RecordBatch:
        keys, counts, _ = merged(held, len(phrases))
        found: dict[tuple[int, int], tuple[list, list]] = {}
        for key, part, n in zip(keys.tolist(), (keys >> U(33) >> U(31 - bits)).tolist(), counts.tolist(), strict=True):
            lang, phrase = phrases[key]
            numbers, texts = found.setdefault((lang, part), ([], []))
            numbers.append(n)
            texts.append(phrase)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[lang] for lang, _ in found], pa.string()), pa.array([part for _, part in found], pa.int64()),
             pa.array([np.array(n, np.int64).tobytes() + b"\n".join(t) for n, t in found.values()], pa.binary()),
             pa.array([len(n) for n, _ in found.values()], pa.int64())], ["lang", "part", "counts", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, str] = {}
        phrases: dict[int, tuple[int, bytes]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def texts():
            for lang, data in _texts(batches):
                names.setdefault(int(_lang_hash(lang)), lang)
                yield lang, data

        for data, starts, langs, stops in _buffers(texts()):
            for _, keys, of, a, b in _grams(data, starts, langs, stops, words.value):
                yes = np.flatnonzero(admits(candidates.value, mix(keys >> U(32 - bits))))
                once, at, counts = np.unique(keys[yes], return_index=True, return_counts=True)
                held.append((once, counts))
                size += len(once)
                for key, k in zip(once.tolist(), yes[at].tolist(), strict=True):
                    if key not in phrases:
                        phrases[key] = int(langs[of[k]]), b" ".join([w for w in data[a[k]:b[k]].split(b" ") if w])
            if len(phrases) > HELD_PHRASES:
                yield blocks(names, phrases, held)
                phrases, held, size = {}, [], 0
            elif size > HELD:
                held, size = [merged(held, len(phrases))[:2]], len(phrases)
        yield blocks(names, phrases, held)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, found = None, Counter()

        def rows() -> pa.RecordBatch:
            often = [(p.decode("utf-8"), p.count(b" ") + 1, n) for p, n in found.items() if n >= least]
            return pa.RecordBatch.from_arrays([pa.array([of[0]] * len(often), pa.string()), *[pa.array([x[k] for x in often], t) for k, t in enumerate(
                (pa.string(), pa.int32(), pa.int64()))]], ["lang", "phrase", "words", "f"])

        for batch in batches:
            for lang, part, blob, n in zip(*[batch[k].to_pylist() for k in range(4)], strict=True):
                if (lang, part) != of:
                    if of:
                        yield rows()
                    of, found = (lang, part), Counter()
                for phrase, k in zip(blob[8 * n:].split(b"\n"), np.frombuffer(blob, np.int64, n).tolist(), strict=True):
                    found[phrase] += k
        if of:
            yield rows()

    return (source.mapInArrow(counted, "lang string, part bigint, counts binary, n bigint")
            .repartition("lang", "part").sortWithinPartitions("lang", "part")
            .mapInArrow(summed, "lang string, phrase string, words int, f bigint"))


def frequent_phrases(docs: DataFrame, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(every phrase of 1 to 4 words with at least ``least`` occurrences ``lang, phrase, words, f``; words per language ``lang, n``)."""
    spark: SparkSession = docs.sparkSession
    source = _source(docs, lang_col, text_col)
    words = common.stored(count_words(docs, lang_col, text_col), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    usual = words.where(F.col("f") >= least).select("lang", "phrase", F.lit(1).alias("words"), "f")
    mass = (LONGEST - 1) * (words.agg(F.sum("f")).first()[0] or 0)
    bits = min(31, max(0, (mass // PARTITION_MASS).bit_length()))
    known = spark.sparkContext.broadcast(filter_of(word_keys(usual)))
    candidates = common.stored(_candidates(_summaries(source, known, bits), least), "candidates")
    likely = spark.sparkContext.broadcast(filter_of(candidates))
    phrases = _counted(source, known, likely, bits, least)
    return common.stored(usual.unionByName(phrases), "phrases"), totals


def collocations(docs: DataFrame, least: int = 30, share: int = 80, first: int = 2000, lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first phrases by score.

    Words are runs without blanks and tabs between ``. , ; : ! ?`` and line ends, A-Z lower-cased; phrases have 2 to 4 words, do not
    reach over those marks and occur a >= ``least`` times.  Cutting a phrase in two gives
    l and r, the numbers of its parts, and floor(2000000 a / (l + r)); the lowest counts, ties to the shortest first part.
    Phrases inside a longer frequent one with at least ``share`` percent of their occurrences go.  n is the language's words.

    Null and empty texts have no words; a null language is ``und``; repeated rows count each; equal scores are
    ordered by a and then by the phrase's bytes; no rows give no rows; columns beside these two are ignored.
    """
    counts, totals = frequent_phrases(docs, least, lang_col, text_col)
    phrases = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    text = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    k = F.col("k")
    cuts = (phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
            .select("lang", "phrase", "f", "k", text(F.lit(1), k).alias("p"), text(k + 1, F.col("words") - k).alias("q")))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    scored = (cuts.join(part("p", "l"), ["lang", "p"]).join(part("q", "r"), ["lang", "q"])
              .withColumn("score", F.expr("cast(2000000 as decimal(7, 0)) * cast(f as decimal(30, 0)) div (cast(l as decimal(37, 0)) + r)"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("s")))
    spans = F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))
    inside = (phrases.where("words > 2").select("lang", "f", F.explode(F.array_distinct(F.flatten(spans))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.join(inside, ["lang", "phrase"], "left")
            .where(F.coalesce(100 * F.col("longer").cast("decimal(30, 0)") < share * F.col("a").cast("decimal(30, 0)"), F.lit(True)))
            .select("lang", "phrase", "a", "s.l", "s.r", "s.score")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
            .join(totals, "lang")
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
