"""Line dedup by a deletion-neighbourhood join, in DataFrame expressions.

Two lines are near duplicates if they are equal, or both have at least
``min_words`` words and one word inserted, deleted or replaced turns one into the
other (outer blanks removed, words between single spaces).  The
earliest such line, by document id and place, stays.

1. Equal lines meet by hash; the earliest stands for them.
2. Every distinct line emits hashed variants.  A line is cut after some of its words, chosen
   by the word alone, into a handful of parts; a variant is the line without one
   part or without two neighbouring ones.  One word's edit changes one part,
   splits one or joins two, so lines within the edit bound share a variant.  (Deleting
   each single word would emit as many keys as the corpus has words.)
3. Of the lines that share a variant each is compared with the earliest; where the
   edit bound holds the link is found.
4. Where it does not hold and the variant has more lines, all its lines emit
   the whole deletion neighbourhood: the line without the word at a place, and the line itself
   with room for a word there, keyed by place and hash.  Lines with an equal key
   are all within the bound of each other, so each one links to the key's earliest.

No pairs are formed within a group, however many lines share a key, and every
link is verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, common

MOD = (1 << 62) - 1
# A word may end a part if its last character is one of these; of such words one in 2**(level - 1), by hash,
# does at a level.  At level 0 every word is a part.
CUT = r" (?<=[dny0-9!-/:-@\[-`{-~] )"
LEVEL_CHUNKS, TOP = 7, 14               # level 1 up to so many chunks (parts of level 1), one more for every doubling
FEW, ENOUGH = 2, 3
LEVEL_MARK = 0x9E3779B97F4A7        # keys of different levels differ
KEY = ["late", "id", "th"]


def _canonical(line: Column) -> Column:
    return F.trim(line)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key of a document: id (null last) and text hash; equal rows are one document."""
    return docs.select(F.col(id_col).isNull().alias("late"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))


def _lines(documents: DataFrame) -> DataFrame:
    return (documents.select(*KEY, F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
            .select(F.struct(*KEY, "pos").alias("first"), _canonical(F.col("raw")).alias("line")).where("line <> ''")
            .withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("2"), F.col("line"))))


def _start_level(chunks: Column) -> Column:
    return F.least(F.lit(TOP), F.greatest(F.lit(1), F.ceil(F.log2(chunks / LEVEL_CHUNKS)).cast("int") + 1))


def _with_variants(lines: DataFrame, min_words: int) -> DataFrame:
    """Adds ``keys``: hashes of the line's variants; empty for short lines.

    Levels are tried from coarse to fine.  One with at least ``FEW`` parts emits; the
    search ends at one with ``ENOUGH`` that is no coarser than a line of one chunk less would
    start at, and starts where one of one chunk more would.  An edit changes the count of a level's parts by one
    at most, so two lines within the bound emit at some common level.
    """
    none = F.array().cast("array<bigint>")
    df = lines.withColumn("near", F.substring_index("line", " ", min_words - 1) != F.col("line"))
    df = df.withColumn("chunks", F.when(F.col("near"), F.split("line", CUT)).otherwise(F.array().cast("array<string>")))
    # the last word ends the line whether it may end a part or not
    last_word = F.transform(F.slice("chunks", 1, F.greatest(F.size("chunks") - 1, F.lit(0))),
                            lambda c: F.xxhash64(F.substring_index(c, " ", -1)))
    df = (df.withColumn("hs", F.transform("chunks", lambda c: F.xxhash64(c)))
          # level up to which each chunk's end is a cut: trailing zero bits of its last word's hash, and one
          .withColumn("tops", F.transform(last_word, lambda h: F.bit_count(
              h.bitwiseOR(1 << TOP - 1).bitwiseXOR(h.bitwiseOR(1 << TOP - 1) - 1)).cast("int"))))
    ranked = F.sort_array("tops", asc=False)
    at_least = lambda parts: F.coalesce(F.get(ranked, F.lit(parts - 2)), F.lit(0))  # noqa: E731  coarsest level with so many parts
    df = (df.withColumn("fine", F.least(at_least(ENOUGH), _start_level(F.greatest(F.size("chunks") - 1, F.lit(1)))))
          .withColumn("coarse", F.greatest("fine", F.least(at_least(FEW), _start_level(F.size("chunks") + 1)))))
    by_level = F.flatten(F.transform(F.sequence(F.greatest("fine", F.lit(1)), F.greatest("coarse", F.lit(1))), _part_hashes))
    keys = F.when(~F.col("near"), none).when(F.col("coarse") == 0, _keys(_words(), F.lit(0))).when(
        F.col("fine") == 0, F.concat(_keys(_words(), F.lit(0)), by_level)).otherwise(by_level)
    return df.withColumn("keys", keys)


def _words() -> Column:
    return F.transform(F.split("line", " "), lambda w: F.xxhash64(w).bitwiseAND(MOD))


def _part_hashes(level: Column) -> Column:
    """Variants at a level: a part is the chunks between two cuts, its hash covers them in order."""
    cuts = F.filter(F.transform("tops", lambda t, i: F.when(t >= level, i + 1)), lambda i: i.isNotNull())
    bounds = F.concat(F.array(F.lit(0)), cuts, F.array(F.size("hs")))
    parts = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1),
                       lambda a, b: F.xxhash64(F.slice("hs", a + 1, b - a)).bitwiseAND(MOD))
    return _keys(parts, level)


def _keys(parts: Column, level: Column) -> Column:
    """The line without one part, and without two neighbouring ones unless nothing is left
    (such a line has no partner that needs it: one of two parts against one of three).  What remains is
    the sum of its parts' hashes, so leaving parts out is a subtraction; lines with
    the same parts in another order are told apart by the comparison of words."""
    def build(p: Column) -> Column:
        whole = F.aggregate(p, F.lit(0).cast("bigint"), lambda s, x: (s + x).bitwiseAND(MOD))
        key = lambda rest: rest.bitwiseAND(MOD).bitwiseXOR(level.cast("bigint") * F.lit(LEVEL_MARK))
        return F.flatten(F.transform(F.array(whole), lambda s: F.concat(
            F.transform(p, lambda x: key(s - x)),
            F.transform(F.slice(p, F.lit(2), F.when(F.size(p) > 2, F.size(p)).otherwise(F.lit(0))),
                        lambda x, i: key((s - x).bitwiseAND(MOD) - F.get(p, i))))))

    return F.flatten(F.transform(F.array(parts), build))


def near_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         min_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """(distinct lines ``h1, h2, first, copies``; those of them that have an earlier near duplicate ``h1, h2``).

    ``first`` is the earliest place ``late, id, th, pos`` of an equal line, ``copies`` the number of all.
    """
    documents = _documents(docs, id_col, text_col)
    lines = _lines(documents)
    distinct = common.stored(
        _with_variants(lines, min_words).select("h1", "h2", "first", "keys")
        .groupBy("h1", "h2").agg(F.min("first").alias("first"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies")), "distinct-lines")
    shared = common.stored(distinct.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                           .where("n > 1"), "shared-variants")
    members = common.stored(
        bloom.admitted(distinct.select("h1", "h2", "first", F.explode("keys").alias("key")), F.col("key"), shared, "key")
        .join(shared, "key"), "variant-lines")
    line = ["h1", "h2"]
    near = members.select(*line, "first").distinct()
    # their texts, at their first places
    texts = common.stored(
        bloom.admitted(lines, F.col("h1"), near, "h1").join(near, [*line, "first"], "left_semi").dropDuplicates(line)
        .select(*line, "first", F.split("line", " ").alias("words")), "near-lines")
    earliest = members.groupBy("key").agg(F.min(F.struct("first", *line)).alias("e"))
    # read twice: for the links and for the variants they leave
    compared = common.stored(members.join(earliest, "key").where("first > e.first")
                             .select("key", "n", *line, F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")), "lines-to-compare")
    linked = common.stored(_verified(compared.select(*line, "e1", "e2").distinct(), texts), "compared-lines")
    # variants whose lines are not all within the bound of the earliest
    mixed = compared.where("n > 2").join(linked, [*line, "e1", "e2"], "left_anti").select("key").distinct()
    rest = texts.join(members.join(mixed, "key", "left_semi").select(*line).distinct(), line, "left_semi")
    emitted = common.stored(
        rest.withColumn("hs", F.transform("words", lambda w: F.xxhash64(w))).select(*line, "first", F.explode(_neighbourhood()).alias("k"))
        .select(*line, "first", "k.place", "k.rest"), "neighbourhoods")
    groups = (emitted.groupBy("place", "rest").agg(F.min(F.struct("first", *line)).alias("e"), F.max("first").alias("last"))
              .where("e.first < last").select("place", "rest", "e"))
    more = _verified(emitted.join(groups, ["place", "rest"]).where("first > e.first")
                     .select(*line, F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).distinct(), texts)
    later = linked.select(*line).unionByName(more.select(*line)).distinct()
    return distinct.select(*line, "first", "copies"), common.stored(later, "later-lines")


def _neighbourhood() -> Column:
    """(place, hash of the line without its word there), and (place, hash of the line) with room for a word there."""
    n = F.size("hs")
    without = lambda p: F.xxhash64(F.concat(F.slice("hs", F.lit(1), p), F.slice("hs", p + 2, n)))
    return F.concat(F.transform("hs", lambda _, p: F.struct(p.alias("place"), without(p).alias("rest"))),
                    F.transform(F.sequence(F.lit(0), n), lambda p: F.struct(p.alias("place"), F.xxhash64("hs").alias("rest"))))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of lines ``h1, h2, e1, e2`` that are within the edit bound."""
    words = texts.select("h1", "h2", "words")
    other = texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("words").alias("e_words"))
    return (pairs.join(words, ["h1", "h2"]).join(other, ["e1", "e2"])
            .where(within_one_word(F.col("words"), F.col("e_words"))).select("h1", "h2", "e1", "e2"))


def within_one_word(a: Column, b: Column) -> Column:
    """Whether one inserted, deleted or replaced element at most turns a into b: the sizes
    differ by one at most, and the common beginning and end leave one element of the longer array.
    (Where repeated elements let both cover the same ones, the sizes decide.)"""
    def common_start(x: Column, y: Column) -> Column:
        differs = F.zip_with(x, y, lambda p, q: F.when(p.eqNullSafe(q), 0).otherwise(1))
        at = F.array_position(differs, 1)
        return F.when(at > 0, at - 1).otherwise(F.least(F.size(x), F.size(y)).cast("bigint"))

    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common_start(a, b) + common_start(F.reverse(a), F.reverse(b)) >= longer - 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the columns ``keep``, ``n_lines``, ``n_kept`` and ``text`` without later near-duplicate lines.

    Empty lines stay where they are.  Order is by doc_id (null last), then by the text's hash, then by place.
    Rows equal in id and text are one document and all keep the same lines.  A null text stays
    null (no lines); an empty one has one empty line.  No rows give no rows; columns beside
    these are ignored.
    """
    distinct, later = near_duplicate_lines(docs, id_col, text_col, min_words)
    block = F.shiftright("pos", 6).alias("block")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos").bitwiseAND(63))
    kept = (distinct.join(later, ["h1", "h2"], "left_anti").select("first.*")
            .groupBy(*KEY, block).agg(F.bit_or(bit).alias("bits"))
            .groupBy(*KEY).agg(F.collect_list(F.struct("block", "bits")).alias("kept")))
    # documents without a line that is repeated or goes are not moved
    touched = distinct.where("copies > 1").select("h1").unionByName(later.select("h1"))
    n = bloom.n_blocks(touched.count(), max_bytes=4 << 20)
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(f"keep_{c}") for c in keep],
                       F.col(id_col).isNull().alias("late"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)).alias("id"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("filter", bloom.inline(touched, "h1", n)).withColumn("lines", F.split("text", "\n"))
    touches = F.coalesce(F.exists("lines", lambda x: bloom.perhaps_in("filter", F.xxhash64(_canonical(x)), n)), F.lit(False))
    joined = (rows.where(touches).drop("filter", "lines").join(kept, KEY, "left").withColumn("lines", F.split("text", "\n"))
              .withColumn("bits", F.when(F.col("kept").isNotNull(), F.map_from_entries("kept")))
              # all blocks of 64 lines, so that a line's bit is found by its place
              .withColumn("bits", F.transform(F.sequence(F.lit(0), F.shiftright(F.size("lines"), 6)),
                                              lambda b: F.coalesce(F.try_element_at("bits", b), F.lit(0).cast("bigint"))))
              .withColumn("stay", F.filter("lines", lambda x, i: (F.trim(x) == "") | (F.call_function(
                  "shiftright", F.get("bits", F.shiftright(i, 6)), i.bitwiseAND(63)).bitwiseAND(1) == 1))))
    size = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.size(c)).cast("bigint")
    out = lambda df, text, lines, stay: df.select("doc_id", *[F.col(f"keep_{c}").alias(c) for c in keep],
                                                  size(lines).alias("n_lines"), size(stay).alias("n_kept"), text.alias("text"))
    return out(joined, F.array_join("stay", "\n"), "lines", "stay").unionByName(
        out(rows.where(~touches), F.col("text"), "lines", "lines"))
