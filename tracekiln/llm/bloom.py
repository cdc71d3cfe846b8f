"""Blocked Bloom filters as DataFrame expressions.

A block has 512 bits in eight 64-bit words.  A key selects one block and sets
one bit in each of its words, so a test reads one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, WORD_BITS = 8, 64
BLOCK_BYTES = WORDS * WORD_BITS // 8


def n_blocks(n_keys: int, bits_per_key: int = 16, max_bytes: int | None = None) -> int:
    """Blocks for ``n_keys``; with ``max_bytes`` no more than fit (then more keys pass in vain)."""
    n = max(1, -(-n_keys * bits_per_key // (WORDS * WORD_BITS)))
    return n if max_bytes is None else min(n, max(1, max_bytes // BLOCK_BYTES))


def block(key: Column, n: int) -> Column:
    return F.pmod(key, F.lit(n).cast("bigint"))


def _bit(key: Column, word: int) -> Column:
    """The key's bit in one word of its block (six bits of a second hash)."""
    at = F.shiftrightunsigned(F.xxhash64(key, F.lit("bit")), 6 * word).bitwiseAND(WORD_BITS - 1)
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))


def _marks(df: DataFrame, key: str, n: int) -> DataFrame:
    k = F.col(key)
    return df.select(block(k, n).alias("block"), *[_bit(k, w).alias(f"w{w}") for w in range(WORDS)])


def _filled(marks: DataFrame) -> DataFrame:
    return (marks.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])
            .select("block", F.array(*[f"w{w}" for w in range(WORDS)]).alias("words")))


def blocks(df: DataFrame, key: str, n: int) -> DataFrame:
    """``block, words``: the eight words of every non-empty block of a bigint column's keys."""
    return _filled(_marks(df, key, n))


def inline(df: DataFrame, key: str, n: int) -> Column:
    """The whole filter as one value (a scalar subquery): an array of blocks.
    Its size, ``n`` blocks, must be bounded by the caller."""
    empty = df.sparkSession.range(n).select(F.col("id").alias("block"), *[F.lit(0).cast("bigint").alias(f"w{w}") for w in range(WORDS)])
    return (_filled(_marks(df, key, n).unionByName(empty))
            .agg(F.array_sort(F.collect_list(F.struct("block", "words"))).alias("b"))
            .select(F.transform("b", lambda x: x["words"])).scalar())


def perhaps(words: Column, key: Column) -> Column:
    """Whether a block's words admit the key."""
    return reduce(Column.__and__, [words[w].bitwiseAND(_bit(key, w)) != 0 for w in range(WORDS)])


def perhaps_in(filter_col: str, key: Column, n: int) -> Column:
    """Whether an inlined filter admits the key."""
    return perhaps(F.element_at(filter_col, (block(key, n) + 1).cast("int")), key)


def admitted(df: DataFrame, key: Column, keys: DataFrame, key_col: str, max_bytes: int = 4 << 20) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys`` (a table without many
    repeats): few others.  The filter's size is bounded, whatever the number of keys."""
    n = n_blocks(keys.count(), max_bytes=max_bytes)
    return df.withColumn("__filter", inline(keys, key_col, n)).where(perhaps_in("__filter", key, n)).drop("__filter")
