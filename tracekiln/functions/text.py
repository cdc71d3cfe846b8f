"""Text measures (C3) and small string helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_count(text) -> Column:
    """``len(text.split())`` on ASCII whitespace; null text -> 0."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")).cast("bigint")


def char_count(text) -> Column:
    return F.coalesce(F.length(_c(text)), F.lit(0)).cast("bigint")


def first_words(text, n: int | None = None) -> Column:
    """First ``n`` (default: all) whitespace-separated words joined by a space (K3)."""
    words = F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(words if n is None else F.slice(words, 1, n), " ")


def problem_key(problem) -> Column:
    """Key of a problem, the md5 of its whole trimmed text."""
    return F.md5(F.regexp_replace(F.coalesce(_c(problem), F.lit("")), r"^\s+|\s+$", ""))
