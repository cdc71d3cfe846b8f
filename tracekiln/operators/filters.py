"""Filters and predicates (B1-B13).  All are Column predicates over flat
columns so Catalyst can push the comparable ones into the parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A

# Failure markers of a broken gold trace (case-sensitive).
BROKEN_GOLD_MARKERS = ["Timed out", "NameError", "Traceback", "Error:", "Exception",
                       "not defined", "SyntaxError", "AttributeError", "IndexError",
                       "KeyError", "RuntimeError", "ZeroDivisionError"]
TOOL_ROLES = ["tool", "ipython"]
CODE_MARKERS = ["```python", "```py"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_hard(acc, max_acc: float = 0.5, exclude_zero: bool = True, missing: float | None = None) -> Column:
    """B1 (``exclude_zero``: 0 < acc < max, missing -> false) and B2
    (``exclude_zero=False, missing=1.0``: acc < max, zero included)."""
    a = _c(acc)
    if missing is not None:
        a = F.coalesce(a, F.lit(float(missing)))
    cond = (a < max_acc) & (a > 0) if exclude_zero else (a < max_acc)
    return F.coalesce(cond, F.lit(False))


def acc_for_split(metadata, split) -> Column:
    """Accuracy under the split's key (medium -> reason_medium_with_tool,
    otherwise reason_high_with_tool) from a ``map<string, struct<accuracy>>``."""
    key = F.when(_c(split) == "medium", F.lit("reason_medium_with_tool")).otherwise(F.lit("reason_high_with_tool"))
    return F.try_element_at(_c(metadata), key)["accuracy"]


def answer_in_range(ans, policy: str = "strict", lo: int = 0, hi: int = 99999) -> Column:
    """B4, five policies:
    strict  -- ``int(str.strip())`` in lo..hi (3.0 fails);
    integral -- float, finite, integral, in range (3.0 passes, 3.5 fails);
    float   -- any float in range (3.5 passes);
    trunc   -- ``int(float(s))`` after removing ``,`` and spaces;
    signed_digits -- digits with leading ``-`` allowed, 0..999 by default.
    """
    s = _c(ans).cast("string")
    if policy == "strict":
        ok = s.rlike(r"^\s*[+-]?\d+\s*$")
        v = F.when(ok, A.strip(s).try_cast("decimal(38,0)"))
        return F.coalesce((v >= lo) & (v <= hi), F.lit(False))
    if policy == "integral":
        d = A.to_double(s)
        return F.coalesce((d == F.floor(d)) & (d >= lo) & (d <= hi), F.lit(False))
    if policy == "float":
        d = A.to_double(s)
        return F.coalesce((d >= lo) & (d <= hi), F.lit(False))
    if policy == "trunc":
        d = A.to_double(F.regexp_replace(A.strip(s), "[, ]", ""))
        return F.coalesce((d > lo - 1) & (d < hi + 1), F.lit(False))
    if policy == "signed_digits":
        t = A.strip(s)
        ok = t.rlike(r"^-*\d+$")
        v = F.when(ok, t.try_cast("decimal(38,0)"))
        return F.coalesce((v >= lo) & (v <= (999 if hi == 99999 else hi)), F.lit(False))
    raise ValueError(f"unknown policy {policy!r}")


def clean_int_answer(ans) -> Column:
    """``str(int(float(x)))`` (truncating) for numeric strings, else null."""
    d = A.to_double(_c(ans).cast("string"))
    return F.when((d > -9.2e18) & (d < 9.2e18), d.cast("bigint").cast("string"))


def by_source(src, value: str, lower: bool = False) -> Column:
    """Exact (v3) or lower-cased (RAFT) source match."""
    s = F.coalesce(_c(src), F.lit(""))
    return (F.lower(s) == value.lower()) if lower else (s == value)


def has_tools_defined(n_tools) -> Column:
    """Tools present and non-empty (array size or a count)."""
    c = _c(n_tools)
    return F.coalesce(c > 0, F.lit(False))


def message_uses_tool(role, text) -> Column:
    """Per-message part of B8: tool/ipython role or a python code fence."""
    t = F.coalesce(_c(text), F.lit(""))
    cond = _c(role).isin(*TOOL_ROLES)
    for m in CODE_MARKERS:
        cond = cond | F.contains(t, F.lit(m))
    return F.coalesce(cond, F.lit(False))


def has_tool_use(messages) -> Column:
    """B8 on a nested ``array<struct<role, content, tool_calls>>``."""
    return F.exists(_c(messages), lambda m: message_uses_tool(m["role"], m["content"])
                    | (F.coalesce(F.length(m["tool_calls"]), F.lit(0)) > 0))


def tool_use_by_conversation(messages_long: DataFrame, key: str = "conv_id") -> DataFrame:
    """B8 on long-form messages: one row per conversation (partial+final agg)."""
    return messages_long.groupBy(key).agg(
        F.max(message_uses_tool(F.col("role"), F.col("text")).cast("int")).cast("boolean").alias("has_tool_use"))


def min_text_len(text, n: int = 100) -> Column:
    """``len(text) > n``."""
    return F.coalesce(F.length(_c(text)) > n, F.lit(False))


def token_estimate(text, per_word: float = 1.3) -> Column:
    """Default pluggable length: words x 1.3 (no tokenizer in the engine)."""
    from ..functions.text import word_count
    return F.ceil(word_count(text) * F.lit(per_word)).cast("bigint")


def drop_overlong(df: DataFrame, length: Column, cap: int) -> DataFrame:
    """Drop (not truncate) rows whose length is above ``cap``."""
    return df.where(length <= cap)


def is_valid_gold(text) -> Column:
    """Length >= 50 and none of the failure markers (case-sensitive)."""
    t = _c(text)
    bad = F.lit(False)
    for m in BROKEN_GOLD_MARKERS:
        bad = bad | F.contains(t, F.lit(m))
    return F.coalesce((F.length(t) >= 50) & ~bad, F.lit(False))


def broken_gold_rate(df: DataFrame, gold: str = "gold_solution", by: str = "accuracy") -> DataFrame:
    """Share of invalid gold traces per accuracy tier."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.round(F.avg((~is_valid_gold(F.col(gold))).cast("double")), 6).alias("broken_share"))


def rejection_sample(attempts: DataFrame, key: str = "problem_id", response: str = "response",
                     gt: str = "gold", order_id: str = "attempt_id") -> DataFrame:
    """Keep attempts whose first-boxed answer matches the gold, then the
    shortest one per problem (ties: lowest attempt id).  Top-1 per key is a
    ``row_number() = 1`` window, planned as WindowGroupLimit (partial+final)."""
    # The match predicate is an ordering key of the window rather than a
    # filter: a filter on it would be pushed below the staged projections and
    # re-expand the whole D12 chain inside the predicate.
    ok = A.add_answers_match(A.add_boxed_first(attempts, F.col(response), "_pred"),
                             F.col("_pred"), F.col(gt), "_ok")
    ok = ok.drop("_pred").withColumn("response_len", F.length(response))
    w = Window.partitionBy(key).orderBy(F.col("_ok").desc(), F.col("response_len").asc(), F.col(order_id).asc())
    return ok.withColumn("_rn", F.row_number().over(w)).where("_rn = 1 AND _ok").drop("_rn", "_ok")
