"""Projections, compression, dedup, sampling and curriculum.

Trajectories are handled in long form ``(conv_id, turn, role, text)``; the
nested ``array<struct>`` form is one ``groupBy`` away and is only built where
an output row needs the whole conversation anyway.

Wide text is materialised late: dedup and ranking run on narrow
``(key, order, id)`` rows and the text joins back on the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import problem_key, word_count

# Role aliases, prompt wrapper, compression labels (reference).
ROLE_ALIASES = {"tool_call": "assistant", "function_call": "assistant",
                "tool_response": "tool", "function": "tool", "ipython": "tool"}
KNOWN_ROLES = ["system", "user", "assistant", "tool", "developer"]
PROMPT_PREFIX = "Please reason step by step, and put your final answer within \\boxed{}.\n\n"
TOOL_OUTPUT_FMT = ("\nOutput:\n```\n", "\n```\n")
CONTEXT_FMT_V4 = ("\n[Context: ", "]\n")
CONTEXT_FMT_V1 = ("\n[Additional context: ", "]\n")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compress_messages(messages: DataFrame, mode: str = "v4", key: str = "conv_id",
                      turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """C1 (v4) / C2 (v1): multi-turn long-form messages -> one
    ``(key, prompt, assistant)`` row, or no row.

    v4: contents stripped; the first user turn is the prompt; assistant
    contents, tool outputs in a fence and later user turns as context, empties
    dropped, joined by newlines; a blank first user turn still claims the slot
    and the row is dropped.  v1: no stripping, empties kept, ``[Additional
    context: ...]``; dropped only without a user turn or without parts.

    One window (first user turn) and one aggregate on ``key``; the aggregate
    reuses the window's partitioning, so the messages shuffle once."""
    strip_content = mode == "v4"
    ctx = CONTEXT_FMT_V4 if mode == "v4" else CONTEXT_FMT_V1
    content = F.coalesce(_c(text), F.lit(""))
    if strip_content:
        content = A.strip(content)
    r = A.strip(F.coalesce(_c(role), F.lit(""))) if strip_content else F.coalesce(_c(role), F.lit(""))
    m = messages.select(F.col(key), F.col(turn).alias("_turn"), r.alias("_role"), content.alias("_content"))
    if strip_content:
        m = m.where(F.col("_role") != "")
    w = Window.partitionBy(key)
    m = m.withColumn("_first_user", F.min(F.when(F.col("_role") == "user", F.col("_turn"))).over(w))
    c, t = F.col("_content"), F.col("_turn")
    keep = (c != "") if strip_content else F.lit(True)
    part = (F.when((F.col("_role") == "assistant") & keep, c)
             .when((F.col("_role") == "tool") & keep, F.concat(F.lit(TOOL_OUTPUT_FMT[0]), c, F.lit(TOOL_OUTPUT_FMT[1])))
             .when((F.col("_role") == "user") & (t > F.col("_first_user")) & keep,
                   F.concat(F.lit(ctx[0]), c, F.lit(ctx[1]))))
    m = m.withColumn("_part", part)
    is_first_user = (F.col("_role") == "user") & (t == F.col("_first_user"))
    g = m.groupBy(key).agg(
        F.max(F.when(is_first_user, c)).alias("prompt"),
        F.count("_part").alias("_n_parts"),
        F.expr("listagg(_part, '\n') WITHIN GROUP (ORDER BY _turn)").alias("assistant"))
    ok = F.col("prompt").isNotNull() & (F.col("_n_parts") > 0)
    if strip_content:
        ok = ok & (F.col("prompt") != "")
    return g.where(ok).drop("_n_parts")


def trajectory_chars(messages: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """C3 (chars): character sum over all message contents per trajectory."""
    return messages.groupBy(key).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("bigint").alias("traj_chars"))


def best_per_problem(df: DataFrame, key, order: list, tie: str, id_col: str) -> DataFrame:
    """C4: one row per key, smallest ``order`` (then ``tie``), returned as
    ``(id_col)`` of the winners -- narrow, so only keys and ids shuffle.
    ``row_number() = 1`` plans as WindowGroupLimit (partial before the
    exchange), so a hot key is cut down map-side."""
    narrow = df.select(_c(key).alias("_key"), *[_c(o).alias(f"_o{i}") for i, o in enumerate(order)],
                       F.col(tie).alias("_tie"), F.col(id_col).alias("_id"))
    w = Window.partitionBy("_key").orderBy(*[F.col(f"_o{i}").asc() for i in range(len(order))], F.col("_tie").asc())
    return narrow.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(F.col("_id").alias(id_col))


def seeded_order(seed: int, key) -> Column:
    """C5 sort key: md5(seed || ':' || key) -- reproducible on any layout."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _c(key).cast("string")))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A whole-set permutation (range-partitioned sort, no single task)."""
    return df.orderBy(seeded_order(seed, key))


def train_eval_split(df: DataFrame, key: str, n_eval: int, seed: int = 42):
    """The first ``n_eval`` rows of the seeded shuffle are eval, the rest
    train (left-anti on the key).  The input is read for both, so hand in a table.  ``orderBy().limit(n)`` plans as
    TakeOrderedAndProject: a per-partition top-n, no global sort."""
    ev = df.orderBy(seeded_order(seed, key)).limit(n_eval)
    tr = df.join(ev.select(key), key, "left_anti")
    return tr, ev


def split_by_fraction(df: DataFrame, key: str, eval_fraction: float, seed: int = 42) -> Column:
    """C6 ``frac`` mode: hash threshold, no sort -- a boolean ``is_eval``."""
    h = F.conv(F.substring(seeded_order(seed, key), 1, 8), 16, 10).cast("bigint")
    return h < F.lit(int(eval_fraction * 2 ** 32))


def upsample(df: DataFrame, acc: str = "accuracy", weights: dict | None = None, copy_no: str | None = None) -> DataFrame:
    """Repeat rows by accuracy tier (0.125 x4, 0.25 x2, else x1) with a
    per-row ``explode(sequence)`` -- no shuffle, no driver loop.  ``copy_no`` names a
    column that numbers the copies from 1."""
    from .evaluate import UPSAMPLE_WEIGHTS
    weights = weights or UPSAMPLE_WEIGHTS
    w = F.lit(1)
    for a, k in sorted(weights.items(), reverse=True):
        w = F.when(F.col(acc) == a, F.lit(k)).otherwise(w)
    out = df.withColumn(copy_no or "_copy", F.explode(F.sequence(F.lit(1), w)))
    return out if copy_no else out.drop("_copy")


def upsample_plan(df: DataFrame, acc: str = "accuracy", weights: dict | None = None) -> DataFrame:
    """Per accuracy value n, weight, n x weight."""
    from .evaluate import UPSAMPLE_WEIGHTS
    weights = weights or UPSAMPLE_WEIGHTS
    w = F.lit(1)
    for a, k in sorted(weights.items(), reverse=True):
        w = F.when(F.col(acc) == a, F.lit(k)).otherwise(w)
    g = df.groupBy(acc).agg(F.count("*").alias("n"))
    return g.withColumn("weight", w.cast("bigint")).withColumn("rows_after", F.col("n") * F.col("weight"))


def sample_per_group(df: DataFrame, group: str, n: int, order) -> DataFrame:
    """C11: the first ``n`` rows per group by ``order`` (WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def think_reformat(solution, expected_answer) -> Column:
    """A final ``\\boxed{..}`` (optionally inside ``\\[ \\]``) at the end
    moves after ``<think>...</think>``; without one, the expected answer is
    boxed and appended."""
    s = A.strip(_c(solution))
    tail_re = r"(\\\[?\s*\\boxed\{[^}]+\}\s*\\\]?\s*)$"
    tail = F.regexp_extract(s, tail_re, 1)
    has = tail != ""
    reasoning = F.when(has, A.strip(F.regexp_replace(s, tail_re, ""))).otherwise(s)
    inner = F.regexp_extract(tail, r"\\boxed\{([^}]+)\}", 1)
    boxed = F.when(has, F.concat(F.lit("\\boxed{"), inner, F.lit("}"))) \
             .otherwise(F.concat(F.lit("\\boxed{"), _c(expected_answer).cast("string"), F.lit("}")))
    return F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n\n"), boxed)


def prompt_wrap(question) -> Column:
    """C14."""
    return F.concat(F.lit(PROMPT_PREFIX), _c(question))


def clean_role(role) -> Column:
    """Alias map; unknown roles become ``user``."""
    r = F.coalesce(_c(role), F.lit("user"))
    out = F.when(r.isin(*KNOWN_ROLES), r)
    for a, to in ROLE_ALIASES.items():
        out = out.when(r == a, F.lit(to))
    return out.otherwise(F.lit("user"))


def formatted_part(role, text) -> Column:
    """C13 fallback template piece: ``<|role|>\\ncontent``."""
    return F.concat(F.lit("<|"), _c(role), F.lit("|>\n"), F.coalesce(_c(text), F.lit("")))


def chat_format(messages: DataFrame, key: str = "conv_id", turn: str = "turn",
                role: str = "role", text: str = "text") -> DataFrame:
    """One formatted text per conversation, parts joined by newlines."""
    m = messages.select(key, F.col(turn).alias("_turn"), formatted_part(clean_role(role), text).alias("_part"))
    return m.groupBy(key).agg(F.expr("listagg(_part, '\n') WITHIN GROUP (ORDER BY _turn)").alias("formatted"))


def assistant_mask_spans(messages: DataFrame, key: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """Per message ``[start, end)`` character offsets in the C13 text,
    ``train`` only on assistant turns; conversations with no trainable span
    are dropped.  Running sum over a window per conversation."""
    m = messages.select(key, turn, clean_role(role).alias("role"),
                        F.length(formatted_part(clean_role(role), text)).alias("_len"))
    w = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumn("end", F.sum(F.col("_len") + 1).over(w) - 1)
    m = m.withColumn("start", F.col("end") - F.col("_len")).withColumn("train", F.col("role") == "assistant")
    has = m.groupBy(key).agg(F.max(F.col("train").cast("int")).alias("_any")).where("_any = 1").select(key)
    return m.join(has, key, "left_semi").select(key, turn, "role", "start", "end", "train")


def pack_sequences(df: DataFrame, id_col: str, length, max_len: int, shards: int, shard: Column | None = None,
                   block_rows: int = 1_000_000) -> DataFrame:
    """C17: concatenate-and-cut packing plan.  Rows are spread over ``shards``
    hash shards; inside a shard a running sum of lengths, by id, gives each row its
    offset and bin = floor(offset / max_len).  Running sums are of two levels: the rows are range-partitioned by
    (shard, id) with sampled bounds into blocks of about ``block_rows``, whatever the ids are (sparse
    ones, hashes, strings), and the blocks' sums are summed up over the blocks.  The blocks are kept by ``checkpoint()``, so
    that both levels see the same bounds.  Rows of equal id share a block, in the order of their length."""
    d = df.select(id_col, (F.col(length) if isinstance(length, str) else length).alias("length"))
    d = d.withColumn("shard", F.pmod(F.xxhash64(F.col(id_col)), F.lit(shards)) if shard is None else shard)
    blocks = max(1, -(-d.count() // block_rows))
    d = d.repartitionByRange(blocks, "shard", id_col).withColumn("_block", F.spark_partition_id()).checkpoint()
    sums = d.groupBy("shard", "_block").agg(F.sum("length").alias("_sum"))
    earlier = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("shard", "_block").orderBy(id_col, "length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_run", F.sum("length").over(inside) - F.col("length")).join(sums, ["shard", "_block"])
    d = d.withColumn("offset", F.col("_run") + F.col("_before")).select(id_col, "length", "shard", "offset")
    return d.withColumn("bin", F.floor(F.col("offset") / F.lit(max_len)).cast("bigint"))


def judge_requests(df: DataFrame, verdicts: DataFrame, gold: str = "gold_solution",
                   solution: str = "response") -> DataFrame:
    """One request per cache key not yet judged, with both whole texts."""
    from .rewards import judge_key
    r = df.select(judge_key(F.md5(gold), F.col(solution)).alias("key"),
                  F.col(gold).alias("gold_body"), F.col(solution).alias("solution_body"))
    r = r.dropDuplicates(["key"])
    return r.join(verdicts.select("key"), "key", "left_anti")


__all__ = ["compress_messages", "trajectory_chars", "best_per_problem", "seeded_order", "seeded_shuffle",
           "train_eval_split", "split_by_fraction", "upsample", "upsample_plan", "sample_per_group",
           "think_reformat", "prompt_wrap", "clean_role", "chat_format", "assistant_mask_spans",
           "pack_sequences", "judge_requests", "problem_key", "word_count"]


def get_problem(messages) -> Column:
    """D24 (nested form): the first user content, else the first message's
    content, else ""."""
    m = _c(messages)
    user = F.try_element_at(F.filter(m, lambda x: x["role"] == "user"), F.lit(1))["content"]
    return F.coalesce(user, F.try_element_at(m, F.lit(1))["content"], F.lit(""))


def get_solution(messages) -> Column:
    """D24 (nested form): the first assistant content, else the last
    message's content when there are two or more, else ""."""
    m = _c(messages)
    asst = F.try_element_at(F.filter(m, lambda x: x["role"] == "assistant"), F.lit(1))["content"]
    last = F.when(F.size(m) > 1, F.try_element_at(m, F.lit(-1))["content"])
    return F.coalesce(asst, last, F.lit(""))
