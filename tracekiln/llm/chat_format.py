"""Chat formatting by rendering turn prefixes with a black-box template.

The template is any callable ``messages -> str`` over a list of ``(role, text)``.
Nothing is known of its markers.  A conversation's prefixes of 1, 2, ... turns
are rendered; comparing an output with the next one shows where each turn
lies, and whether the template changed what it had written before.  Two more
renderings of each prefix, its last text replaced by two different characters,
show where that text begins and ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Message = tuple[str, str]
SPANS = ("array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>")
SCHEMA = f"conv_id bigint, formatted string, rewrites boolean, turns {SPANS}, loss array<struct<start:int,end:int>>"
PROBES = ("x", "y")


class MarkedTurns:
    """``### User: text </turn>`` per turn.

    Inside texts a backslash is put before each backslash, ``###`` and ``</turn>``, so that
    none is taken for a marker and ``parse`` gets every text back exactly.  Roles other
    than the four named ones are written as ``=role`` with colons escaped too.
    """

    names = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
    control = re.compile(r"\\|###|</turn>")
    role_control = re.compile(r"\\|###|</turn>|:")
    token = re.compile(r"\\.|</turn>", re.S)
    head = re.compile(r"### ((?:\\.|[^\\:])*): ", re.S)

    @classmethod
    def escape(cls, text: str) -> str:
        return cls.control.sub(lambda m: "\\" + m[0], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    @classmethod
    def label(cls, role: str) -> str:
        return cls.names.get(role) or "=" + cls.role_control.sub(lambda m: "\\" + m[0], role)

    @classmethod
    def turn(cls, role: str, text: str) -> str:
        return f"### {cls.label(role)}: {cls.escape(text)} </turn>\n"

    def __call__(self, messages: list[Message]) -> str:
        # the turns of a conversation's prefixes recur
        return "".join((_remembered_turn if len(text) < REMEMBERED else self.turn)(role, text) for role, text in messages)

    @classmethod
    def parse(cls, formatted: str) -> list[Message]:
        roles = {v: k for k, v in cls.names.items()}
        at, found = 0, []
        while at < len(formatted):
            head = cls.head.match(formatted, at)
            if not head:
                raise ValueError(f"no turn at {at}")
            end = next(m for m in cls.token.finditer(formatted, head.end()) if m[0] == "</turn>")
            label = head[1]
            role = cls.unescape(label[1:]) if label.startswith("=") else roles[label]
            found.append((role, cls.unescape(formatted[head.end():end.start() - 1])))
            at = end.end() + 1
        return found


REMEMBERED = 1 << 14


@lru_cache(maxsize=2048)
def _remembered_turn(role: str, text: str) -> str:
    return MarkedTurns.turn(role, text)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning, by comparing halves."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def locate(messages: list[Message], render: Callable[[list[Message]], str],
           learn: frozenset[str] = frozenset({"assistant"})) -> dict:
    """Render prefix by prefix: text, each turn's span and its text's span.

    ``rewrites`` is true if some output neither continues the one before nor
    continues it up to a closing part that every output ends with; then there
    are no spans and nothing is learnt from the conversation.
    """
    turns, before, stable, rewrites = [], "", 0, False
    for n, (role, _) in enumerate(messages, 1):
        output = render(messages[:n])
        start = _shared(before, output)
        closing = before[start:]
        if start < stable or not output.endswith(closing):
            rewrites = True
            break
        one, two = (render([*messages[:n - 1], (role, p)]) for p in PROBES)
        left = _shared(one, two)
        right = len(one) - left - 1
        if left < start or output[:left] != one[:left] or output[len(output) - right:] != one[left + 1:]:
            rewrites = True
            break
        turns.append([role, start, len(output), left, len(output) - right])
        if len(turns) > 1:
            turns[-2][2] = start            # without the closing part of the shorter output
        before, stable = output, len(output) - right
    text = render(messages) if messages else ""
    if rewrites:
        turns = []
    return {"formatted": text, "rewrites": rewrites, "turns": [tuple(t) for t in turns],
            "loss": [(t[3], t[4]) for t in turns if t[0] in learn]}


def conversations(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation with its turns in order (ties by role and text).
    The row is the whole conversation, so it is as large as the result's row."""
    return (rows.groupBy(F.col(conv_col).cast("bigint").alias("conv_id"))
            .agg(F.sort_array(F.collect_list(F.struct(
                F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))).alias("turns")))


def format_conversations(rows: DataFrame, render: Callable[[list[Message]], str] | None = None,
                         learn: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` to ``conv_id, formatted, rewrites, turns, loss``.

    Offsets are in code points.  A null text or role is empty; repeated rows are repeated
    turns; rows without a conv_id make one conversation; no rows give no
    rows; other columns are ignored.  Renderings of a conversation grow with the square of
    its turns, its memory with its length.
    """
    common.python_workers(rows.sparkSession)
    render = render or MarkedTurns()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"conv_id": [], "formatted": [], "rewrites": [], "turns": [], "loss": []}
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out["conv_id"].append(conv)
                got = locate([(t["role"], t["text"]) for t in turns], render, learn)
                got["turns"] = [dict(zip(("role", "start", "end", "text_start", "text_end"), t)) for t in got["turns"]]
                got["loss"] = [dict(zip(("start", "end"), t)) for t in got["loss"]]
                for k, v in got.items():
                    out[k].append(v)
            span = pa.struct([("role", pa.string()), *[(k, pa.int32()) for k in ("start", "end", "text_start", "text_end")]])
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array(out["conv_id"], pa.int64()), "formatted": pa.array(out["formatted"], pa.string()),
                "rewrites": pa.array(out["rewrites"], pa.bool_()), "turns": pa.array(out["turns"], pa.list_(span)),
                "loss": pa.array(out["loss"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))})

    return conversations(rows).mapInArrow(work, SCHEMA)


def digests(formatted: DataFrame, template: type[MarkedTurns] = MarkedTurns) -> DataFrame:
    """What the formatted text says, read back from it: turns and learnt text."""
    import hashlib

    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3))):
                turns = template.parse(text)
                learnt = "".join(template.unescape(text[s["start"]:s["end"]]) for s in loss)
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                             len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [[]] * 6
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=list(names))

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(read, schema)
