import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tracekiln.llm.chat_format import MarkedTurns, digests, format_conversations, locate

TEXT = st.lists(st.sampled_from(["\\", "#", "###", "### User: ", "</turn>", " ", "\n", "a", "é", ":", "<", "/turn>", "x", "y"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "User", "", "a:b"]), TEXT), TEXT), max_size=5))
@settings(max_examples=200, deadline=None)
def test_template_is_reversible_and_located(messages):
    got = locate(messages, MarkedTurns())
    assert MarkedTurns.parse(got["formatted"]) == messages
    assert not got["rewrites"]
    texts = [MarkedTurns.unescape(got["formatted"][t[3]:t[4]]) for t in got["turns"]]
    assert texts == [t for _, t in messages]
    assert "".join(got["formatted"][t[1]:t[2]] for t in got["turns"]) == got["formatted"]


def test_template_with_closing_part():
    render = lambda ms: "<s>" + "".join(f"[{r}]{t}[/]" for r, t in ms) + "</s>"
    got = locate([("user", "hi"), ("assistant", "</s>"), ("assistant", "")], render)
    assert not got["rewrites"]
    assert [got["formatted"][a:b] for a, b in got["loss"]] == ["</s>", ""]


def test_template_that_rewrites_history():
    def render(ms):        # keeps only the last assistant's thoughts
        last = max((i for i, (r, _) in enumerate(ms) if r == "assistant"), default=-1)
        return "".join(f"{r}: {t if i == last or r == 'user' else t.split('|')[-1]}\n" for i, (r, t) in enumerate(ms))

    got = locate([("user", "q"), ("assistant", "think|a"), ("user", "q2"), ("assistant", "t|b")], render)
    assert got["rewrites"] and got["turns"] == [] and got["loss"] == []
    assert not locate([("user", "q"), ("assistant", "think|a")], render)["rewrites"]


def test_rows(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hello", "### User: x </turn>", "", None, "a\\b"]), "x")
            for c in range(20) for t in range(rng.randint(1, 6))]
    rows += [(50, 0, None, "no role", "x"), (None, 0, "user", "no conversation", "x"), (51, None, "assistant", "z" * 300_000, "x"),
             (52, 1, "user", "tie", "x"), (52, 1, "user", "tie", "x"), (52, 1, "assistant", "tie", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in digests(format_conversations(df)).collect()}
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(convs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        turns = [t[1:] for t in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        assert got[c].formatted_chars == len(MarkedTurns()(turns))
    assert digests(format_conversations(df.limit(0))).collect() == []
