import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracekiln.llm import common, queries, token_store
from tracekiln.llm.token_store import EliasFano, Encoder

from .data import awkward, docs


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_elias_fano_selects_every_value(lengths):
    ends = np.cumsum(lengths)
    ef = EliasFano.encode(ends)
    assert ef.select(np.arange(len(ends))).tolist() == ends.tolist()
    assert ef.select(np.array([len(ends) - 1])).tolist() == [ends[-1]]


def test_boundaries_need_little_space():
    ends = np.cumsum(np.full(100_000, 700))
    ef = EliasFano.encode(ends)
    assert (ef.low.nbytes + ef.high.nbytes + ef.ranks.nbytes) * 8 / len(ends) < 2.3 + np.log2(700)


def test_encoder_equals_the_library():
    path = queries.tokenizer_path()
    whole, ours = Tokenizer.from_file(path), Encoder(path, 2, keep=300)
    rng = random.Random(1)
    parts = [*"aAbzÉéeßÇ ñ  \n\t'’.,!?0123456789Σσς漢字ひ가İiı½²_-\x1c\x85@#$​😀ﬁǅ", "ñ", "'s", "'re ", "<|endoftext|>",
             "<|startoftext|>", " the ", "\xa0", "가"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u2").tobytes() for t in texts]
    assert ours(texts) == want
    assert ours([None, ""]) == [b"\x02\x00"] * 2


def test_round_trip_of_awkward_documents(spark):
    rows = awkward()
    df = docs(spark, rows).repartition(3)
    manifest = token_store.write_store(df, common.scratch_path(spark, "t"), queries.tokenizer_path(), 2)
    got = sorted(map(tuple, token_store.read_store(manifest, docs_per_read=2).collect()), key=lambda r: r[1])
    whole = Tokenizer.from_file(queries.tokenizer_path())
    want, start = [], 0
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())
    for r in sorted(rows, key=key):
        ids = np.array((whole.encode(r[1], add_special_tokens=False).ids if r[1] else []) + [2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_no_documents(spark):
    manifest = token_store.write_store(docs(spark, []), common.scratch_path(spark, "t"), queries.tokenizer_path(), 2)
    assert token_store.read_store(manifest).collect() == []


def test_damaged_file_is_refused(spark, tmp_path):
    p = tmp_path / "x.ids"
    p.write_bytes(b"y" * 200)
    with pytest.raises(ValueError):
        token_store.StoreFile(str(p))


def test_a_run_of_letters_is_remembered_once():
    ours = Encoder(queries.tokenizer_path(), 2, keep=3)
    first = ours(["alpha Alpha alpha,"])
    assert set(ours.known) == {"alpha", "Alpha", "alpha,"}
    # three pieces fit: nothing is encoded again
    ours._learn_runs = lambda runs: runs and pytest.fail(f"encoded again: {runs}")
    assert ours(["alpha Alpha alpha,"]) == first
