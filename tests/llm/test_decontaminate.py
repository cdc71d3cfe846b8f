import random
import re

import pytest

from tracekiln.llm import decontaminate

from .data import awkward, doc, docs, edited, prose


def shingle_set(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(n, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(doc_rows, items):
    out = []
    for d, text in doc_rows:
        for item, q in set(items):
            want = shingle_set(q)
            if not want:
                continue
            g = len(next(iter(want)))
            have = shingle_set(text, g) if len(re.findall(r"\w+", (text or "").lower())) >= g else set()
            shared = len(want & have)
            if 5 * shared >= 4 * len(want):
                out.append((d, item, shared, len(want)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_matches_brute_force(spark, block_bytes):
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 12, 20, 33, 40, 64, 100])]
    items += [(50, None), (51, ""), (52, "..."), (53, items[7][1]), (None, items[8][1]), items[6]]
    rows = [r[:2] for r in awkward()]
    for i in range(150):
        _, q = rng.choice(items[:12])
        rows.append((100 + i, prose(rng, rng.randint(0, 60)) + " " + edited(rng, q, rng.randint(0, 3)) + "! " + prose(rng, rng.randint(0, 400))))
    rows.append((999, prose(rng, 30_000) + ", " + items[9][1].upper().replace(" ", " - ") + "\n" + prose(rng, 10)))
    df = docs(spark, [doc(d, t) for d, t in rows])
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    got = decontaminate.find_contaminated(df, bench, block_bytes=block_bytes).collect()
    want = brute(rows, items)
    assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got), key=repr) == want
    assert any(w[0] == 999 and w[1] == 9 for w in want)
    kept = decontaminate.drop_contaminated(df, bench, block_bytes=block_bytes)
    bad = {repr((d, t)) for d, t in rows for w in brute([(d, t)], items)[:1]}
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(repr(r) for r in rows if repr(r) not in bad)
    assert kept.columns == df.columns


def test_empty_tables(spark):
    df, none = docs(spark, awkward()), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_contaminated(df, none).collect() == []
    assert decontaminate.drop_contaminated(df, none).count() == len(awkward())
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert decontaminate.find_contaminated(docs(spark, []), bench).collect() == []


def test_sketch_cannot_miss():
    """Every item with the least containment holds one of the sketched shingles."""
    rng = random.Random(12)
    for n in range(5, 90):
        text = prose(rng, n)
        index = decontaminate.ItemIndex([(1, text)], 0.8)
        g, _, table = index.by_gram[0]
        assert len(table) > len(index.sets[0]) - index.need[0]
