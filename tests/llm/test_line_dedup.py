import random

import pytest

from tracekiln.llm import line_dedup

from .data import awkward, doc, docs, edited, prose


def near(a, b):
    """Whether one word inserted, deleted or replaced at most turns a into b."""
    if a == b:
        return True
    x, y = sorted((a, b), key=len)
    if len(y) - len(x) > 1:
        return False
    k = next((i for i in range(len(x)) if x[i] != y[i]), len(x))
    return x[k:] == y[k + 1:] or (len(x) == len(y) and x[k + 1:] == y[k + 1:])


def brute(rows, hashes, least=8):
    """Text of every row by comparing every line with every earlier one."""
    keys = sorted({((d is None, d or 0, hashes[t]), t) for d, t in rows if t is not None})
    places = [(key, pos, line.strip(" ")) for key, t in keys for pos, line in enumerate(t.split("\n"))]
    first = {}
    for key, pos, line in places:
        if line:
            first.setdefault(line, (key, pos))
    order = sorted(first, key=first.get)
    gone = set()
    words = {x: x.split(" ") for x in order}
    for j, b in enumerate(order):
        if len(words[b]) >= least and any(len(words[a]) >= least and near(words[a], words[b]) for a in order[:j]
                                          if abs(len(words[a]) - len(words[b])) <= 1):
            gone.add(b)
    stay = {(k, p) for k, p, line in places if not line or (line not in gone and first[line] == (k, p))}
    return [(d, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if ((d is None, d or 0, hashes[t]), p) in stay)) for d, t in rows]


def compare(spark, rows, **how):
    df = docs(spark, rows)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    got = line_dedup.dedup_lines(df, keep=("lang",), **how).collect()
    want = brute([(r[0], r[1]) for r in rows], hashes)
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
    return got


def test_random_edits_match_brute_force(spark):
    rng = random.Random(7)
    bases = [prose(rng, n) for n in [*range(5, 40, 3), 62, 63, 64, 65, 66, 100, 127, 128, 129, 200, 255, 256, 257, 500, 1025]]
    rows = []
    for i in range(250):
        lines = [edited(rng, rng.choice(bases), rng.choice([0, 1, 1, 2, 3])) for _ in range(4)] + ["", prose(rng, 3)]
        rng.shuffle(lines)
        rows.append(doc(i, "\n".join(lines)))
    got = compare(spark, rows)
    assert sum(r.n_lines - r.n_kept for r in got) > 500


def test_repetitive_words(spark):
    rng = random.Random(8)
    rows = [doc(i, "\n".join(" ".join(rng.choice(["a,", "b", "on"]) for _ in range(rng.randint(7, 14))) for _ in range(5))) for i in range(60)]
    compare(spark, rows + [doc(100, "on " * 3000 + "end\n" + "on " * 3001 + "end"), doc(101, "x, " * 2000 + "\n" + "x, " * 2001)])


@pytest.mark.parametrize("seed", range(2))
def test_many_lines_of_two_words(spark, seed):
    """A thousand lines of a vocabulary of two words: common beginning and end cover the same words."""
    rng = random.Random(100 + seed)
    rows = [doc(i, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(8, 22))) for _ in range(4))) for i in range(250)]
    rows += [doc(300, "x " * 8 + "\n" + "x " * 10), doc(301, "a b " * 4 + "\n" + "a b " * 6), doc(302, "x " * 9 + "\n" + "x " * 12)]
    compare(spark, rows)


def test_within_one_word(spark):
    pairs = [("x " * 8, "x " * 10), ("a b " * 4, "a b " * 6), ("x " * 8, "x " * 9), ("a b a", "a a"), ("a b", "b a"), ("a", "b"), ("a a", "a a")]
    df = spark.createDataFrame([(a.split(), b.split()) for a, b in pairs], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(line_dedup.within_one_word(df.a, df.b)).collect()]
    assert got == [near(a.split(), b.split()) for a, b in pairs] == [False, False, True, True, False, True, True]


def test_hot_template(spark):
    """Many lines that differ in two places: none within the bound of the earliest, some of each other."""
    rng = random.Random(9)
    rows = [doc(i, f"the number of item w{rng.randint(0, 12)} on this long page and its list is w{rng.randint(0, 12)} or more") for i in range(120)]
    compare(spark, rows)


def test_awkward_documents(spark):
    compare(spark, awkward())
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


@pytest.mark.parametrize("text, lines", [(None, 0), ("", 1), ("a\n\nb", 3)])
def test_line_counts(spark, text, lines):
    row = line_dedup.dedup_lines(docs(spark, [doc(1, text)])).first()
    assert (row.n_lines, row.n_kept, row.text) == (lines, lines, text)


def test_no_python_in_the_plan(spark):
    plan = line_dedup.dedup_lines(docs(spark, [doc(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
