import math
import random

import numpy as np
import pytest

from tracekiln.llm import quality

from .data import awkward, docs, prose


def network(seed=1, hidden=5, gates=3):
    rng = np.random.default_rng(seed)
    weights = quality._start(quality.DIMS, hidden, gates, rng)
    weights["b"], weights["d"] = rng.normal(size=hidden), rng.normal(size=1)
    return quality.Network(rng.normal(0, .1, quality.DIMS), rng.uniform(.5, 2, quality.DIMS), weights, 0.3)


def naive_score(net, bag):
    """The forward pass number by number."""
    w = net.weights
    total, z = 0.0, [0.0] * len(w["c"])
    for x in bag:
        x = [(float(v) - m) / s for v, m, s in zip(x, net.mean, net.scale)]
        h = [math.tanh(sum(x[i] * w["W"][i, j] for i in range(len(x))) + w["b"][j]) for j in range(len(w["b"]))]
        gate = 0.0
        for g in range(len(w["w"])):
            v = sum(h[j] * w["V"][j, g] for j in range(len(h)))
            u = sum(h[j] * w["U"][j, g] for j in range(len(h)))
            gate += w["w"][g] * math.tanh(v) / (1 + math.exp(-u))
        e = math.exp(gate)
        total += e
        z = [a + e * b for a, b in zip(z, h)]
    logit = sum(a / total * c for a, c in zip(z, w["c"])) + w["d"][0] - net.shift
    return 1 / (1 + math.exp(-logit))


def bags_of(texts):
    found = [[] for _ in texts]
    for owner, x in quality.passages(texts):
        for k, row in zip(owner, x):
            found[k].append(row)
    return found


def naive_features(words):
    """Some of a passage's features by their definitions."""
    text = " ".join(words)
    return {0: text.count(" ") / len(text), 4: text.count("!") / len(text), quality.LOWER: sum("a" <= c <= "z" for c in text) / len(text),
            -8: len(set(words)) / len(words), -7: max(map(words.count, words)) / len(words),
            -6: sum(a == b for a, b in zip(words, words[1:])) / len(words), -5: sum(math.log(len(w)) for w in words) / len(words),
            -4: sum(len(w) > 20 for w in words) / len(words), -3: sum(w[0].isupper() for w in words) / len(words),
            -2: sum(not w[-1].isalnum() for w in words) / len(words), -1: len(words) / 64}


def test_scores_match_a_naive_forward_pass():
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 63, 64, 65, 128, 500)] + ["", None, " \n ", "ß 漢字 !!"]
    net = network()
    want = [naive_score(net, bag) for bag in bags_of(texts)]
    assert np.allclose(net.scores(texts), want, atol=1e-9)
    assert np.allclose([net.scores([t])[0] for t in texts], want, atol=1e-9)


def test_features_by_definition():
    rng = random.Random(4)
    for n in (1, 5, 64, 200):
        words = [rng.choice(["a", "b!", "Cd", "x" * 25, "longer", "10%"]) for _ in range(n)]
        bag = bags_of([" ".join(words)])[0]
        assert len(bag) == -(-n // 64)
        for k, row in enumerate(bag):
            for at, value in naive_features(words[64 * k:64 * k + 64]).items():
                assert row[at] == pytest.approx(value, abs=1e-6), at


def test_long_texts_in_parts(monkeypatch):
    """Parts change nothing: the same passages, also around very long words and blanks."""
    rng = random.Random(5)
    texts = [prose(rng, 4000), "  " * 3000 + prose(rng, 300), "x" * 9000 + " " + prose(rng, 100), prose(rng, 700) + "\n" * 9000, " " * 9000, prose(rng, 64)]
    whole = bags_of(texts)
    monkeypatch.setattr(quality, "BUFFER", 1500)
    parts = bags_of(texts)
    assert [len(b) for b in parts] == [len(b) for b in whole] == [63, 5, 2, 11, 1, 1]
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(parts, whole))


def test_gradients():
    rng = np.random.default_rng(2)
    weights = quality._start(6, 4, 3, rng)
    x, bag = rng.normal(size=(11, 6)), np.repeat([0, 1, 2, 3], [1, 5, 2, 3])
    y, cost = np.array([0, 1, 1, 0]), np.array([1.0, 2, 1, .5])
    _, grads = quality.loss_and_gradients(weights, x, bag, y, cost)
    for name, value in weights.items():
        for at in np.ndindex(value.shape):
            kept, around = value[at], []
            for d in (1e-6, -1e-6):
                value[at] = kept + d
                around.append(quality.loss_and_gradients(weights, x, bag, y, cost)[0])
            value[at] = kept
            assert grads[name][at] == pytest.approx((around[0] - around[1]) / 2e-6, abs=1e-6), name


def labelled(rng, n):
    """Good and bad documents; in a bad one some passages only are bad."""
    out = []
    for i in range(n):
        passages = [prose(rng, 64) for _ in range(rng.randint(1, 5))]
        good = rng.random() < .7
        if not good:
            passages[rng.randrange(len(passages))] = rng.choice([" ".join(w + "%%%" for w in prose(rng, 64).split()), "again " * 64, prose(rng, 64).upper()])
        out.append((i, " ".join(passages), int(good)))
    return out


def test_held_out_accuracy(spark):
    rows = labelled(random.Random(6), 500)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    net = quality.fit(df, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in quality.score_documents(df, net).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if i % 5 == 0]
    assert sum(p == y for p, y in held) / len(held) >= 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_awkward_documents_and_labels(spark):
    rows = awkward()
    df = docs(spark, rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (5, 1), (7, 1), (8, None), (None, 1), (4, 0), (9, 7)], "doc_id bigint, quality int")
    net = quality.fit(df, labels)
    got = quality.score_documents(df, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for row in rows:
        by_text.setdefault(row[1] or "", set()).update(r.score for r in got if r.doc_id == row[0] and row[0] in (1, 2))
    assert len(by_text[""]) == 1                                       # null as empty
    assert quality.score_documents(docs(spark, []), net).collect() == []
    for only in ([], [(5, 1)], [(77, 0)]):
        none = quality.fit(df, spark.createDataFrame(only, "doc_id bigint, quality int"))
        assert {r.score for r in quality.score_documents(df, none).collect()} == {0.5}


def test_documents_that_do_not_fit_are_left_out(spark):
    rows = labelled(random.Random(8), 60)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, "word " * 100_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, 1)], "doc_id bigint, quality int")
    net = quality.fit(df, labels, max_passages=400)
    assert np.abs(net.weights["c"]).sum() > 0
    with pytest.raises(ValueError):
        quality.fit(df, labels.where("doc_id = 1000"), max_passages=400)


def test_best_cut():
    assert quality.best_cut(np.array([0., 1, 5, 6]), np.array([0, 0, 1, 1])) == 3
    assert quality.best_cut(np.array([1., 1]), np.array([0, 1])) == 0
