import random

import numpy as np

from tracekiln.llm import shingles, toxicity

from .data import awkward, docs, prose

BAD = {"en": ["vileword", "nastyterm", "badphrase here"], "fr": ["motmechant", "grossier"]}


def corpus(n=900, seed=13):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = "fr" if i % 3 == 0 else "en"
        text, y = prose(rng, rng.randint(5, 120)), int(rng.random() < 0.2)
        if y:
            words = text.split()
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD[lang]))
            text = " ".join(words)
        rows.append((i, text, lang, "s", len(text), 1.0, "c", 1, 2, "f"))
        labels.append((i, 1, y))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_rejection(spark):
    rows, labels = corpus()
    df = docs(spark, rows)
    net = toxicity.fit(df, labelled(spark, [x for x in labels if x[0] % 5] + [(1, 0, None), (None, 0, 1), (10**9, 1, 1)]))
    from pyspark.sql import functions as F
    got = {r.doc_id: r.s for r in df.select("doc_id", toxicity.score_column(df, net, F.col("text")).alias("s")).collect()}
    held = [(got[i], y) for i, _, y in labels if i % 5 == 0]
    hit = sum(s >= 0.5 for s, y in held if y)
    assert hit >= 0.9 * sum(y for _, y in held)
    assert sum(s >= 0.5 for s, y in held if not y) <= 0.05 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    kept = {r.doc_id for r in toxicity.reject_toxic(df, net).collect()}
    y = {i: y for i, _, y in labels}
    assert sum(y[i] for i in kept) < 0.1 * sum(y.values()) and len(kept) > 0.75 * len(rows)
    assert set(net.thresholds) == {"en", "fr"}


def test_awkward_texts_have_scores(spark):
    from pyspark.sql import functions as F
    rows, labels = corpus(200)
    df = docs(spark, rows)
    net = toxicity.fit(df, labelled(spark, labels))
    odd = docs(spark, awkward())
    got = odd.select("doc_id", "text", toxicity.score_column(odd, net, F.col("text")).alias("s")).collect()
    assert len(got) == len(awkward()) and all(0 <= r.s <= 1 for r in got)
    empty = {r.s for r in got if not r.text or not r.text.strip()}
    assert len(empty) == 1
    assert toxicity.reject_toxic(odd, net).columns == odd.columns
    assert toxicity.reject_toxic(docs(spark, []), net).collect() == []


def test_without_labels(spark):
    df = docs(spark, corpus(40)[0])
    for labels in ([], [(i, 1, 0) for i in range(40)]):
        net = toxicity.fit(df, labelled(spark, labels))
        assert toxicity.reject_toxic(df, net).count() == 40


def test_long_texts_pool_over_all_segments():
    rows, labels = corpus(300)
    words = [toxicity.buckets(w, toxicity.ROWS) for _, part in shingles.words_of([r[1] for r in rows]) for w in part]
    net = toxicity.train(words, np.array([y for _, _, y in labels]), epochs=2)
    rng = random.Random(14)
    long = prose(rng, 3000) + " vileword nastyterm " + prose(rng, 500)
    whole = net.scores([long, "x"])
    old, toxicity.SEGMENT = toxicity.SEGMENT, 100
    try:
        assert np.allclose(net.scores([long, "x"]), whole)
    finally:
        toxicity.SEGMENT = old


def test_words_across_parts_of_a_long_text():
    rng = random.Random(15)
    text = prose(rng, 2000) + " é漢 " + prose(rng, 2000)
    whole = next(shingles.words_of([text]))[1][0]
    old, shingles.BUFFER = shingles.BUFFER, 1000
    try:
        assert (next(shingles.words_of([text]))[1][0] == whole).all()
    finally:
        shingles.BUFFER = old
    assert len(whole) == len(shingles.word_list(text))


def test_long_document_takes_no_other_from_the_sample(spark):
    rows, labels = corpus(400)
    df = docs(spark, rows)
    whole = toxicity.fit(df, labelled(spark, labels))
    first = min(range(400), key=lambda i: (i * 2654435761) & 0xFFFFFFFF)
    cut = toxicity.fit(df, labelled(spark, labels), max_words=len(rows[first][1].split()) - 1)
    assert (cut.embed == whole.embed).all() and cut.offset == whole.offset and cut.thresholds == whole.thresholds
    assert toxicity.reject_toxic(df, cut).count() < 350


def test_repeated_rows_are_sampled_once(spark):
    rows, labels = corpus(300)
    whole = toxicity.fit(docs(spark, rows), labelled(spark, labels))
    again = toxicity.fit(docs(spark, rows + rows[:1] * 500), labelled(spark, labels))
    assert (again.embed == whole.embed).all() and again.thresholds == whole.thresholds
    many = [(rows[0][0], f"text {i}", *rows[0][2:]) for i in range(500)]
    net = toxicity.fit(docs(spark, rows + many), labelled(spark, labels), max_rows=300)
    assert len(net.embed) == toxicity.ROWS                  # one id with many texts leaves the others in the sample


def test_peaks_of_long_texts():
    rows, labels = corpus(60)
    words = [toxicity.buckets(w, toxicity.ROWS) for _, part in shingles.words_of([r[1] for r in rows]) for w in part]
    y = np.array([y for _, _, y in labels])
    whole = toxicity.train(words, y, epochs=2)
    old, toxicity.SEGMENT = toxicity.SEGMENT, 10
    try:
        assert np.allclose(toxicity.train(words, y, epochs=2).embed, whole.embed, atol=1e-4)
    finally:
        toxicity.SEGMENT = old
