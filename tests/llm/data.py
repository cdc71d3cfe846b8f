"""Small documents with every awkward case; tables written as Parquet."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[k] = "changed" + str(rng.randint(0, 9999))
        elif kind == 1:
            words.insert(k, "added" + str(rng.randint(0, 9999)))
        elif len(words) > 1:
            del words[k]
    return " ".join(words)


DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, cluster string, key int, pos int, filter string"


def doc(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1.0, "c", 1, 2, "f")


def awkward():
    """Null ids, texts, languages and sources; empty and blank texts; repeated rows; ties; a very long text."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    return [doc(None, "a text without an id of some words"), doc(1, None), doc(2, ""), doc(3, " \n\t "), doc(4, "one"),
            doc(5, "same text here again and again"), doc(5, "same text here again and again"),
            doc(6, "same text here again and again", None, None), doc(7, long, "xx"), doc(8, long), doc(9, "né ß Ωmega 漢字 😀 İ"),
            doc(5, "another text under a used id"), doc(None, None, None, None)]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA)
