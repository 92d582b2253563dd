"""Small corpora for the operators' tests."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def corpus(spark):
    return lambda texts, langs=None: make(spark, texts, langs)


@pytest.fixture(scope="session")
def prose():
    """Texts of made-up words, with near copies and a shared passage."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice(["ta", "ri", "mo", "sel", "ku", "an"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    out = [text(rng.randrange(5, 150)) for _ in range(30)]
    for i in range(6):
        words = out[i].split()
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
        out.append(f"{text(20)} {passage} {text(10 + i)}")
    return [*out, out[3], out[3]]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    long_text = "alpha beta gamma\n" * 4000
    texts = [None, "", " \t\r\n", "one", "one", "a\x00b ▁ ퟿", long_text, "Ünïcode ÀÉ straße — « x »", "\n\n\n", "word " * 40, "ONE", "x  y   z "]
    names = ["row_key", "text_key", "h", "n", "bin", "shard", "got", "kept", "score", "node", "bands", "spans", "found", "copies", "target_id", "w"]
    rows = [(i if i != 3 else None, t, None if i % 3 else "en", None, None, *[i] * len(names)) for i, t in enumerate(texts)]
    rows += rows[3:5]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in names))
