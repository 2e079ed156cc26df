import random

import pytest

#: Texts with the cases that every operator must stand: null, empty, blank, short, repeated, long, odd signs.
WORDS = ["the", "of", "Ünder", "río", "naïve", "can't", "x1", "—", "end.", "ß"]


@pytest.fixture(scope="session")
def odd_texts():
    r = random.Random(5)
    texts = [
        None, "", " \t\n", "a", "one two three", "one two three", "日本語 テキスト 😀", "<|endoftext|> in a text", "x" * 3000,
        "  spaces   and\ttabs\r\n", "a " * 400,
    ]
    texts += [" ".join(r.choice(WORDS) for _ in range(r.choice([3, 15, 60]))) for _ in range(30)]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """doc_id (one repeated, one null), text, lang, source, and columns whose names clash with what operators use."""
    rows = [(i if i != 12 else 11, t, ["en", "fr", None][i % 3], ["b", None, "a"][i % 3], len(t or ""), "k", i) for i, t in enumerate(odd_texts)]
    rows.append((None, "no id here", "en", "a", 10, "k", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
