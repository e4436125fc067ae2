import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, label int, score string, copy int, kept string, words int"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or longer tuples, with columns whose names operators use themselves."""

    def build(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *[None] * (4 - len(r)))
            full.append((doc_id, text, lang, source, None if text is None else len(text), "r", 7, "s", 3, "k", 1))
        return spark.createDataFrame(full, COLUMNS)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    rng = random.Random(3)
    long = sentence(rng, 8_000)
    same = sentence(rng, 80)
    return [
        (1, None, None, None),
        (None, "only text", "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", "en", None),
        (4, long, "en", "a"),
        (5, same, "de", "b"),
        (6, same, "de", "b"),
        (6, same, "de", "b"),
        (None, None, None, None),
        (7, "x" * 50_000, "fr", "b"),
        (8, "5" * 20_000 + " é à 漢字 \U0001f600", None, "c"),
    ]


@pytest.fixture(scope="session")
def odd(make, odd_rows):
    return make(odd_rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
