import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, c long, n_words string, place int"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join("w" + str(r.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty and very long texts, near and exact copies, repeated rows, and columns with names that operators use."""
    base = words(120, 1)
    near = base.replace("w7 ", "x7 ", 1) + " tail"
    texts = [None, "", " \n\t", "one two", "One  TWO", base, base, near, words(30_000, 2), "é" * 3000, "password=abcdef123456 and a@b.co " + words(40, 3), ". . . !", "x" * 50_000]
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, None if t is None else len(t), "clash", i, "clash", i) for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
