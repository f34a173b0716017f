import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, label int"


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), 0.0, "k", 1)


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(5)
    return ["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(3, 8))) for _ in range(600)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls in every column, empty, wordless and very long texts, repeated rows and ids, clashing extra columns."""
    rnd = random.Random(6)
    prose = " ".join(rnd.choice(words) for _ in range(60))
    return [row(1, prose), row(1, prose), row(2, prose), row(3, None), row(4, ""), row(5, "### !!"), row(None, prose + " tail"),
            (6, "alpha beta", None, None, None, None, None, None), row(7, "x" * 50_000), row(8, "y z " * 60_000),
            row(9, "Ünï çödé 文字 🙂 \u0000 end"), row(10, "one"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
