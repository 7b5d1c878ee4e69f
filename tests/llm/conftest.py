import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeou") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(60)
    rows = [
        (0, base, "en", "s0"), (1, base, "en", "s0"), (2, base + " tail words here", None, "s0"), (3, "", "en", "s1"), (4, None, "fr", None),
        (5, " \n\t ", "fr", "s1"), (6, prose(9000), "en", "s0"), (7, "12 34 !! 56", "de", "s2"), (8, "émile Ünsal ﬁn İstanbul 日本語 \U0001f600 ▁x", "fr", "s2"),
        (9, "one two", "en", "s2"), (9, "one two", "en", "s2"), (None, prose(20), "en", "s0"), (11, prose(40) + "\n" + base, None, None),
    ]
    rows += [(20 + i, prose(rng.randint(1, 80)), rng.choice(["en", "fr", None]), f"s{i % 3}") for i in range(30)]
    full = [(a, b, c, d, None if b is None else len(b), 0, "x", 1.5, "k") for a, b, c, d in rows]
    return spark.createDataFrame(full, DOC_SCHEMA + ", fp long, Component string, score double, key string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
