import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, size long"


def words(draw: random.Random, n: int) -> str:
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6))) for _ in range(n))


def near(draw: random.Random, text: str, edits: int) -> str:
    parts = text.split(" ")
    for _ in range(edits):
        parts[draw.randrange(len(parts))] = words(draw, 1)
    return " ".join(parts)


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, source): nulls, empty and very long texts, ties, repeated rows, exact and near copies."""
    draw = random.Random(3)
    rows = [(0, None, None), (1, "", "s1"), (2, " \n\t ", "s0"), (3, "One", "s2"), (4, "one", None), (5, "two words", "s1"), (6, words(draw, 20000), "s0")]
    for i in range(12):
        text = words(draw, draw.choice([6, 15, 40, 150, 400]))
        rows += [(10 + 10 * i + j, near(draw, text, e).upper() if j == 3 else near(draw, text, e), draw.choice(["s0", "s0", "s1", "s2", None])) for j, e in enumerate((0, 0, 1, 0, 3, 8))]
    base = words(draw, 120)
    rows += [(200 + i, near(draw, base, draw.randint(0, 4)), "s0") for i in range(40)]
    rows.append(rows[9])
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 0.5, 1) for i, t, s in corpus], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
