import random

import pytest

import tessera.llm  # noqa: F401  (the subpackage must import)

BASE = "".join(random.Random(7).choice("abcdefgh ") for _ in range(900))


def passage(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


def documents():
    """Nulls, empty and blank texts, ties, repeated rows, copies, shared passages and a long text."""
    shared = passage(80, 1)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "Short."), (4, BASE), (5, BASE), (6, BASE), (6, BASE), (None, BASE), (7, "a" * 350), (8, "xyz " * 90)]
    rows += [(10 + i, f"{passage(20 + i, 100 + i)} {shared[i * 3 :]} {passage(9, 200 + i)}") for i in range(12)]
    near = passage(120, 2).split()
    for i in range(9):
        words = list(near)
        words[i * 11] = f"changed{i}"
        rows.append((40 + i, " ".join(words)))
    rows += [(60, "\n".join([passage(15, 3), passage(14, 4), "Of."])), (61, "\n".join([passage(15, 3)[:-1] + "#", "Of.", passage(14, 5), "", ""]))]
    rows += [(70, passage(3000, 6)), (71, "日本語 テキスト é" * 30), (72, "one two three")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns whose names the operators use inside."""
    full = [(i, t, "en", n, 1.0, 5) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, first int, score double, shard int").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
