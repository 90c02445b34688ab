import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string"


def rows_of(texts, start=0):
    return [(start + i, t, "en", None if i % 7 == 3 else f"src{i % 3}", len(t or ""), None, "x") for i, t in enumerate(texts)]


def corpus(n=160, seed=1):
    """Texts with exact and near copies, nulls, empty ones, repeated lines and one very long one."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = []
    for i in range(n):
        kind = i % 10
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 140))]
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
        elif kind == 2 and i > 3:
            base = (texts[i - 2] or "some words here").split() or ["x"]
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
        elif kind == 3:
            texts.append(None if i % 20 == 3 else "  \n\t")
        elif kind == 4:
            texts.append((texts[0] or "a b c").upper())
        elif kind == 5:
            texts.append("\n".join(["the same line again"] * rng.randint(2, 9)) + " é ß 漢字")
        else:
            texts.append(" ".join(words))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(9000)))
    return texts


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows_of(corpus()), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows and repeated ids."""
    rows = rows_of(["one two three four five six"] * 3 + ["", None, "lone"])
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, "one two three four five six", None, None, None, None, None), (None, "by itself", None, None, None, None, None), (5, "other text", None, None, None, None, None)], SCHEMA)
