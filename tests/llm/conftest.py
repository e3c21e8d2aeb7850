import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string, row string, text_ string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, source]) as a table with extra columns whose names clash with internal ones."""
    def make(rows):
        out = []
        for r in rows:
            i, t, source = (*r, "host")[:3]
            out.append((i, t, "en", source, len(t) if t is not None else None, "x", "k", "r", "t"))
        return spark.createDataFrame(out, DDL)
    return make


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows, near copies."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = list(base)
    near[60] = "changed"
    far = words(rng, 120)
    long_ = " ".join(words(rng, 30000, 5000)) + "\n" + "z" * 40000
    return [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, ""), (6, " \n\t "),
            (7, "one two"), (8, "One TWO"), (9, long_), (10, " ".join(base).upper()), (10, " ".join(base).upper()),
            (None, "a text without id " * 20), (12, "línea única ñ é 中文 \U0001f600 " * 30), (13, "x")]
