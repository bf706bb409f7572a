import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n_bytes string, words string, score string"


def rows_of(texts, source="s"):
    return [(i, t, "en", source, None if t is None else len(t), "x", "y", "z", "q") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    """Null, empty, blank, very short, very long and repeated texts, null and repeated ids, columns with clashing names."""
    r = random.Random(1)
    long = " ".join(r.choice("abcdefgh") + str(r.randrange(500)) for _ in range(60_000))
    texts = [None, "", " \n\t", "one", "ONE", "a b c", long, long, "x" * 300_000, "tie tie tie tie tie tie", "tie tie tie tie tie tie", "é✓ ÀB \x1c c d \x0b e"]
    rows = rows_of(texts)
    rows += [rows[5], rows[5], (None, "a b c", "en", None, 5, "x", "y", "z", "q"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
