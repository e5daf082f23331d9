import random

import pytest

#: Names that the operators use inside, as columns of the input.
CLASHES = ("sig", "gram", "key", "lo0", "hi0", "id0", "_row", "copies", "bucket", "_s", "_q", "k", "counts", "keeper", "row")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(4000)]


@pytest.fixture
def prose(words):
    rng = random.Random(11)
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture
def documents(spark):
    """A documents table with columns whose names clash with the operators' own."""

    def make(rows, clashes=True):
        data = [(i, t, lang, src, n) + ((("x",) * len(CLASHES)) if clashes else ()) for i, t, lang, src, n in rows]
        extra = "".join(f", `{c}` string" for c in CLASHES) if clashes else ""
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long{extra}")

    return make


@pytest.fixture
def odd(documents, prose):
    """Nulls everywhere, empty and very long texts, ties and repeated rows."""
    same = prose(80)
    long = prose(400_000)  # more than one slice of text
    rows = [
        (1, same, "en", "a", len(same)),
        (1, same, "en", "a", len(same)),
        (2, same, "de", None, None),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "fr", "b", 4),
        (None, same, "en", "a", 10),
        (6, "word", "en", "b", 4),
        (7, long, "en", "b", len(long)),
        (8, "start " + long, "de", "c", len(long) + 6),
        (9, "!!! ??? 123", None, "c", 11),
    ]
    return documents(rows)


@pytest.fixture
def nothing(documents):
    return documents([])
