"""Small documents with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 16) % len(WORDS)] + ("" if (x >> 8) % 3 else str((x >> 10) % 10)))
    return " ".join(out)


BASE = prose(1, 120)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("alpha", "ALPHA"), "en", "b"), (4, " ".join(BASE.split()[:110]), "en", "b"),
    (5, prose(5, 200), "en", "c"), (6, "", "en", "c"), (7, None, None, None), (8, " \t\n ", "de", None), (9, "one two", "en", "a"),
    (10, "ONE  two", "en", "b"), (11, prose(11, 30_000), "fr", "a"), (12, prose(12, 80), "en", ""), (12, prose(12, 80), "en", ""),
    (None, prose(13, 90), "en", "a"), (14, "héllo wörld 😀 " * 40, "fr", "b"), (-3, prose(14, 60), "es", "c"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, i, "x", 1.5) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, size int, block string, score double"
    ).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("1 = 0")
