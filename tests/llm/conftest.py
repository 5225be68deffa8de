import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
EXTRA = ", rep long, key string, block long, size long, copies long, words string, part long, m int, n_shingles long"


def prose(rng, n, vocabulary=400):
    return " ".join("the" if i % 9 == 0 else f"w{rng.randrange(vocabulary)}" for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    base = prose(rng, 120)
    long = prose(rng, 30_000, 5_000)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base + " tail", None, None, None),
        (4, None, "en", "b", None), (5, "", "de", "b", 0), (6, " \n\t ", "de", None, 3), (7, "one", "fr", "c", 3),
        (8, "one two", "fr", "c", 7), (None, prose(rng, 60), "en", "c", 5), (9, long, "en", "d", 9), (10, long[:100_000], "en", "d", 9),
        (11, "é" * 40 + " " + "ß" * 40, "de", "d", 81), (12, "123 456 !!!", "en", "é", 11), (13, "\x00\x1c\x85  x", "en", "é", 5),
        (-5, prose(rng, 80), "es", "a", 9),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4, "w", 5, 6, 7) for r in edge_rows], DOCS + EXTRA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS + EXTRA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return sorted(((r["doc_id"], r["text"], r["source"], r["lang"]) for r in small.collect()), key=lambda r: r[0])
