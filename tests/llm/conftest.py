import pytest
from brute import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string"


def messy_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and columns named like the operators' own."""
    long = words(9000, 1, 5000)
    base = words(200, 2)
    near = base.replace("w7 ", "x7 ", 1)
    passage = words(70, 3)
    texts = [
        (1, "", "s1"), (2, None, "s1"), (3, "   \n\t ", None), (4, base, "s0"), (5, base.upper(), "s0"), (6, base, "s0"), (7, near, "s0"),
        (8, base.replace(" ", "  \n"), "s1"), (9, long, "s0"), (10, long + " end", "s0"), (11, "one two", "s2"), (12, "one two", "s2"), (12, "one two", "s2"), (13, "ONE\ttwo", None),
        (14, words(80, 4) + " " + passage, "s0"), (15, passage + " " + words(60, 5), "s1"), (16, words(30, 6) + " " + passage + " " + words(30, 7), None),
        (17, "Licensed under CC BY 4.0. All rights reserved. GNU General Public License", "s2"), (18, "naïve café — „Ünïcode“ 日本語 \U0001f600 don't 123456 you idiot!!!", "s2"),
        (None, base, "s0"), (None, None, None), (19, "a" * 5000, "s3"), (20, "x y z\x1f w\x85v", None), (21, words(49, 8), "s1"), (22, words(50, 9), "s1"), (23, words(50, 9), "s1"),
        (24, "the the the " * 60, "s0"), (25, "the the the " * 61, "s0"),
    ]
    return [(i, t, None if i and i % 3 == 0 else "en", s, None if t is None else len(t), "size", None, "x") for i, t, s in texts]


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def messy(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
