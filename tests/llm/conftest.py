import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTENDED = f"{SCHEMA}, digest string, cls binary, kept boolean, id long, score double, `n` long, piece int, p double, tokens long"

LONG = "lorem ipsum dolor sit amet " * 20_000


def rows():
    """Nulls in every column, empty and blank texts, a very long text, ties and repeated rows."""
    texts = [
        (1, "the quick brown fox jumps over the lazy dog today", "en", "a"),
        (2, "the quick  brown fox jumps over\tthe lazy dog today", "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (5, " \t\n", "en", "b"), (6, "x", None, "b"),
        (7, LONG, "la", "c"), (8, "12345 67890 !!!", "en", None), (None, "text without an identifier", "en", "a"),
        (None, None, None, None), (9, "the quick brown fox jumps over the lazy dog today", "en", "a"),
        (9, "the quick brown fox jumps over the lazy dog today", "en", "a"), (10, "İstanbul ÜBER café   naïve", "tr", "d"),
        (11, "All rights reserved. Licensed under CC BY-NC 4.0. The MIT License", "en", "d"),
    ]
    return [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def odd_extended(spark):
    return spark.createDataFrame([(*r, *[None] * 9) for r in rows()], EXTENDED)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
