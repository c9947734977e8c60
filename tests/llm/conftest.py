import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with results."""
    rows = [
        (1, None, "n", 1.0),
        (2, "", "n", 2.0),
        (3, " \t\n", None, 3.0),
        (None, "a text without an id that is long enough to have shingles", "x", 4.0),
        (5, "same words in two rows of one id and more words", "x", 5.0),
        (5, "same words in two rows of one id and more words", "x", 5.0),
        (6, "same words in two rows of one id and more words", "x", 6.0),
        (7, "é" * 700, "x", 7.0),
        (8, "word " * 60_000, "x", 8.0),
        (9, "one", "x", 9.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double").withColumnsRenamed({}).selectExpr(
        "doc_id", "text", "source", "score", "'c' as comp", "0 as n_words", "0 as spans", "1 as rank", "2 as n_shingles", "cast(1 as long) as n_chars", "'xx' as lang", "0 as k"
    )


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
