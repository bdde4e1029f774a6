import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    long = "word%d " * 3000 % tuple(range(3000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "en", None, len(long)), (5, "same text here again", "de", "b", 20),
        (5, "same text here again", "de", "b", 20), (5, "another text for this id", "de", "b", 24), (None, "no id at all", None, "c", 12), (7, "x" * 100_000, "en", "a", 100_000), (8, "é😀 ﬁ z", "fr", "a", 7),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
