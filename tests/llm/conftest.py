import pytest
from llm_tables import LONG, SCHEMA, documents


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    plain = "One plain line of text.\nAnd a second line here.\nThen the third one stands.\nAnd a last line."
    rows = [(1, plain, "en", "a"), (2, plain, "en", "a"), (2, plain, "en", "a"), (2, "other text", "en", None),
            (3, None, "en", "b"), (4, "", None, "b"), (5, LONG, "en", "b"), (6, " \n\t \n ", "fr", ""),
            (7, "x" * 300_000, "fr", "c"), (8, "12@@..+++ 4444 5555", "fr", "c"), (9, "\U0001F600 é K", "de", "c"),
            (None, plain, "de", "c"), (None, None, None, None)]
    return documents(spark, rows).union(spark.createDataFrame([(None,) * 16], SCHEMA))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
