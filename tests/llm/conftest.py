import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty, repeated and long texts, and a column of a clashing name."""
    rows = [(5, "The cat's  hat\n\nisn't it? 12,345 ßtraße 漢字 😀", "a"), (1, "", "b"), (2, None, None), (3, "x" * 50_000, "c"), (None, "no id here", "d"), (7, "same text", "e"), (7, "same text", "f"), (9, " \t\n ", "g"), (8, "don't we'll they've 'tis ''s it's", "h")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
