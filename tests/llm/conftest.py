import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Make a documents table: rows of (doc_id, text, lang)."""
    def make(rows, parts=3):
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(parts)
    return make


@pytest.fixture(scope="session")
def odd(table):
    """Nulls, empty and blank texts, one long text, repeated rows, one id with two texts."""
    long = " ".join(f"word{i % 977} of the line{i % 13}." + ("\n" if i % 40 == 0 else "") for i in range(30_000))
    return table([(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, long, "en"), (5, "The same row twice, with words.", "en"), (5, "The same row twice, with words.", "en"),
                  (6, "one text", "fr"), (6, "another text", "fr"), (None, "Text without an id.", "de"), (7, "12345 --- !!!", "en"), (8, "É" * 300, "fr")])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")
