import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of given texts, numbered from 0, in the columns of the table."""

    def make(*texts, first=0):
        rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
