import pytest


@pytest.fixture
def documents(spark):
    """Make a documents table of (doc_id, text) pairs, with the other columns and one that clashes with results."""

    def make(rows):
        rows = [(i, t, "en", "src0", len(t or "")) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
