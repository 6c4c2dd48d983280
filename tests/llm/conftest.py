import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as a documents table with extra columns whose names clash with the operators' own."""

    def make(rows, source=None):
        full = [(i, t, "en", (source or {}).get(i, "s"), None, "x", 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string, kept int")

    return make

