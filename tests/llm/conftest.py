import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """(doc_id, text) pairs -> a documents table, with extra columns whose names the operators use inside."""

    def make(rows, **more):
        full = [(i, t, more.get("lang", "en"), more.get("source", "s"), None if t is None else len(t), 1, "x", "h") for i, t in rows]
        return spark.createDataFrame(full, DOC + ", id long, key string, hash string")

    return make
