import pytest


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text) or (doc_id, text, lang, source) tuples."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make
