import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) pairs or from texts, with extra columns whose names clash with inner ones."""

    def build(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        rows = [(i, t, "en", "host", len(t or ""), i) for i, t in rows]
        names = "doc_id long, text string, lang string, source string, n_chars long, row long"
        return spark.createDataFrame(rows, names).repartition(3)

    return build
