import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes ``documents`` of texts, with other columns, one of them with a name that operators use too."""

    def make(texts, start=0, source="s"):
        rows = [(start + i, t, "en", source, len(t or ""), "own") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")

    return make
