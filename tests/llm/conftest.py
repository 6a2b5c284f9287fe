import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, item long, `n` long, bands string, id long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents with further columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, lang, "s", None if t is None else len(t), 1, 2, "x", 3) for i, t, lang in ((*r, "en")[:3] if len(r) < 3 else r for r in rows)]
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}
