import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a table of documents with columns that clash with names the operators use."""

    def make(rows, parts=3):
        full = [(i, t, "en", f"s{k % 2}", len(t or ""), k, "x", "y", 1.5, None) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(
            full, DOCS + ", u long, id string, digest string, rate double, fingerprint string").repartition(parts)

    return make
