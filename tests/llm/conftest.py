import tempfile

import pytest


@pytest.fixture
def table(spark):
    """Rows stored as parquet in a few files and read back."""

    def store(rows, schema, files=3):
        path = tempfile.mkdtemp(prefix="spark-test-") + "/t"
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return store


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(table):
    """Documents of (id, text) or (id, text, lang)."""

    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return table(full, DOCS)

    return make
