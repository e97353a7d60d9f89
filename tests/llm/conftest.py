import pytest


@pytest.fixture
def documents(spark):
    """Rows of a documents table; texts may be null."""

    def make(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string" + extra)

    return make
