import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def docs(spark):
    """Build a documents table from (doc_id, text) pairs, with an extra column of a clashing name."""

    def make(*pairs, source="s"):
        rows = [(i, t, "en", source, None, 7) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label int")

    return make


@pytest.fixture(scope="session")
def rows_of():
    def collect(df) -> list[Row]:
        return df.collect()

    return collect
