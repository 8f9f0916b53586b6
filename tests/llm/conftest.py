import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a DataFrame in several partitions from rows and a schema."""

    def make(rows, schema="doc_id long, text string", parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
