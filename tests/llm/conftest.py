import pytest
from pyspark.sql import SparkSession


@pytest.fixture
def docs(spark: SparkSession):
    """A documents table from (doc_id, text[, source]) rows, with two columns of clashing names."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None, 7, "x") for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, size long, _salt string"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
