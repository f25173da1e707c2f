import sys, os
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns whose names clash with columns that operators add
    T.StructField("key", T.StringType()), T.StructField("size", T.LongType()), T.StructField("class", T.StringType()),
])


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text) or (doc_id, text, source), with further, clashing columns."""
    def make(rows, partitions=3):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "src0", None, "k", 7, "c") for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)

    return make


@pytest.fixture
def small_batches(spark):
    """Arrow batches of a few rows, so that groups run across batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)
