import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("start", T.StringType()), T.StructField("ids", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """make_docs([(id, text), ...]): documents with further columns whose names clash with results'."""
    return lambda rows, parts=3: spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", "y") for i, t in rows], DOCS).repartition(parts)
