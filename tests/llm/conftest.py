from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """A frame of documents from (doc_id, text) pairs, with two more columns whose names operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS)
        return df.selectExpr("*", "'x' as words", "7 as component_id", "1 as shard", "'y' as w") if extra else df

    return make
