import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents with every odd case: nulls, empty and long texts, repeats, extra columns with clashing names."""

    def make(rows):
        kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("id", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("t", T.IntegerType()), T.StructField("fp", T.StringType())])
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "x", 1, 2, None) for i, t in rows], kind)

    return make


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "no id"), (5, "word " * 6000), (6, "x" * 5000), (7, "émigré ÀÉ ſK 日本語   ½ x@y.zz"), (8, "<|endoftext|> and <s> ▁▁ it's")]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)


@pytest.fixture(scope="session")
def empty(docs):
    return docs([])
