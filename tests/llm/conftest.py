import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session", autouse=True)
def by_value():
    import __spark_entry__
    __spark_entry__.queries()


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from texts (or (id, text) pairs), with all its columns."""

    def make(texts, lang="en", extra=None):
        rows = [(x if isinstance(x, tuple) else (i, x)) for i, x in enumerate(texts)]
        rows = [(i, t, lang, "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(rows, DOCS)
        for name, value in (extra or {}).items():
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit(value))
        return df

    return make


@pytest.fixture(scope="session")
def make_labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
