import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])

LONG = "alpha beta gamma delta " * 40_000


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, over several tasks."""
    def make(*rows, schema=DOC):
        full = [tuple(r) + (None,) * (len(schema) - len(r)) for r in rows]
        return spark.createDataFrame(full, schema).repartition(3)
    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, clashing columns."""
    rows = [(1, None), (2, ""), (3, " \n\t\n "), (4, LONG), (5, "one two three"), (5, "one two three"), (None, "no id here"),
            (None, None), (6, "ÄÖÜ ß 123 ¿que? 中文字符"), (7, "!!! ??? ..."), (8, "a b c\u0085d e")]
    docs = frame(*rows)
    return docs.selectExpr("*", "text AS _th", "1 AS salt", "'x' AS fp", "2 AS n_lines", "'y' AS lang_pred", "3 AS component",
                           "'z' AS _gone", "4 AS kept", "'s' AS slot", "5 AS sequence_id", "6 AS row", "'l' AS license")


@pytest.fixture(scope="session")
def empty(frame, spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def sample(spark):
    """All documents of the smallest table, as (doc_id, text)."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
