import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, schema=DOCUMENTS):
        """Rows of (doc_id, text) or whole rows."""
        return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) if schema == DOCUMENTS else r for r in rows], schema)

    return make


#: Null, empty, blank, letterless and plain texts, one of them repeated.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "12 -- 34"), (5, "the end of the story"), (5, "the end of the story"),
       (None, "the end of the story"), (None, None)]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)


@pytest.fixture(scope="session")
def clashing(spark, documents):
    """The same rows with columns whose names operators make themselves, or that differ only in case."""
    from pyspark.sql import functions as F

    frame = documents(ODD)
    for name in ("size", "shard", "slot", "rep", "key", "band", "score", "rule", "host", "ids", "spans", "node", "n", "row"):
        frame = frame.withColumn(name, F.lit("x"))
    names = [*frame.columns, "TEXT", "Doc_Id"]
    return frame.withColumns({"a1": F.lit("y"), "a2": F.lit("z")}).toDF(*names)


@pytest.fixture(scope="session")
def none(documents, spark):
    return spark.createDataFrame([], DOCUMENTS)


def table_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="session")
def rows():
    return table_of
