from __future__ import annotations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, a long text, unusual characters."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
    line = "one line that all of these texts share, word for word"
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n\x0b\r ", "en", "a", 6),
        (4, "one two", "en", "a", 7),
        (4, "one two", "en", "a", 7),
        (5, "One TWO", "en", "b", 7),
        (6, long, "en", "b", len(long)),
        (7, long + " tail", "de", None, len(long) + 5),
        (None, "no number\nhas this one " + line, None, "c", 20),
        (8, "éÉß 漢字 \U0001f600 x\x00y\x85z İ", "fr", "c", 20),
    ]
    return rows + [(10 + i, f"{line}\nown text {i} of this document only\n{line}", "en", "d", 90) for i in range(12)]


@pytest.fixture(scope="session")
def edge(spark: SparkSession, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark: SparkSession):
    return spark.createDataFrame([], DOCS)
