import pytest
from pyspark.sql import SparkSession


LONG = "word " * 3000
PROSE = "A river ran below the old mill and nobody in the village knew how deep it was in spring or who had built the wheel."
# Nulls in every column, empty and very long texts, ties, repeated rows.
ROWS = [
    (1, PROSE, "a"), (2, PROSE, "b"), (2, PROSE, "b"), (3, None, "a"), (4, "", None), (5, " \n\t ", "a"), (6, LONG, "a"),
    (7, PROSE + " Yes.", None), (None, PROSE, "a"), (None, None, None), (8, "é 日本 🙂 'tis", "a"), (9, "a", "c"),
]


def table(spark: SparkSession, rows):
    """Documents with further columns, some named like the operators' own."""
    wide = [(*r, 1, "x", [1], True, 2.0) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, source string, size int, row string, words array<int>, kept boolean, target double").repartition(3)


@pytest.fixture(scope="session")
def corner(spark):
    return table(spark, ROWS)


@pytest.fixture(scope="session")
def empty(spark):
    return table(spark, ROWS).limit(0)
