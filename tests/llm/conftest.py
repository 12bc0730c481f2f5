import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Nulls, empty texts, white space only, ties, repeated rows, words beyond ASCII.
ROWS = [
    (1, "a b c", "s1"),
    (2, "a b c", "s1"),
    (2, "a b c", "s1"),
    (None, "a b c", None),
    (3, None, "s2"),
    (4, "", "s2"),
    (5, " \n\t ", None),
    (6, "größe élan 你好 \U0001f600 end", "s3"),
    (7, "word " * 3000, "s3"),
    (8, "Licensed under the Apache License, Version 2.0. All rights reserved.", None),
    (9, "x y z", "s1"),
]


@pytest.fixture
def docs(spark):
    """The rows above, with columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(4)
    for name in ("id", "digest", "size", "block", "n", "words", "bucket", "line", "kept", "start", "key", "label", "score"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
