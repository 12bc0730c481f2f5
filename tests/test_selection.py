"""Quantiles by selection against Spark's exact percentile."""

import math

import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from loomframe import operators as op
from loomframe.operators.selection import values_near

PROBS = [0.0, 0.1, 0.5, 0.999, 1.0]


@pytest.fixture
def data(spark):
    """A hot group of half the rows, heavy values, huge and tiny magnitudes, missing keys and values."""
    h = F.abs(F.xxhash64("id"))
    key = F.when(h % 2 == 0, F.lit("hot")).when(h % 11 != 0, F.concat(F.lit("g"), (h % 60).cast("string")))
    wide = F.pow(F.lit(10.0), (h % 600 - 300).cast("double")) * F.when(h % 3 == 0, -1).otherwise(1) * (1 + h % 97)
    x = F.when(h % 7 == 0, F.lit(None).cast("double")).when(h % 5 == 0, 2.5).otherwise(wide)
    return spark.range(30000).select("id", key.alias("g"), x.alias("x"))


@pytest.mark.parametrize("accuracy", [20, 300, 10_000])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_as_percentile(data, by, accuracy, layout):
    if layout == "blocks" and accuracy != 300:
        pytest.skip("one accuracy in blocks")
    limit = 50 if layout == "blocks" else None
    want = op.reframe_quantiles(data, "x", PROBS, by, limit=op.WHOLE_GROUPS)
    got = op.select_quantiles(data, "x", PROBS, by, accuracy=accuracy, limit=limit)
    assert got.columns == want.columns
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and a
    for p, q in zip(a, b, strict=True):
        assert p[:-1] == q[:-1] and math.isclose(p[-1], q[-1], rel_tol=1e-9)


def test_only_values_near_are_ranked(spark):
    n, probs = 40_000, [0.25, 0.5, 0.9]
    many = spark.range(n).select((F.xxhash64("id") % 10**9).cast("double").alias("__x"))
    near = values_near(many, [], probs, 1000)
    assert {r["__i"] for r in near.select("__i").distinct().collect()} == {0, 1, 2}
    assert near.count() < n * len(probs) * 10 / 1000


def test_a_value_that_most_rows_share(frame):
    df = frame([(1.0,)] * 900 + [(float(i),) for i in range(100)], "x double")
    got = op.select_quantiles(df, "x", [0.3, 0.5, 0.9], accuracy=50)
    same(got, rows(op.reframe_quantiles(df, "x", [0.3, 0.5, 0.9])))


def test_small_empty_and_missing(frame):
    df = frame([("A", 1), ("A", 2), ("B", 3), ("B", None), ("C", None), (None, 7)], "g string, x int")
    want = [("A", 0.25, 1.25), ("A", 0.75, 1.75), ("B", 0.25, 3.0), ("B", 0.75, 3.0), (None, 0.25, 7.0), (None, 0.75, 7.0)]
    same(op.select_quantiles(df, "x", [0.25, 0.75], ["g"]), want)
    same(op.select_quantiles(df.where("false"), "x", [0.5], ["g"]), [])
    same(op.select_quantiles(df.where("false"), "x", [0.5]), [])
