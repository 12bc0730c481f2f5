"""Joins of keys that are heavy on both sides against a plain join."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomframe import operators as op
from loomframe.operators import hot

SCHEMA = "k string, g int, v int"


def tables(spark, seed=1, n=600, m=300):
    rng = random.Random(seed)

    def some(count):
        # A third of the rows have one key, some have none, some are repeated.
        made = [(rng.choice(["hot", None, f"k{rng.randrange(40)}"]), rng.choice([1, 1, 1, None]), i // 2) for i in range(count)]
        return spark.createDataFrame(made, SCHEMA)

    return some(n), some(m)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("limit", [None, 1, 7, 50])
def test_same_as_plain(spark, how, limit):
    left, right = tables(spark)
    r = right.select(F.col("k").alias("rk"), F.col("g").alias("rg"), F.col("v").alias("v_y"))
    want = left.withColumnRenamed("v", "v_x").join(r, (F.col("k") == F.col("rk")) & (F.col("g") == F.col("rg")), how).drop("rk", "rg")
    got = op.join_hot_keys(left, right, ["k", "g"], how, limit=limit)
    assert got.columns == ["k", "g", "v_x", "v_y"]
    assert rows(got) == rows(want)


def test_heavy_on_one_side_only(spark):
    left, right = tables(spark)
    others = right.where("k <> 'hot'")
    for how in ("left", "inner"):
        for a, b in ((left, others), (others, left), (left.limit(0), right), (left, right.limit(0))):
            want = a.withColumnRenamed("v", "v_x").join(b.select("k", F.col("g").alias("g_y"), F.col("v").alias("v_y")), "k", how).withColumnRenamed("g", "g_x")
            assert rows(op.join_hot_keys(a, b, "k", how, limit=9)) == rows(want.select("k", "g_x", "v_x", "g_y", "v_y"))


def test_cells_are_even(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
    right = left.where("id < 1200")
    cuts = hot.heavy_keys(left, right, "k", 100)
    assert [tuple(r) for r in cuts.collect()] == [("hot", 20, 8, True)]
    for df, side, copies in ((left, "left", 8), (right, "right", 20)):
        sizes = [r["count"] for r in hot.deal(df, ["k"], cuts, side).where("k = 'hot'").groupBy("__row", "__col").count().collect()]
        assert len(sizes) == 160 and sum(sizes) == copies * df.where("k = 'hot'").count()
        assert max(sizes) < 160


def test_keys_of_other_types_stop(spark):
    left = spark.createDataFrame([(1, 1.0)], "k int, x double")
    with pytest.raises(TypeError):
        op.join_hot_keys(left, left.withColumn("k", F.col("k").cast("long")), "k")
    with pytest.raises(TypeError):
        op.join_hot_keys(left, left, "x")
    with pytest.raises(ValueError):
        op.join_hot_keys(left, left, "k", how="full")
