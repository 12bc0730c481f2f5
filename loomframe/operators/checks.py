"""Checks of shape, key and order, each returning its findings as one row.

Keys are counted per value before anything moves, so heavy keys cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.joins import _pairs


def check_shape(
    df: DataFrame,
    grain: Sequence[str],
    n_rows: int | None = None,
    n_cols: int | None = None,
) -> DataFrame:
    """Rows, columns, distinct keys; whether the grain is unique and the shape as said."""
    keys = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("n"))
    found = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.max("n") == 1, F.lit(True)).alias("grain_unique"),
    )
    good = F.col("grain_unique")
    if n_rows is not None:
        good = good & (F.col("n_rows") == n_rows)
    if n_cols is not None:
        good = good & (F.col("n_cols") == n_cols)
    return found.withColumn("as_expected", good)


def _most_per_key(df: DataFrame, keys: Sequence[str]) -> Column:
    present = df.dropna(subset=list(keys))
    counts = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("m")).select("m").scalar()


def join_relation(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """1:1, 1:N, N:1 or N:N, from the most rows any key has on each side."""
    pairs = _pairs(on)
    one = left.sparkSession.range(1)
    found = one.select(
        _most_per_key(left, [l for l, _ in pairs]).alias("left_most"),
        _most_per_key(right, [r for _, r in pairs]).alias("right_most"),
    )
    side = lambda c: F.when(F.col(c) > 1, "N").otherwise("1")
    return found.withColumn(
        "relation", F.concat(side("left_most"), F.lit(":"), side("right_most"))
    )


def check_order_key(df: DataFrame, by: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Whether (group, order) identifies a row, as ordered operators need."""
    keys = [*by, *([order_by] if isinstance(order_by, str) else order_by)]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_tied_keys"),
    ).withColumn("unique", F.col("n_tied_keys") == 0)
