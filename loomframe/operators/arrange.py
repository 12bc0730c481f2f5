"""Sorting a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.plans.blocks import parse_order, sort_columns


def arrange(df: DataFrame, order_by) -> DataFrame:
    """Rows in order, a leading minus meaning descending, missing values always last.

    Rows with equal keys are ordered by a hash of the row, so that a value shared by
    much of the table is sorted by several tasks.
    """
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.orderBy(*sort_columns(parse_order(order_by)), F.xxhash64(*hashed))
