"""Size checks that decide between physical strategies.

Two session settings steer them:

``loomframe.broadcastBytes``  a table is broadcast only if it measures below this
``loomframe.rowsPerBlock``    a group above this many rows is worked on in blocks
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_BLOCK = 4_000_000
_ROWS_SEEN = 128


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get("loomframe.broadcastBytes", str(BROADCAST_BYTES)))


def rows_per_block(spark: SparkSession, given: int | None = None) -> int:
    if given is not None:
        return int(given)
    return int(spark.conf.get("loomframe.rowsPerBlock", str(ROWS_PER_BLOCK)))


def row_bytes(schema: T.StructType) -> Column:
    """In-memory size of a row, variable-length columns measured, others 16 bytes."""
    fixed, total = 0, None
    for f in schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.coalesce(F.octet_length(f.name), F.lit(0)) + 24
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) * 2 + 48
        else:
            fixed += 16
            continue
        total = size if total is None else total + size
    base = F.lit(fixed + 16)
    return base if total is None else total + base


def table_fits(df: DataFrame) -> bool:
    """Measure the whole table and tell whether it may be broadcast."""
    size = df.agg(F.sum(row_bytes(df.schema).cast("long")).alias("b")).first()["b"]
    return (size or 0) <= broadcast_bytes(df.sparkSession)


def groups_fit(
    df: DataFrame, by: Sequence[str], n_values: int, wide: Sequence[str] = ()
) -> bool:
    """Whether one row of ``n_values`` statistics per group may be broadcast.

    A statistic counts as 16 bytes, or as the widest value of ``wide`` where it may be one.

    Reads the key columns only and needs no shuffle of keys: the number of groups is
    estimated by a sketch, and twice the estimate is held against the limit.
    """
    keys = T.StructType([df.schema[c] for c in by])
    values = T.StructType([df.schema[c] for c in wide])
    probe = df.agg(
        F.approx_count_distinct(F.struct(*by)).alias("n"),
        F.max(row_bytes(keys)).alias("width"),
        F.max(row_bytes(values)).alias("value"),
    ).first()
    width = (probe["width"] or 0) + max(16, probe["value"] or 0) * n_values
    return 2 * probe["n"] * width <= broadcast_bytes(df.sparkSession)


def row_share(limit: int, per_block: int = _ROWS_SEEN) -> float:
    """Share of rows to look at so that ``limit`` rows are seen as about ``per_block``."""
    return min(1.0, per_block / limit)


def seen_as_large(n: Column, limit: int, share: float) -> Column:
    """Whether ``n`` rows seen at this share mean a group above the limit.

    Exact when every row is looked at. On a sample the bar is set a quarter lower, so a
    large group is hardly ever overlooked; results do not depend on it either way, only
    how evenly the work is spread.
    """
    return n > limit if share >= 1.0 else n >= 0.75 * share * limit


def some_rows(df: DataFrame, share: float) -> DataFrame:
    return df if share >= 1.0 else df.where(F.rand(11) < share)


def same_rows(df: DataFrame, share: float) -> DataFrame:
    """A share of the rows by a hash of their values: the same ones on every evaluation."""
    if share >= 1.0:
        return df
    steps = 1 << 30
    return df.where(F.pmod(F.xxhash64(*df.columns), F.lit(steps)) < F.lit(int(share * steps)))


def large_groups(df: DataFrame, by: Sequence[str], limit: int) -> list[Row]:
    """Groups of more than about ``limit`` rows with their sizes ``n``.

    Reads the key columns and counts a sample of rows; about (rows / limit) rows at
    most reach the driver.
    """
    share = row_share(limit)
    sizes = some_rows(df.select(*by), share).groupBy(*by).agg(F.count(F.lit(1)).alias("seen"))
    large = sizes.where(seen_as_large(F.col("seen"), limit, share))
    return large.select(*by, F.ceil(F.col("seen") / share).alias("n")).collect()
