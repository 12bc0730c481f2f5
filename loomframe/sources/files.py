"""Files in, files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_grouped(
    spark: SparkSession, path: str, schema: str, key_regex: str = r"^([a-z])(?=\d)", key: str = "grp"
) -> DataFrame:
    """Read a set of CSV files at once, the group taken from each file's name.

    One scan over all files; the first group of ``key_regex`` names the rows' group.
    """
    rows = spark.read.option("header", True).schema(schema).csv(path)
    name = F.col("_metadata.file_name")
    return rows.select(F.regexp_extract(name, key_regex, 1).alias(key), "*")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a result table as CSV with a header, one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)
