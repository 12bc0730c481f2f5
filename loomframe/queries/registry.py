"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def money(x: str) -> Column:
    """Exact sum of a two-decimal amount."""
    return F.sum(F.col(x).cast("decimal(18,2)")).cast("double")


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer's nation and region."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


SALES = """orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

MONEY = "cast(sum(cast({} as decimal(18,2))) as double)"


def events_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose value is missing for errors."""
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf, "events").withColumn("v", value)


GAPPY = "(select *, case when event_type <> 'error' then value end as v from events)"
