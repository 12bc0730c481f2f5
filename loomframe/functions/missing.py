"""Expressions whose result in the presence of missing values is spelled out.

Spark's own aggregates skip nulls and ``otherwise`` catches them. The functions
here let a missing value stay missing unless the caller asks for it to be removed.
All of them are plain Catalyst expressions, so they stay inside generated code and
the aggregates combine on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice that is null where the condition is null."""
    return F.when(cond, yes).when(~cond, no)


def case_when(*branches: tuple[Column, object], default=None) -> Column:
    """First branch whose condition is true; an unknown condition is not taken."""
    chain = F
    for cond, value in branches:
        chain = chain.when(cond, value)
    return chain.otherwise(default)


def all_true(cond: Column) -> Column:
    """True when every row of the group passes; an unknown outcome does not pass."""
    return F.bool_and(F.coalesce(cond, F.lit(False)))


def _unless_missing(agg: Column, x: Column, na_rm: bool) -> Column:
    return agg if na_rm else F.when(F.count(F.lit(1)) == F.count(x), agg)


def sum_of(x: Column | str, na_rm: bool = False) -> Column:
    x = col_of(x)
    return F.coalesce(F.sum(x), F.lit(0)) if na_rm else _unless_missing(F.sum(x), x, False)


def mean_of(x: Column | str, na_rm: bool = False) -> Column:
    x = col_of(x)
    return _unless_missing(F.avg(x), x, na_rm)


def max_of(x: Column | str, na_rm: bool = False) -> Column:
    x = col_of(x)
    return _unless_missing(F.max(x), x, na_rm)


def min_of(x: Column | str, na_rm: bool = False) -> Column:
    x = col_of(x)
    return _unless_missing(F.min(x), x, na_rm)


def missing_share(x: Column | str) -> Column:
    return F.avg(F.isnull(col_of(x)).cast("int"))


def any_missing(x: Column | str) -> Column:
    return F.max(F.isnull(col_of(x)))


def n_complete(x: Column | str) -> Column:
    return F.count(col_of(x))


def n_distinct(*cols: Column | str) -> Column:
    """Distinct tuples, a missing part counting as a value of its own."""
    return F.count_distinct(F.struct(*[col_of(c) for c in cols]))


def safe_div(x, d) -> Column:
    """x / d, null where the divisor is zero (ANSI mode would raise)."""
    return col_of(x) / F.nullif(col_of(d), F.lit(0))


def row_min(*cols: Column | str, na_rm: bool = False) -> Column:
    """Smallest of several columns in a row; null if any is null unless ``na_rm``."""
    cs = [col_of(c) for c in cols]
    least = F.least(*cs)
    if na_rm:
        return least
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cs]), least)


def standard_score(x, mean, sd) -> Column:
    """(x - mean) / sd; null for a constant or one-row group."""
    return safe_div(col_of(x) - col_of(mean), sd)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column (one notion of missing)."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
