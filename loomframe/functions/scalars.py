"""Text, date and conversion helpers, each one a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.missing import col_of, safe_div


def str_squish(x: Column | str) -> Column:
    """Strip the ends and shrink inner runs of white space, of any script, to one space."""
    return F.trim(F.regexp_replace(col_of(x), r"(?U)\s+", " "))


def str_detect(x: Column | str, pattern: str) -> Column:
    return col_of(x).rlike(pattern)


def str_extract(x: Column | str, pattern: str) -> Column:
    """First match of the pattern, null (not '') when there is none."""
    return F.regexp_substr(col_of(x), F.lit(pattern))


def as_integer(x: Column | str) -> Column:
    """Integer value, a fraction cut off; null when the text is not a number that fits."""
    whole = col_of(x).try_cast("double")
    return F.when(~F.isnan(whole), F.when(whole >= 0, F.floor(whole)).otherwise(F.ceil(whole))).try_cast("int")


def paste(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def month_sequence(start: Column, stop: Column) -> Column:
    """Array of dates one month apart, both ends included."""
    return F.sequence(start, stop, F.expr("interval 1 month"))


def set_difference_size(a: Column | str, b: Column | str) -> Column:
    """How many distinct elements of array ``a`` are not in array ``b``."""
    return F.size(F.array_except(col_of(a), col_of(b)))


def change_ratio(now, before) -> Column:
    """now / before - 1, null when there is no usable earlier value."""
    return safe_div(now, before) - 1
