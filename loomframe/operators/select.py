"""Column selection, operations across columns, row predicates over columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.missing import standard_score
from loomframe.functions.scalars import str_squish
from loomframe.plans.matching import attach_group_stats

Selector = Callable[[T.StructType], list[str]]


def numeric() -> Selector:
    return lambda schema: [f.name for f in schema if isinstance(f.dataType, T.NumericType)]


def textual() -> Selector:
    return lambda schema: [f.name for f in schema if isinstance(f.dataType, T.StringType)]


def starts_with(prefix: str) -> Selector:
    return lambda schema: [f.name for f in schema if f.name.startswith(prefix)]


def positions(*at: int) -> Selector:
    """Columns by zero-based position; negative counts from the end."""
    return lambda schema: [schema.names[i] for i in at]


def resolve(df: DataFrame, cols, exclude: Iterable[str] = ()) -> list[str]:
    """Column names meant by a selector, a list of names or one name."""
    if callable(cols):
        names = cols(df.schema)
    else:
        names = [cols] if isinstance(cols, str) else list(cols)
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    left_out = set(exclude)
    return [c for c in names if c not in left_out]


def drop_positions(df: DataFrame, *at: int) -> DataFrame:
    return df.drop(*resolve(df, positions(*at)))


def mutate_across(
    df: DataFrame, cols, f: Callable[[Column], Column], exclude: Iterable[str] = ()
) -> DataFrame:
    """Replace each selected column by ``f`` of it."""
    return df.withColumns({c: f(F.col(c)) for c in resolve(df, cols, exclude)})


def summarise_across(
    df: DataFrame, cols, f: Callable[[Column], Column], by: Sequence[str] = (), name: str = "{col}"
) -> DataFrame:
    """One aggregate per selected column, all in a single pass."""
    chosen = resolve(df, cols, exclude=by)
    return df.groupBy(*by).agg(*[f(F.col(c)).alias(name.format(col=c)) for c in chosen])


def scale_columns(
    df: DataFrame, cols, by: Sequence[str] = (), exclude: Iterable[str] = ()
) -> DataFrame:
    """Replace columns by their z-scores, over the table or within groups.

    A column with a missing value keeps it; the other rows are scaled without it.
    """
    chosen = resolve(df, cols, exclude=[*exclude, *by])
    stats = {}
    for i, c in enumerate(chosen):
        stats[f"__mean_{i}"] = F.avg(c)
        stats[f"__sd_{i}"] = F.stddev_samp(c)
    scaled = attach_group_stats(df, by, stats).withColumns(
        {c: standard_score(c, f"__mean_{i}", f"__sd_{i}") for i, c in enumerate(chosen)}
    )
    return scaled.drop(*stats)


def filter_if_all(df: DataFrame, cols, f: Callable[[Column], Column]) -> DataFrame:
    """Rows where every selected column passes."""
    return df.where(reduce(lambda a, b: a & b, [f(F.col(c)) for c in resolve(df, cols)]))


def filter_if_any(df: DataFrame, cols, f: Callable[[Column], Column]) -> DataFrame:
    """Rows where at least one selected column passes, whatever is unknown of the others."""
    return df.where(reduce(lambda a, b: a | b, [f(F.col(c)) for c in resolve(df, cols)]))


def filter_not_any(df: DataFrame, cols, f: Callable[[Column], Column]) -> DataFrame:
    """Rows where no selected column passes.

    Where ``f`` is unknown for a column the row is dropped, as in SQL; use
    ``drop_matching_rows`` for text that may be missing.
    """
    return df.where(~reduce(lambda a, b: a | b, [f(F.col(c)) for c in resolve(df, cols)]))


def drop_matching_rows(df: DataFrame, pattern: str, cols=None) -> DataFrame:
    """Drop rows where the squished text of any column matches; missing text never does."""
    chosen = resolve(df, cols if cols is not None else textual())
    hits = [str_squish(F.coalesce(F.col(c), F.lit(""))).rlike(pattern) for c in chosen]
    return df.where(~reduce(lambda a, b: a | b, hits))
