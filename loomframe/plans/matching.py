"""Join one small or unique-keyed table back to a large one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.plans.sizing import groups_fit


def null_safe_match(pairs: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(l).eqNullSafe(F.col(r)) for l, r in pairs])


def renamed_keys(table: DataFrame, on: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The table with its key columns moved out of the way of equal names."""
    keys = [f"__key_{i}" for i in range(len(on))]
    others = [c for c in table.columns if c not in on]
    return table.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], *others), keys


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    small: bool = False,
) -> DataFrame:
    """Null-safe equi-join on ``on`` that adds the table's other columns to ``df``.

    With ``small`` (its size was checked) the table is sent to every task and ``df``
    is not shuffled. Otherwise both sides are shuffled; ``table`` then has unique
    keys, so adaptive execution can cut a heavy key of ``df`` into several tasks.
    """
    right, keys = renamed_keys(table, on)
    if small:
        right = F.broadcast(right)
    joined = df.join(right, null_safe_match(list(zip(on, keys))), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*keys)


def attach_group_stats(
    df: DataFrame,
    by: Sequence[str],
    stats: dict[str, Column],
    source: DataFrame | None = None,
    few_groups: bool | None = None,
    wide: Sequence[str] = (),
) -> DataFrame:
    """Add per-group aggregates to every row without gathering any group.

    They are taken over ``source`` (rows derived from ``df``), by default ``df`` itself.
    The aggregates combine on the map side, so a group of any size costs one row per
    task; they are joined back rather than computed in a window, which would pull the
    whole group into one task. ``few_groups`` says that the groups are known to be few
    (or many); otherwise they are counted to decide how to join, and columns that a
    statistic takes values from are measured if named in ``wide``.
    """
    named = [agg.alias(name) for name, agg in stats.items()]
    source = df if source is None else source
    if not by:
        one_row = source.agg(F.struct(*named).alias("s")).select("s").scalar()
        return (
            df.withColumn("__total", one_row)
            .select(*df.columns, *[F.col("__total")[n].alias(n) for n in stats])
        )
    table = source.groupBy(*by).agg(*named)
    small = groups_fit(df, by, len(stats), wide) if few_groups is None else few_groups
    return lookup_join(df, table, by, small=small)


def keep_groups(
    df: DataFrame, by: Sequence[str], passes: Column, few_groups: bool | None = None
) -> DataFrame:
    """Rows of the groups for which the aggregate ``passes`` is true."""
    good = df.groupBy(*by).agg(passes.alias("__ok")).where("__ok").select(*by)
    small = groups_fit(df, by, 1) if few_groups is None else few_groups
    return lookup_join(df, good, by, how="left_semi", small=small)
