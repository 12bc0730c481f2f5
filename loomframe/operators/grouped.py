"""Grouped summaries that return several rows, group filters, row selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.missing import all_true, max_of, missing_share
from loomframe.operators.select import resolve
from loomframe.operators.windows import cumsum, number_rows
from loomframe.plans.blocks import parse_order, sort_columns
from loomframe.plans.matching import attach_group_stats, keep_groups
from loomframe.plans.sizing import large_groups, rows_per_block


# Spark limits row numbers before the shuffle up to this many rows.
_LIMITED_ROWS = 1000


def filter_at_max(
    df: DataFrame,
    x: str,
    by: Sequence[str] = (),
    na_rm: bool = False,
    few_groups: bool | None = None,
) -> DataFrame:
    """Rows holding their group's largest value, ties included.

    A group with a missing value has no known maximum and goes, unless ``na_rm``.
    """
    stats = {"__max": max_of(x, na_rm)}
    marked = attach_group_stats(df, by, stats, few_groups=few_groups, wide=[x])
    return marked.where(F.col(x) == F.col("__max")).drop("__max")


def keep_groups_all(
    df: DataFrame, cond: Column, by: Sequence[str], few_groups: bool | None = None
) -> DataFrame:
    """Groups in which every row passes; an unknown outcome does not pass."""
    return keep_groups(df, by, all_true(cond), few_groups)


def keep_groups_missing_below(
    df: DataFrame, x: str, by: Sequence[str], share: float, few_groups: bool | None = None
) -> DataFrame:
    """Groups whose share of missing values lies strictly below ``share``."""
    return keep_groups(df, by, missing_share(x) < share, few_groups)


def slice_max(
    df: DataFrame,
    x: str,
    n: int = 1,
    by: Sequence[str] = (),
    with_ties: bool = True,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` rows with the largest value per group, missing values last.

    With ties the n-th value is found first and rows are kept by comparing with it,
    so any number of tied rows stays where it is. Without ties ``tiebreak`` columns
    settle which row stays, and what they leave open is an error. Row limits apply inside
    each task before the shuffle.
    """
    if not with_ties:
        return slice_head(df, n, by, [f"-{x}", *tiebreak])
    if n == 1:
        marked = attach_group_stats(df, by, {"__cut": F.max(x), "__open": F.max(x).isNull()})
    else:
        stats = {"__cut": F.min("__x"), "__open": F.max(F.isnull("__x"))}
        marked = attach_group_stats(df, by, stats, source=_top_values(df, x, n, by))
    kept = marked.where(F.col("__open") | (F.col(x) >= F.col("__cut")))
    return kept.drop("__cut", "__open")


def _top_values(df: DataFrame, x: str, n: int, by: Sequence[str]) -> DataFrame:
    """The values of the first ``n`` rows per group from the largest down."""
    values = df.select(*by, F.col(x).alias("__x"))
    if n <= _LIMITED_ROWS:
        return _head(values, n, by, "-__x", lambda kept, tied: kept)
    counts = values.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__n"))
    reached = cumsum(counts, "__n", by, "-__x", out="__upto")
    return reached.where(F.col("__upto") - F.col("__n") < n)


def _head(df: DataFrame, n: int, by: Sequence[str], order_by, keep) -> DataFrame:
    """Rows numbered up to n + 1; ``keep(first n, tied with the row ahead)`` says which stay.

    Up to 1,000 rows each task keeps only the first it sees of a group before the shuffle;
    for more, rows are numbered in blocks.
    """
    place, rank = F.col("__rn"), F.col("__rk")
    if n > _LIMITED_ROWS:
        numbered = number_rows(df, by, order_by, "__rn", tied="__tied")
        tied = F.col("__tied")
    else:
        along = Window.partitionBy(*by).orderBy(*sort_columns(parse_order(order_by)))
        numbered = df.withColumns({"__rn": F.row_number().over(along), "__rk": F.rank().over(along)})
        tied = rank < place
    numbered = numbered.where(place <= n + 1)
    return numbered.where(keep(place <= n, tied)).select(*df.columns)


def slice_head(df: DataFrame, n: int, by: Sequence[str], order_by) -> DataFrame:
    """The first ``n`` rows of each group in the given order.

    Stops where the order does not tell the n-th row from the next, whatever ``n`` is.
    """
    names = ", ".join(c for c, _ in parse_order(order_by))
    text = F.lit(f"order_by ({names}) does not fix which rows are the first {n} of a group")

    def keep(first: Column, tied: Column) -> Column:
        return F.when(~first & tied, F.raise_error(text)).otherwise(first)

    return _head(df, n, by, order_by, keep)


def reframe_quantiles(
    df: DataFrame,
    x: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    out: str = "q",
    limit: int | None = None,
) -> DataFrame:
    """Interpolated quantiles, one row per group and probability, missing values left out.

    Spark's exact percentile keeps a group's distinct values in one task's memory. Once
    a group is too large for that, values are counted, ranked by a blocked running sum
    and the two neighbours of each quantile picked out.
    """
    probs = [float(p) for p in probs]
    by = list(by)
    present = df.select(*by, x).where(F.col(x).isNotNull())
    most = rows_per_block(df.sparkSession, limit)
    if by:
        large = bool(large_groups(present, by, most))
    else:
        large = present.count() > most
    if not large:
        got = F.percentile(F.col(x), F.array(*[F.lit(p) for p in probs]))
        table = present.groupBy(*by).agg(got.alias("__q"))
        pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"), F.col("__q"))
        return table.select(*by, F.inline(pairs).alias("prob", out))

    counts = present.groupBy(*by, x).agg(F.count(F.lit(1)).alias("__n"))
    ranked = cumsum(counts, "__n", by, x, out="__upto", limit=limit)
    ranked = attach_group_stats(ranked, by, {"__all": F.sum("__n")})
    picks = []
    for i, p in enumerate(probs):
        place = (F.col("__all") - 1) * F.lit(p)
        low, high = F.floor(place), F.ceil(place)
        for name, at in (("lo", low), ("hi", high)):
            covers = (at >= F.col("__upto") - F.col("__n")) & (at < F.col("__upto"))
            picks.append(F.max(F.when(covers, F.col(x).cast("double"))).alias(f"__{name}{i}"))
    table = ranked.groupBy(*by).agg(F.first("__all").alias("__all"), *picks)
    rows = []
    for i, p in enumerate(probs):
        place = (F.col("__all") - 1) * F.lit(p)
        part = place - F.floor(place)
        value = F.col(f"__lo{i}") + part * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))
        rows.append(F.struct(F.lit(p).alias("prob"), value.alias(out)))
    return table.select(*by, F.inline(F.array(*rows)))


def summarise_columns(
    df: DataFrame, cols, f: Callable[[Column], Column], name_to: str = "col", out: str = "value"
) -> DataFrame:
    """One statistic of each column, as one row per column.

    All columns are aggregated in one pass and only the single result row is turned.
    """
    chosen = resolve(df, cols)
    wide = df.agg(*[f(F.col(c)).alias(c) for c in chosen])
    rows = [F.struct(F.lit(c).alias(name_to), F.col(c).alias(out)) for c in chosen]
    return wide.select(F.inline(F.array(*rows)))


def _line(y: str, x: str) -> Column:
    return F.struct(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def fit_per_column(df: DataFrame, y: str, cols, name_to: str = "col") -> DataFrame:
    """Least-squares line of ``y`` on each column; pairs with a missing part left out."""
    chosen = resolve(df, cols, exclude=[y])
    wide = df.agg(*[_line(y, c).alias(c) for c in chosen])
    rows = [
        F.struct(F.lit(c).alias(name_to), *[F.col(c)[n].alias(n) for n in _LINE]) for c in chosen
    ]
    return wide.select(F.inline(F.array(*rows)))


_LINE = ("slope", "intercept", "r2", "n")


def fit_per_group(df: DataFrame, y: str, x: str, by: Sequence[str]) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` in each group."""
    fits = df.groupBy(*by).agg(_line(y, x).alias("fit"))
    return fits.select(*by, *[F.col("fit")[n].alias(n) for n in _LINE])
