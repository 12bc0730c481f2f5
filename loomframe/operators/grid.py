"""Grids of combinations, completing a table to a grid, finding what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.operators.windows import lag
from loomframe.plans.blocks import EXACT_JSON, constant_list
from loomframe.plans.matching import lookup_join
from loomframe.plans.sizing import table_fits

_CHUNK = 10_000
_CONSTANT_BYTES = 4 * 1024 * 1024


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, whose rows are distinct.

    Up to 10,000 right rows of 4 MB in all become a constant that each left row unpacks.
    More are packed into arrays of about that size, and the left rows meet each array once.
    """
    texts = right.select(F.to_json(F.struct(*right.columns), EXACT_JSON).alias("j"))
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("j")).alias("b")).first()
    n, weight = size["n"], size["b"] or 0
    if n <= _CHUNK and weight <= _CONSTANT_BYTES:
        found = texts.collect()
        packed = constant_list([r["j"] for r in found], right.schema)
        return left.select("*", F.inline(packed))
    chunks = max(-(-n // _CHUNK), -(-weight // _CONSTANT_BYTES))
    packs = (
        right.withColumn("__chunk", F.pmod(F.xxhash64(*right.columns), F.lit(chunks)))
        .groupBy("__chunk")
        .agg(F.collect_list(F.struct(*right.columns)).alias("__pack"))
    )
    every = F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))
    spread = left.withColumn("__chunk", F.explode(every))
    joined = lookup_join(spread, packs, ["__chunk"], how="inner", small=table_fits(packs))
    return joined.select(*left.columns, F.inline("__pack"))


def expand_grid(base: DataFrame, **axes: Column | Sequence) -> DataFrame:
    """Rows of ``base`` with every combination of the given axes.

    An axis is a list of values or an array column such as ``F.sequence(...)``.
    """
    grid = base
    for name, axis in axes.items():
        values = axis if isinstance(axis, Column) else F.array(*[F.lit(v) for v in axis])
        grid = grid.withColumn(name, F.explode(values))
    return grid


def _grid(df: DataFrame, dims: dict[str, Column | Sequence | None]) -> DataFrame:
    observed = [d for d, axis in dims.items() if axis is None]
    if not observed:
        raise ValueError("at least one column must take its values from the data")
    tables = [df.select(d).distinct() for d in observed]
    grid = tables[0]
    for t in tables[1:]:
        grid = product(grid, t)
    given = {d: axis for d, axis in dims.items() if axis is not None}
    grid = expand_grid(grid, **given)
    return grid.select(*[F.col(d).cast(df.schema[d].dataType).alias(d) for d in dims])


def missing_cells(df: DataFrame, dims: dict[str, Column | Sequence | None] | Sequence[str]):
    """Combinations of the grid that the table has no row for.

    ``dims`` maps a column to its full list of values, or to None for those it shows.
    """
    if not isinstance(dims, dict):
        dims = dict.fromkeys(dims)
    cells = df.select(*dims).distinct()
    return lookup_join(_grid(cells, dims), cells, list(dims), how="left_anti")


def complete(
    df: DataFrame,
    dims: dict[str, Column | Sequence | None] | Sequence[str],
    fill: dict | None = None,
    explicit: bool = True,
) -> DataFrame:
    """Add a row for every missing combination; existing rows all stay, off the grid too.

    ``fill`` replaces missing values, in all rows or (``explicit=False``) only in the
    added ones. The table itself is never shuffled: only its distinct cells are.
    """
    added = missing_cells(df, dims)
    others = [f for f in df.schema if f.name not in added.columns]
    blank = {f.name: F.lit(None).cast(f.dataType) for f in others}
    added = added.withColumns(blank) if blank else added
    fill = fill or {}
    if not explicit:
        return df.unionByName(_fill(added, fill))
    return _fill(df.unionByName(added), fill)


def _fill(df: DataFrame, fill: dict) -> DataFrame:
    made = {
        c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fill.items()
    }
    return df.withColumns(made) if made else df


# Periods in days and in months.
_DAYS = {"day": 1, "week": 7}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _stepping(kind: T.DataType, every: int | str):
    """Step, place of a value on the axis (null where it is on no step), and value of a place."""
    if isinstance(kind, T.IntegralType) and isinstance(every, int) and every > 0:
        return every, lambda c: c.cast("long"), lambda i: i.cast(kind)
    if isinstance(kind, T.DateType) and (every in _DAYS or isinstance(every, int) and every > 0):
        step = _DAYS[every] if isinstance(every, str) else every
        return step, lambda c: F.unix_date(c).cast("long"), lambda i: F.date_from_unix_date(i.cast("int"))
    if isinstance(kind, T.DateType) and every in _MONTHS:
        months = lambda c: F.when(F.day(c) == 1, (F.year(c) * 12 + F.month(c) - 1).cast("long"))
        return _MONTHS[every], months, lambda i: F.add_months(F.lit("0001-01-01").cast("date"), (i - 12).cast("int"))
    raise ValueError(f"no steps of {every!r} along a column of type {kind.simpleString()}")


def gap_runs(
    df: DataFrame,
    axis: str,
    by: Sequence[str] = (),
    every: int | str = 1,
    between: tuple | None = None,
    unfold: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """What each group lacks along an axis, one row per run of missing steps: first, last, n.

    ``axis`` is a whole number with steps of ``every``, or a date with steps of so many days, or
    of a "day", "week", "month", "quarter" or "year" (first days of months). Steps count from the
    lower end of ``between``, by default the smallest and largest value of the table; values
    that are missing, outside or between the steps fill nothing. Missing keys form a group; a
    group without any row is not known and not listed.

    Neighbours along the axis tell the runs, so no grid is built: the cost is that of the cells
    that exist, however wide the gaps. With ``unfold`` every missing step is a row instead,
    under the name of the axis.
    """
    by = list(by)
    kind = df.schema[axis].dataType
    step, place, value = _stepping(kind, every)
    cells = df.select(*by, place(F.col(axis)).alias("__at"))
    if between is None:
        ends = cells.agg(F.min("__at").alias("lo"), F.max("__at").alias("hi")).first()
        lo, hi = ends["lo"], ends["hi"]
    else:
        limits = [place(F.lit(v).cast(kind)) for v in between]
        lo, hi = df.sparkSession.range(1).select(*limits).first()
        if lo is None or hi is None:
            raise ValueError(f"the ends {between!r} are not on steps of {every!r}")
    if lo is None:
        lo, hi = 0, -1
    at = F.col("__at")
    cells = cells.where((at >= lo) & (at <= hi) & (F.pmod(at - F.lit(lo), F.lit(step)) == 0)).distinct()
    last_step = lo + (hi - lo) // step * step
    before = lag(cells, "__at", by, "__at", out="__before", limit=limit)
    begin = F.coalesce(F.col("__before"), F.lit(lo - step)) + step
    inner = before.where(at > begin).select(*by, begin.alias("__from"), (at - step).alias("__to"))
    final = cells.groupBy(*by).agg(F.max("__at").alias("__at")).where(at < last_step)
    runs = inner.unionByName(final.select(*by, (at + step).alias("__from"), F.lit(last_step).cast("long").alias("__to")))
    if unfold:
        steps = F.explode(F.sequence("__from", "__to", F.lit(step).cast("long")))
        return runs.select(*by, steps.alias("__at")).select(*by, value(at).alias(axis))
    n = ((F.col("__to") - F.col("__from")) / F.lit(step)).cast("long") + 1
    return runs.select(*by, value(F.col("__from")).alias("first"), value(F.col("__to")).alias("last"), n.alias("n"))
