"""Columns computed along or over a group: ratios, ranks, running and rolling values.

Whatever needs an order takes ``order_by`` (leading minus for descending). Operators
whose result depends on the order of tied rows stop on a tie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.missing import standard_score
from loomframe.functions.scalars import change_ratio
from loomframe.plans.blocks import WHOLE_GROUPS, OrderedBlocks, parse_order
from loomframe.plans.matching import attach_group_stats, lookup_join
from loomframe.plans.sizing import groups_fit, large_groups, rows_per_block


def lag(
    df: DataFrame, x, by: Sequence[str], order_by, n: int = 1, out="lagged", limit=None
) -> DataFrame:
    """Value(s) ``n`` rows earlier in the group; ``x`` and ``out`` may be lists."""
    xs = [x] if isinstance(x, str) else list(x)
    outs = [out] if isinstance(out, str) else list(out)
    blocks = OrderedBlocks(df, by, order_by, limit)
    rows, w = blocks.with_lookback(n), blocks.window()
    lagged = {o: blocks.ordered(F.lag(c, n).over(w)) for c, o in zip(xs, outs)}
    return blocks.finish(rows.withColumns(lagged))


def lag_change(
    df: DataFrame,
    x: str,
    by: Sequence[str],
    order_by,
    n: int = 1,
    out: str = "change",
    scale: float = 1.0,
    limit: int | None = None,
) -> DataFrame:
    """Change against the value ``n`` rows earlier: x / lag(x, n) - 1, times ``scale``.

    Counts rows, not calendar steps: complete the grid first if periods may be missing.
    """
    before = lag(df, x, by, order_by, n, out="__before", limit=limit)
    return before.withColumn(out, change_ratio(x, "__before") * F.lit(scale)).drop("__before")


def fixed_base_change(
    df: DataFrame,
    x: str,
    at: str,
    base,
    by: Sequence[str],
    out: str = "vs_base",
    few_groups: bool | None = None,
) -> DataFrame:
    """Change against the group's value at ``at == base``; null where there is none.

    Should several rows carry the base, the smallest value is taken.
    """
    stats = {"__base": F.min(F.when(F.col(at) == base, F.col(x)))}
    marked = attach_group_stats(df, by, stats, few_groups=few_groups)
    return marked.withColumn(out, change_ratio(x, "__base")).drop("__base")


def center(df: DataFrame, x: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    marked = attach_group_stats(df, by, {"__mean": F.avg(x)})
    return marked.withColumn(out or x, F.col(x) - F.col("__mean")).drop("__mean")


def standardise(df: DataFrame, x: str, by: Sequence[str] = (), out: str | None = None):
    marked = attach_group_stats(df, by, {"__mean": F.avg(x), "__sd": F.stddev_samp(x)})
    scored = marked.withColumn(out or x, standard_score(x, "__mean", "__sd"))
    return scored.drop("__mean", "__sd")


def _any_large(df: DataFrame, by: Sequence[str], limit: int | None) -> bool:
    most = rows_per_block(df.sparkSession, limit)
    if most >= WHOLE_GROUPS:
        return False
    if not by:
        return df.count() > most
    return bool(large_groups(df, by, most))


def _rank(df, x, by, out, limit, window_rank, table_rank) -> DataFrame:
    name = parse_order(x)[0][0]
    if not _any_large(df, by, limit):
        w = Window.partitionBy(*by).orderBy(*_ranking(x))
        return df.withColumn(out, F.when(F.col(name).isNotNull(), window_rank().over(w)))
    values = (
        df.where(F.col(name).isNotNull())
        .groupBy(*by, name)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    ranked = table_rank(values).select(*by, name, F.col("__rank").cast("int").alias(out))
    return lookup_join(df, ranked, [*by, name])


def _ranking(x: str) -> list[Column]:
    (name, desc), = parse_order(x)
    return [F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_last()]


def min_rank(
    df: DataFrame, x: str, by: Sequence[str] = (), out: str = "rank", limit: int | None = None
) -> DataFrame:
    """1 + number of rows ahead; ties share a rank, missing values have none.

    In large groups rows are first counted per value, so neither a large group nor a
    value shared by most rows ends up in one task.
    """

    def from_values(values: DataFrame) -> DataFrame:
        summed = cumsum(values, "__n", by, x, out="__upto", limit=limit)
        return summed.withColumn("__rank", F.col("__upto") - F.col("__n") + 1)

    return _rank(df, x, by, out, limit, F.rank, from_values)


def dense_rank(
    df: DataFrame, x: str, by: Sequence[str] = (), out: str = "rank", limit: int | None = None
) -> DataFrame:
    """1 + number of distinct values ahead; missing values have no rank."""

    def from_values(values: DataFrame) -> DataFrame:
        ones = values.withColumn("__n", F.lit(1))
        return cumsum(ones, "__n", by, x, out="__rank", limit=limit)

    return _rank(df, x, by, out, limit, F.dense_rank, from_values)


def row_number(
    df: DataFrame,
    x: str,
    by: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    out: str = "rank",
    limit: int | None = None,
) -> DataFrame:
    """Position in the order of ``x`` and ``tiebreak``; missing values have none."""
    name = parse_order(x)[0][0]
    numbered = number_rows(df, by, [x, *tiebreak], "__rn", limit)
    place = F.when(F.col(name).isNotNull(), F.col("__rn").cast("int"))
    return numbered.withColumn(out, place).drop("__rn")


def number_rows(
    df: DataFrame, by, order_by, out: str, limit: int | None = None, tied: str | None = None
) -> DataFrame:
    """Each row's position in its group; a tie is an error, or marked in column ``tied``."""
    blocks = OrderedBlocks(df, by, order_by, limit)
    own = F.row_number().over(blocks.window())
    if tied is None:
        rows = blocks.df.withColumn("__own", blocks.ordered(own))
    else:
        # Equal keys share a block.
        rows = blocks.df.withColumns({"__own": own, tied: F.rank().over(blocks.window()) < own})
    rows = blocks.carry(rows, {"__before": (F.count(F.lit(1)), F.sum)})
    place = F.col("__own") + F.coalesce(F.col("__before"), F.lit(0))
    return blocks.finish(rows.withColumn(out, place)).drop("__own", "__before")


def cumulate(
    blocks: OrderedBlocks,
    rows: DataFrame,
    x: str,
    out: str,
    agg: Callable[[Column], Column],
    combine: Callable[[Column, Column], Column],
    unit,
    na_rm: bool = False,
) -> DataFrame:
    """Running aggregate of ``x`` over prepared rows, block by block."""
    running = blocks.running()
    gap = F.isnull(x).cast("int")
    rows = rows.withColumns(
        {
            "__part": blocks.ordered(F.coalesce(agg(F.col(x)).over(running), F.lit(unit))),
            "__gaps": F.sum(gap).over(running),
        }
    )
    rows = blocks.carry(rows, {"__part0": (agg(F.col(x)), agg), "__gaps0": (F.sum(gap), F.sum)})
    value = combine(F.col("__part"), F.coalesce(F.col("__part0"), F.lit(unit)))
    if not na_rm:
        gaps = F.col("__gaps") + F.coalesce(F.col("__gaps0"), F.lit(0))
        value = F.when(gaps == 0, value)
    # The same type whether or not there are blocks: that of the aggregate.
    kind = rows.agg(agg(F.col(x)).alias("v")).schema["v"].dataType
    done = rows.withColumn(out, value.cast(kind)).drop("__part", "__gaps", "__part0", "__gaps0")
    return blocks.finish(done)


def cumsum(
    df: DataFrame,
    x: str,
    by: Sequence[str] = (),
    order_by=(),
    out: str = "cum",
    na_rm: bool = False,
    limit: int | None = None,
    ties: str = "error",
) -> DataFrame:
    """Running sum; missing from the first missing value on unless ``na_rm``.

    Rows that share their order key stop it, or, with ``ties="together"``, all get the sum
    up to the last of them: rows are first summed per key, so a key of any size will do.
    """
    if ties not in ("error", "together"):
        raise ValueError(f"unknown ties {ties!r}")
    if ties == "together":
        keys = list(dict.fromkeys([*by, *[c for c, _ in parse_order(order_by)]]))
        whole = F.lit(True) if na_rm else F.count(x) == F.count(F.lit(1))
        sums = df.groupBy(*keys).agg(F.when(whole, F.sum(x)).alias("__sum"))
        summed = cumsum(sums, "__sum", by, order_by, out="__cum", na_rm=na_rm, limit=limit)
        kept = df.select(*[c for c in df.columns if c != out or c in keys])
        return lookup_join(kept, summed.select(*keys, F.col("__cum").alias(out)), keys)
    blocks = OrderedBlocks(df, by, order_by, limit)
    return cumulate(blocks, blocks.df, x, out, F.sum, lambda a, b: a + b, 0, na_rm)


def cumprod(
    df: DataFrame,
    x: str,
    by: Sequence[str] = (),
    order_by=(),
    out: str = "cum",
    na_rm: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Running product; missing from the first missing value on unless ``na_rm``."""
    blocks = OrderedBlocks(df, by, order_by, limit)
    return cumulate(blocks, blocks.df, x, out, F.product, lambda a, b: a * b, 1.0, na_rm)


@dataclass(frozen=True)
class Mergeable:
    """A statistic of rows that can be put together from the statistics of parts of them.

    ``parts`` maps a name to (aggregate, join): the aggregate of a column's values, and how
    the values of two neighbouring runs of rows, the earlier one first, become that of both.
    Missing values of a part (no usable row) are stepped over. ``finish`` makes the result
    from the parts by name.
    """

    parts: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]]
    finish: Callable[[dict[str, Column]], Column]

    def joined(self, name: str, earlier: Column, later: Column) -> Column:
        both = self.parts[name][1](earlier, later)
        return F.when(earlier.isNull(), later).when(later.isNull(), earlier).otherwise(both)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _one(agg: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Mergeable:
    return Mergeable({"v": (agg, join)}, lambda p: p["v"])


_MEAN = Mergeable({"sum": (F.sum, _add), "n": (F.count, _add)}, lambda p: p["sum"] / F.nullif(p["n"], F.lit(0)))

_ROLLING: dict[str, tuple[Callable[[Column], Column], Mergeable]] = {
    "mean": (F.avg, _MEAN),
    "sum": (F.sum, _one(F.sum, _add)),
    "min": (F.min, _one(F.min, F.least)),
    "max": (F.max, _one(F.max, F.greatest)),
}

# Frames above so many rows are put together from two running values instead of walked.
WIDE_FRAME = 100


def rolling(
    df: DataFrame,
    x: str,
    f: str | Mergeable | Callable[[Column], Column] = "mean",
    before: int = 1,
    by: Sequence[str] = (),
    order_by=(),
    out: str = "rolling",
    complete: bool = True,
    na_rm: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """One value from the current and the ``before`` rows ahead of it.

    ``f`` is "mean", "sum", "min", "max", a ``Mergeable`` or any aggregate. With ``complete`` a
    window reaching over the start of the group gives null. The cost of a row does not depend
    on the frame, but for an aggregate of which nothing is known: it walks each row's frame.
    """
    blocks = OrderedBlocks(df, by, order_by, limit)
    rows = blocks.with_lookback(before)
    if isinstance(f, str):
        agg, merge = _ROLLING[f]
    else:
        agg, merge = (None, f) if isinstance(f, Mergeable) else (f, None)
    if merge is not None and (agg is None or before >= WIDE_FRAME):
        kind = df.agg(agg(F.col(x)).alias("v")).schema["v"].dataType if agg is not None else None
        if f == "mean" and not isinstance(df.schema[x].dataType, T.DecimalType):
            rows = rows.withColumn("__x", F.col(x).cast("double"))
        else:
            rows = rows.withColumn("__x", F.col(x))
        return blocks.finish(_rolling_wide(blocks, rows, merge, kind, before, out, complete, na_rm))
    frame = blocks.window().rowsBetween(-before, 0)
    value, size = agg(F.col(x)).over(frame), F.count(F.lit(1)).over(frame)
    usable = F.lit(True)
    if complete:
        usable = usable & (size == before + 1)
    if not na_rm:
        usable = usable & (F.count(x).over(frame) == size)
    return blocks.finish(rows.withColumn(out, blocks.ordered(F.when(usable, value))))


def _rolling_wide(blocks: OrderedBlocks, rows: DataFrame, merge: Mergeable, kind, before: int, out: str, complete: bool, na_rm: bool) -> DataFrame:
    """Rolling values of column __x from two running values per row.

    The rows of a block are cut into runs as long as the frame. A frame then is the end of one
    run and the beginning of the next: the value from a row to its run's end, taken from the
    row where the frame begins, joined to the value from its run's start to the current row.
    """
    size = before + 1
    merge = Mergeable({**merge.parts, "__missing": (lambda c: F.count_if(c.isNull()), _add)}, merge.finish)
    names = list(merge.parts)
    rows = rows.withColumn("__rn", blocks.ordered(F.row_number().over(blocks.window())))
    rows = rows.withColumn("__run", F.floor((F.col("__rn") - 1) / F.lit(size)))
    run = Window.partitionBy(*blocks.keys, "__run")
    upto = Window.unboundedPreceding, Window.currentRow
    onward, back = (run.orderBy(order).rowsBetween(*upto) for order in (F.col("__rn").asc(), F.col("__rn").desc()))
    rows = rows.withColumn("__tail", F.struct(*[merge.parts[n][0](F.col("__x")).over(back).alias(n) for n in names]))
    rows = rows.withColumn("__head", F.struct(*[merge.parts[n][0](F.col("__x")).over(onward).alias(n) for n in names]))
    # In the order of the running value, so that the rows need no further sort.
    along = Window.partitionBy(*blocks.keys).orderBy("__run", "__rn")
    # Before the first full frame, all rows from the start: the run's running value says it.
    whole = F.col("__rn") % size == 0
    rows = rows.withColumn("__from", F.when(~whole, F.lag("__tail", before).over(along)))
    parts = {n: merge.joined(n, F.col("__from")[n], F.col("__head")[n]) for n in names}
    value = merge.finish({n: c for n, c in parts.items() if n != "__missing"})
    value = value if kind is None else value.cast(kind)
    usable = F.lit(True)
    if complete:
        usable = usable & (F.col("__rn") >= size)
    if not na_rm:
        usable = usable & (parts["__missing"] == 0)
    return rows.withColumn(out, F.when(usable, value)).drop("__x", "__rn", "__run", "__tail", "__head", "__from")


def rolling_list(
    df: DataFrame,
    fields: Sequence[str],
    f: Callable[[Column], Column],
    before: int = 1,
    by: Sequence[str] = (),
    order_by=(),
    out: str = "rolling",
    complete: bool = True,
    limit: int | None = None,
) -> DataFrame:
    """Any value from the window's rows: ``f`` gets them as an array of structs."""
    blocks = OrderedBlocks(df, by, order_by, limit)
    rows = blocks.with_lookback(before)
    frame = blocks.window().rowsBetween(-before, 0)
    got = F.collect_list(F.struct(*fields)).over(frame)
    rows = rows.withColumn("__window", blocks.ordered(got))
    value = f(F.col("__window"))
    if complete:
        value = F.when(F.size("__window") == before + 1, value)
    return blocks.finish(rows.withColumn(out, value).drop("__window"))


def period_set_change(
    df: DataFrame,
    item: str,
    by: Sequence[str],
    period: str,
    lost: str = "lost",
    gained: str = "gained",
    limit: int | None = None,
    small_sets: bool = False,
) -> DataFrame:
    """Per group and period, how many items went and came since the previous period.

    Each item carries the period it was last seen in; it stayed if that is the group's
    previous period. No set of items is ever gathered, unless ``small_sets`` says that the
    items of a period fit a row: then each period's set is held against the one before,
    with one shuffle less for every step. The first period of a group has nothing to
    compare with, and missing items are items.
    """
    keys = [*by, period]
    if small_sets:
        items = F.collect_set(F.struct(item)).alias("__now")
        sets = lag(df.groupBy(*keys).agg(items), "__now", by, period, out="__then", limit=limit)
        gone, come = F.array_except("__then", "__now"), F.array_except("__now", "__then")
        known = F.col("__then").isNotNull()
        sizes = {lost: F.when(known, F.size(gone)), gained: F.when(known, F.size(come))}
        return sets.select(*keys, *[n.cast("long").alias(c) for c, n in sizes.items()])
    present = df.select(*keys, item).distinct()
    seen = lag(present, period, [*by, item], period, out="__seen", limit=limit)
    periods = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    periods = lag(periods, [period, "__n"], by, period, out=["__prev", "__prev_n"], limit=limit)
    periods = periods.drop("__n")
    both = lookup_join(seen, periods, keys, small=groups_fit(present, keys, 3))
    counts = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.col("__seen") == F.col("__prev")).alias("__stay"),
        F.max("__prev_n").alias("__prev_n"),
    )
    return counts.select(
        *keys,
        (F.col("__prev_n") - F.col("__stay")).alias(lost),
        F.when(F.col("__prev_n").isNotNull(), F.col("__n") - F.col("__stay")).alias(gained),
    )


def first_last(
    df: DataFrame,
    x: str,
    by: Sequence[str],
    order_by,
    first: str = "first",
    last: str = "last",
) -> DataFrame:
    """The group's first and last value along the order, on every row.

    Stops where several rows share the first or the last place.
    """
    order = parse_order(order_by)
    if len({desc for _, desc in order}) > 1:
        raise ValueError("first_last takes one direction for all order columns")
    descending = order[0][1]
    names = [c for c, _ in order]
    # A row per order key tells how many rows share it.
    places = df.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("__n"), F.max(x).alias("__v"))
    key = F.struct(*[
        part
        for c, desc in order
        for part in ((F.col(c).isNotNull() if desc else F.col(c).isNull()), F.col(c))
    ])
    value = F.struct("__n", "__v")
    low, high = F.min_by(value, key), F.max_by(value, key)
    ends = {first: high, last: low} if descending else {first: low, last: high}
    text = F.lit(f"order_by ({', '.join(names)}) does not fix the first and last row of a group")
    marked = attach_group_stats(df, by, ends, source=places, wide=[x])
    return marked.withColumns(
        {c: F.when(F.col(c)["__n"] > 1, F.raise_error(text)).otherwise(F.col(c)["__v"]) for c in ends}
    )
