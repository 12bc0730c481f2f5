"""Recurrences: each row's value from the previous row's value.

A linear step ``k -> a*k + b`` is a map, and maps compose, so a large group is folded
block by block and the block results are chained afterwards. So does any other family of
steps that is closed under composition (``Steps``). A step that is an arbitrary function
can only be followed row by row; its group streams through one task in sorted Arrow batches
and is never held as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.functions.missing import col_of
from loomframe.operators.windows import cumsum, cumulate
from loomframe.plans.blocks import LARGE, WHOLE_GROUPS, OrderedBlocks
from loomframe.plans.matching import lookup_join
from loomframe.plans.sizing import ROWS_PER_BLOCK

_ROW, _FIRST = "__row", "__k0"
_MULT, _ADD, _LOW, _HIGH = "__mult", "__add", "__low", "__high"
_SCALE, _SHIFT = "__scale", "__shift"


def _sorted_rows(blocks: OrderedBlocks, df: DataFrame) -> DataFrame:
    """Rows of each block together and in order, numbered within it."""
    return df.withColumn(_ROW, blocks.ordered(F.row_number().over(blocks.window())))


def _composed(rows: DataFrame) -> DataFrame:
    """Replace each row's step (a, b) by the composition of all steps of its block."""

    # Defined here, so that it travels to the workers as code and not as an import.
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = shift = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            number, a, b = (
                batch.column(c).to_numpy(zero_copy_only=False).astype(t, copy=True)
                for c, t in ((_ROW, np.int64), (_MULT, float), (_ADD, float))
            )
            # What came before the batch goes on until its first new block.
            if number[0] != 1:
                a[0], b[0] = a[0] * scale, a[0] * shift + b[0]
            rows = np.arange(len(a))
            place = rows - np.maximum.accumulate(np.where(number == 1, rows, 0))
            longest = int(place.max())
            with np.errstate(over="ignore", invalid="ignore"):
                if longest * 20 < len(a):
                    # Many short blocks: their second rows at once, then their third rows ...
                    order = np.argsort(place, kind="stable")
                    ends = np.searchsorted(place[order], np.arange(1, longest + 2))
                    for lo, hi in zip(ends[:-1], ends[1:]):
                        at = order[lo:hi]
                        b[at] = a[at] * b[at - 1] + b[at]
                        a[at] = a[at] * a[at - 1]
                else:
                    scales, shifts = a.tolist(), b.tolist()
                    for i, fresh in enumerate((place == 0).tolist()):
                        if fresh:
                            scale, shift = scales[i], shifts[i]
                        else:
                            shift = scales[i] * shift + shifts[i]
                            scale = scales[i] * scale
                            scales[i], shifts[i] = scale, shift
                    a, b = np.array(scales), np.array(shifts)
            scale, shift = a[-1], b[-1]
            kept = [n for n in batch.schema.names if n not in (_MULT, _ADD)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + [pa.array(a), pa.array(b)],
                names=[*kept, _SCALE, _SHIFT],
            )

    kept = [f for f in rows.schema if f.name not in (_MULT, _ADD)]
    schema = T.StructType(
        [*kept, T.StructField(_SCALE, T.DoubleType()), T.StructField(_SHIFT, T.DoubleType())]
    )
    return rows.mapInArrow(compose, schema)


def _composed_steps(rows: DataFrame, names: Sequence[str], combine: Callable, first: str | None = None) -> DataFrame:
    """Replace each row's step by the composition of all steps of its block up to the row.

    A step is given by the columns ``names``; ``combine`` takes two dicts of their arrays, of
    earlier and of later steps, and returns that of the compositions. Rows of a batch are
    composed in doubling distances, so a batch of n rows takes log(n) vectorised passes
    (short blocks: row after row, all blocks at once). ``first`` names a column whose value at
    the block's first row is put on all its rows.
    """
    names = list(names)

    # Defined here, so that it travels to the workers as code and not as an import.
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = begun = None
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(_ROW).to_numpy(zero_copy_only=False)
            steps = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float, copy=True) for c in names}
            rows = np.arange(len(number))
            heads = np.maximum.accumulate(np.where(number == 1, rows, 0))
            place, longest = rows - heads, 1
            with np.errstate(over="ignore", invalid="ignore"):
                # What came before the batch goes on until its first new block.
                if number[0] != 1:
                    one = combine({c: before[c] for c in names}, {c: steps[c][:1] for c in names})
                    for c in names:
                        steps[c][:1] = one[c]
                if place.max() * 20 < len(place):
                    # Many short blocks: their second rows at once, then their third rows ...
                    order = np.argsort(place, kind="stable")
                    ends = np.searchsorted(place[order], np.arange(1, place.max() + 2))
                    turns = [(order[lo:hi], 1) for lo, hi in zip(ends[:-1], ends[1:])]
                else:
                    turns = []
                    while longest <= place.max():
                        turns.append((np.flatnonzero(place >= longest), longest))
                        longest *= 2
                for at, back in turns:
                    both = combine({c: steps[c][at - back] for c in names}, {c: steps[c][at] for c in names})
                    for c in names:
                        steps[c][at] = both[c]
            before = {c: steps[c][-1:] for c in names}
            columns = {n: batch.column(n) for n in batch.schema.names} | {c: pa.array(steps[c]) for c in names}
            if first is not None:
                value = batch.column(first).to_numpy(zero_copy_only=False).astype(float)
                opened = value[heads]
                if number[0] != 1:
                    opened[heads == 0] = begun
                begun = opened[-1]
                columns[first] = pa.array(opened)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(compose, rows.schema)


def accumulate_affine(
    df: DataFrame,
    mult: Column | float,
    add: Column | str,
    by: Sequence[str] = (),
    order_by=(),
    init: Column | float | None = None,
    out: str = "acc",
    limit: int | None = None,
) -> DataFrame:
    """K_t = mult * K_{t-1} + add, each group starting at ``init`` or its first ``add``.

    The first row's ``add`` is left out when ``init`` is given, as the start value
    already stands for that row. A missing value makes the rest of its group missing.
    """
    blocks = OrderedBlocks(df, by, order_by, limit)
    kept = list(df.columns)
    mult, add = _column(mult).cast("double"), col_of(add).cast("double")
    start = add if init is None else _column(init).cast("double")
    begins = blocks.is_first(F.col(_ROW))
    missing = F.lit(float("nan"))
    local = _composed(
        _sorted_rows(blocks, blocks.df).withColumns(
            {
                _MULT: F.when(begins, F.lit(0.0)).otherwise(F.coalesce(mult, missing)),
                _ADD: F.coalesce(F.when(begins, start).otherwise(add), missing),
            }
        )
    )
    if not blocks.split:
        return local.select(*kept, F.nanvl(F.col(_SHIFT), F.lit(None)).alias(out))

    ends = (
        local.where(LARGE)
        .groupBy(*blocks.keys)
        .agg(F.max_by(F.struct(_SCALE, _SHIFT), _ROW).alias("__end"))
        .select(
            *blocks.keys,
            F.col("__end")[_SCALE].alias(_MULT),
            F.col("__end")[_SHIFT].alias(_ADD),
        )
    )
    # One row per block from here to the join, so no further cutting is needed.
    chain = OrderedBlocks(ends, blocks.by, blocks.keys[-1], limit=WHOLE_GROUPS)
    chained = _composed(_sorted_rows(chain, chain.df))
    entering = chained.select(*blocks.keys, F.lag(_SHIFT).over(chain.window()).alias("__enter"))
    joined = lookup_join(local, entering, blocks.keys, small=blocks.fits(entering))
    value = F.when(
        F.col("__enter").isNotNull(), F.col(_SCALE) * F.col("__enter") + F.col(_SHIFT)
    ).otherwise(F.col(_SHIFT))
    return joined.select(*kept, F.nanvl(value, F.lit(None)).alias(out))


def _block_ends(blocks: OrderedBlocks, local: DataFrame, names: Sequence[str]) -> DataFrame:
    """The last row's values of each block of the large groups."""
    ends = local.where(LARGE).groupBy(*blocks.keys).agg(F.max_by(F.struct(*names), _ROW).alias("__end"))
    return ends.select(*blocks.keys, *[F.col("__end")[n].alias(n) for n in names])


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def chain_index(
    df: DataFrame,
    x: str,
    by: Sequence[str] = (),
    order_by=(),
    init: float = 100.0,
    out: str = "index",
    limit: int | None = None,
) -> DataFrame:
    """K_t = K_{t-1} * x_t / 100 from ``init`` at the first row: a running product.

    The first row's own value is left out, as ``init`` stands for that row.
    """
    blocks = OrderedBlocks(df, by, order_by, limit)
    begins = blocks.is_first(F.row_number().over(blocks.window()))
    factor = F.when(begins, F.lit(1.0)).otherwise(F.col(x) / 100)
    rows = blocks.df.withColumn("__factor", factor)
    done = cumulate(blocks, rows, "__factor", out, F.product, lambda a, b: a * b, 1.0)
    return done.withColumn(out, F.col(out) * init).drop("__factor")


@dataclass(frozen=True)
class Steps:
    """Steps k -> f(k) of a family in which the composition of two steps is a step again.

    ``params`` are the numbers that make up a row's step (a missing one makes the rest of the
    group missing), ``identity`` those of the step that changes nothing. ``combine(earlier,
    later)`` takes and returns dicts of numpy arrays, ``apply(params, k)`` columns.
    """

    params: dict[str, Column]
    identity: dict[str, float]
    combine: Callable[[dict, dict], dict]
    apply: Callable[[dict[str, Column], Column], Column]


def clamped(
    mult: Column | float = 1.0,
    add: Column | float | str = 0.0,
    low: Column | float | str | None = None,
    high: Column | float | str | None = None,
) -> Steps:
    """k -> mult * k + add, not below ``low`` and not above ``high``; ``mult`` must not be negative.

    A decaying maximum is ``clamped(0.9, low="x")``, a stock that cannot fall below zero
    ``clamped(1.0, "change", low=0.0)``. Where ``low`` is above ``high``, ``high`` holds.
    """

    def number(x, default: float) -> Column:
        if x is None:
            return F.lit(default)
        return (F.col(x) if isinstance(x, str) else _column(x)).cast("double")

    m, top = number(mult, 1.0), number(high, float("inf"))
    checked = F.when(m < 0, F.raise_error(F.lit("a clamped step needs a multiplier that is not negative"))).otherwise(m)
    low_ = number(low, float("-inf"))
    bottom = F.when(low_.isNotNull() & top.isNotNull(), F.least(low_, top))
    params = {_MULT: checked, _ADD: number(add, 0.0), _LOW: bottom, _HIGH: top}
    identity = {_MULT: 1.0, _ADD: 0.0, _LOW: float("-inf"), _HIGH: float("inf")}
    mult_, add_, lo, hi = _MULT, _ADD, _LOW, _HIGH

    def combine(earlier, later):
        def moved(v):
            # A multiplier of zero makes any bound, an infinite one too, the added value.
            with np.errstate(invalid="ignore"):
                return np.where(later[mult_] == 0, later[add_], later[mult_] * v + later[add_])

        def held(v):
            return np.minimum(np.maximum(v, later[lo]), later[hi])

        return {
            mult_: later[mult_] * earlier[mult_],
            add_: later[mult_] * earlier[add_] + later[add_],
            lo: held(moved(earlier[lo])),
            hi: held(moved(earlier[hi])),
        }

    def apply(p, k):
        return F.least(F.greatest(p[mult_] * k + p[add_], p[lo]), p[hi])

    return Steps(params, identity, combine, apply)


def accumulate(
    df: DataFrame,
    step: Callable[[float, object], float] | Steps,
    x: str | None,
    by: Sequence[str],
    order_by,
    init: float | None = None,
    out: str = "acc",
    limit: int | None = None,
) -> DataFrame:
    """Fold a step along each group, starting at ``init`` or the first value of ``x``.

    With ``Steps`` (``clamped`` and families of your own) large groups, and a table without
    groups, are cut into blocks that are composed independently and chained. The first row's
    step is left out, as the start stands for that row.

    Any other function of (previous, x) is followed row by row; its group cannot be divided, so
    it streams through one task with one batch in memory, and a table without groups of more
    than ``limit`` (4 million) rows stops.
    """
    if isinstance(step, Steps):
        return _accumulate_steps(df, step, x, by, order_by, init, out, limit)
    if not by and df.count() > (ROWS_PER_BLOCK if limit is None else limit):
        raise ValueError("a large table without groups is folded by Steps only: any other function would run in one task")
    blocks = OrderedBlocks(df, by, order_by, limit=WHOLE_GROUPS)
    rows = _sorted_rows(blocks, df.withColumn("__x", F.col(x)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = None
        for batch in batches:
            values = []
            numbers, xs = batch.column(_ROW).to_pylist(), batch.column("__x").to_pylist()
            for number, v in zip(numbers, xs):
                if number == 1:
                    k = v if init is None else init
                else:
                    k = None if k is None or v is None else step(k, v)
                values.append(k)
            names = [n for n in batch.schema.names if n not in (_ROW, "__x")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(values, pa.float64())],
                names=[*names, out],
            )

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return rows.mapInArrow(fold, schema)


def _accumulate_steps(df, step: Steps, x, by, order_by, init, out, limit) -> DataFrame:
    blocks = OrderedBlocks(df, by, order_by, limit)
    kept, names = list(df.columns), list(step.params)
    begins, missing = blocks.is_first(F.col(_ROW)), F.lit(float("nan"))
    start = _column(init) if init is not None else F.col(x)
    rows = _sorted_rows(blocks, blocks.df)
    own = {n: F.when(begins, F.lit(float(step.identity[n]))).otherwise(F.coalesce(c.cast("double"), missing)) for n, c in step.params.items()}
    rows = rows.withColumns({**own, _FIRST: F.coalesce(F.when(begins, start.cast("double")), missing)})
    local = _composed_steps(rows, names, step.combine, _FIRST)

    def value(k: Column) -> Column:
        # A missing parameter or start makes the result missing, whatever a maximum makes of it.
        lost = reduce(lambda a, b: a | b, [F.isnan(n) for n in names])
        return F.when(~lost & ~F.isnan(k), step.apply({n: F.col(n) for n in names}, k))

    if not blocks.split:
        return local.select(*kept, value(F.col(_FIRST)).alias(out))
    ends = _block_ends(blocks, local, [*names, _FIRST])
    chain = OrderedBlocks(ends, blocks.by, blocks.keys[-1], limit=WHOLE_GROUPS)
    chained = _composed_steps(_sorted_rows(chain, chain.df), names, step.combine, _FIRST)
    reached = chained.withColumn("__reached", value(F.col(_FIRST)))
    entering = reached.select(*blocks.keys, F.coalesce(F.lag("__reached").over(chain.window()), missing).alias("__enter"))
    joined = lookup_join(local, entering, blocks.keys, small=blocks.fits(entering))
    opened = F.coalesce(F.col(blocks.keys[-1]), F.lit(0)) == 0
    k = F.when(opened, F.col(_FIRST)).otherwise(F.col("__enter"))
    return joined.select(*kept, value(k).alias(out))


def record_id(
    df: DataFrame,
    opens: Column,
    order_by,
    by: Sequence[str] = (),
    out: str = "record",
    limit: int | None = None,
) -> DataFrame:
    """Number the records of a listing in which ``opens`` marks each record's first row."""
    flagged = df.withColumn("__opens", F.coalesce(opens, F.lit(False)).cast("int"))
    return cumsum(flagged, "__opens", by, order_by, out=out, limit=limit).drop("__opens")
