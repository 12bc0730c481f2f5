"""Ordered work on groups of any size.

A window puts a whole group into one task. Groups above ``rows_per_block`` rows are
therefore cut along their order into blocks, each of which becomes a partition of
its own, and what a block needs to know about earlier rows is brought to it:

* ``carry``         a summary of all earlier blocks (running sums, last values)
* ``with_lookback`` copies of the last k rows before the block (lags, rolling frames)

Which groups are large, and where to cut them, comes from a sample that a hash of the keys
picks. Up to a few thousand cut points are collected once and stay constants of the plan;
more of them form a table under a short coarse list. Either way re-running a lost task
places every row in the same block. The sample only decides how even the blocks are, never
what a row's result is: the place of a row is found by comparing its order key with the
cut points, and equal keys stay together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.plans.matching import lookup_join
from loomframe.plans.sizing import (
    broadcast_bytes,
    row_share,
    rows_per_block,
    seen_as_large,
    same_rows,
    table_fits,
)

# As a limit: the caller knows every group to be small, so nothing is counted or cut.
WHOLE_GROUPS = 2**62

BLOCK = "__block"
COPY = "__copy"
LARGE = "__large"
_FIRST, _COUNT = "__first", "__count"
_COARSE, _CELL, _CUTS = "__coarse", "__cell", "__cuts"
_SMALLEST_BLOCK = 1_000
_TOO_MANY = object()

# Cut points up to which they are one list, and blocks of a coarse cell beyond that.
LISTED_CUTS, FAN = 4_096, 1_024

Order = list[tuple[str, bool]]

# Formats that keep every digit of a timestamp.
EXACT_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def parse_order(order_by: str | Sequence[str]) -> Order:
    """Column names, a leading minus meaning descending."""
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if not names:
        raise ValueError("order_by is required: rows of a table have no order of their own")
    return [(n[1:], True) if n.startswith("-") else (n, False) for n in names]


def sort_columns(order: Order, backwards: bool = False) -> list[Column]:
    """Sort keys with missing values last (first when walking backwards)."""
    if backwards:
        return [
            F.col(c).asc_nulls_first() if desc else F.col(c).desc_nulls_first()
            for c, desc in order
        ]
    return [
        F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in order
    ]


def _comes_after(order: Order, cut: Column) -> Column:
    """Whether the row's order key lies behind the cut point."""
    result = F.lit(False)
    for i, (name, desc) in reversed(list(enumerate(order))):
        x, c = F.col(name), cut[f"k{i}"]
        behind = F.coalesce((x < c) if desc else (x > c), x.isNull() & c.isNotNull())
        result = behind | (x.eqNullSafe(c) & result)
    return result


def constant_list(items: list[str], item_type: T.StructType) -> Column:
    """An array constant from the JSON texts of its items, parsed once when planning."""
    text = F.lit("[" + ",".join(items) + "]")
    return F.from_json(text, T.ArrayType(item_type), EXACT_JSON)


def leading_count(n: Column, most: int, holds: Callable[[Column], Column]) -> Column:
    """How many of ``n`` ordered items come before the first for which ``holds`` fails.

    ``holds`` takes an item's zero-based place and must be true up to some place and
    false from there on. Binary search, by the powers of two up to ``most``.
    """
    steps = [1 << i for i in reversed(range(max(most, 1).bit_length()))]

    def advance(done: Column, step: Column) -> Column:
        more = (done + step <= n) & holds(done + step - 1)
        return F.when(more, done + step).otherwise(done)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def _picked(df: DataFrame, by: list[str], order: Order, limit: int) -> DataFrame:
    """Rows (by..., k0, k1..., __rn) of a sample that cut the large groups evenly along their order.

    The sample is chosen by a hash of the keys, so a second evaluation picks the same rows.
    """
    share = row_share(limit)
    names = [f"k{i}" for i in range(len(order))]
    keys = df.select(*by, *[F.col(c).alias(k) for k, (c, _) in zip(names, order)])
    along = Window.partitionBy(*by).orderBy(
        *sort_columns([(k, desc) for k, (_, desc) in zip(names, order)])
    )
    seen, place, parts = F.col("__seen"), F.col("__rn"), F.ceil(F.col("__seen") / share / limit)
    return (
        same_rows(keys, share)
        .withColumn("__seen", F.count(F.lit(1)).over(Window.partitionBy(*by)))
        .where(seen_as_large(seen, limit, share))
        .withColumn("__rn", F.row_number().over(along))
        .where(
            (F.floor(place * parts / seen) > F.floor((place - 1) * parts / seen)) & (place < seen)
        )
        .drop("__seen")
    )


def _cut_points(df: DataFrame, by: list[str], order: Order, limit: int, most: int | None = None):
    """The large groups' cut points as a list, None if there is no large group.

    Returns a table (by..., first, count) that says where a group's cuts lie in the list,
    the list as a constant, and the largest count. One job over the key and order columns of
    a sample. With more than ``most`` cut points it returns _TOO_MANY.
    """
    names = [f"k{i}" for i in range(len(order))]
    picked = _picked(df, by, order, limit).orderBy(*by, "__rn")
    cut = F.to_json(F.struct(*names), EXACT_JSON).alias("__cut")
    rows = (picked if most is None else picked.limit(most + 1)).select(*by, cut).collect()
    if not rows:
        return None
    if most is not None and len(rows) > most:
        return _TOO_MANY
    cut_type = T.StructType(
        [T.StructField(k, df.schema[c].dataType) for k, (c, _) in zip(names, order)]
    )
    cuts = constant_list([r["__cut"] for r in rows], cut_type)
    spans: dict[tuple, list[int]] = {}
    for i, r in enumerate(rows):
        spans.setdefault(tuple(r[c] for c in by), [i, 0])[1] += 1
    table = df.sparkSession.createDataFrame(
        [(*g, first, count) for g, (first, count) in spans.items()],
        T.StructType(
            [
                *[df.schema[c] for c in by],
                T.StructField(_FIRST, T.IntegerType()),
                T.StructField(_COUNT, T.IntegerType()),
            ]
        ),
    )
    # What one row per block weighs, by the keys alone.
    width = max(sum(len(str(v).encode()) + 24 for v in g) + 32 for g in spans)
    return table, cuts, max(count for _, count in spans.values()), (len(rows) + len(spans), width)


def _apart(number: Column) -> Column:
    """``number`` as a generated column.

    As a plain column the search would be pushed into the inputs of a union below it, where
    Spark takes the renumbered variables of the search for columns with small numbers, those
    that a session reads first, and stops with "key not found".
    """
    return F.explode(F.array(number))


def _numbered(df: DataFrame, by: list[str], order: Order, found, out: str) -> DataFrame:
    """Add how many of the listed cut points a row comes after; null outside the groups that have any."""
    table, cuts, most, size = found
    if by:
        small = size[0] * size[1] <= broadcast_bytes(df.sparkSession)
        marked = lookup_join(df, table, by, small=small)
    else:
        marked = df.withColumns({_FIRST: F.lit(0), _COUNT: F.lit(most)})
    # The list of cuts is one constant of the plan; a row carries only its place in it.
    number = leading_count(
        F.col(_COUNT), most, lambda i: _comes_after(order, F.get(cuts, F.col(_FIRST) + i))
    )
    return marked.withColumn(out, _apart(F.when(F.col(_COUNT).isNotNull(), number))).drop(_FIRST, _COUNT)


def _two_levels(df: DataFrame, by: list[str], order: Order, limit: int) -> tuple[DataFrame, tuple[int, int]]:
    """Blocks where the cut points are too many for a list.

    A coarse list, one cut for about FAN blocks, is a constant of the plan. The cuts inside a
    coarse cell are found in a sample of that cell, one task per cell, and reach the rows as
    an array of at most about FAN cuts, joined by group and cell. Nothing but the coarse list
    comes to the driver.
    """
    names = [f"k{i}" for i in range(len(order))]
    coarse = _cut_points(df, by, order, limit * FAN)
    if coarse is None:
        marked = df.withColumn(_COARSE, F.lit(None).cast("int"))
    else:
        marked = _numbered(df, by, order, coarse, _COARSE)
    inner = [*by, _CELL]
    marked = marked.withColumn(_CELL, F.coalesce(_COARSE, F.lit(0)))
    fine = (
        _picked(marked, inner, order, limit)
        .groupBy(*inner)
        .agg(F.sort_array(F.collect_list(F.struct("__rn", *names))).alias(_CUTS))
    )
    measured = fine.agg(
        F.sum(F.size(_CUTS) + 1).alias("n"),
        F.max(F.size(_CUTS)).alias("most"),
        F.max(F.octet_length(F.to_json(F.struct(*inner)))).alias("width"),
    ).first()
    marked = lookup_join(marked, fine, inner, small=table_fits(fine))
    number = leading_count(
        F.size(_CUTS), measured["most"] or 1, lambda i: _comes_after(order, F.get(_CUTS, i))
    )
    large = F.col(_COARSE).isNotNull() | F.col(_CUTS).isNotNull()
    inside = F.when(F.col(_CUTS).isNotNull(), number).otherwise(0)
    block = F.shiftleft(F.col(_CELL).cast("long"), 32) + inside
    marked = marked.withColumn(BLOCK, _apart(F.when(large, block))).withColumn(LARGE, F.coalesce(large, F.lit(False)))
    blocks = (measured["n"] or 0) + (coarse[3][0] if coarse else 0)
    return marked.drop(_COARSE, _CELL, _CUTS), (blocks, 2 * (measured["width"] or 0) + 64)


def assign_blocks(
    df: DataFrame, by: Sequence[str], order_by, limit: int | None = None
) -> tuple[DataFrame, tuple[int, int] | None]:
    """Add the block number (null outside large groups) if any group is large.

    Also returns the number of blocks and the bytes of a block's key, or None.
    """
    by, order = list(by), parse_order(order_by)
    spark = df.sparkSession
    limit = rows_per_block(spark, limit)
    if limit >= WHOLE_GROUPS:
        return df, None
    if not by:
        # A table without groups is spread over the tasks even when it is not large.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        limit = min(limit, max(_SMALLEST_BLOCK, -(-df.count() // tasks)))
    found = _cut_points(df, by, order, limit, LISTED_CUTS)
    if found is None:
        return df, None
    if found is _TOO_MANY:
        return _two_levels(df, by, order, limit)
    marked = _numbered(df, by, order, found, BLOCK)
    return marked.withColumn(LARGE, F.col(BLOCK).isNotNull()), found[3]


class OrderedBlocks:
    """A table prepared for ordered work within ``by``."""

    def __init__(self, df: DataFrame, by, order_by, limit: int | None = None):
        self.by = list(by or [])
        self.order = parse_order(order_by)
        self.df, self.size = assign_blocks(df, self.by, order_by, limit)
        self.split = self.size is not None
        self.keys = [*self.by, BLOCK] if self.split else self.by

    def fits(self, table: DataFrame, item_bytes: int = 0) -> bool:
        """Whether a table of one row per block may be broadcast.

        Its rows are counted off the cut points; ``item_bytes`` is the most that arrays in a
        row hold. Values of unknown width are measured.
        """
        blocks, width = self.size or (1, 32)
        own = [f.dataType for f in table.schema if f.name not in self.keys]
        wide = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
        if not item_bytes and any(isinstance(t, wide) for t in own):
            return table_fits(table)
        bytes_ = blocks * (width + 16 * len(own) + item_bytes)
        return bytes_ <= broadcast_bytes(table.sparkSession)

    def window(self, backwards: bool = False) -> WindowSpec:
        # Without keys the window covers one block of rows whose number was checked.
        return Window.partitionBy(*self.keys).orderBy(*sort_columns(self.order, backwards))

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def is_first(self, number: Column) -> Column:
        """Whether a row numbered within its block is the first of its group.

        Every cut point is a row's key, so block 0 is never empty.
        """
        if not self.split:
            return number == 1
        return (number == 1) & (F.coalesce(F.col(BLOCK), F.lit(0)) == 0)

    def _blocks_in_order(self) -> WindowSpec:
        # One row per block: its length is the block count, not the row count.
        return Window.partitionBy(*self.by).orderBy(BLOCK)

    def carry(
        self, df: DataFrame, parts: dict[str, tuple[Column, Callable[[Column], Column]]]
    ) -> DataFrame:
        """Add, for each row, summaries of the blocks before its own.

        ``parts`` maps a new column to (aggregate of one block, aggregate that joins
        block summaries). Rows outside large groups and in a first block get null.
        """
        if not self.split:
            return df.withColumns(
                {n: F.lit(None).cast(_type_of(df, self.keys, agg)) for n, (agg, _) in parts.items()}
            )
        totals = (
            df.where(LARGE)
            .groupBy(*self.keys)
            .agg(*[agg.alias(n) for n, (agg, _) in parts.items()])
        )
        earlier = self._blocks_in_order().rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(
            *self.keys, *[join(F.col(n)).over(earlier).alias(n) for n, (_, join) in parts.items()]
        )
        return lookup_join(df, before, self.keys, small=self.fits(before))

    def with_lookback(self, k: int) -> DataFrame:
        """The rows, plus marked copies of the k rows before each block.

        The copies number at most k per block. A row_number limit keeps the search for
        them to k rows per task and block before anything is shuffled.
        """
        rows = self.df.withColumn(COPY, F.lit(False))
        if not self.split or k < 1:
            return rows
        large = self.df.where(LARGE)
        tails = large.withColumn("__back", F.row_number().over(self.window(True))).where(
            F.col("__back") <= k
        )
        in_order = self._blocks_in_order()
        # Blocks that start within k rows of where a block starts, itself included.
        reach = Window.partitionBy(*self.by).orderBy("__start").rangeBetween(0, k - 1)
        ends = (
            large.groupBy(*self.keys)
            .agg(F.count(F.lit(1)).alias("__n"))
            .withColumn(
                "__start",
                F.coalesce(
                    F.sum("__n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0),
                ),
            )
            .withColumn("__end", F.col("__start") + F.col("__n"))
            .withColumn("__here", F.collect_list(F.struct(BLOCK, "__start")).over(reach))
            .withColumn("__later", F.lead("__here").over(in_order))
            .drop("__n", "__start", "__here")
        )
        # A block's list names the blocks that start within k rows, itself included.
        reached = 48 * min(k + 1, self.size[0])
        copies = (
            lookup_join(tails, ends, self.keys, how="inner", small=self.fits(ends, reached))
            .withColumn("__reach", F.col("__end") - F.col("__back") + k)
            .withColumn(
                "__target",
                F.explode(F.filter("__later", lambda b: b["__start"] <= F.col("__reach"))),
            )
            .withColumn(BLOCK, F.col(f"__target.{BLOCK}"))
            .withColumn(COPY, F.lit(True))
        )
        return rows.unionByName(copies.select(*rows.columns))

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop the copies and helper columns."""
        if COPY in df.columns:
            df = df.where(~F.col(COPY)).drop(COPY)
        return df.drop(BLOCK, LARGE)

    def ordered(self, value: Column) -> Column:
        """``value``, or an error if two rows of a group share their order key.

        Rides on the sort the window needs anyway.
        """
        key = F.struct(*[c for c, _ in self.order])
        tie = F.lag(key).over(self.window()).eqNullSafe(key)
        names = ", ".join(c for c, _ in self.order)
        message = f"order_by ({names}) does not fix the order of the rows in a group"
        return F.when(tie, F.raise_error(F.lit(message))).otherwise(value)


def _type_of(df: DataFrame, keys: Sequence[str], agg: Column) -> T.DataType:
    return df.groupBy(*keys).agg(agg.alias("v")).schema["v"].dataType
