"""Equality joins whose keys are heavy on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.operators.joins import _equi, _pairs
from loomframe.plans.sizing import rows_per_block

#: A key is heavy if it has a block of rows and this share of its table, so few are.
_SHARE = 1_000
#: Counters of the sketch: it is off by well below a fifth of the share above.
_COUNTERS = 10_000
_NULL_SLICES = 1_000


def _heavy(df: DataFrame, keys: list[str], limit: int) -> set[int]:
    """Hashes of the keys that are heavy, from a frequent-items sketch merged over the tasks."""
    present = df.select(F.xxhash64(*keys).alias("__h"), *keys).dropna(subset=keys)
    seen = present.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(__h, {2 * _SHARE}, {_COUNTERS})").alias("top")).first()
    slack = seen["n"] / (5 * _SHARE)
    return {x["item"] for x in seen["top"] or () if x["count"] + slack > max(limit, seen["n"] / _SHARE)}


def _counts(df: DataFrame, keys: list[str], hot: set[int], out: str) -> DataFrame:
    rows = df.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).where(F.xxhash64(*(f"__k{i}" for i in range(len(keys)))).isin(list(hot)))
    return rows.dropna().groupBy(*rows.columns).agg(F.count("*").alias(out))


def heavy_keys(left: DataFrame, right: DataFrame, on, limit: int) -> DataFrame | None:
    """__k0.., __cut_left, __cut_right, __both: the heavy keys, counted exactly, and the slices of
    either side; None if there are none. A constant of the plan of at most a few thousand rows."""
    pairs = _pairs(on)
    lkeys, rkeys = [l for l, _ in pairs], [r for _, r in pairs]
    hot = _heavy(left, lkeys, limit) | _heavy(right, rkeys, limit)
    if not hot:
        return None
    keys = [f"__k{i}" for i in range(len(pairs))]
    counted = _counts(left, lkeys, hot, "__left").join(_counts(right, rkeys, hot, "__right"), keys, "full")
    slices = [F.greatest(F.ceil(F.coalesce(n, F.lit(0)) / limit), F.lit(1)).cast("int") for n in (F.col("__left"), F.col("__right"))]
    cut = counted.select(
        *keys,
        slices[0].alias("__cut_left"),
        slices[1].alias("__cut_right"),
        (F.col("__left").isNotNull() & F.col("__right").isNotNull()).alias("__both"),
    ).where("__cut_left > 1 or __cut_right > 1")
    found = cut.collect()
    return left.sparkSession.createDataFrame(found, cut.schema) if found else None


def deal(df: DataFrame, keys: list[str], cuts: DataFrame, side: str) -> DataFrame:
    """Rows with their cell __row, __col of the grid of their key: a left row stands in one line of
    the grid, a right row in one column. Rows of other keys have cell 0, 0; rows without a key,
    which meet nobody, are spread."""
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    spread = F.xxhash64(F.lit(side), *hashed)
    match = None
    for i, k in enumerate(keys):
        equal = df[k] == cuts[f"__k{i}"]
        match = equal if match is None else match & equal
    own, across = ("__cut_left", "__cut_right") if side == "left" else ("__cut_right", "__cut_left")
    line, other = ("__row", "__col") if side == "left" else ("__col", "__row")
    absent = F.lit(False)
    for k in keys:
        absent = absent | df[k].isNull()
    slices = F.when(absent, _NULL_SLICES).otherwise(F.coalesce(F.col(own), F.lit(1)))
    return (
        df.withColumn("__spread", spread)
        .join(F.broadcast(cuts), match, "left")
        .withColumn(line, F.pmod("__spread", slices).cast("int"))
        .withColumn("__both", F.coalesce("__both", F.lit(False)))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(across), F.lit(1)) - 1)))
        .select(*df.columns, "__row", "__col", "__both")
    )


def join_hot_keys(
    left: DataFrame,
    right: DataFrame,
    on,
    how: str = "left",
    suffix: tuple[str, str] = ("_x", "_y"),
    limit: int | None = None,
) -> DataFrame:
    """``left_join`` (or an inner join, ``how="inner"``) for keys that are heavy on both sides.

    A sketch of each side finds the keys with more rows than a block (``limit``, by default
    ``loomframe.rowsPerBlock``) and a thousandth of the table. Such a key becomes a grid: left
    rows are dealt over its lines, right rows over its columns, and each copy goes to one cell
    of about a block of either side, so each pair meets once, in one of many tasks. Without
    such keys it is the plain join. Rows are dealt by a hash of their columns, so a task that
    runs again deals alike; rows equal in all columns stand in one slice.

    Missing keys never match; left rows without a match stay in a left join. Key columns have
    the same type on both sides and are not floating.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is 'left' or 'inner'")
    pairs = _pairs(on)
    for l, r in pairs:
        a, b = left.schema[l].dataType, right.schema[r].dataType
        if a != b or isinstance(a, (T.FloatType, T.DoubleType)):
            raise TypeError(f"{l} and {r}: keys need one type, and none that floats, not {a.simpleString()} and {b.simpleString()}")
    limit = rows_per_block(left.sparkSession, limit)
    cuts = heavy_keys(left, right, on, limit)
    if cuts is None:
        return _equi(left, right, on, how, suffix, "never")
    lefts = deal(left, [l for l, _ in pairs], cuts, "left")
    rights = deal(right, [r for _, r in pairs], cuts, "right").drop("__both").withColumn("__hit", F.lit(True))
    joined = _equi(lefts, rights, [*pairs, ("__row", "__row"), ("__col", "__col")], how, suffix, "never")
    if how == "left":
        # A cell may hold left rows only; a heavy key of both sides has no row without a match.
        joined = joined.where(F.col("__hit").isNotNull() | ~F.col("__both"))
    return joined.drop("__row", "__col", "__both", "__hit")
