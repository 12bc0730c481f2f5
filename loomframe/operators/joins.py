"""Joins by equality, per group, by inequality, by closest value, by interval."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.operators.grid import product
from loomframe.plans.blocks import (
    EXACT_JSON,
    WHOLE_GROUPS,
    OrderedBlocks,
    constant_list,
    leading_count,
)
from loomframe.plans.matching import lookup_join
from loomframe.plans.sizing import large_groups, row_bytes, rows_per_block, table_fits

_COMPARE = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}
_INLINE_STEPS = 256
_LISTED_BYTES = 8 * 1024 * 1024
_RANGE_ROWS, _MOST_RANGES = 1_000, 4_096


def _pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, dict):
        return list(on.items())
    return [(c, c) if isinstance(c, str) else tuple(c) for c in on]


def _suffixed(left: DataFrame, right: DataFrame, suffix: tuple[str, str]):
    """Rename the columns both sides have."""
    clash = [c for c in left.columns if c in right.columns]
    return (
        left.withColumnsRenamed({c: c + suffix[0] for c in clash}),
        right.withColumnsRenamed({c: c + suffix[1] for c in clash}),
    )


def _equi(left, right, on, how, suffix, na_matches) -> DataFrame:
    pairs = _pairs(on)
    rkeys = [r for _, r in pairs]
    hidden = {r: f"__right_{i}" for i, r in enumerate(rkeys)}
    right = right.withColumnsRenamed(hidden)
    left, right = _suffixed(left, right, suffix)
    equal = [
        F.col(l).eqNullSafe(F.col(hidden[r])) if na_matches == "na" else F.col(l) == F.col(hidden[r])
        for l, r in pairs
    ]
    joined = left.join(right, reduce(lambda a, b: a & b, equal), how)
    if how == "right":
        joined = joined.withColumns({l: F.col(hidden[r]) for l, r in pairs})
    return joined.drop(*hidden.values())


def left_join(
    left: DataFrame,
    right: DataFrame,
    on,
    suffix: tuple[str, str] = ("_x", "_y"),
    na_matches: str = "never",
) -> DataFrame:
    """All left rows with their matches.

    ``on`` is a name, a list of names or {left name: right name}. The key is kept once;
    other columns on both sides get the suffixes. Missing keys match only with
    ``na_matches="na"``.
    """
    return _equi(left, right, on, "left", suffix, na_matches)


def right_join(
    left: DataFrame,
    right: DataFrame,
    on,
    suffix: tuple[str, str] = ("_x", "_y"),
    na_matches: str = "never",
) -> DataFrame:
    """All right rows with their matches; the key is named as on the left."""
    return _equi(left, right, on, "right", suffix, na_matches)


def join_per_group(
    df: DataFrame, roster: DataFrame, by: Sequence[str], on: Sequence[str]
) -> DataFrame:
    """In every group, all members of the roster: its rows in ``df``, or one blank row.

    Rows of ``df`` that are not on the roster go. The table is joined to the roster by
    key; only its distinct (group, member) pairs are held against the full list.
    """
    by, on = list(by), list(on)
    keys = [*by, *on]
    small = table_fits(roster)
    found = lookup_join(df, roster, on, how="inner", small=small)
    expected = product(df.select(*by).distinct(), roster.select(*on).distinct())
    absent = lookup_join(expected, df.select(*keys).distinct(), keys, how="left_anti")
    absent = lookup_join(absent, roster, on, how="inner", small=small)
    return found.unionByName(absent, allowMissingColumns=True)


def stack_rows(*tables: DataFrame) -> DataFrame:
    """Rows of all tables under each other, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


# ---------------------------------------------------------------- inequality


def _usable(df: DataFrame, c: str) -> Column:
    """The column with NaN as a missing value."""
    kind = df.schema[c].dataType
    return F.nanvl(c, F.lit(None)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c)


def _sorted_steps(values: DataFrame, backwards: bool = False) -> tuple[Column, int]:
    """The values of a one-column table, sorted by Spark, as a list constant of their own type."""
    (name,) = values.columns
    at = F.col(name)
    ordered = values.orderBy(at.desc() if backwards else at.asc())
    texts = ordered.select(F.to_json(F.struct(name), EXACT_JSON).alias("j")).collect()
    return constant_list([r["j"] for r in texts], values.schema), len(texts)


def join_inequality(
    left: DataFrame,
    lookup: DataFrame,
    left_col: str,
    op: str,
    right_col: str,
    how: str = "left",
    suffix: tuple[str, str] = ("_x", "_y"),
    by: Sequence[str] = (),
) -> DataFrame:
    """All lookup rows with ``left_col op right_col``, of equal keys if ``by`` names any.

    The lookup's values are cut into ranges of about a thousand rows (at most 4,096 ranges),
    at values of a sample that Spark sorts, so any type with an order will do. A left row is
    sent to the ranges it can match (whole ranges, and one in which the condition is
    checked), so hardly any pairs are made that do not belong to the result. Missing values,
    NaN among them, match nothing.
    """
    compare = _COMPARE[op]
    upward = op in ("<=", "<")
    bys = [f"__by_{i}" for i in range(len(by))]
    lookup = lookup.withColumnsRenamed(dict(zip(by, bys)))
    left, lookup = _suffixed(left, lookup, suffix)
    rcol = right_col if right_col in lookup.columns else right_col + suffix[1]
    lcol = left_col if left_col in left.columns else left_col + suffix[0]
    value = _usable(left, lcol)
    usable = lookup.where(_usable(lookup, rcol).isNotNull())
    n = usable.count()
    parts = max(1, min(_MOST_RANGES, -(-n // _RANGE_ROWS)))
    seen = usable.select(F.col(rcol).alias("c"))
    if n > 32 * parts:
        seen = seen.where(F.rand(7) < 32 * parts / n)
    along = F.row_number().over(Window.orderBy("c"))
    count = F.count(F.lit(1)).over(Window.partitionBy())
    # One value in about 32, of a sample of at most 32 for each range.
    marks = seen.withColumns({"r": along, "n": count}).where(
        F.floor(F.col("r") * parts / F.col("n")) > F.floor((F.col("r") - 1) * parts / F.col("n"))
    )
    cuts, n_cuts = _sorted_steps(marks.where("r < n").select("c").distinct())

    def place(v: Column) -> Column:
        if not n_cuts:
            return F.lit(0)
        return leading_count(F.lit(n_cuts), n_cuts, lambda i: F.get(cuts, i)["c"] < v)

    right = usable.withColumn("__bin", place(F.col(rcol)))
    own = place(value)
    reach = F.sequence(own, F.lit(n_cuts)) if upward else F.sequence(F.lit(0), own)
    equal = [F.col(b) == F.col(r) for b, r in zip(by, bys)]
    if by:
        # Whether a group has a match is seen from its outermost value.
        outer = usable.groupBy(*bys).agg((F.max if upward else F.min)(rcol).alias("__edge"))
        outer = outer.withColumnsRenamed({r: f"__edge{r}" for r in bys})
        met = [F.col(b) == F.col(f"__edge{r}") for b, r in zip(by, bys)]
        edged = left.join(outer, reduce(lambda a, b: a & b, met), "left").drop(*[f"__edge{r}" for r in bys])
    else:
        edge = usable.agg((F.max if upward else F.min)(rcol).alias("e")).select("e").scalar()
        edged = left.withColumn("__edge", edge)
    has = F.coalesce(compare(value, F.col("__edge")), F.lit(False))
    # A row without any match goes to no range, and comes back alone.
    probes = edged.withColumn("__probe", F.explode(F.when(has, reach).otherwise(F.array(F.lit(-1)))))
    probes = probes.drop("__edge")
    if how == "inner":
        probes = probes.where("__probe >= 0")
    if table_fits(right):
        right = F.broadcast(right)
    same = (F.col("__probe") == F.col("__bin")) & compare(value, F.col(rcol))
    joined = probes.join(right, reduce(lambda a, b: a & b, [same, *equal]), "left")
    return joined.where("__probe < 0 OR __bin IS NOT NULL").drop("__probe", "__bin", *bys)


# ---------------------------------------------------------------- closest


def _by_conditions(v: Column, op: str, steps: Column, n: int) -> Column:
    """The closest value as nested conditions, which stay in generated code."""
    compare = _COMPARE[op]

    def step(i: int) -> Column:
        return F.get(steps, F.lit(i))["__at"]

    def pick(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return step(lo)
        mid = (lo + hi) // 2
        return F.when(compare(v, step(mid)), pick(mid, hi)).otherwise(pick(lo, mid))

    return F.when(compare(v, step(0)), pick(0, n))


def _by_search(v: Column, op: str, steps: Column, n: int) -> Column:
    """The closest value by binary search in one sorted list shared by all rows."""
    compare = _COMPARE[op]
    passed = leading_count(
        F.lit(n), n, lambda i: F.coalesce(compare(v, F.get(steps, i)["__at"]), F.lit(False))
    )
    return F.get(steps, passed - 1)["__at"]


def join_closest(
    left: DataFrame,
    lookup: DataFrame,
    left_col: str,
    op: str,
    right_col: str,
    by: Sequence[str] = (),
    suffix: tuple[str, str] = ("_x", "_y"),
    strategy: str = "auto",
) -> DataFrame:
    """Each left row with the lookup rows at the closest value for which ``op`` holds.

    All lookup rows tied at that value join; a row without a match keeps nulls. With
    ``by`` the match is sought within equal keys. Missing values and keys, NaN among the
    values, match nothing.

    ``strategy`` may be "conditions" (the lookup's values as nested conditions in generated
    code), "list" (a sorted constant that each row searches) or "scan": both tables are put
    in one order and the last lookup value is carried forward; large groups and an ungrouped
    table are scanned in blocks over distinct values. The first two take no ``by`` and do
    not shuffle the left table. Left alone, up to 256 values become conditions and up to
    8 MB of them a list. All give the same rows.
    """
    by = list(by)
    if strategy not in ("auto", "conditions", "list", "scan"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if by and strategy in ("conditions", "list"):
        raise ValueError(f"strategy {strategy!r} takes no by")
    lookup = lookup.where(_usable(lookup, right_col).isNotNull())
    lookup = lookup.dropna(subset=by) if by else lookup
    bys = [f"__by_{i}" for i in range(len(by))]
    lookup = lookup.withColumnsRenamed(dict(zip(by, bys)))
    left, lookup = _suffixed(left, lookup, suffix)
    left_col = left_col if left_col in left.columns else left_col + suffix[0]
    shown = right_col if right_col in lookup.columns else right_col + suffix[1]
    lookup = lookup.withColumnRenamed(shown, "__at")
    if not by and strategy != "scan":
        values = lookup.select("__at").distinct()
        size = values.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(values.schema)).alias("b")).first()
        if strategy != "auto" or (size["b"] or 0) <= _LISTED_BYTES:
            steps, n = _sorted_steps(values, backwards=op in ("<=", "<"))
            if strategy == "auto":
                strategy = "conditions" if n <= _INLINE_STEPS else "list"
            find = _by_conditions if strategy == "conditions" else _by_search
            value = _usable(left, left_col)
            best = find(value, op, steps, n) if n else F.lit(None)
            best = best.cast(lookup.schema["__at"].dataType)
            return _attach_at(left.withColumn("__best", best), lookup, [], [], shown)

    unique = not lookup.groupBy(*bys, "__at").count().where("count > 1").limit(1).count()
    payload = [c for c in lookup.columns if c not in bys] if unique else ["__at"]
    heavy = not by or bool(
        large_groups(
            left.select(*by).union(lookup.select(*bys)), by, rows_per_block(left.sparkSession)
        )
    )
    probes = left.select(*by, left_col).distinct() if heavy else left
    limit = None if heavy else WHOLE_GROUPS
    best = _scan_closest(probes, lookup, by, bys, left_col, op, payload, limit)
    if heavy:
        table = best.select(*by, left_col, "__hit")
        best = lookup_join(left, table, [*by, left_col])
    if unique:
        cells = [F.col("__hit")[c].alias(shown if c == "__at" else c) for c in payload]
        return best.select(*left.columns, *cells)
    chosen = best.withColumn("__best", F.col("__hit")["__at"]).drop("__hit")
    return _attach_at(chosen, lookup, by, bys, shown)


def _attach_at(chosen, lookup, by, bys, shown) -> DataFrame:
    """Join the lookup rows at the chosen value, ties and all."""
    equal = [F.col(b) == F.col(r) for b, r in zip(by, bys)]
    equal.append(F.col("__best") == F.col("__at"))
    right = F.broadcast(lookup) if table_fits(lookup) else lookup
    joined = chosen.join(right, reduce(lambda a, b: a & b, equal), "left")
    return joined.drop("__best", *bys).withColumnRenamed("__at", shown)


def _scan_closest(probes, lookup, by, bys, left_col, op, payload, limit) -> DataFrame:
    """Walk both tables in one order and carry the last lookup row to each probe."""
    backwards = op in ("<=", "<")
    right_first = op in (">=", "<=")
    rights = lookup.select(
        *[F.col(r).alias(b) for r, b in zip(bys, by)],
        F.col("__at").alias("__t"),
        F.lit(0 if right_first else 1).alias("__side"),
        F.lit(False).alias("__probe"),
        F.struct(*payload).alias("__hit"),
    )
    if payload == ["__at"]:
        rights = rights.distinct()
    lefts = probes.withColumns(
        {
            "__t": _usable(probes, left_col),
            "__side": F.lit(1 if right_first else 0),
            "__probe": F.lit(True),
        }
    )
    rows = lefts.unionByName(rights, allowMissingColumns=True)
    order = ["-__t" if backwards else "__t", "__side"]
    blocks = OrderedBlocks(rows, by, order, limit)
    last = F.last("__hit", ignorenulls=True).over(blocks.running())
    scanned = blocks.df.withColumn("__last", last)
    ahead = F.col("__hit")
    place = F.when(ahead.isNotNull(), F.col("__t"))
    newest = (F.min_by if backwards else F.max_by)(ahead, place)
    scanned = blocks.carry(
        scanned, {"__earlier": (newest, lambda c: F.last(c, ignorenulls=True))}
    )
    hit = F.when(F.col("__t").isNotNull(), F.coalesce("__last", "__earlier"))
    found = scanned.withColumn("__found", hit).where("__probe")
    found = found.drop("__hit", "__last", "__earlier", "__t", "__side", "__probe")
    return blocks.finish(found.withColumnRenamed("__found", "__hit"))


# ---------------------------------------------------------------- intervals


def _number(c: str, dtype: T.DataType) -> Column:
    """A number in the order of the column's values."""
    if isinstance(dtype, T.NumericType):
        return F.col(c).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(F.col(c)).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(F.col(c)).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(c)).cast("double")
    raise ValueError(f"no interval join on {dtype.simpleString()}")


def _points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    at: str,
    start: str,
    end: str,
    cond: Column,
    equal: Sequence[tuple[str, str]],
) -> DataFrame:
    """Pairs with start <= at <= end that also meet ``cond``; every pair comes up once.

    The axis is cut into bins whose width doubles from level to level. An interval is
    filed on the level of its own length, where it touches at most two bins (one without
    length under its value), a point once on each level in use, and the two meet by equality
    of level, bin and the columns ``equal`` pairs up. Intervals of one length therefore never
    share a bin with much shorter ones, and a crowded bin is a join key that adaptive
    execution can cut.
    """
    ptype, stype = points.schema[at].dataType, intervals.schema[start].dataType
    etype = intervals.schema[end].dataType
    low, high = _number(start, stype), _number(end, etype)
    length = high - low
    # Lengths below the smallest normal number count as none; ends are compared exactly.
    level = F.when(length > _TINY, F.ceil(F.log2(length)).cast("int")).otherwise(_NO_LENGTH)
    filed = intervals.where(low <= high).withColumn("__level", level)

    def bin_of(x: Column, lev: Column) -> Column:
        cut = F.floor(x / F.pow(F.lit(2.0), lev)).cast("double")
        return F.when(lev == _NO_LENGTH, x).otherwise(cut)

    used = filed.agg(F.sort_array(F.collect_set("__level")).alias("u")).first()["u"]
    ends = F.array_distinct(F.array(bin_of(low, F.col("__level")), bin_of(high, F.col("__level"))))
    filed = filed.withColumn("__bin", F.explode(ends))
    spread = (
        points.where(F.col(at).isNotNull())
        .withColumn("__plevel", F.explode(F.array(*[F.lit(v) for v in used or [0]])))
        .withColumn("__pbin", bin_of(_number(at, ptype), F.col("__plevel")))
    )
    meet = (F.col("__plevel") == F.col("__level")) & (F.col("__pbin") == F.col("__bin"))
    for a, b in equal:
        meet = meet & (F.col(a) == F.col(b))
    inside = (F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))
    return spread.join(filed, meet & inside & cond).drop("__plevel", "__pbin", "__level", "__bin")


# What level intervals without length are filed on, and what counts as no length.
_NO_LENGTH, _TINY = -10_000, 2.3e-308


def _interval_join(x, y, x_span, y_span, how, key, suffix, by, pairs) -> DataFrame:
    if how == "left" and not key:
        raise ValueError("how='left' needs the key columns of the left table")
    bys = [f"__by_{i}" for i in range(len(by))]
    y = y.withColumnsRenamed(dict(zip(by, bys)))
    x, y = _suffixed(x, y, suffix)
    xs, xe = (c if c in x.columns else c + suffix[0] for c in x_span)
    ys, ye = (c if c in y.columns else c + suffix[1] for c in y_span)
    columns = [*x.columns, *[c for c in y.columns if c not in bys]]
    matched = pairs(x, y, xs, xe, ys, ye, list(zip(by, bys))).select(*columns)
    if how == "inner":
        return matched
    keys = [c if c in x.columns else c + suffix[0] for c in key]
    alone = lookup_join(x, matched.select(*keys).distinct(), keys, how="left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def join_within(
    x: DataFrame,
    y: DataFrame,
    x_span: tuple[str, str],
    y_span: tuple[str, str],
    how: str = "inner",
    key: Sequence[str] = (),
    suffix: tuple[str, str] = ("_x", "_y"),
    by: Sequence[str] = (),
) -> DataFrame:
    """Pairs in which the interval of ``x`` lies within that of ``y``, ends included.

    With ``by`` only rows of equal keys are paired.
    """

    def pairs(x, y, xs, xe, ys, ye, equal):
        inside = (F.col(xs) <= F.col(xe)) & (F.col(xe) <= F.col(ye))
        return _points_in_intervals(x, y, xs, ys, ye, inside, equal)

    return _interval_join(x, y, x_span, y_span, how, key, suffix, by, pairs)


def join_overlap(
    x: DataFrame,
    y: DataFrame,
    x_span: tuple[str, str],
    y_span: tuple[str, str],
    how: str = "inner",
    key: Sequence[str] = (),
    suffix: tuple[str, str] = ("_x", "_y"),
    by: Sequence[str] = (),
) -> DataFrame:
    """Pairs of intervals that share a point, ends included.

    Either y starts in x, or x starts in y after y's start: two joins without common
    pairs. With ``by`` only rows of equal keys are paired.
    """

    def pairs(x, y, xs, xe, ys, ye, equal):
        first = _points_in_intervals(y, x, ys, xs, xe, F.col(ys) <= F.col(ye), equal)
        starts_later = (F.col(ys) < F.col(xs)) & (F.col(xs) <= F.col(xe))
        second = _points_in_intervals(x, y, xs, ys, ye, starts_later, equal)
        return first.unionByName(second)

    return _interval_join(x, y, x_span, y_span, how, key, suffix, by, pairs)
