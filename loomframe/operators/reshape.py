"""Wide to long, long to wide, and one column to several."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.select import resolve

VALUE = ".value"
_INLINE_CELLS = 24


def pivot_longer(
    df: DataFrame,
    ids=None,
    cols=None,
    names_to: str | Sequence[str] = "name",
    values_to: str = "value",
    names_pattern: str | None = None,
    names_cast: dict[str, str] | None = None,
    values_drop_na: bool = False,
) -> DataFrame:
    """Turn columns into rows.

    Give the identifying columns (``ids``) or the ones to stack (``cols``). With
    ``names_pattern`` the groups of the expression become the ``names_to`` columns; the
    group named ``.value`` says which output column a cell goes to. Names are taken
    apart once, on the schema, and the rows are made in one pass without a shuffle.
    """
    if (ids is None) == (cols is None):
        raise ValueError("give either ids or cols")
    if cols is not None:
        stacked = resolve(df, cols)
        kept = [c for c in df.columns if c not in stacked]
    else:
        kept = resolve(df, ids)
        stacked = [c for c in df.columns if c not in kept]
    names = [names_to] if isinstance(names_to, str) else list(names_to)
    casts = names_cast or {}

    parsed = []
    for c in stacked:
        if names_pattern is None:
            groups = (c,)
        else:
            hit = re.fullmatch(names_pattern, c)
            if hit is None:
                raise ValueError(f"column {c!r} does not match {names_pattern!r}")
            groups = hit.groups() or (hit.group(0),)
        if len(groups) != len(names):
            raise ValueError(f"{len(names)} names for {len(groups)} parts of {c!r}")
        part = dict(zip(names, groups))
        parsed.append((c, part.pop(VALUE, values_to), part))

    key_names = [n for n in names if n != VALUE]
    value_names = list(dict.fromkeys(v for _, v, _ in parsed))
    for v in value_names:
        types = {df.schema[c].dataType.simpleString() for c, target, _ in parsed if target == v}
        if len(types) > 1:
            raise ValueError(f"cells for {v!r} have different types: {', '.join(sorted(types))}")

    cells: dict[tuple, dict[str, str]] = {}
    for c, target, part in parsed:
        cells.setdefault(tuple(part[n] for n in key_names), {})[target] = c
    sample = {v: next(c for c, t, _ in parsed if t == v) for v in value_names}
    rows = []
    for key, by_value in cells.items():
        fields = []
        for n, text in zip(key_names, key):
            literal = F.lit(text)
            fields.append((literal.try_cast(casts[n]) if n in casts else literal).alias(n))
        for v in value_names:
            blank = F.lit(None).cast(df.schema[sample[v]].dataType)
            fields.append((F.col(by_value[v]) if v in by_value else blank).alias(v))
        rows.append(F.struct(*fields))
    long = df.select(*kept, F.inline(F.array(*rows)))
    if values_drop_na:
        long = long.dropna(how="all", subset=value_names)
    return long


def _cell_value(how: str, x: Column, here: Column, order_by: Sequence[str]) -> Column:
    """Aggregate that makes one cell of the rows for which ``here`` holds; null without any."""
    if how == "error":
        # The cell holds one value; the largest of one needs the smaller buffer.
        return F.max(F.when(here, x))
    if how == "list":
        order = [F.col(c) for c in order_by]
        got = F.collect_list(F.when(here, F.struct(*order, x.alias("__x"))))
        items = F.transform(F.array_sort(got), lambda s: s["__x"])
        return F.when(F.count_if(here) > 0, items)
    raise ValueError(f"unknown values_fn {how!r}")


def pivot_wider(
    df: DataFrame,
    names_from: str,
    values_from: str | Sequence[str],
    id_cols: Sequence[str] | None = None,
    values: Sequence | None = None,
    names_prefix: str = "",
    values_fn: str | Callable[[Column], Column] = "error",
    values_fill=None,
    order_by: Sequence[str] = (),
    unlisted: str = "error",
    most_columns: int | None = None,
) -> DataFrame:
    """Turn the values of ``names_from`` into columns.

    ``values`` fixes the columns and their order, and a value that is not among them is an
    error unless ``unlisted`` is "drop"; without ``values`` one distinct job finds them, and
    stops above ``most_columns`` if that is given. A cell with several rows is an error
    unless ``values_fn`` is "list", "first" (by ``order_by``, tied first rows being an error)
    or an aggregate, which sees the rows of its cell only. A cell without rows is null, or
    ``values_fill``. Cells are aggregated before the shuffle, so a heavy id costs one row
    per task.
    """
    measures = [values_from] if isinstance(values_from, str) else list(values_from)
    ids = (
        [c for c in df.columns if c != names_from and c not in measures]
        if id_cols is None
        else list(id_cols)
    )
    key = F.coalesce(F.col(names_from).cast("string"), F.lit("NA"))
    if values is None:
        found = df.select(key.alias("k")).distinct().orderBy("k")
        rows = (found if most_columns is None else found.limit(most_columns + 1)).collect()
        if most_columns is not None and len(rows) > most_columns:
            raise ValueError(f"more than {most_columns} values of {names_from} to make columns of")
        wanted = [r["k"] for r in rows]
    else:
        wanted = [str(v) for v in values]
        if unlisted == "error":
            text = F.concat(F.lit(f"pivot_wider has no column for this value of {names_from}: "), key)
            key = F.when(key.isin(wanted), key).otherwise(F.raise_error(text))
        elif unlisted == "drop":
            key = F.when(key.isin(wanted), key)
        else:
            raise ValueError(f"unlisted is 'error' or 'drop', not {unlisted!r}")

    def out_name(measure: str, value: str) -> str:
        tail = f"{names_prefix}{value}"
        return tail if len(measures) == 1 else f"{measure}_{tail}"

    few = len(wanted) * len(measures) <= _INLINE_CELLS
    one_pass = few and values_fn in ("error", "list")
    make = _pivot_inline if one_pass else _pivot_many
    wide = make(df, key, ids, measures, wanted, out_name, values_fn, order_by)
    if values_fill is not None:
        made = [out_name(m, v) for m in measures for v in wanted]
        wide = wide.withColumns({c: F.coalesce(F.col(c), F.lit(values_fill)) for c in made})
    return wide


def _unordered(df: DataFrame, measures: Sequence[str]) -> bool:
    """Whether values have no order, such as maps, and are taken as they come."""
    kinds = " ".join(df.schema[m].dataType.simpleString() for m in measures)
    return "map<" in kinds or "variant" in kinds


def _stop_on_collision(count: Column, value: Column) -> Column:
    text = F.lit("a cell of pivot_wider holds several rows; set values_fn or add an id column")
    return F.when(count > 1, F.raise_error(text)).otherwise(value)


def _pivot_inline(df, key, ids, measures, wanted, out_name, values_fn, order_by) -> DataFrame:
    """Few columns: one aggregation, one shuffle on the ids."""
    plain = _unordered(df, measures) and values_fn == "error"
    keyed = df.withColumn("__key", key)
    aggs, checks = [], []
    for v in wanted:
        here = F.coalesce(F.col("__key") == F.lit(v), F.lit(False))
        for m in measures:
            x = F.col(m)
            cell = (
                F.first(F.when(here, x), ignorenulls=True)
                if plain
                else _cell_value(values_fn, x, here, order_by)
            )
            aggs.append(cell.alias(out_name(m, v)))
        checks.append(F.count_if(here).alias(f"__n_{v}"))
    made = [out_name(m, v) for m in measures for v in wanted]
    if values_fn != "error":
        return keyed.groupBy(*ids).agg(*aggs).select(*ids, *made)
    counted = keyed.groupBy(*ids).agg(*aggs, *checks)
    out = [
        _stop_on_collision(F.col(f"`__n_{v}`"), F.col(f"`{out_name(m, v)}`")).alias(out_name(m, v))
        for m in measures
        for v in wanted
    ]
    return counted.select(*ids, *out)


def _cells(keyed: DataFrame, ids, measures, values_fn, order_by) -> DataFrame:
    """One row per id and key, the cell of measure i as __v{i}."""
    groups = keyed.groupBy(*ids, "__key")
    names = [f"__v{i}" for i in range(len(measures))]
    if values_fn == "first":
        if not order_by:
            raise ValueError("values_fn='first' needs order_by")
        along = [c for o in order_by for c in (F.col(o).isNull(), F.col(o))]
        ranked = keyed.groupBy(*ids, "__key", *order_by).agg(
            F.count(F.lit(1)).alias("__n"), F.first(F.struct(*measures)).alias("__x")
        )
        first = F.min_by(F.struct("__n", "__x"), F.struct(*along)).alias("__f")
        text = F.lit(f"order_by ({', '.join(order_by)}) does not fix the first row of a cell")
        tied = F.when(F.col("__f")["__n"] > 1, F.raise_error(text))
        return ranked.groupBy(*ids, "__key").agg(first).select(
            *ids, "__key",
            *[tied.otherwise(F.col("__f")["__x"][m]).alias(n) for m, n in zip(measures, names)],
        )
    if callable(values_fn):
        return groups.agg(*[values_fn(F.col(m)).alias(n) for m, n in zip(measures, names)])
    here = F.lit(True)
    if values_fn == "list":
        return groups.agg(
            *[_cell_value("list", F.col(m), here, order_by).alias(n) for m, n in zip(measures, names)]
        )
    if values_fn != "error":
        raise ValueError(f"unknown values_fn {values_fn!r}")
    plain = _unordered(keyed, measures)
    counted = groups.agg(
        F.count(F.lit(1)).alias("__n"),
        *[
            (F.first(m, ignorenulls=True) if plain else F.max(m)).alias(n)
            for m, n in zip(measures, names)
        ],
    )
    # Rows of values that get no column may collide.
    several = F.when(F.col("__key").isNotNull(), F.col("__n"))
    return counted.withColumns({n: _stop_on_collision(several, F.col(n)) for n in names}).drop("__n")


def _pivot_many(df, key, ids, measures, wanted, out_name, values_fn, order_by) -> DataFrame:
    """Any columns: cells first, then Spark's pivot over unique cells."""
    cells = _cells(df.withColumn("__key", key), ids, measures, values_fn, order_by)
    aggs = [F.first(f"__v{i}", ignorenulls=True).alias(f"__v{i}") for i in range(len(measures))]
    wide = cells.groupBy(*ids).pivot("__key", wanted).agg(*aggs)
    names = {}
    for i, m in enumerate(measures):
        for v in wanted:
            names[v if len(measures) == 1 else f"{v}___v{i}"] = out_name(m, v)
    return wide.withColumnsRenamed(names)


def _quoted(delim: str) -> str:
    return r"\Q" + delim + r"\E"


def separate_delim(
    df: DataFrame,
    col: str,
    delim: str,
    names: Sequence[str],
    too_few: str = "error",
    too_many: str = "error",
    keep: bool = False,
) -> DataFrame:
    """Split text at a literal delimiter.

    ``too_few`` may be "error" or "align_start" (missing pieces are null), ``too_many``
    "error", "drop" or "merge" (the rest stays in the last piece).
    """
    k = len(names)
    parts = F.split(F.col(col), _quoted(delim), k if too_many == "merge" else -1)
    size = F.size(parts)
    problem = F.lit(False)
    if too_few == "error":
        problem = problem | (size < k)
    if too_many == "error":
        problem = problem | (size > k)
    message = F.concat(
        F.lit(f"{col} has not {k} pieces between {delim!r}: "), F.col(col)
    )
    pieces = F.when(F.col(col).isNotNull() & problem, F.raise_error(message)).otherwise(parts)
    out = df.withColumn("__parts", pieces)
    out = out.withColumns({n: F.get("__parts", F.lit(i)) for i, n in enumerate(names)})
    return out.drop("__parts", *([] if keep or col in names else [col]))


def separate_position(
    df: DataFrame,
    col: str,
    widths: Sequence[tuple[str | None, int]] | dict[str, int],
    too_few: str = "error",
    too_many: str = "error",
    keep: bool = False,
) -> DataFrame:
    """Split text by widths; a width with no name is skipped over."""
    spans = list(widths.items()) if isinstance(widths, dict) else list(widths)
    if not any(n for n, _ in spans):
        raise ValueError("widths must be named, at least in part")
    total = sum(w for _, w in spans)
    length = F.length(col)
    problem = F.lit(False)
    if too_few == "error":
        problem = problem | (length < total)
    if too_many == "error":
        problem = problem | (length > total)
    message = F.concat(F.lit(f"{col} is not {total} characters wide: "), F.col(col))
    text = F.when(problem, F.raise_error(message)).otherwise(F.col(col))
    made, start = {}, 1
    for name, width in spans:
        if name:
            piece = F.substring("__text", start, width)
            made[name] = F.when(F.length("__text") >= start, piece)
        start += width
    out = df.withColumn("__text", text).withColumns(made)
    return out.drop("__text", *([] if keep or col in made else [col]))
