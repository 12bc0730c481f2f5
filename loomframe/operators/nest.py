"""Rows as arrays, arrays as rows, any function per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.plans.matching import attach_group_stats

# Groups whose states a task holds before it hands them on.
_HELD_GROUPS = 20_000


def nest(df: DataFrame, by: Sequence[str], into: str = "data") -> DataFrame:
    """One row per group, its other columns as an array of structs.

    A group's rows meet in one array; use ``nest_parts`` where that is too long.
    """
    fields = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias(into))


def nest_parts(
    df: DataFrame, by: Sequence[str], rows: int, into: str = "data", part: str = "part"
) -> DataFrame:
    """``nest`` with arrays of about ``rows`` rows: one row per group and numbered part.

    A group has as many parts as its number of rows asks for, and every row says which
    one it is. Repeated rows are counted before they move and unfolded in the parts, so
    copies spread as well.
    """
    by = list(by)
    fields = [c for c in df.columns if c not in by]
    sizes = {"__parts": F.ceil(F.count(F.lit(1)) / F.lit(rows))}
    marked = attach_group_stats(df, by, sizes)
    counted = marked.groupBy(*df.columns, "__parts").agg(F.count(F.lit(1)).alias("__n"))
    # Equal rows fill pieces of at most `rows` copies; pieces are dealt to the parts.
    last = F.expr(f"(__n - 1) div {int(rows)}")
    pieces = counted.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    times = F.least(F.lit(rows), F.col("__n") - F.col("__piece") * rows).cast("int")
    dealt = F.pmod(F.xxhash64(*df.columns, "__piece"), F.col("__parts"))
    packed = (
        pieces.withColumn("__dealt", dealt)
        .groupBy(*by, "__dealt")
        .agg(F.flatten(F.collect_list(F.array_repeat(F.struct(*fields), times))).alias(into))
    )
    return packed.select(*by, F.col("__dealt").alias(part), into)


def unnest(df: DataFrame, col: str = "data") -> DataFrame:
    """One row per array element, the struct's fields as columns.

    A row whose array is empty or missing gives no row.
    """
    return df.select(*[c for c in df.columns if c != col], F.inline(col))


def group_apply(df: DataFrame, by: Sequence[str], f: Callable, schema) -> DataFrame:
    """Any function of a group's rows, for what no expression can say.

    ``f`` takes a pandas frame, or, annotated ``Iterator[pd.DataFrame] ->
    Iterator[pd.DataFrame]``, the group in batches; use the latter where a group may be
    large. Statistics per group, group filters and joins have operators of their own
    that split large groups.
    """
    return df.groupBy(*by).applyInPandas(f, schema)


@dataclass(frozen=True)
class Reduction:
    """A function of a group that is put together from states of parts of its rows.

    ``update(state, rows)`` takes a state, None at first, and some of the group's rows as an
    Arrow table, ``merge(a, b)`` two states; both return a state, a dict with the fields of the
    DDL text ``state``. ``finish(state)`` returns the group's result rows as a list of dicts
    with the fields of the DDL text ``result``. No function may depend on the order of the
    rows or of the merges.
    """

    update: Callable[[dict | None, pa.Table], dict]
    merge: Callable[[dict, dict], dict]
    finish: Callable[[dict], list[dict]]
    state: str
    result: str


def group_reduce(df: DataFrame, by: Sequence[str], f: Reduction) -> DataFrame:
    """One or more result rows per group from mergeable states; missing keys form a group.

    A task makes the states of its own rows, so a group of any size sends one state per task
    through the shuffle, and they are merged one after the other as they come in: no group is
    ever held, in memory or in one task. An empty table gives no rows, and so does a group for
    which ``finish`` returns none.
    """
    by = list(by)
    keys = T.StructType([df.schema[c] for c in by])
    state = T.StructType.fromDDL(f.state)
    if {x.name for x in state} & set(by):
        raise ValueError("a field of the state has the name of a key")
    partial = df.mapInArrow(_partial_states(by, f.update, _arrow(df, state)), T.StructType([*keys, *state]))
    result = T.StructType([*keys, *T.StructType.fromDDL(f.result)])
    if not by:
        # One state per task, merged as they stream in.
        merged = partial.repartition(1).mapInArrow(_merged_stream(f.merge, f.finish, _arrow(df, result)), result)
        return merged
    return partial.groupBy(*by).applyInArrow(_merged_group(by, f.merge, f.finish, _arrow(df, result)), result)


def _arrow(df: DataFrame, schema: T.StructType) -> pa.Schema:
    return df.sparkSession.createDataFrame([], schema).toArrow().schema


def _partial_states(by: list[str], update: Callable, fields: pa.Schema):
    """States of the groups of a task, handed on when there are many."""
    most = _HELD_GROUPS

    def out(held: dict, keys: pa.Schema) -> pa.RecordBatch:
        shown = [pa.array([k[1][i] for k in held.values()], t) for i, t in enumerate(keys.types)]
        states = [pa.array([k[0][n] for k in held.values()], t) for n, t in zip(fields.names, fields.types)]
        return pa.RecordBatch.from_arrays([*shown, *states], names=[*keys.names, *fields.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, list]] = {}
        keys = pa.schema([])
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            keys = pa.schema([batch.schema.field(c) for c in by])
            code = np.zeros(batch.num_rows, np.int64)
            for c in by:
                mine = pc.dictionary_encode(batch.column(c), null_encoding="encode")
                code = np.unique(code * (len(mine.dictionary) + 1) + mine.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
            table = table.take(pa.array(order))
            for start, stop in zip(starts, np.append(starts[1:], len(order))):
                values = [table[c][int(start)].as_py() for c in by]
                # As text, in which NaN equals itself.
                name = repr(values)
                before = held[name][0] if name in held else None
                held[name] = update(before, table.slice(start, stop - start)), values
            if len(held) >= most:
                yield out(held, keys)
                held = {}
        if held:
            yield out(held, keys)

    return run


def _result_rows(schema: pa.Schema):
    # Made here, so that it travels to the workers as code and not as an import.
    def rows(found: list[dict], keys: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{**keys, **r} for r in found], schema=schema)

    return rows


def _merged_stream(merge: Callable, finish: Callable, schema: pa.Schema):
    rows_of = _result_rows(schema)

    def run(batches):
        state = None
        for batch in batches:
            for other in batch.to_pylist():
                state = other if state is None else merge(state, other)
        if state is not None:
            yield rows_of(finish(state), {})

    return run


def _merged_group(by: list[str], merge: Callable, finish: Callable, schema: pa.Schema):
    rows_of = _result_rows(schema)

    def run(key, batches):
        state = None
        for batch in batches:
            for other in batch.to_pylist():
                other = {n: v for n, v in other.items() if n not in by}
                state = other if state is None else merge(state, other)
        yield rows_of(finish(state), {c: k.as_py() for c, k in zip(by, key)})

    run.__annotations__ = {
        "key": tuple[pa.Scalar, ...],
        "batches": Iterator[pa.RecordBatch],
        "return": Iterator[pa.RecordBatch],
    }
    return run
