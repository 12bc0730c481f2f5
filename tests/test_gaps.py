"""Missing runs along an axis against the full grid."""

import datetime as dt
import random

import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from loomframe import operators as op


def runs(values, lo, hi, step):
    """(first, last, n) of the steps from lo to hi that are not among the values."""
    out, have = [], set(values)
    for v in range(lo, hi + 1, step):
        if v in have:
            continue
        if out and out[-1][1] == v - step:
            out[-1] = (out[-1][0], v, out[-1][2] + 1)
        else:
            out.append((v, v, 1))
    return out


@pytest.fixture
def numbers(frame):
    rng = random.Random(1)
    data = [(g, v) for g in ("a", "b", None) for v in rng.sample(range(40), 22)]
    data += [("a", data[0][1]), ("a", None), ("one", 17), ("none", None)]  # a repeated row and missing values
    return data, frame(data, "g string, v int")


@pytest.mark.parametrize("step,between", [(1, None), (1, (-3, 45)), (3, (1, 36)), (5, (10, 10))])
def test_whole_numbers(numbers, layout, step, between):
    data, df = numbers
    lo, hi = between or (min(v for _, v in data if v is not None), max(v for _, v in data if v is not None))
    by = {}
    for g, v in data:
        if v is not None and lo <= v <= hi and (v - lo) % step == 0:
            by.setdefault(g, []).append(v)
    want = [(g, *r) for g, values in by.items() for r in runs(values, lo, hi, step)]
    got = op.gap_runs(df, "v", ["g"], step, between)
    same(got, want)
    unfolded = op.gap_runs(df, "v", ["g"], step, between, unfold=True)
    same(unfolded, [(g, v) for g, a, b, _ in want for v in range(a, b + 1, step)])
    assert unfolded.schema["v"].dataType == df.schema["v"].dataType


def test_agrees_with_the_grid(numbers, layout):
    _, df = numbers
    known = df.where("v is not null")
    ends = known.agg(F.min("v"), F.max("v")).first()
    grid = op.missing_cells(known, {"g": None, "v": range(ends[0], ends[1] + 1)})
    assert rows(op.gap_runs(df, "v", ["g"], unfold=True)) == rows(grid, "g", "v")


def test_periods(frame, layout):
    day = dt.date
    df = frame([("x", day(2023, 11, 1)), ("x", day(2024, 3, 1)), ("x", day(2024, 4, 15)), ("y", day(2024, 1, 1))], "g string, d date")
    months = op.gap_runs(df, "d", ["g"], "month", (day(2023, 11, 1), day(2024, 5, 1)))
    same(months, [("x", day(2023, 12, 1), day(2024, 2, 1), 3), ("x", day(2024, 4, 1), day(2024, 5, 1), 2),
                  ("y", day(2023, 11, 1), day(2023, 12, 1), 2), ("y", day(2024, 2, 1), day(2024, 5, 1), 4)])
    years = op.gap_runs(df, "d", ["g"], "year", (day(2022, 1, 1), day(2024, 1, 1)))
    same(years, [("y", day(2022, 1, 1), day(2023, 1, 1), 2)])
    weeks = op.gap_runs(df.where("g = 'y'"), "d", [], "week", (day(2023, 12, 25), day(2024, 1, 20)))
    same(weeks, [(day(2023, 12, 25), day(2023, 12, 25), 1), (day(2024, 1, 8), day(2024, 1, 15), 2)])


def test_wide_gaps_cost_nothing(frame):
    df = frame([(0,), (10**12,)], "v long")
    same(op.gap_runs(df, "v"), [(1, 10**12 - 1, 10**12 - 1)])


def test_empty_and_wrong(frame):
    df = frame([], "g string, v int, s string")
    assert op.gap_runs(df, "v", ["g"]).collect() == []
    with pytest.raises(ValueError, match="steps"):
        op.gap_runs(df, "s", ["g"])
    with pytest.raises(ValueError, match="steps"):
        op.gap_runs(frame([], "d date"), "d", every="month", between=(dt.date(2024, 1, 2), dt.date(2024, 2, 1)))
