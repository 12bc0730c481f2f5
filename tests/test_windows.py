import datetime as dt

import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from loomframe import operators as op


def test_w1_percent_change(frame, layout):
    df = frame([("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 4.0)], "g string, o int, x double")
    got = op.lag_change(df, "x", ["g"], "o", scale=100.0)
    same(got, [("A", 1, None), ("A", 2, 100.0), ("B", 1, None)], "g", "o", "change")


def test_w2_monthly_yearly_and_fixed_base(frame, layout):
    sales = [100, 110, 105, 108, 112, 115, 118, 120, 117, 121, 125, 128, 130]
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(13)]
    df = frame(
        [(r, m, float(s)) for r in "EW" for m, s in zip(months, sales)],
        "region string, date date, sales double",
    )
    mom = op.lag_change(df, "sales", ["region"], "date").where("region = 'E'")
    got = dict(rows(mom, "date", "change"))
    assert got[months[0]] is None and got[months[1]] == 0.1
    yoy = op.lag_change(df, "sales", ["region"], "date", n=12)
    assert yoy.where("change is null").count() == 24
    same(yoy.where("change is not null"), [("E", 0.3), ("W", 0.3)], "region", "change")
    base = op.fixed_base_change(df, "sales", "date", F.lit(dt.date(2020, 1, 1)), ["region"])
    same(base.where(F.col("date") == dt.date(2020, 2, 1)), [("E", 0.1), ("W", 0.1)], "region", "vs_base")
    assert base.where("vs_base = 0").count() == 2


def test_lag_crosses_small_blocks(frame, layout):
    df = frame([("A", i, i * 1.0) for i in range(10)] + [("B", 0, 5.0)], "g string, o int, x double")
    for n in (1, 3, 7):
        got = op.lag(df, "x", ["g"], "o", n)
        want = [("A", i, float(i - n) if i >= n else None) for i in range(10)] + [("B", 0, None)]
        same(got, want, "g", "o", "lagged")
    back = op.lag(df, "x", ["g"], "-o", 2)
    same(back, [("A", i, float(i + 2) if i < 8 else None) for i in range(10)] + [("B", 0, None)], "g", "o", "lagged")


def test_w3_ranks(frame, layout):
    df = frame([("A", 20, 1), ("A", 20, 2), ("A", 10, 3), ("B", 5, 4)], "store string, sales int, o int")
    same(op.min_rank(df, "-sales", ["store"]), [(1, 1), (2, 1), (3, 3), (4, 1)], "o", "rank")
    same(op.dense_rank(df, "-sales", ["store"]), [(1, 1), (2, 1), (3, 2), (4, 1)], "o", "rank")
    same(op.row_number(df, "-sales", ["store"], ["o"]), [(1, 1), (2, 2), (3, 3), (4, 1)], "o", "rank")


def test_ranks_of_a_whole_table(frame, layout):
    df = frame([(i, i % 5) for i in range(20)], "o int, x int")
    want_min = [(i, (i % 5) * 4 + 1) for i in range(20)]
    same(op.min_rank(df, "x"), want_min, "o", "rank")
    same(op.dense_rank(df, "x"), [(i, i % 5 + 1) for i in range(20)], "o", "rank")
    same(op.row_number(df, "x", tiebreak=["o"]), [(i, (i % 5) * 4 + i // 5 + 1) for i in range(20)], "o", "rank")


def test_w4_w5_running_sum_and_recurrence(frame, layout):
    df = frame([(1, 1.0, 20.0, "A"), (2, 2.0, 30.0, "A"), (3, 3.0, 25.0, "B")],
               "o int, x double, invest double, region string")
    same(op.cumsum(df, "x", order_by="o"), [(1, 1.0), (2, 3.0), (3, 6.0)], "o", "cum")
    same(op.cumprod(df, "x", order_by="o"), [(1, 1.0), (2, 2.0), (3, 6.0)], "o", "cum")
    k = op.accumulate_affine(df, 0.95, "x", order_by="o")
    same(k, [(1, 1.0), (2, 2.95), (3, 5.8025)], "o", "acc")
    k = op.accumulate_affine(df, 0.95, "invest", ["region"], "o")
    same(k, [(1, 20.0), (2, 49.0), (3, 25.0)], "o", "acc")
    df = frame([("A", 1, 20.0), ("A", 2, 30.0), ("A", 3, 25.0), ("B", 1, 50.0), ("B", 2, 40.0)],
               "region string, year int, invest double")
    k = op.accumulate_affine(df, 0.95, "invest", ["region"], "year")
    same(k, [("A", 1, 20.0), ("A", 2, 49.0), ("A", 3, 71.55), ("B", 1, 50.0), ("B", 2, 87.5)],
         "region", "year", "acc")


def test_w6_w7_chain_index(frame, layout):
    df = frame([(1, 100.0, 50.0), (2, 102.0, 60.0), (3, 99.0, 55.0)], "o int, price double, invest double")
    same(op.chain_index(df, "price", order_by="o"), [(1, 100.0), (2, 102.0), (3, 100.98)], "o", "index")
    k = op.accumulate_affine(df, 0.95, "invest", order_by="o")
    same(k, [(1, 50.0), (2, 107.5), (3, 157.125)], "o", "acc")
    df = frame([(1, 105.0), (2, 98.0), (3, 102.0)], "o int, x double")
    want = [(1, 100.0), (2, 98.0), (3, 99.96)]
    same(op.chain_index(df, "x", order_by="o"), want, "o", "index")
    same(op.accumulate_affine(df, F.col("x") / 100, F.lit(0), order_by="o", init=100.0), want, "o", "acc")
    same(op.accumulate(df, lambda k, x: k * x / 100, "x", [], "o", init=100.0), want, "o", "acc")


def test_missing_values_poison_the_rest(frame, layout):
    df = frame([("A", i, None if i == 3 else 1.0) for i in range(7)] + [("B", i, 1.0) for i in range(3)],
               "g string, o int, x double")
    want = [("A", i, float(i + 1) if i < 3 else None) for i in range(7)] + [("B", i, i + 1.0) for i in range(3)]
    same(op.cumsum(df, "x", ["g"], "o"), want, "g", "o", "cum")
    same(op.accumulate_affine(df, 1.0, "x", ["g"], "o"), want, "g", "o", "acc")
    same(op.accumulate(df, lambda k, x: k + x, "x", ["g"], "o"), want, "g", "o", "acc")
    ones = [(g, o, None if v is None else 1.0) for g, o, v in want]
    same(op.cumprod(df, "x", ["g"], "o"), ones, "g", "o", "cum")
    loose = [("A", i, float(i + 1 - (i >= 3))) for i in range(7)] + want[7:]
    same(op.cumsum(df, "x", ["g"], "o", na_rm=True), loose, "g", "o", "cum")


def test_recurrence_does_not_overflow(frame):
    df = frame([(i, 1.0) for i in range(5000)], "o int, x double")
    got = op.accumulate_affine(df, 0.5, "x", order_by="o", limit=500)
    assert got.where("abs(acc - 2) < 1e-9").count() > 4900
    grown = op.accumulate_affine(df, 0.0, "x", order_by="o", limit=500)
    assert grown.where("acc = 1").count() == 5000


def test_w8_rolling_within_groups(frame, layout):
    df = frame([(s, d, float(v)) for s, vs in (("A", (10, 20, 30)), ("B", (100, 200, 300))) for d, v in enumerate(vs)],
               "store string, day int, sales double")
    got = op.rolling(df, "sales", "mean", before=2, by=["store"], order_by="day")
    want = [("A", 0, None), ("A", 1, None), ("A", 2, 20.0), ("B", 0, None), ("B", 1, None), ("B", 2, 200.0)]
    same(got, want, "store", "day", "rolling")
    part = op.rolling(df, "sales", F.sum, before=2, by=["store"], order_by="day", complete=False)
    same(part.where("store = 'A'"), [(0, 10.0), (1, 30.0), (2, 60.0)], "day", "rolling")


def test_w9_rolling_list(frame, layout):
    df = frame([(1, 1), (2, 2), (3, 3)], "o int, x int")

    def total(rows_):
        return F.aggregate(rows_, F.lit(0), lambda a, r: a + r["x"])

    got = op.rolling_list(df, ["x"], total, before=1, order_by="o")
    same(got, [(1, None), (2, 3), (3, 5)], "o", "rolling")


def test_w10_lost_and_gained(frame, layout):
    trips = {("BJ", 2019): "abc", ("BJ", 2020): "c", ("BJ", 2021): "cd", ("SH", 2019): "xy", ("SH", 2021): "y"}
    df = frame([(f, y, d) for (f, y), ds in trips.items() for d in ds + ds[:1]],
               "from string, year int, dest string")
    got = op.period_set_change(df, "dest", ["from"], "year")
    same(got, [("BJ", 2019, None, None), ("BJ", 2020, 2, 0), ("BJ", 2021, 0, 1),
               ("SH", 2019, None, None), ("SH", 2021, 1, 0)])
    same(op.period_set_change(df, "dest", ["from"], "year", small_sets=True), rows(got))
    gone = df.union(frame([("BJ", 2021, None)], df.schema))
    split, whole = (rows(op.period_set_change(gone, "dest", ["from"], "year", small_sets=s)) for s in (False, True))
    assert split == whole and ("BJ", 2021, 0, 2) in whole


def test_w11_centre_and_scale(frame, layout):
    df = frame([("A", 1), ("A", 3), ("B", 10)], "g string, x int")
    same(op.center(df, "x", ["g"]), [("A", -1.0), ("A", 1.0), ("B", 0.0)])
    got = op.standardise(df, "x", ["g"], out="z")
    same(got, [("A", 1, -(0.5**0.5)), ("A", 3, 0.5**0.5), ("B", 10, None)])


def test_first_and_last(frame, layout):
    df = frame([("A", 2, 5), ("A", 1, None), ("B", 1, 7), ("A", None, 9)], "g string, o int, x int")
    got = op.first_last(df, "x", ["g"], "o")
    assert set(rows(got, "g", "first", "last")) == {("A", None, 9), ("B", 7, 7)}
    got = op.first_last(df, "x", ["g"], "-o")
    assert set(rows(got, "g", "first", "last")) == {("A", 5, 9), ("B", 7, 7)}


def test_ties_in_the_order_are_an_error(frame, layout):
    df = frame([("A", 1, 1), ("A", 1, 2), ("A", 2, 3)], "g string, o int, x int")
    for broken in (
        lambda: op.cumsum(df, "x", ["g"], "o"),
        lambda: op.lag(df, "x", ["g"], "o"),
        lambda: op.rolling(df, "x", "sum", 1, ["g"], "o"),
        lambda: op.accumulate_affine(df, 1.0, "x", ["g"], "o"),
        lambda: op.row_number(df, "o", ["g"]),
    ):
        with pytest.raises(Exception, match="does not fix the order"):
            broken().collect()
    with pytest.raises(ValueError, match="order_by"):
        op.cumsum(df, "x", ["g"])
