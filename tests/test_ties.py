import pytest
from conftest import same

from loomframe import operators as op
from loomframe.queries import QUERIES


def test_tied_rows_share_the_running_sum(frame, layout):
    data = [("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("a", None, 8.0), ("a", None, 8.0), ("b", 1, 3.0)]
    df = frame(data, "g string, o int, x double")
    want = [("a", 1, 3.0)] * 2 + [("a", 2, 7.0)] + [("a", None, 23.0)] * 2 + [("b", 1, 3.0)]
    same(op.cumsum(df, "x", ["g"], "o", ties="together"), want, "g", "o", "cum")
    down = [("a", 1, 7.0)] * 2 + [("a", 2, 4.0)] + [("a", None, 23.0)] * 2 + [("b", 1, 3.0)]
    same(op.cumsum(df, "x", ["g"], "-o", ties="together"), down, "g", "o", "cum")
    same(op.cumsum(df.where("g = 'b'"), "x", order_by="o", out="x", ties="together"), [("b", 1, 3.0)], "g", "o", "x")


def test_a_missing_value_among_tied_rows(frame, layout):
    df = frame([(1, 1.0), (2, 2.0), (2, None), (3, 4.0)], "o int, x double")
    same(op.cumsum(df, "x", order_by="o", ties="together"), [(1, 1.0), (2, None), (2, None), (3, None)], "o", "cum")
    loose = [(1, 1.0), (2, 3.0), (2, 3.0), (3, 7.0)]
    same(op.cumsum(df, "x", order_by="o", na_rm=True, ties="together"), loose, "o", "cum")


def test_ties_are_checked(frame):
    df = frame([(1, 1.0), (1, 2.0)], "o int, x double")
    with pytest.raises(ValueError, match="unknown ties"):
        op.cumsum(df, "x", order_by="o", ties="first")
    with pytest.raises(Exception, match="does not fix the order"):
        op.cumsum(df, "x", order_by="o").collect()


def test_a_value_that_is_the_mean_is_not_above_it(spark, frame, tmp_path):
    tenths = [(i, 1, 0.1) for i in range(10)]
    others = [(20, 2, 1.0), (21, 2, 3.0), (22, 2, None), (30, 3, 1e300), (31, 3, 2.0), (40, 4, 0.125), (41, 4, 0.126), (50, None, 1.0), (51, None, 0.5)]
    odd = [(60, 5, float("nan")), (61, 5, 1.0), (70, 6, None)]
    events = frame([*tenths, *others, *odd], "event_id long, user_id long, value double")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["nest_above_mean"](spark, str(tmp_path))
    same(got, [(21, 2, 3.0), (30, 3, 1e300), (41, 4, 0.126), (50, None, 1.0)], "event_id", "user_id", "value")


def test_running_sum_of_events_at_one_time(spark, frame, tmp_path):
    events = frame([(1, 10, 1.25), (2, 20, 2.5), (3, 20, 3.0), (4, 30, 1.0)], "event_id long, s long, value double")
    events.selectExpr("event_id", "timestamp_seconds(s) as ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    same(QUERIES["win_cumsum_global"](spark, str(tmp_path)), [(1, 1.25), (2, 6.75), (3, 6.75), (4, 7.75)], "event_id", "cum")
