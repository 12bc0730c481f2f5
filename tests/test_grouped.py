import datetime as dt

import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import operators as op


def test_a1_count_and_mean(frame):
    df = frame([("A", 1.0), ("A", 3.0), ("B", 5.0)], "g string, x double")
    got = df.groupBy("g").agg(F.count("*").alias("n"), L.mean_of("x", na_rm=True).alias("m"))
    same(got, [("A", 2, 2.0), ("B", 1, 5.0)])


def test_a2_ratio_of_summaries_by_year(frame):
    d = dt.date
    df = frame(
        [("a", d(2021, 3, 5), 100.0), ("a", d(2021, 3, 6), 200.0), ("b", d(2022, 1, 1), 150.0),
         ("b", d(2022, 1, 2), 50.0), ("b", None, 999.0)],
        "card string, sold date, paid double",
    )
    kept = op.filter_not_any(df, op.positions(0, 1), lambda c: c.isNull())
    got = (
        kept.withColumn("year", F.year("sold")).groupBy("year")
        .agg(L.n_distinct("card", "sold").alias("n"), F.sum("paid").alias("total"))
        .withColumn("each", L.safe_div("total", "n"))
    )
    same(got, [(2021, 2, 300.0, 150.0), (2022, 2, 200.0, 100.0)])


def test_a3_quantiles(frame, layout):
    df = frame([("A", 1.0), ("A", 2.0), ("B", 3.0), ("B", None)], "g string, x double")
    got = op.reframe_quantiles(df, "x", [0.25, 0.75], ["g"])
    same(got, [("A", 0.25, 1.25), ("A", 0.75, 1.75), ("B", 0.25, 3.0), ("B", 0.75, 3.0)])


def test_quantiles_of_a_whole_table(frame, layout):
    df = frame([(float(i),) for i in range(11)], "x double")
    same(op.reframe_quantiles(df, "x", [0.0, 0.5, 0.95, 1.0]), [(0.0, 0.0), (0.5, 5.0), (0.95, 9.5), (1.0, 10.0)])


def test_a4_statistics_and_fits_per_column(frame):
    df = frame(
        [(1.0, 2.0, 4.0), (2.0, 1.0, None), (3.0, 4.0, 2.0), (4.0, 3.0, 1.0)],
        "y double, x1 double, x2 double",
    )
    got = op.summarise_columns(df, ["x1", "x2"], lambda c: L.mean_of(c, na_rm=True))
    same(got, [("x1", 2.5), ("x2", 7 / 3)])
    fits = op.fit_per_column(df, "y", ["x1", "x2"])
    same(fits, [("x1", 0.6), ("x2", -1.0)], "col", "slope")


def test_fit_per_group(frame):
    df = frame([("A", 0.0, 1.0), ("A", 1.0, 3.0), ("B", 0.0, 5.0), ("B", 2.0, 1.0)], "g string, x double, y double")
    same(op.fit_per_group(df, "y", "x", ["g"]), [("A", 2.0, 1.0), ("B", -2.0, 5.0)], "g", "slope", "intercept")


def test_g1_rows_at_maximum(frame, layout):
    df = frame([("A", 1), ("A", 5), ("A", 5), ("B", 3)], "g string, x int")
    same(op.filter_at_max(df, "x", ["g"]), [("A", 5), ("A", 5), ("B", 3)])
    gap = frame([("A", 1), ("A", None), ("B", 3)], "g string, x int")
    same(op.filter_at_max(gap, "x", ["g"]), [("B", 3)])
    same(op.filter_at_max(gap, "x", ["g"], na_rm=True), [("A", 1), ("B", 3)])


def test_missing_group_is_a_group(frame, layout):
    df = frame([(None, 1), (None, 4), ("B", 3)], "g string, x int")
    same(op.filter_at_max(df, "x", ["g"]), [(None, 4), ("B", 3)])
    same(op.keep_groups_all(df, F.col("x") != 3, ["g"]), [(None, 1), (None, 4)])
    same(op.center(df, "x", ["g"]), [(None, -1.5), (None, 1.5), ("B", 0.0)])
    df = df.withColumn("o", F.col("x"))
    same(op.cumsum(df, "x", ["g"], "o"), [(None, 1), (None, 5), ("B", 3)], "g", "cum")


def test_g2_all_positive(frame, layout):
    df = frame([("A", 1), ("A", 2), ("B", -1)], "g string, x int")
    same(op.keep_groups_all(df, F.col("x") > 0, ["g"]), [("A", 1), ("A", 2)])


def test_g3_missing_share_is_strict(frame, layout):
    data = [("A", 1), ("A", 2), ("A", 3), ("A", None), ("B", None), ("B", None), ("C", 7),
            ("C", 8), ("D", None), ("D", 5)]
    got = op.keep_groups_missing_below(frame(data, "g string, x int"), "x", ["g"], 0.5)
    same(got, [r for r in data if r[0] in "AC"])


def test_g4_rows_groups_and_share(frame, layout):
    data = [("A", 1), ("A", None), ("A", 5), ("B", None), ("B", None), ("B", None), ("C", 7), ("C", 8)]
    df = frame(data, "g string, x int")
    assert df.where(F.col("x").isNotNull()).count() == 4
    same(op.keep_groups_all(df, F.col("x").isNotNull(), ["g"]), [("C", 7), ("C", 8)])
    assert op.keep_groups_missing_below(df, "x", ["g"], 0.6).count() == 5


def test_g5_if_all_and_not_if_any(frame):
    df = frame([(1, 4, "A"), (None, 5, "A"), (3, None, "B"), (None, None, "B")], "x int, y int, g string")
    same(op.filter_if_all(df, ["x", "y"], lambda c: c.isNotNull()), [(1, 4, "A")])
    same(op.filter_not_any(df, op.positions(0, 1), lambda c: c.isNull()), [(1, 4, "A")])


def test_g7_slices(frame, layout):
    df = frame(
        [("x", "g1", 3, 1), ("x", "g1", 3, 2), ("y", "g2", 2, 3), ("z", "g1", 5, 4)],
        "cust string, grp string, t int, v int",
    )
    assert op.slice_max(df, "t", by=["cust"]).count() == 4
    assert op.slice_max(df, "t", by=["cust"], with_ties=False, tiebreak=["v"]).count() == 3
    same(op.slice_head(df, 2, ["grp"], "v"), [(1,), (2,), (3,)], "v")
    same(op.slice_max(df, "t", n=2), [(1,), (2,), (4,)], "v")
    same(op.slice_max(df, "t", n=2, by=["grp"]), [(1,), (2,), (3,), (4,)], "v")


def test_slice_max_puts_missing_last(frame, layout):
    df = frame([("A", None), ("A", None), ("A", 1), ("B", 1), ("B", 2), ("B", None)], "g string, x int")
    same(op.slice_max(df, "x", n=2, by=["g"]), [("A", None), ("A", None), ("A", 1), ("B", 1), ("B", 2)])
    only = frame([("A", None), ("A", None)], "g string, x int")
    assert op.slice_max(only, "x", by=["g"]).count() == 2


def test_m1_rows_above_group_mean(spark, frame):
    from loomframe.plans.matching import attach_group_stats

    df = frame([("A", 1), ("A", 5), ("B", 2), ("B", 8)], "g string, x int")
    marked = attach_group_stats(df, ["g"], {"m": F.avg("x")}).where("x > m")
    same(marked, [("A", 5), ("B", 8)], "g", "x")

    import pandas as pd

    def above(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[pdf.x > pdf.x.mean()]

    same(op.group_apply(df, ["g"], above, "g string, x long"), [("A", 5), ("B", 8)])


def test_m2_nest_and_unnest(frame, layout):
    data = [("A", i % 3, float(i % 3)) for i in range(9)] + [("B", 1, None), (None, 2, 2.0)]
    df = frame(data, "g string, x int, y double")
    nested = op.nest(df, ["g"])
    assert nested.columns == ["g", "data"]
    assert nested.count() == 3
    same(op.unnest(nested), data)
    parts = op.nest_parts(df, ["g"], 2)
    assert parts.columns == ["g", "part", "data"]
    same(op.unnest(parts), data, "g", "x", "y")


@pytest.mark.parametrize("n", [1, 2, 1001])
def test_first_rows_stop_on_a_tie_at_the_cut(frame, layout, n):
    tied = frame([("A", i, float(i)) for i in range(n)] + [("A", n - 1, -1.0), ("B", 0, 0.0)], "g string, o int, x double")
    with pytest.raises(Exception, match="does not fix which rows are the first"):
        op.slice_head(tied, n, ["g"], "o").collect()
    assert op.slice_head(tied, n + 1, ["g"], "o").count() == n + 2
    assert op.slice_head(tied, n, ["g"], ["o", "x"]).count() == n + 1
    with pytest.raises(Exception, match="does not fix which rows are the first"):
        op.slice_max(tied.withColumn("o", -F.col("o")), "o", n, ["g"], with_ties=False).collect()


def test_first_and_last_stop_on_a_tie(frame, layout):
    df = frame([("A", 1, 5.0), ("A", 2, 6.0), ("A", 2, 7.0), ("A", 3, 8.0)], "g string, o int, x double")
    same(op.first_last(df, "x", ["g"], "o"), [(5.0, 8.0)] * 4, "first", "last")
    for bad in (df.where("o < 3"), df.where("o > 1")):
        with pytest.raises(Exception, match="does not fix the first and last row"):
            op.first_last(bad, "x", ["g"], "o").collect()


def test_running_sums_have_one_type(frame, spark):
    df = frame([("A", i, i) for i in range(6)], "g string, o int, x int").withColumn("x", F.col("x").cast("decimal(18,2)"))
    types = {op.cumsum(df, "x", ["g"], "o", limit=n).schema["cum"].dataType.simpleString() for n in (2, op.WHOLE_GROUPS)}
    assert types == {"decimal(28,2)"}


def test_any_column_passes(frame):
    df = frame([(1, None, 5), (2, 1, None), (3, None, None), (4, 0, 0)], "id int, a int, b int")
    same(op.filter_if_any(df, ["a", "b"], lambda c: c > 0), [(1,), (2,)], "id")


def test_across(frame):
    df = frame([(1, 1.0, 10.0), (2, 2.0, 20.0), (3, 3.0, 30.0)], "id int, a double, b double")
    scaled = op.scale_columns(df, op.numeric())
    assert scaled.columns == ["id", "a", "b"]
    for c in scaled.columns:
        assert abs(scaled.agg(F.avg(c)).first()[0]) < 1e-9
    assert rows(op.scale_columns(df, op.numeric(), exclude=["id"]), "id") == [(1,), (2,), (3,)]
    s = frame([(1, 1.0, 3.0, 9.0), (2, 2.0, 4.0, 9.0)], "id int, sales_1 double, sales_2 double, other double")
    same(op.summarise_across(s, op.starts_with("sales_"), lambda c: L.mean_of(c, na_rm=True)), [(1.5, 3.5)])
    same(op.drop_positions(s, 0), [(1.0, 3.0, 9.0), (2.0, 4.0, 9.0)])
    same(op.mutate_across(s, ["other"], lambda c: c + 1), [(1, 10.0), (2, 10.0)], "id", "other")
    with pytest.raises(ValueError, match="no such column"):
        op.mutate_across(s, ["zzz"], lambda c: c)
