import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import operators as op
from loomframe.operators import reshape


@pytest.fixture(params=["inline", "many columns"])
def pivot_form(request, monkeypatch):
    if request.param == "many columns":
        monkeypatch.setattr(reshape, "_INLINE_CELLS", 0)


def test_r1_longer(frame):
    df = frame([("p", 1.0, 3.0), ("q", 2.0, 4.0)], "key string, month1 double, month2 double")
    want = [("p", "month1", 1.0), ("p", "month2", 3.0), ("q", "month1", 2.0), ("q", "month2", 4.0)]
    got = op.pivot_longer(df, ids=["key"], names_to="k", values_to="v")
    assert got.columns == ["key", "k", "v"]
    same(got, want)
    same(op.pivot_longer(df, cols=op.starts_with("month"), names_to="k", values_to="v"), want)


def test_longer_keeps_missing_cells_and_wants_one_type(frame):
    df = frame([(1, None, 2)], "id int, a int, b int")
    assert op.pivot_longer(df, ids=["id"]).count() == 2
    assert op.pivot_longer(df, ids=["id"], values_drop_na=True).count() == 1
    mixed = frame([(1, "x", 2)], "id int, a string, b int")
    with pytest.raises(ValueError, match="different types"):
        op.pivot_longer(mixed, ids=["id"])
    with pytest.raises(ValueError, match="does not match"):
        op.pivot_longer(df, ids=["id"], names_pattern=r"m(\d)")


def test_r2_longer_with_value_columns(frame):
    df = frame([(1, 1, 3, 5, 7), (2, 2, 4, 6, 8)], "id int, a_1 int, a_2 int, b_1 int, b_2 int")
    got = op.pivot_longer(df, ids=["id"], names_pattern=r"(.*)_(\d+)", names_to=[".value", "num"])
    assert got.columns == ["id", "num", "a", "b"]
    same(got, [(1, "1", 1, 5), (1, "2", 3, 7), (2, "1", 2, 6), (2, "2", 4, 8)])


def test_value_columns_with_a_hole_and_two_digits(frame):
    df = frame([(1, 1, 3, 5)], "id int, a_1 int, a_10 int, b_10 int")
    got = op.pivot_longer(
        df, ids=["id"], names_pattern=r"(.*)_(\d+)", names_to=[".value", "num"], names_cast={"num": "int"}
    )
    same(got, [(1, 1, 1, None), (1, 10, 3, 5)])


def test_r3_choose_between_columns(frame, pivot_form):
    df = frame(
        [(1, 1, 10, 5, 0, 30, 7), (2, 0, 20, 6, 1, 40, 8)],
        "id int, daw_1 int, zda_1 int, da_1 int, daw_2 int, zda_2 int, da_2 int",
    )
    long = op.pivot_longer(df, ids=["id"], names_pattern=r"(.*)_(\d+)", names_to=[".value", "grp"])
    long = long.withColumn("adl", L.if_else(F.col("daw") == 1, F.col("zda"), F.col("da")))
    wide = op.pivot_wider(long, "grp", ["daw", "zda", "da", "adl"], id_cols=["id"])
    same(wide, [(1, 10, 7), (2, 6, 40)], "id", "adl_1", "adl_2")


def test_r4_wider_with_prefix(frame, pivot_form):
    df = frame([(1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "b", 4)], "id int, k string, v int")
    got = op.pivot_wider(df, "k", "v", names_prefix="pre_")
    assert got.columns == ["id", "pre_a", "pre_b"]
    same(got, [(1, 1, 2), (2, 3, 4)])


R5 = [(1, "A", 2.13), (2, "A", 3.65), (3, "B", 1.88), (4, "B", 2.30), (5, "C", 6.55), (6, "C", 4.21)]


def test_r5_what_identifies_a_row(frame, pivot_form):
    df = frame(R5, "x int, y string, z double")
    assert op.pivot_wider(df, "y", "z").count() == 6
    bare = op.drop_positions(df, 0)
    listed = op.pivot_wider(bare, "y", "z", values_fn="list")
    same(listed, [((2.13, 3.65), (1.88, 2.30), (4.21, 6.55))])
    in_order = op.pivot_wider(df, "y", "z", id_cols=[], values_fn="list", order_by=["x"])
    same(in_order, [((2.13, 3.65), (1.88, 2.30), (6.55, 4.21))])
    numbered = op.row_number(df, "x", ["y"], out="n")
    same(op.pivot_wider(numbered, "y", "z", id_cols=["n"]), [(1, 2.13, 1.88, 6.55), (2, 3.65, 2.30, 4.21)])


def test_collision_is_an_error_unless_resolved(frame, pivot_form):
    df = frame([(1, "a", 1, 1), (1, "a", 2, 2), (2, "a", 3, 3)], "id int, k string, o int, v int")
    with pytest.raises(Exception, match="several rows"):
        op.pivot_wider(df, "k", "v", id_cols=["id"]).collect()
    same(op.pivot_wider(df, "k", "v", id_cols=["id"], values_fn="first", order_by=["o"]), [(1, 1), (2, 3)])
    same(op.pivot_wider(df, "k", "v", id_cols=["id"], values_fn=F.sum), [(1, 3), (2, 3)])
    with pytest.raises(ValueError, match="order_by"):
        op.pivot_wider(df, "k", "v", id_cols=["id"], values_fn="first")


def test_cells_may_hold_maps_and_arrays(frame, pivot_form):
    df = frame([(1, "a", {"p": 1}, [1, 2]), (1, "b", {"q": 2}, [3])],
               "id int, k string, m map<string,int>, l array<int>")
    wide = op.pivot_wider(df, "k", ["m", "l"])
    same(wide.select("id", F.col("m_a")["p"], F.col("m_b")["q"], "l_a", "l_b"), [(1, 1, 2, (1, 2), (3,))])


def test_wider_fill_missing_key_and_value_list(frame, pivot_form):
    df = frame([(1, "a", 1), (2, None, 2)], "id int, k string, v int")
    got = op.pivot_wider(df, "k", "v", values=["b", "a", "NA"], values_fill=0)
    assert got.columns == ["id", "b", "a", "NA"]
    same(got, [(1, 0, 1, 0), (2, 0, 0, 2)])


def test_r6_records_from_a_listing(frame, layout):
    listing = [("name", "p1"), ("company", "c1"), ("name", "p2"), ("company", "c2"),
               ("email", "e2@x.com"), ("name", "p3")]
    df = frame([(i, f, v) for i, (f, v) in enumerate(listing)], "o int, field string, value string")
    marked = op.record_id(df, F.col("field") == "name", "o", out="id")
    wide = op.pivot_wider(marked, "field", "value", id_cols=["id"], values=["name", "company", "email"])
    same(wide, [(1, "p1", "c1", None), (2, "p2", "c2", "e2@x.com"), (3, "p3", None, None)])


def test_r7_long_change_wide(frame):
    df = frame([(1, 1, 3), (2, 2, 4)], "id int, m1 int, m2 int")
    long = op.pivot_longer(df, ids=["id"], names_to="var", values_to="val")
    wide = op.pivot_wider(long.withColumn("val", F.col("val") * 2), "var", "val")
    same(wide, [(1, 2, 6), (2, 4, 8)])


def test_r8_split(frame):
    df = frame([("01-A001",), ("02-B002",)], "code string")
    same(op.separate_delim(df, "code", "-", ["area", "num"]), [("01", "A001"), ("02", "B002")])
    df = frame([("01A001",), ("02B002",)], "code string")
    same(op.separate_position(df, "code", {"area": 2, "num": 4}), [("01", "A001"), ("02", "B002")])
    same(op.separate_position(df, "code", [(None, 2), ("num", 4)]), [("A001",), ("B002",)])
    with pytest.raises(ValueError, match="named"):
        op.separate_position(df, "code", [(None, 2), (None, 4)])
    with pytest.raises(Exception, match="characters wide"):
        op.separate_position(df, "code", {"area": 2, "num": 3}).collect()
    loose = op.separate_position(df, "code", {"area": 6, "num": 3}, too_few="align_start")
    same(loose, [("01A001", None), ("02B002", None)])


def test_months_in_column_names_are_numbers(frame):
    df = frame([(1, 1.0, 2.0)], "id int, month_2 double, month_10 double")
    got = op.pivot_longer(
        df, ids=["id"], names_to="m", names_pattern=r"month_(\d+)", names_cast={"m": "int"}
    )
    assert [r["m"] for r in got.orderBy("m").collect()] == [2, 10]
    assert rows(got, "m") == [(10,), (2,)]


CELLS = [(1, "a", 1.0), (1, "b", 2.0), (1, "a", 5.0), (2, "b", 3.0), (2, "b", None)]


@pytest.fixture(params=[24, 0])
def cell_limit(request, monkeypatch):
    """Few columns in one pass, and any number by cells."""
    from loomframe.operators import reshape

    monkeypatch.setattr(reshape, "_INLINE_CELLS", request.param)


@pytest.mark.parametrize(
    ("how", "want"),
    [
        (lambda x: F.count(x), [(1, 2, 1), (2, None, 1)]),
        (L.sum_of, [(1, 6.0, 2.0), (2, None, None)]),
        (lambda x: L.sum_of(x, na_rm=True), [(1, 6.0, 2.0), (2, None, 3.0)]),
        (L.mean_of, [(1, 3.0, 2.0), (2, None, None)]),
        (L.missing_share, [(1, 0.0, 0.0), (2, None, 0.5)]),
        ("list", [(1, (1.0, 5.0), (2.0,)), (2, None, (None, 3.0))]),
    ],
)
def test_a_cell_sees_its_own_rows(frame, cell_limit, how, want):
    df = frame(CELLS, "id int, k string, x double")
    same(op.pivot_wider(df, "k", "x", values=["a", "b"], values_fn=how), want)
    same(op.pivot_wider(df, "k", "x", values_fn=how), want)


def test_collisions_of_listed_values_only(frame, cell_limit):
    df = frame(CELLS[:4], "id int, k string, x double")
    same(op.pivot_wider(df, "k", "x", values=["b"], unlisted="drop"), [(1, 2.0), (2, 3.0)])
    with pytest.raises(Exception, match="no column for this value of k: a"):
        op.pivot_wider(df, "k", "x", values=["b"]).collect()
    with pytest.raises(Exception, match="several rows"):
        op.pivot_wider(df, "k", "x", values=["a", "b"]).collect()
    with pytest.raises(ValueError, match="more than 1 values"):
        op.pivot_wider(df, "k", "x", most_columns=1)


def test_first_row_of_a_cell(frame, cell_limit):
    df = frame([(1, "a", 3, "x"), (1, "a", 2, "y"), (1, "b", None, "z"), (1, "b", 9, "w")], "id int, k string, o int, v string")
    wide = op.pivot_wider(df, "k", "v", id_cols=["id"], values_fn="first", order_by=["o"])
    same(wide, [(1, "y", "w")])
    tied = df.union(frame([(1, "a", 2, "u")], "id int, k string, o int, v string"))
    with pytest.raises(Exception, match="does not fix the first row of a cell"):
        op.pivot_wider(tied, "k", "v", id_cols=["id"], values_fn="first", order_by=["o"]).collect()
