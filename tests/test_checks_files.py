from conftest import same

from loomframe import operators as op
from loomframe.sources import read_grouped, write_csv


def test_shape(frame):
    df = frame([("a", 1), ("a", 2), ("b", 1)], "g string, o int")
    same(op.check_shape(df, ["g", "o"], n_rows=3, n_cols=2), [(3, 2, 3, True, True)])
    same(op.check_shape(df, ["g"], n_rows=4), [(3, 2, 2, False, False)])
    same(op.check_shape(df.limit(0), ["g"], n_rows=0), [(0, 2, 0, True, True)])


def test_join_relation(frame):
    l = frame([(1,), (1,), (2,), (None,), (None,)], "k int")
    r = frame([(1,), (2,), (2,)], "j int")
    same(op.join_relation(l, r, {"k": "j"}), [(2, 2, "N:N")])
    same(op.join_relation(l, r.distinct(), {"k": "j"}), [(2, 1, "N:1")])
    same(op.join_relation(l.distinct(), r, {"k": "j"}), [(1, 2, "1:N")])
    same(op.join_relation(l.distinct(), r.distinct(), {"k": "j"}), [(1, 1, "1:1")])


def test_order_key(frame):
    df = frame([("a", 1), ("a", 1), ("b", 1)], "g string, o int")
    same(op.check_order_key(df, ["g"], "o"), [(3, 2, 1, False)])
    same(op.check_order_key(df.distinct(), ["g"], "o"), [(2, 2, 0, True)])


def test_s1_grouped_files(spark, tmp_path):
    texts = {"a1": [(1, 10), (2, 20)], "a2": [(3, 30)], "b1": [(4, 40)]}
    for name, data in texts.items():
        (tmp_path / f"{name}.csv").write_text("id,val\n" + "".join(f"{i},{v}\n" for i, v in data))
    got = read_grouped(spark, str(tmp_path), "id int, val int")
    same(got, [("a", 1, 10), ("a", 2, 20), ("a", 3, 30), ("b", 4, 40)])
    same(got.groupBy("grp").count(), [("a", 3), ("b", 1)])


def test_s5_write_csv(spark, frame, tmp_path):
    path = str(tmp_path / "out")
    write_csv(frame([(1, "x, y"), (2, None)], "id int, text string"), path)
    same(spark.read.option("header", True).schema("id int, text string").csv(path), [(1, "x, y"), (2, None)])
