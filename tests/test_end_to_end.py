from conftest import rows, same
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import operators as op


def test_x1_month_means_equal_column_means(frame):
    data = [(i, *[float(i * 10 + (i + 1) * m % 7) for m in range(1, 13)]) for i in range(3)]
    schema = "id int, " + ", ".join(f"month_{m} double" for m in range(1, 13))
    long = op.pivot_longer(
        frame(data, schema), ids=["id"], names_to="month", values_to="v",
        names_pattern=r"month_(\d+)", names_cast={"month": "int"},
    )
    got = long.groupBy("month").agg(L.mean_of("v").alias("m")).orderBy("month").collect()
    assert [r["month"] for r in got] == list(range(1, 13))
    for r in got:
        assert abs(r["m"] - sum(d[r["month"]] for d in data) / 3) < 1e-9


def test_x2_only_full_regions(frame, layout):
    holes = {("A", 2), ("C", 3)}
    data = [(r, m, None if (r, m) in holes else 10.0 * m + ord(r)) for r in "ABC" for m in range(1, 7)]
    df = frame(data, "region string, month int, sales double")
    changed = op.lag_change(df, "sales", ["region"], "month")
    kept = op.keep_groups_all(changed, F.col("sales").isNotNull(), ["region"])
    same(kept.groupBy("region").agg(L.n_complete("sales")), [("B", 6)])


def test_x3_inventory(frame, layout):
    df = frame([("A", 1, 20.0), ("A", 2, 30.0), ("A", 3, 25.0)], "region string, year int, invest double")
    stock = op.accumulate_affine(df, 0.95, "invest", ["region"], "year", init=100.0, out="K")
    same(stock, [(1, 100.0), (2, 125.0), (3, 143.75)], "year", "K")
    assert df.select("region").distinct().count() == 1


def test_x4_capstone(frame, layout):
    wide = [(f"S{i}", "EN"[i % 2], *[float(100 - 5 * i + m) for m in range(6)]) for i in range(1, 6)]
    wide[2] = (*wide[2][:4], None, *wide[2][5:])
    df = frame(wide, "store string, region string, " + ", ".join(f"m{m} double" for m in range(1, 7)))
    long = op.pivot_longer(
        df, ids=["store", "region"], names_to="month", values_to="sales",
        names_pattern=r"m(\d)", names_cast={"month": "int"},
    )
    changed = op.lag_change(long, "sales", ["store"], "month")
    assert changed.count() == 30 and changed.where("change is null").count() == 7 - 1 + 1
    clean = op.keep_groups_all(changed, F.col("sales").isNotNull(), ["store"])
    assert clean.count() == 24 and clean.where("store = 'S3'").count() == 0
    one = op.accumulate_affine(
        changed.where("store = 'S1'"), 0.9, "sales", order_by="month", init=100.0, out="base"
    )
    k, want = 100.0, [100.0]
    for v in wide[0][3:]:
        k = k * 0.9 + v
        want.append(k)
    same(one, [(v,) for v in want], "base")
    totals = clean.groupBy("store").agg(L.sum_of("sales").alias("total"))
    ranked = op.min_rank(totals, "-total", out="place")
    assert rows(ranked, "place", "store") == [(1, "S1"), (2, "S2"), (3, "S4"), (4, "S5")]
