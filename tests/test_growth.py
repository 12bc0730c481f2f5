"""Work and memory of a task that grow no faster than the tables."""

from conftest import same
from pyspark.sql import functions as F

from loomframe.queries import QUERIES, matching, shaping


def test_pairs_of_heavy_keys_are_not_made(spark, frame, tmp_path, monkeypatch):
    customers = [(i, [1, 1, 1, 2, 3, None][i % 6], "ab"[i // 6 % 2]) for i in range(600)]
    suppliers = [(j, [1, 1, 2, None][j % 4], j / 4) for j in range(80)] + [(0, 1, 0.0)]
    frame(customers, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    frame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    made, join = [], matching.op.join_hot_keys

    def counted(*args, **more):
        pairs = join(*args, **more)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(matching.op, "join_hot_keys", counted)
    got = QUERIES["join_hot_key"](spark, str(tmp_path))
    want = []
    for nation in (1, 2, 3, None):
        for segment in "ab":
            n = sum(c[1:] == (nation, segment) for c in customers)
            met = [s for s in suppliers if nation is not None and s[1] == nation]
            balance = n * sum(s[2] for s in met) if met else None
            want.append((nation, segment, n * max(len(met), 1), len({s[0] for s in met}), balance))
    same(got, want, "c_nationkey", "c_mktsegment", "n_rows", "n_suppliers", "balance")
    assert made == [2 * (41 + 20 + 1 + 1)]


def test_a_task_is_dealt_no_more_orders_of_a_larger_table(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(shaping, "_MOST_DEALT", 50, raising=False)
    lines = [(i // 4, i % 4 + 1, 2.0, 1.25) for i in range(2000)]
    schema = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    frame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["reshape_longer_value"](spark, str(tmp_path))
    by_task = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert by_task <= 4 * 7 * 50 / 4
    want = [(o, k, 2.0, 1.25) if k < 5 else (o, k, None, None) for o in range(500) for k in range(1, 8)]
    same(got, want, "l_orderkey", "num", "qty", "price")
