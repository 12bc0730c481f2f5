import datetime as dt
import itertools

import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import operators as op
from loomframe.operators import grid, joins
from loomframe.plans import blocks


@pytest.fixture(params=["conditions", "search", "scan", "scan in blocks"])
def closest_form(spark, request, monkeypatch):
    """Each way to find the closest value, whatever the size of the lookup table."""
    if request.param != "conditions":
        monkeypatch.setattr(joins, "_INLINE_STEPS", 0)
    if request.param.startswith("scan"):
        monkeypatch.setattr(joins, "_LISTED_BYTES", -1)
    if request.param == "scan in blocks":
        spark.conf.set("loomframe.rowsPerBlock", "2")
        spark.conf.set("loomframe.broadcastBytes", "-1")
        monkeypatch.setattr(blocks, "_SMALLEST_BLOCK", 2)
    yield
    spark.conf.unset("loomframe.rowsPerBlock")
    spark.conf.unset("loomframe.broadcastBytes")


TIERS = [(0, "lo"), (50, "mid"), (100, "hi"), (50, "mid2")]


def test_j1_closest_with_ties_and_no_match(frame, closest_form):
    df = frame([(5,), (55,), (105,), (50,), (-1,), (None,), (55,)], "value int")
    look = frame(TIERS, "threshold int, tier string")
    got = op.join_closest(df, look, "value", ">=", "threshold")
    assert got.columns == ["value", "threshold", "tier"]
    same(got, [(5, 0, "lo"), (55, 50, "mid"), (55, 50, "mid2"), (55, 50, "mid"), (55, 50, "mid2"),
               (105, 100, "hi"), (50, 50, "mid"), (50, 50, "mid2"), (-1, None, None), (None, None, None)])


@pytest.mark.parametrize("sign", [">=", ">", "<=", "<"])
def test_closest_against_brute_force(frame, closest_form, sign):
    compare = joins._COMPARE[sign]
    values, steps = [3, 1, 4, 1, 5, 9, 2, 6, 0], [2, 4, 5, 8]
    df = frame([(v,) for v in values], "v int")
    look = frame([(float(s), f"s{s}") for s in steps], "s double, name string")
    want = []
    for v in values:
        fit = [s for s in steps if compare(v, s)]
        best = (max(fit) if sign[0] == ">" else min(fit)) if fit else None
        want.append((v, None if best is None else f"s{best}"))
    same(op.join_closest(df, look, "v", sign, "s"), want, "v", "name")


@pytest.mark.parametrize("sign", [">=", "<"])
@pytest.mark.parametrize("tied", [False, True])
def test_closest_within_key(frame, layout, sign, tied):
    compare = joins._COMPARE[sign]
    left = [("A", i) for i in range(0, 20, 2)] + [("B", 3), ("C", 1), ("A", 4), (None, 3)]
    right = [("A", t, f"a{t}") for t in (1, 4, 9, 15)] + [("B", 3, "b3"), ("B", 5, "b5")]
    if tied:
        right += [("A", 9, "tie")]
    df = frame(left, "k string, v int")
    look = frame(right, "k string, t int, name string")
    want = []
    for k, v in left:
        fit = [t for rk, t, _ in right if rk == k and compare(v, t)]
        best = (max(fit) if sign[0] == ">" else min(fit)) if fit else None
        hits = [n for rk, t, n in right if rk == k and t == best] or [None]
        want += [(k, v, best, n) for n in hits]
    got = op.join_closest(df, look, "v", sign, "t", by=["k"])
    assert got.columns == ["k", "v", "t", "name"]
    same(got, want)


def test_j2_j3_two_lookups_and_row_minimum(frame, closest_form):
    df = frame([(30,), (90,), (200,)], "hours int")
    look = frame([(0, 1), (50, 2), (100, 3), (300, 4)], "hours int, coef int")
    got = op.join_closest(df, look, "hours", ">=", "hours")
    assert got.columns == ["hours_x", "hours_y", "coef"]
    same(got, [(30, 1), (90, 2), (200, 3)], "hours_x", "coef")
    df = frame([(40, 5), (60, 40)], "h int, d int")
    look = frame([(0, 0, 1.0), (30, 7, 1.1), (60, 30, 1.2)], "hours int, days int, coef double")
    once = op.join_closest(df, look, "h", ">=", "hours")
    twice = op.join_closest(once, look, "d", ">=", "days", suffix=("_hours", "_days"))
    same(twice.select("h", L.row_min("coef_hours", "coef_days")), [(40, 1.0), (60, 1.2)])


def test_j4_names_and_suffixes(frame):
    l = frame([("01-A001", 7), ("02-B002", 6)], "id string, score int")
    r = frame([("01-A001", 9), ("02-B002", 8)], "cust_id string, score int")
    got = op.left_join(l, r, {"id": "cust_id"}, suffix=("_l", "_r"))
    assert got.columns == ["id", "score_l", "score_r"]
    same(got, [("01-A001", 7, 9), ("02-B002", 6, 8)])
    r = r.union(frame([("03", 1)], "a string, b int"))
    same(op.right_join(l, r, {"id": "cust_id"}), [("01-A001", 7, 9), ("02-B002", 6, 8), ("03", None, 1)])
    same(op.stack_rows(l, r), [("01-A001", 7, None), ("02-B002", 6, None), (None, 9, "01-A001"),
                               (None, 8, "02-B002"), (None, 1, "03")], "id", "score", "cust_id")


@pytest.mark.parametrize("chunk", [10_000, 1])
def test_j5_roster_in_every_group(frame, layout, monkeypatch, chunk):
    monkeypatch.setattr(grid, "_CHUNK", chunk)
    a, b = dt.date(2022, 1, 1), dt.date(2022, 1, 2)
    df = frame([(a, "A"), (a, "B"), (b, "A"), (b, "Z"), (b, "A")], "date date, id string")
    roster = frame([("A", 100), ("B", None), ("C", 300)], "id string, salary int")
    got = op.join_per_group(df, roster, ["date"], ["id"]).na.fill({"salary": 0})
    same(got, [(a, "A", 100), (a, "B", 0), (a, "C", 300), (b, "A", 100), (b, "A", 100),
               (b, "B", 0), (b, "C", 300)], "date", "id", "salary")


def test_inequality_join_all_matches(frame, layout):
    df = frame([(5,), (55,), (105,), (-1,), (None,)], "value int")
    look = frame([(0, "lo"), (50, "mid"), (100, "hi"), (None, "none")], "threshold int, tier string")
    want = [(5, "lo"), (55, "lo"), (55, "mid"), (105, "lo"), (105, "mid"), (105, "hi")]
    same(op.join_inequality(df, look, "value", ">=", "threshold", how="inner"), want, "value", "tier")
    got = op.join_inequality(df, look, "value", ">=", "threshold")
    same(got, [*want, (-1, None), (None, None)], "value", "tier")
    assert op.join_inequality(df, look.where("threshold > 999"), "value", ">=", "threshold").count() == 5


@pytest.mark.parametrize("sign", [">=", ">", "<=", "<"])
def test_inequality_join_many_values(frame, sign):
    compare = joins._COMPARE[sign]
    lefts, rights = [i * 7 % 200 for i in range(50)], [i * 3 % 211 for i in range(300)]
    got = op.join_inequality(frame([(v,) for v in lefts], "v int"), frame([(t,) for t in rights], "t int"),
                             "v", sign, "t")
    want = []
    for v in lefts:
        want += [(v, t) for t in rights if compare(v, t)] or [(v, None)]
    same(got, want)


X = [("x1", 1.0, 10.0), ("x2", 4.0, 4.0), ("x3", 50.0, 60.0), ("x4", 0.0, 1000.0), ("x5", 5.5, None)]
Y = [("y1", 2.0, 5.0), ("y2", 0.0, 5.0), ("y3", 10.0, 12.0), ("y4", 60.0, 60.0), ("y5", 1.0, 10.0), ("y6", 61.0, 1e6)]


def test_intervals_against_brute_force(frame):
    x, y = frame(X, "id string, s double, e double"), frame(Y, "id string, s double, e double")
    pairs = [(a, b) for a, b in itertools.product(X, Y) if a[2] is not None]
    inside = [(a[0], b[0]) for a, b in pairs if a[1] >= b[1] and a[2] <= b[2]]
    common = [(a[0], b[0]) for a, b in pairs if a[1] <= b[2] and b[1] <= a[2]]
    span = ("s", "e")
    same(op.join_within(x, y, span, span), inside, "id_x", "id_y")
    same(op.join_overlap(x, y, span, span), common, "id_x", "id_y")
    lonely = [(a[0], None) for a in X if a[0] not in {i for i, _ in inside}]
    same(op.join_within(x, y, span, span, how="left", key=["id"]), inside + lonely, "id_x", "id_y")
    with pytest.raises(ValueError, match="key"):
        op.join_overlap(x, y, span, span, how="left")


def test_fixture_intervals(frame):
    x = frame([(1, 1, 10)], "id int, s int, e int")
    y = frame([(1, 2, 5), (2, 0, 5), (3, 10, 12)], "id int, s int, e int")
    span = ("s", "e")
    same(op.join_within(y, x, span, span), [(1, 1)], "id_x", "id_y")
    same(op.join_overlap(x, y, span, span), [(1, 1), (1, 2), (1, 3)], "id_x", "id_y")


def test_intervals_of_dates_and_times(frame):
    d = dt.date
    x = frame([(1, d(2020, 1, 1), d(2020, 1, 31))], "a int, s date, e date")
    y = frame([(1, d(2020, 1, 31), d(2020, 2, 3)), (2, d(2020, 2, 1), d(2020, 2, 2))], "b int, s date, e date")
    same(op.join_overlap(x, y, ("s", "e"), ("s", "e")), [(1, 1)], "a", "b")
    tx, ty = (f.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("s", "e")}) for f in (x, y))
    same(op.join_overlap(tx, ty, ("s", "e"), ("s", "e")), [(1, 1)], "a", "b")
    same(op.join_within(ty, ty, ("s", "e"), ("s", "e")), [(1, 1), (2, 1), (2, 2)], "b_x", "b_y")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_intervals(frame, seed):
    import random

    rng = random.Random(seed)
    data = [(i, s, s + rng.choice([0, 1, 3, 40, 900])) for i in range(120) for s in [rng.randrange(-500, 500)]]
    df = frame(data, "i int, s int, e int")
    want = [(a[0], b[0]) for a in data for b in data if a[1] <= b[2] and b[1] <= a[2]]
    same(op.join_overlap(df, df, ("s", "e"), ("s", "e")), want, "i_x", "i_y")


def test_c1_complete(frame, layout):
    df = frame([("E", 1, 10), ("W", 3, 30), ("W", 99, 5)], "region string, month int, sales int")
    got = op.complete(df, {"region": None, "month": range(1, 13)}, fill={"sales": 0})
    assert got.count() == 25 and rows(got.agg(F.sum("sales"))) == [(45,)]
    assert rows(got.where("month = 99"), "region") == [("W",)]
    holes = op.missing_cells(df, {"region": None, "month": F.sequence(F.lit(1), F.lit(12))})
    assert holes.count() == 22


def test_complete_fills_made_rows_or_all(frame):
    df = frame([("a", 1, None), ("b", 2, 7)], "g string, m int, x int")
    same(op.complete(df, ["g", "m"], {"x": 0}), [("a", 1, 0), ("a", 2, 0), ("b", 1, 0), ("b", 2, 7)])
    same(op.complete(df, ["g", "m"], {"x": 0}, explicit=False), [("a", 1, None), ("a", 2, 0), ("b", 1, 0), ("b", 2, 7)])


def test_expand_grid(frame):
    base = frame([("E",), ("W",)], "region string")
    assert op.expand_grid(base, month=range(1, 13), kind=["a", "b"]).count() == 48


@pytest.mark.parametrize("strategy", ["conditions", "list", "scan"])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "decimal(12,3)", "string", "double"])
def test_closest_of_any_type_in_any_zone(spark, strategy, kind):
    """No form goes through the Python process's own clock."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = {
            "string": ["b", "d", "d", "f"], "decimal(12,3)": ["1.5", "3.25", "3.25", "9"], "double": ["1.5", "3.25", "3.25", "9"],
            "date": ["2021-03-01", "2021-03-14", "2021-03-14", "2021-04-01"],
        }.get(kind, ["2021-03-14 01:30:00", "2021-03-14 11:30:00", "2021-03-14 11:30:00", "2021-03-15 00:00:00"])
        probes = {
            "string": ["a", "b", "e"], "decimal(12,3)": ["1", "1.5", "4"], "double": ["1", "1.5", "4"],
            "date": ["2021-02-01", "2021-03-01", "2021-03-20"],
        }.get(kind, ["2021-03-14 00:00:00", "2021-03-14 01:30:00", "2021-03-14 12:00:00"])
        look = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", F.col("t").cast(kind).alias("t"))
        left = spark.createDataFrame([(i, v) for i, v in enumerate([*probes, None])], "i int, v string").select("i", F.col("v").cast(kind).alias("v"))
        want = [(0, None), (1, 0), (2, 1), (2, 2), (3, None)]
        same(op.join_closest(left, look, "v", ">=", "t", strategy=strategy), want, "i", "n")
        alone = look.where("n <> 2")
        same(op.join_closest(left, alone, "v", ">=", "t", strategy=strategy), [w for w in want if w[1] != 2], "i", "n")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("strategy", ["conditions", "list", "scan"])
@pytest.mark.parametrize("sign", [">=", "<"])
def test_closest_leaves_nan_out(frame, strategy, sign):
    nan = float("nan")
    look = frame([(1.0, "a"), (nan, "x"), (3.0, "b"), (5.0, "c"), (None, "y")], "s double, name string")
    df = frame([(1, 1.5), (2, 3.5), (3, 9.0), (4, nan), (5, None), (6, 0.0)], "i int, v double")
    names = ["a", "b", "c", None, None, None] if sign == ">=" else ["b", "c", None, None, None, "a"]
    same(op.join_closest(df, look, "v", sign, "s", strategy=strategy), list(enumerate(names, 1)), "i", "name")


@pytest.mark.parametrize("tied", [False, True])
def test_closest_never_matches_missing_keys(frame, layout, tied):
    look = frame([(None, 1, "n"), ("A", 1, "a"), *([("A", 1, "a2")] if tied else [])], "g string, s int, name string")
    df = frame([(None, 5), ("A", 5)], "g string, v int")
    want = [(None, None), ("A", "a"), *([("A", "a2")] if tied else [])]
    same(op.join_closest(df, look, "v", ">=", "s", by=["g"]), want, "g", "name")


def test_closest_strategies_are_checked(frame):
    df = frame([("A", 5)], "g string, v int")
    with pytest.raises(ValueError, match="unknown strategy"):
        op.join_closest(df, df.withColumnRenamed("v", "s"), "v", ">=", "s", strategy="guess")
    with pytest.raises(ValueError, match="takes no by"):
        op.join_closest(df, df.withColumnRenamed("v", "s"), "v", ">=", "s", by=["g"], strategy="list")


@pytest.mark.parametrize("sign", [">=", ">", "<=", "<"])
@pytest.mark.parametrize("kind", ["string", "date", "double"])
def test_inequality_of_any_type_and_key(spark, monkeypatch, sign, kind):
    monkeypatch.setattr(joins, "_RANGE_ROWS", 2)

    def typed(c):
        if kind == "string":
            return F.lpad(c, 3, "0")
        return F.date_add(F.lit("2020-01-01"), c.cast("int")) if kind == "date" else c.cast("double")

    left = spark.range(12).select(F.col("id").alias("i"), (F.col("id") % 3).alias("g"), typed(F.col("id") * 2).alias("a"))
    look = spark.range(15).select(F.col("id").alias("j"), (F.col("id") % 2).alias("g"), typed(F.col("id") + 3).alias("b"))
    look = look.unionByName(spark.range(1).select(F.lit(99).alias("j"), F.lit(0).alias("g"), F.lit(None).cast(look.schema["b"].dataType).alias("b")))
    compare = joins._COMPARE[sign]
    pairs = [(i, j) for i in range(12) for j in range(15) if compare(2 * i, j + 3)]
    every = pairs + [(i, None) for i in range(12) if i not in {p[0] for p in pairs}]
    same(op.join_inequality(left, look, "a", sign, "b"), every, "i", "j")
    same(op.join_inequality(left, look, "a", sign, "b", how="inner"), pairs, "i", "j")
    keyed = [(i, j) for i, j in pairs if i % 3 == j % 2]
    alone = [(i, None) for i in range(12) if i not in {p[0] for p in keyed}]
    got = op.join_inequality(left, look, "a", sign, "b", by=["g"])
    assert got.columns == ["i", "g", "a", "j", "b"]
    same(got, keyed + alone, "i", "j")


def spans_against_brute_force(x, y, by):
    def pairs(test):
        return [(a[0], b[0]) for a in x for b in y if test(a, b) and (not by or a[3] is not None and a[3] == b[3])]

    overlap = pairs(lambda a, b: a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2])
    within = pairs(lambda a, b: a[1] <= a[2] and b[1] <= a[1] and a[2] <= b[2])
    return overlap, within


@pytest.mark.parametrize("by", [[], ["k"]])
def test_intervals_of_all_lengths(frame, by):
    spans = [(0, 0.0, 0.0), (1, 0.0, 1e6), (2, 5.0, 5.0), (3, 5.0, 5.25), (4, -3.0, 1e-9), (5, 7.0, 6.0), (6, 1e6, 1e6), (7, 2.0, 4.0), (8, 5.25, 900.0)]
    x = [(i, a, b, "AB"[i % 2] if i != 2 else None) for i, a, b in spans]
    y = [(i, a, b, "AB"[i % 3 % 2] if i != 3 else None) for i, a, b in spans]
    overlap, within = spans_against_brute_force(x, y, by)
    schema = "i int, s double, e double, k string"
    left, right = frame(x, schema), frame([(i, a, b, k) for i, a, b, k in y], schema.replace("i int", "j int"))
    same(op.join_overlap(left, right, ("s", "e"), ("s", "e"), by=by), overlap, "i", "j")
    same(op.join_within(left, right, ("s", "e"), ("s", "e"), by=by), within, "i", "j")
    left_only = [(a[0], None) for a in x if a[0] not in {p[0] for p in within}]
    same(op.join_within(left, right, ("s", "e"), ("s", "e"), how="left", key=["i"], by=by), within + left_only, "i", "j")


def test_one_long_interval_does_not_gather_the_points(spark):
    """Candidate pairs stay within a small multiple of the pairs that belong to the result."""
    n = 50_000
    points = spark.range(n).select(F.col("id").alias("p"), F.col("id").cast("double").alias("s"), F.col("id").cast("double").alias("e"))
    every = points.union(spark.createDataFrame([(n, 0.0, float(n))], "p long, s double, e double"))
    made = op.join_overlap(every, every, ("s", "e"), ("s", "e"))
    made.write.format("noop").mode("overwrite").save()
    level = joins._NO_LENGTH
    assert made.count() == 3 * n + 1
    # Filed bins: every point interval under its own value, the long one on a level of its own.
    filed = every.select(F.when(F.col("e") > F.col("s"), 1).otherwise(level).alias("l"), F.when(F.col("e") > F.col("s"), F.lit(0.0)).otherwise(F.col("s")).alias("b"))
    assert filed.groupBy("l", "b").count().agg(F.max("count")).first()[0] == 1
