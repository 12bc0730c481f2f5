"""Blocks against plain windows on a table in which one group holds a third of the rows."""

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe import operators as op
from loomframe.plans.blocks import BLOCK, OrderedBlocks
from loomframe.plans.sizing import large_groups


@pytest.fixture(scope="module")
def skewed(spark):
    h = F.abs(F.xxhash64("id"))
    n = spark.range(6000).select(
        "id",
        F.when(h % 3 == 0, F.lit(0)).otherwise(h % 400).alias("g"),
        (F.abs(F.xxhash64("id", F.lit(1))) % 50).alias("o"),
        F.when(h % 7 != 0, (F.abs(F.xxhash64("id", F.lit(2))) % 100).cast("double")).alias("x"),
    )
    return n.cache()


@pytest.fixture(params=[100, 700])
def limit(request):
    return request.param


@pytest.fixture
def two_levels(monkeypatch):
    """Any cut points are too many for a list; a coarse cell holds three blocks."""
    monkeypatch.setattr("loomframe.plans.blocks.LISTED_CUTS", 0)
    monkeypatch.setattr("loomframe.plans.blocks.FAN", 3)


def agree(got, want, *cols):
    assert rows(got, "id", *cols) == rows(want, "id", *cols)


def along():
    return Window.partitionBy("g").orderBy("o", "id")


def test_large_group_is_found_and_cut_evenly(skewed, limit):
    found = large_groups(skewed, ["g"], limit)
    assert [r["g"] for r in found] == [0]
    blocks = OrderedBlocks(skewed, ["g"], ["o", "id"], limit)
    sizes = blocks.df.where("g = 0").groupBy(BLOCK).count().collect()
    assert len(sizes) >= 2000 // limit
    assert max(r["count"] for r in sizes) < 3 * limit
    assert blocks.df.where("g <> 0").where(F.col(BLOCK).isNotNull()).count() == 0


def test_same_block_on_every_evaluation(skewed):
    blocks = OrderedBlocks(skewed, ["g"], ["o", "id"], 100)
    again = blocks.df.select("id", F.col(BLOCK).alias("again"))
    moved = blocks.df.join(again, "id").where(~F.col(BLOCK).eqNullSafe(F.col("again")))
    assert moved.count() == 0


def test_running_sum(skewed, limit):
    got = op.cumsum(skewed, "x", ["g"], ["o", "id"], out="c", na_rm=True, limit=limit)
    running = along().rowsBetween(Window.unboundedPreceding, 0)
    agree(got, skewed.withColumn("c", F.coalesce(F.sum("x").over(running), F.lit(0.0))), "c")


@pytest.mark.parametrize("n", [1, 150])
def test_lag(skewed, limit, n):
    got = op.lag(skewed, "x", ["g"], ["o", "id"], n, out="c", limit=limit)
    agree(got, skewed.withColumn("c", F.lag("x", n).over(along())), "c")


def test_rolling_reaches_over_several_blocks(skewed, limit):
    got = op.rolling(skewed, "x", "max", 250, ["g"], ["o", "id"], out="c", na_rm=True, limit=limit)
    frame = along().rowsBetween(-250, 0)
    full = F.when(F.count(F.lit(1)).over(frame) == 251, F.max("x").over(frame))
    agree(got, skewed.withColumn("c", full), "c")


def test_ranks(skewed, limit):
    known = F.col("x").isNotNull()
    by_x = Window.partitionBy("g").orderBy(F.col("x").desc_nulls_last())
    got = op.min_rank(skewed, "-x", ["g"], out="c", limit=limit)
    agree(got, skewed.withColumn("c", F.when(known, F.rank().over(by_x))), "c")
    got = op.dense_rank(skewed, "-x", ["g"], out="c", limit=limit)
    agree(got, skewed.withColumn("c", F.when(known, F.dense_rank().over(by_x))), "c")


def test_recurrence(skewed, limit):
    filled = skewed.na.fill({"x": 1.0})
    got = op.accumulate_affine(filled, 0.7, "x", ["g"], ["o", "id"], out="c", limit=limit)
    want = op.accumulate(filled, lambda k, v: 0.7 * k + v, "x", ["g"], ["o", "id"], out="c")
    agree(got, want, "c")


@pytest.mark.parametrize("n", [20, 1500])
def test_first_rows(spark, skewed, n):
    spark.conf.set("loomframe.rowsPerBlock", "100")
    by_x = Window.partitionBy("g").orderBy(F.col("x").desc_nulls_last())
    got = op.slice_max(skewed, "x", n, ["g"])
    agree(got, skewed.withColumn("r", F.rank().over(by_x)).where(F.col("r") <= n))
    got = op.slice_head(skewed, n, ["g"], ["o", "id"])
    agree(got, skewed.withColumn("r", F.row_number().over(along())).where(F.col("r") <= n))
    spark.conf.unset("loomframe.rowsPerBlock")


def test_quantiles(skewed, limit):
    got = op.reframe_quantiles(skewed, "x", [0.1, 0.5, 0.99], ["g"], limit=limit)
    want = op.reframe_quantiles(skewed, "x", [0.1, 0.5, 0.99], ["g"], limit=op.WHOLE_GROUPS)
    assert rows(got) == rows(want)


def test_copies_in_a_nested_group(spark):
    copies = spark.range(3000).select(F.lit("a").alias("g"), (F.col("id") % 2).alias("v"))
    nested = op.nest_parts(copies, ["g"], 200)
    assert max(r["n"] for r in nested.select(F.size("data").alias("n")).collect()) <= 1000
    parts = [r["part"] for r in nested.collect()]
    assert len(parts) > 1 and len(set(parts)) == len(parts) and max(parts) < 15
    assert rows(op.unnest(nested.drop("part")).groupBy("v").count()) == [(0, 1500), (1, 1500)]


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "decimal(12,3)", "string", "float"])
def test_cut_points_of_any_type(spark, kind):
    base = spark.range(3000)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        micros = F.timestamp_micros(F.col("id") * 86_400_000_123)
        key = micros.cast(kind)
    else:
        key = (F.lpad(F.col("id"), 6, "0") if kind == "string" else F.col("id") / 8).cast(kind)
    df = base.select("id", key.alias("k"), F.lit(1).alias("one"))
    got = op.cumsum(df, "one", order_by="k", out="c", limit=500)
    assert got.where("c = id + 1").count() == 3000
    down = op.cumsum(df, "one", order_by="-k", out="c", limit=500)
    assert down.where("c = 3000 - id").count() == 3000


def test_nothing_is_broadcast_beyond_the_limit(spark, skewed):
    spark.conf.set("loomframe.broadcastBytes", "10")
    automatic = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filled = skewed.na.fill({"x": 1.0})
        made = [
            op.lag(filled, "x", ["g"], ["o", "id"], limit=100),
            op.cumsum(filled, "x", ["g"], ["o", "id"], limit=100),
            op.accumulate_affine(filled, 0.7, "x", ["g"], ["o", "id"], limit=100),
            op.min_rank(filled, "x", ["g"], limit=100),
            op.first_last(filled, "x", ["g"], ["o", "id"]),
            op.filter_at_max(filled, "x", ["g"]),
        ]
        for df in made:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    finally:
        spark.conf.unset("loomframe.broadcastBytes")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", automatic)


@pytest.mark.parametrize(
    "name,before,size", [("mean", 0, 700), ("sum", 1, 100), ("min", 7, 100), ("max", 150, 100), ("mean", 150, 10**6), ("sum", 3000, 10**6)]
)
def test_wide_frames_are_put_together(skewed, monkeypatch, name, before, size):
    """The two running values against a walk over every frame."""
    for na_rm, complete in ((True, False), (False, True)):
        both = []
        for wide in (0, 10**9):
            monkeypatch.setattr("loomframe.operators.windows.WIDE_FRAME", wide)
            both.append(op.rolling(skewed, "x", name, before, ["g"], ["o", "id"], out="c", complete=complete, na_rm=na_rm, limit=size))
        assert both[0].schema == both[1].schema
        agree(*both, "c")


def test_wide_frames_without_groups_and_types(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "cast(id % 7 as int) i", "cast(id % 11 as decimal(9,2)) d", "date_add(date'2020-01-01', cast(id * 37 % 101 as int)) t")
    for x, names in (("i", ("mean", "sum")), ("d", ("mean", "sum")), ("t", ("max",))):
        for name in names:
            both = []
            for wide in (0, 10**9):
                monkeypatch.setattr("loomframe.operators.windows.WIDE_FRAME", wide)
                both.append(op.rolling(df, x, name, 120, order_by="-id", out="c", limit=500))
            assert both[0].schema == both[1].schema
            agree(*both, "c")


def test_own_statistic_of_parts(skewed, limit):
    """Population variance from counts, sums and sums of squares."""
    add = lambda a, b: a + b
    spread = op.Mergeable(
        {"n": (F.count, add), "s": (F.sum, add), "q": (lambda c: F.sum(c * c), add)},
        lambda p: p["q"] / F.nullif(p["n"], F.lit(0)) - F.pow(p["s"] / F.nullif(p["n"], F.lit(0)), F.lit(2)),
    )
    got = op.rolling(skewed, "x", spread, 40, ["g"], ["o", "id"], out="c", complete=False, na_rm=True, limit=limit)
    frame = along().rowsBetween(-40, 0)
    agree(got.withColumn("c", F.round("c", 6)), skewed.withColumn("c", F.round(F.var_pop("x").over(frame), 6)), "c")


def test_cost_of_a_row_does_not_grow_with_the_frame(skewed):
    """No frame of the wide form reaches back a number of rows."""
    plan = op.rolling(skewed, "x", "max", 2000, ["g"], ["o", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -2000, currentrow" not in plan


def plain_fold(rows_, step, init=None):
    """Values by id of (g, o, id, x) rows, one group after the other."""
    got, k, group = {}, None, object()
    for g, o, i, x in sorted(rows_, key=lambda r: (r[0], r[1], r[2])):
        if g != group:
            group, k = g, (x if init is None else init)
        else:
            k = None if k is None or x is None else step(k, x)
        got[i] = k
    return got


@pytest.mark.parametrize("size", [100, 700, 10**6])
def test_clamped_steps_compose(skewed, size):
    """Blocks against a walk, row by row; values that are missing end their group."""
    full = skewed.withColumn("x", F.coalesce("x", F.lit(0.5)) - 40)
    data = [(r.g, r.o, r.id, r.x) for r in full.collect()]
    cases = [
        (op.clamped(0.9, low="x"), lambda k, x: max(0.9 * k, x), None),
        (op.clamped(1.0, "x", low=0.0), lambda k, x: max(k + x, 0.0), 10.0),
        (op.clamped(F.when(F.col("x") > 0, 0.0).otherwise(1.1), "x", -50.0, 60.0), lambda k, x: min(max((0.0 if x > 0 else 1.1) * k + x, -50.0), 60.0), None),
    ]
    for steps, walk, init in cases:
        got = op.accumulate(full, steps, "x", ["g"], ["o", "id"], init=init, limit=size)
        want = plain_fold(data, walk, init)
        assert {r.id: r.acc for r in got.collect()} == pytest.approx(want, abs=1e-6)
    holes = [(r.g, r.o, r.id, r.x) for r in skewed.collect()]
    want = plain_fold(holes, lambda k, x: max(0.9 * k, x))
    got = {r.id: r.acc for r in op.accumulate(skewed, op.clamped(0.9, low="x"), "x", ["g"], ["o", "id"], limit=size).collect()}
    assert {i for i, v in got.items() if v is None} == {i for i, v in want.items() if v is None}
    assert {i: v for i, v in got.items() if v is not None} == pytest.approx({i: v for i, v in want.items() if v is not None})


def test_steps_without_groups_and_of_own_family(spark):
    """Remainders of a linear step: a family of its own, over a table that is cut."""
    df = spark.range(3000).withColumn("m", (F.col("id") * 37 % 11).cast("double"))
    steps = op.Steps(
        {"__m": F.col("m"), "__c": F.col("id") % 5},
        {"__m": 1.0, "__c": 0.0},
        lambda a, b: {"__m": a["__m"] * b["__m"] % 97, "__c": (b["__m"] * a["__c"] + b["__c"]) % 97},
        lambda p, k: (p["__m"] * k + p["__c"]) % 97,
    )
    got = [r.acc for r in op.accumulate(df, steps, None, [], "id", init=3.0, limit=500).orderBy("id").collect()]
    k, want = 3, [3]
    for i in range(1, 3000):
        k = (i * 37 % 11 * k + i % 5) % 97
        want.append(k)
    assert got == want


def test_other_functions_stop_on_a_large_table_without_groups(spark):
    df = spark.range(50).withColumn("x", F.col("id").cast("double"))
    assert op.accumulate(df, lambda k, x: k + x, "x", [], "id").count() == 50
    with pytest.raises(ValueError, match="Steps"):
        op.accumulate(df, lambda k, x: k + x, "x", [], "id", limit=10)
    with pytest.raises(Exception, match="not negative"):
        op.accumulate(df, op.clamped(-1.0), "x", [], "id").collect()


def test_two_levels_of_cut_points(skewed, two_levels):
    blocks = OrderedBlocks(skewed, ["g"], ["o", "id"], 100)
    sizes = [r["count"] for r in blocks.df.where("g = 0").groupBy(BLOCK).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 300
    assert blocks.df.where("g <> 0").where(F.col(BLOCK).isNotNull()).count() == 0
    # Blocks follow each other along the order, in more than one coarse cell.
    ends = blocks.df.where("g = 0").groupBy(BLOCK).agg(F.min(F.struct("o", "id")).alias("a"), F.max(F.struct("o", "id")).alias("b")).orderBy(BLOCK).collect()
    assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]))
    assert len({r[BLOCK] >> 32 for r in ends}) > 2


def test_two_levels_give_the_same_values(skewed, two_levels):
    running = along().rowsBetween(Window.unboundedPreceding, 0)
    got = op.cumsum(skewed, "x", ["g"], ["o", "id"], out="c", na_rm=True, limit=100)
    agree(got, skewed.withColumn("c", F.coalesce(F.sum("x").over(running), F.lit(0.0))), "c")
    got = op.lag(skewed, "x", ["g"], ["o", "id"], 250, out="c", limit=100)
    agree(got, skewed.withColumn("c", F.lag("x", 250).over(along())), "c")
    filled = skewed.na.fill({"x": 0.5})
    got = op.accumulate(filled, op.clamped(0.5, "x", 1.0), "x", ["g"], ["o", "id"], out="c", limit=100)
    agree(got.withColumn("c", F.round("c", 6)), op.accumulate(filled, op.clamped(0.5, "x", 1.0), "x", ["g"], ["o", "id"], out="c", limit=10**6).withColumn("c", F.round("c", 6)), "c")


def test_two_levels_without_groups(skewed, two_levels, monkeypatch):
    monkeypatch.setattr("loomframe.plans.blocks._SMALLEST_BLOCK", 100)
    everywhere = Window.orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    got = op.cumsum(skewed, "x", order_by=["o", "id"], out="c", na_rm=True, limit=100)
    agree(got, skewed.withColumn("c", F.coalesce(F.sum("x").over(everywhere), F.lit(0.0))), "c")
    records = op.record_id(skewed, F.col("o") % 10 == 0, ["o", "id"], limit=100)
    agree(records, skewed.withColumn("record", F.sum((F.col("o") % 10 == 0).cast("int")).over(everywhere)), "record")


def test_sample_is_the_same_on_any_layout(skewed):
    from loomframe.plans.sizing import same_rows

    a, b = (sorted(r.id for r in same_rows(skewed.select("id", "o").repartition(n), 0.1).collect()) for n in (2, 7))
    assert a == b and 400 < len(a) < 800
