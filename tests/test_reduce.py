"""Mergeable states of groups against the whole group at once."""

import sys

import pytest
from conftest import rows, same
from pyspark.sql import functions as F

from loomframe import operators as op


def _runs():
    """Number of rows, their sum of x, and the three smallest ids: missing x count as rows only."""

    def update(state, part):
        ids = part["id"].to_pylist()
        total = sum(v for v in part["x"].to_pylist() if v is not None)
        if state is not None:
            ids, total = ids + state["ids"], total + state["total"]
        return {"n": part.num_rows + (state["n"] if state else 0), "total": total, "ids": sorted(ids)[:3]}

    def merge(a, b):
        return {"n": a["n"] + b["n"], "total": a["total"] + b["total"], "ids": sorted(a["ids"] + b["ids"])[:3]}

    def finish(state):
        # One row per kept id, none for groups of a single row.
        return [{"n": state["n"], "total": state["total"], "first": i} for i in state["ids"]] if state["n"] > 1 else []

    return op.Reduction(update, merge, finish, "n long, total double, ids array<long>", "n long, total double, first long")


@pytest.fixture
def data(spark):
    """A third of the rows in one group, some groups of one row, missing keys and values."""
    h = F.abs(F.xxhash64("id"))
    key = F.when(h % 3 == 0, F.lit("hot")).when(h % 11 != 0, F.concat(F.lit("g"), (h % 700).cast("string")))
    x = F.when(h % 7 != 0, (h % 100).cast("double"))
    return spark.range(9000).select("id", key.alias("g"), (h % 2).cast("int").alias("k"), x.alias("x"))


def expected(df, by):
    places = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"), F.slice(F.sort_array(F.collect_list("id")), 1, 3).alias("ids"))
    return rows(places.where("n > 1").select(*by, "n", "total", F.explode("ids").alias("first")))


@pytest.mark.parametrize("by", [["g"], ["g", "k"]])
def test_same_as_whole_groups(data, monkeypatch, by):
    monkeypatch.setattr(sys.modules["loomframe.operators.nest"], "_HELD_GROUPS", 50)  # many states per group
    for parts in (1, 9):
        assert rows(op.group_reduce(data.repartition(parts), by, _runs())) == expected(data, by)


def test_without_groups_and_empty(data):
    got = op.group_reduce(data, [], _runs())
    same(got, expected(data, []))
    assert op.group_reduce(data.limit(0), ["g"], _runs()).collect() == []
    assert op.group_reduce(data.limit(0), [], _runs()).collect() == []


def test_a_hot_group_sends_states_and_no_rows(data):
    """The shuffle holds at most one state per task and group."""
    few = data.where("g = 'hot'").repartition(4)
    got = op.group_reduce(few, ["g"], _runs())
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Exchange hashpartitioning(g") < plan.index("MapInArrow", plan.index("Exchange hashpartitioning(g"))


def test_state_must_not_hide_a_key(data):
    with pytest.raises(ValueError, match="key"):
        op.group_reduce(data, ["g"], op.Reduction(None, None, None, "g long", "n long"))
