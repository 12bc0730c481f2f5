"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import staged


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the smallest node of the component.

    Each round a node takes the smallest node among itself and its neighbours, then that one's,
    and the edges left between different names make the next, smaller graph; a path of n nodes
    takes about log(n) rounds. Rounds are written to the shared folder. A hub's neighbours are
    combined before the shuffle.
    """
    ends = edges.where("a <> b").select("a", "b")
    graph = staged(ends.union(ends.select("b", "a")).distinct(), "edges")
    names = None
    while True:
        low = graph.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
        up = low.select(F.col("node").alias("up"), F.col("low").alias("root"))
        step = staged(low.join(up, low["low"] == up["up"]).select("node", "root"), "roots")
        if names is None:
            names = step
        else:
            then = step.select(F.col("node").alias("up"), F.col("root").alias("lower"))
            names = names.join(then, names["root"] == then["up"], "left").select("node", F.coalesce("lower", "root").alias("root"))
        first, second = (step.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        between = graph.join(first, "a").join(second, "b").where("a_root <> b_root")
        graph = staged(between.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges")
        if not graph.take(1):
            return staged(names, "components")
