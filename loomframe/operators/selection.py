"""Exact quantiles by selection: a sketch brackets each rank, only values inside are ranked."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.operators.windows import cumsum
from loomframe.plans.matching import attach_group_stats
from loomframe.plans.sizing import groups_fit


def _place(probs: Sequence[float], i: int):
    """The place of a quantile among a group's values, counted from 0."""
    return (F.col("__all") - 1) * F.lit(probs[i])


def values_near(present: DataFrame, by: Sequence[str], probs: Sequence[float], accuracy: int) -> DataFrame:
    """The rows (by, __x) that may hold quantile ``__i``, with the group's size ``__all`` and
    the number ``__base`` of smaller values that were left out.

    A sketch per group gives a bracket for each quantile; exact counts below and up to its
    ends tell whether the quantile's two neighbours lie inside. Where they do not (a small
    group, or a sketch that missed), the whole group stands for the bracket.
    """
    margin = 3.0 / accuracy
    ends = [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)]
    few = groups_fit(present, by, 8 * len(ends) + 8) if by else None
    sketch = {"__cuts": F.percentile_approx("__x", ends, accuracy)}
    cut = attach_group_stats(present, by, sketch, few_groups=few)

    x, one, counts = F.col("__x"), F.lit(1), {"__all": F.count(F.lit(1)), "__ends": F.first("__cuts")}
    for i in range(len(probs)):
        counts[f"__below{i}"] = F.count(F.when(x < F.col("__cuts")[2 * i], one))
        counts[f"__upto{i}"] = F.count(F.when(x <= F.col("__cuts")[2 * i + 1], one))
    known = attach_group_stats(present, by, counts, source=cut, few_groups=few)

    inside, brackets = [], []
    for i in range(len(probs)):
        place = _place(probs, i)
        good = (F.floor(place) >= F.col(f"__below{i}")) & (F.ceil(place) < F.col(f"__upto{i}"))
        here = ~good | ((x >= F.col("__ends")[2 * i]) & (x <= F.col("__ends")[2 * i + 1]))
        base = F.when(good, F.col(f"__below{i}")).otherwise(F.lit(0))
        inside.append(here)
        brackets.append(F.when(here, F.struct(F.lit(i).alias("__i"), base.alias("__base"))))
    kept = known.where(reduce(lambda a, b: a | b, inside))
    return kept.select(*by, "__x", "__all", F.inline(F.array_compact(F.array(*brackets))))


def select_quantiles(
    df: DataFrame,
    x: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    out: str = "q",
    accuracy: int = 10_000,
    limit: int | None = None,
) -> DataFrame:
    """Interpolated quantiles as ``reframe_quantiles`` gives them, for groups of any size.

    Of a large group only about 6 / ``accuracy`` of its values per quantile are ranked; the
    others are counted where they are read. ``accuracy`` steers the work, not the result.
    The table is read three times. Missing values are left out; a group without any other
    value has no row. NaN is the largest value.
    """
    probs, by = [float(p) for p in probs], list(by)
    present = df.select(*by, F.col(x).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    near = values_near(present, by, probs, accuracy)
    counts = near.groupBy(*by, "__i", "__x").agg(
        F.count(F.lit(1)).alias("__n"), F.first("__all").alias("__all"), F.first("__base").alias("__base")
    )
    ranked = cumsum(counts, "__n", [*by, "__i"], "__x", out="__upto", limit=limit)
    prob = F.array(*[F.lit(p) for p in probs])[F.col("__i")]
    place = (F.col("__all") - 1) * prob
    upto = F.col("__base") + F.col("__upto")

    def value(at):
        return F.max(F.when((at >= upto - F.col("__n")) & (at < upto), F.col("__x")))

    ends = ranked.groupBy(*by, "__i").agg(
        F.first("__all").alias("__all"), value(F.floor(place)).alias("__lo"), value(F.ceil(place)).alias("__hi")
    )
    part = place - F.floor(place)
    between = F.when(part == 0, F.col("__lo")).otherwise(F.col("__lo") + part * (F.col("__hi") - F.col("__lo")))
    return ends.select(*by, prob.alias("prob"), between.alias(out))
