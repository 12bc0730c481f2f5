"""Least squares with several predictors, per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fit_linear(
    df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), prefix: str = "b_"
) -> DataFrame:
    """Least squares of ``y`` on all of ``xs`` and a constant, one row per group.

    Columns: the keys, ``n`` (rows without a missing value, NaN among them, in y and xs),
    ``rank`` (of the predictors, the constant left out), ``intercept``, one coefficient per
    predictor under ``prefix`` and its name, and ``r2``. Where the predictors do not fix the
    coefficients (one is constant or follows from the others, or there are too few rows) the
    rank falls short of their number and coefficients, intercept and r2 are null; r2 is null
    too where y is constant. Missing keys form a group.

    The rows are reduced to means and centred products, which combine before the shuffle; what
    is solved is one small matrix per group. Their number grows with the square of the number
    of predictors.
    """
    by, xs = list(by), list(xs)
    if not xs:
        raise ValueError("at least one predictor is required")
    if len({y, *xs}) <= len(xs):
        raise ValueError("y and the predictors must be different columns")
    names = [*xs, y]
    clean = df.select(*by, *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"__{i}") for i, c in enumerate(names)])
    whole = reduce(lambda a, b: a & b, [F.col(f"__{i}").isNotNull() for i in range(len(names))])
    used = {f"__{i}": F.when(whole, F.col(f"__{i}")) for i in range(len(names))}
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    products = [F.coalesce(F.covar_pop(f"__{i}", f"__{j}"), F.lit(0.0)) for i, j in pairs]
    means = [F.coalesce(F.avg(f"__{i}"), F.lit(0.0)) for i in range(len(names))]
    sums = clean.withColumns(used).groupBy(*by).agg(
        F.count("__0").alias("n"), F.array(*means).alias("__means"), F.array(*products).alias("__products")
    )
    fields = [T.StructField("rank", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("intercept", *[prefix + x for x in xs], "r2")]
    schema = T.StructType([*[df.schema[c] for c in by], sums.schema["n"], *fields])
    return sums.mapInArrow(_solver(len(xs), pairs, [f.name for f in schema]), schema)


def _solver(p: int, pairs: list[tuple[int, int]], columns: list[str]):
    # Made here, so that it travels to the workers as code and not as an import.
    def solve(n: int, means: np.ndarray, products: np.ndarray) -> tuple:
        cov = np.zeros((p + 1, p + 1))
        for (i, j), v in zip(pairs, products):
            cov[i, j] = cov[j, i] = v
        spread = np.sqrt(np.maximum(np.diag(cov), 0))
        # A spread that is rounding beside the mean counts as none.
        live = spread > 1e-12 * np.abs(means)
        scale = np.where(live, spread, 1.0)
        alike = np.where(np.outer(live, live), cov / np.outer(scale, scale), 0.0)
        rank = int(np.linalg.matrix_rank(alike[:p, :p], tol=1e-10, hermitian=True)) if n else 0
        if rank < p:
            return rank, None, [None] * p, None
        b = np.linalg.solve(alike[:p, :p], alike[:p, p]) * scale[p] / scale[:p]
        r2 = min(1.0, float(b @ cov[:p, p]) / cov[p, p]) if live[p] else None
        return rank, float(means[p] - b @ means[:p]), b.tolist(), r2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                solve(n, np.array(m), np.array(q))
                for n, m, q in zip(*(batch.column(c).to_pylist() for c in ("n", "__means", "__products")))
            ]
            kept = [batch.column(c) for c in batch.schema.names if c not in ("__means", "__products")]
            solved = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64())]
            solved += [pa.array([f[2][k] for f in found], pa.float64()) for k in range(p)]
            solved.append(pa.array([f[3] for f in found], pa.float64()))
            yield pa.RecordBatch.from_arrays([*kept, *solved], names=columns)

    return run
