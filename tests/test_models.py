"""Least squares with several predictors against numpy."""

import numpy as np
import pytest

from loomframe import operators as op


def solved(rows):
    x = np.array([[1.0, *r[1:]] for r in rows])
    y = np.array([r[0] for r in rows])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return [*b, 1 - ((y - x @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()]


def test_per_group(frame):
    rng = np.random.default_rng(0)
    data = []
    for g, shift in (("a", 0.0), ("b", 1e6), (None, -5.0)):
        for _ in range(50):
            u, v, w = (rng.normal(size=3) + shift).tolist()
            data.append((g, 2 * u - 3 * v + 0.5 * w + float(rng.normal()) + shift, u, v, w))
    holes = [("a", None, 1.0, 1.0, 1.0), ("a", 1.0, None, 1.0, 1.0), ("b", float("nan"), 1.0, 1.0, 1.0), ("b", 9.0, 1.0, 1.0, float("nan"))]
    df = frame(data + holes, "g string, y double, u double, v double, w double").repartition(5)
    got = {r.g: r for r in op.fit_linear(df, "y", ["u", "v", "w"], ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        want = solved([d[1:] for d in data if d[0] == g])
        assert (r.n, r["rank"]) == (50, 3)
        assert [r.b_u, r.b_v, r.b_w, r.r2] == pytest.approx(want[1:], rel=1e-5)
        assert r.intercept == pytest.approx(want[0], rel=1e-4, abs=1e-4 * abs(np.mean([d[2] for d in data if d[0] == g])))


def test_rank_falls_short(frame):
    data = [("twice", 1.0, 1.0, 2.0), ("twice", 2.0, 2.0, 4.0), ("twice", 5.0, 3.0, 6.0), ("twice", 5.0, 4.0, 8.0)]
    data += [("flat", float(i), float(i), 7.1) for i in range(5)] + [("few", 1.0, 2.0, 3.0)] + [("none", None, 1.0, 1.0)]
    data += [("same", 4.0, float(i), float(i * i)) for i in range(5)]
    df = frame(data, "g string, y double, u double, v double")
    got = {r.g: r for r in op.fit_linear(df, "y", ["u", "v"], ["g"]).collect()}
    assert {g: (r.n, r["rank"]) for g, r in got.items()} == {"twice": (4, 1), "flat": (5, 1), "few": (1, 0), "none": (0, 0), "same": (5, 2)}
    for g in ("twice", "flat", "few", "none"):
        assert got[g].b_u is got[g].b_v is got[g].intercept is got[g].r2 is None
    same = got["same"]
    assert [same.b_u, same.b_v, same.intercept] == pytest.approx([0, 0, 4.0], abs=1e-9) and same.r2 is None


def test_one_predictor_is_the_line(frame):
    df = frame([(1, 2.0, 1), (1, 4.0, 2), (1, 5.0, 3), (2, 1.0, 1), (2, 0.0, 5)], "g int, y double, x int")
    line = {r.g: r for r in op.fit_per_group(df, "y", "x", ["g"]).collect()}
    for r in op.fit_linear(df, "y", ["x"], ["g"]).collect():
        assert [r.b_x, r.intercept, r.r2, r.n] == pytest.approx([line[r.g].slope, line[r.g].intercept, line[r.g].r2, line[r.g].n])


def test_whole_table_and_wrong_calls(frame):
    df = frame([(1.0, 1.0), (3.0, 2.0)], "y double, x double")
    (r,) = op.fit_linear(df, "y", ["x"]).collect()
    assert (r.n, round(r.b_x, 9), round(r.intercept, 9)) == (2, 2.0, -1.0)
    (r,) = op.fit_linear(df.limit(0), "y", ["x"]).collect()
    assert (r.n, r["rank"], r.b_x) == (0, 0, None)
    assert op.fit_linear(df.limit(0), "y", ["x"], ["y"]).collect() == []
    for xs in ([], ["y"], ["x", "x"]):
        with pytest.raises(ValueError):
            op.fit_linear(df, "y", xs)
