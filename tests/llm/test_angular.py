import math
import random

import numpy as np
import pytest

from loomframe.llm import angular
from loomframe.llm.angular import Anchors, angles_to, directions, hard_negatives, overlapping, products, score_bounds

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, k=5):
    """The same by comparing every anchor with every row."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            hits = [(i, -t) for t, i, same in scored if not same and -80 * s <= -100 * t <= -100 * s][:k]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(hits)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives(df, **options).collect()))


@pytest.fixture
def clustered():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 12))
    rows = []
    for i in range(900):
        v = middle[i % 6] + rng.normal(size=12) * (0.05 if i % 3 else 1.0)
        rows.append((i, (v / np.linalg.norm(v)).astype(float).tolist(), i % 4))
    return rows


def test_same_as_comparing_all(spark, clustered):
    want = plain(clustered, every=30)
    assert want and run(spark, clustered, anchor_every=30) == want
    # Several blocks of anchors.
    assert run(spark, clustered, anchor_every=30, block_anchors=7) == want


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.5, 1.0]) for _ in range(3)], i % 2) for i in range(60)]  # many ties
    rows += [(0, [1.0, 1.0, 1.0], 5), (0, [1.0, 1.0, 1.0], 5), (61, None, 1), (62, [1.0], None), (None, [1.0, 0.0, 0.0], 1)]
    rows += [(63, [1.0, None, 0.0], 1), (64, [float("nan"), 0.0, 0.0], 0), (65, [float("inf"), 0.0, 0.0], 0)]
    rows += [(66, [], 1), (67, [2.0], 0), (68, [0.0, 0.0, 0.0], 1), (100, [0.0, 0.0, 0.0], 1), (200, [-1.0, -1.0, -1.0], 0)]
    assert run(spark, rows, anchor_every=20) == plain(rows, every=20)


def test_copies(spark):
    """A third of all rows are one vector."""
    rng = np.random.default_rng(1)
    rows = [(i, [0.5, 0.5, 0.1] if i % 3 == 0 else rng.normal(size=3).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    assert run(spark, rows, anchor_every=50) == plain(rows, every=50)


def test_empty_and_no_anchor(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert run(spark, [(100, None, 0)]) == []
    assert run(spark, [(100, [], 0), (101, [], 0), (102, [], 1)]) == plain([(100, [], 0), (101, [], 0), (102, [], 1)])


def test_other_columns(spark, clustered):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(clustered, SCHEMA)
    for name in ("id", "v", "row", "length", "own", "nearest", "score", "rank"):
        df = df.withColumn(name, F.lit(name))
    assert sorted(map(tuple, hard_negatives(df, anchor_every=60).collect())) == plain(clustered, every=60)


def test_long_vectors_stay_exact():
    rows = np.array([[2**40, 3], [-(2**40), 5]])
    anchors = np.array([[2**10, 1]])
    assert products(rows, anchors, 2.0**51).tolist() == products(rows, anchors, 2.0**54).tolist() == [[2**50 + 3], [5 - 2**50]]
    with pytest.raises(OverflowError):
        products(rows, anchors, 2.0**56)


def test_bounds_hold_every_score(spark):
    import pyarrow as pa

    rng = np.random.default_rng(9)
    v = np.floor(256 * rng.normal(size=(400, 8))).astype(np.int64)
    references = directions(v.astype(float), 5)
    length, angle = angles_to(v.astype(float), references)
    table = pa.table({"id": np.arange(400), "label": np.zeros(400, int), "v": v.tolist(), "length": length, "angles": angle.tolist()})
    anchors = Anchors(table, 8, len(references))
    order = np.lexsort((angle[np.arange(400), angle.argmin(axis=1)], angle.argmin(axis=1)))
    passed = 0
    for at in np.split(order, 40):
        score = products(v[at], v, 1e9)
        near = np.abs(angle[at][:, None, :] - angle).max(axis=2)
        far = np.minimum(angle[at][:, None, :] + angle, 2 * np.pi - angle[at][:, None, :] - angle).min(axis=2)
        low, high = score_bounds(near, far, length[at][:, None], length[at][:, None])
        assert (low * length <= score).all() and (score <= high * length).all()
        wanted = np.full(400, 300_000)
        found = overlapping(anchors, length[at], angle[at], wanted, np.full(400, np.inf))
        assert set(np.flatnonzero((score >= 300_000).any(axis=0))) <= set(found)
        passed += 400 - len(found)
    assert passed > 0  # some runs are not scored at all


def test_runs_out_of_reach_are_not_scored(spark, clustered, monkeypatch):
    """Rows in tight groups: an anchor meets few runs."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    middle = rng.normal(size=(8, 16))
    v = np.floor(256 * (middle[np.arange(4096) // 512] + 0.02 * rng.normal(size=(4096, 16)))).astype(np.int64)
    references = directions(v[::8].astype(float), 8)
    length, angle = angles_to(v.astype(float), references)
    table = pa.table({"id": np.arange(4096), "label": np.zeros(4096, int), "v": v.tolist(), "length": length, "angles": angle.tolist()})
    anchors = Anchors(table.slice(0, 512), 16, len(references))
    floor = angular._first_floor(anchors, 5)
    met = sum(len(overlapping(anchors, length[s : s + 256], angle[s : s + 256], floor, np.full(512, np.inf))) for s in range(0, 4096, 256))
    assert met <= 512 * 2  # of 512 * 16
