"""Hard negatives by angular triangle filtering.

Vectors become integers, and each keeps its length and its angles to a few reference
directions. If a vector lies at the angle p from a reference and an anchor at q, the angle
between the two is at least |p - q| and at most p + q (or 2 pi - p - q): a cosine interval,
and, times both lengths, an interval that holds the score. Rows are laid out along their angle
to the nearest reference, so that runs of rows have narrow ranges of angles; only runs whose
interval reaches into what an anchor still looks for are scored, exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import ship_package, staged

#: Vectors that the reference directions are fitted to: those with the smallest hashes of their ids.
MOST_SAMPLED = 2_048
REFERENCES = 16
#: Rows that are held against an anchor's bounds, and scored, together.
RUN_ROWS = 256
#: Anchors that are sent to the tasks at a time.
BLOCK_ANCHORS = 4_096
_HELD = 500_000
#: Radians by which angles may be off; far more than rounding makes them.
_SLACK = 1e-6


def directions(sample: np.ndarray, n: int = REFERENCES, rounds: int = 5) -> np.ndarray:
    """Unit vectors in the middle of groups of the sample's vectors, by spherical k-means."""
    length = np.linalg.norm(sample, axis=1)
    unit = sample[length > 0] / length[length > 0][:, None]
    if not len(unit):
        return np.eye(1, max(1, sample.shape[1]))
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(n, len(unit)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        long = np.linalg.norm(sums, axis=1)
        centres = np.where(long[:, None] > 1e-9, sums / np.maximum(long, 1e-9)[:, None], centres)
    return centres


def angles_to(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the angle to each reference; a vector without length counts as at a right angle."""
    length = np.linalg.norm(vectors, axis=1)
    cosine = (vectors @ references.T) / np.where(length > 0, length, 1.0)[:, None]
    return length, np.arccos(np.clip(cosine, -1, 1))


def score_bounds(near: np.ndarray, far: np.ndarray, shortest: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of length * cosine for angles from near to far, safe from rounding."""
    low, high = np.cos(np.minimum(far + _SLACK, np.pi)), np.cos(np.maximum(near - _SLACK, 0))
    low = low * np.where(low < 0, longest, shortest)
    high = high * np.where(high > 0, longest, shortest)
    return low - np.abs(low) * 1e-9, high + np.abs(high) * 1e-9


def _numpy(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _measure(references: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, angle = angles_to(_numpy(batch.column("v"), dim).astype(float), references)
            nearest = angle.argmin(axis=1) if len(angle) else np.zeros(0, int)
            own = angle[np.arange(len(angle)), nearest]
            offsets = pa.array(np.arange(0, angle.size + 1, angle.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(length), pa.ListArray.from_arrays(offsets, pa.array(angle.ravel())), pa.array(nearest.astype(np.int32)), pa.array(own)],
                names=[*batch.schema.names, "length", "angles", "nearest", "own"],
            )

    return run


class Anchors:
    """A block of anchors: ids, labels, vectors, lengths, angles."""

    def __init__(self, table: pa.Table, dim: int, references: int) -> None:
        self.id = table["id"].to_numpy()
        self.label = table["label"].to_numpy()
        self.v = _numpy(table["v"].combine_chunks(), dim)
        self.length = table["length"].to_numpy()
        self.angle = _numpy(table["angles"].combine_chunks(), references)
        self.reach = float(np.sqrt((self.v.astype(float) ** 2).sum(axis=1)).max(initial=0.0))


def products(rows: np.ndarray, anchors: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products. `most` bounds them, and every partial sum, in size.

    Below 2**53 doubles hold all of these exactly.
    """
    if most < 2**53:
        return np.rint(rows.astype(float) @ anchors.astype(float).T).astype(np.int64)
    if most >= 2**55:
        raise OverflowError("inner products of these vectors do not fit 55 bits")
    return rows @ anchors.T


def _runs(batches: Iterator[pa.RecordBatch], dim: int, references: int):
    """Runs of rows as they are laid out: id, label, vector, length, angles."""
    for batch in batches:
        for start in range(0, batch.num_rows, RUN_ROWS):
            run = batch.slice(start, RUN_ROWS)
            yield (
                run.column("id").to_numpy(),
                run.column("label").to_numpy(),
                _numpy(run.column("v"), dim),
                run.column("length").to_numpy(),
                _numpy(run.column("angles"), references),
            )


def overlapping(anchors: Anchors, length: np.ndarray, angle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Anchors for which a run may hold scores from low to high."""
    first, last = angle.min(axis=0), angle.max(axis=0)
    near = np.maximum(np.maximum(first - anchors.angle, anchors.angle - last), 0).max(axis=1)
    far = np.minimum(anchors.angle + last, 2 * np.pi - anchors.angle - first).min(axis=1)
    least, most = score_bounds(near, np.maximum(far, near), length.min(), length.max())
    return np.flatnonzero((most * anchors.length >= low) & (least * anchors.length <= high))


def _best(of: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each `of`, smaller ids first among equals."""
    order = np.lexsort((ids, -score, of))
    of = of[order]
    rank = np.arange(len(of)) - np.maximum.accumulate(np.where(np.append(True, of[1:] != of[:-1]), np.arange(len(of)), 0)) if len(of) else of
    return order[rank < k]


def _positives(shared, dim: int, references: int, k: int, floor):
    """The rows of a task that may be among an anchor's positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        low = floor.value.copy()
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def reduce() -> None:
            of, ids, score = (np.concatenate(x) for x in zip(*held, strict=True))
            kept = _best(of, ids, score, k)
            held[:] = [(of[kept], ids[kept], score[kept])]
            full = np.flatnonzero(np.bincount(of[kept], minlength=len(low)) == k)
            least = np.full(len(low), np.iinfo(np.int64).max)
            np.minimum.at(least, of[kept], score[kept])
            low[full] = np.maximum(low[full], least[full])

        for ids, label, v, length, angle in _runs(batches, dim, references):
            near = overlapping(anchors, length, angle, low, np.full(len(low), np.inf))
            if not len(near):
                continue
            score = products(v, anchors.v[near], anchors.reach * max(1.0, float(length.max())))
            fits = (score >= low[near]) & (label[:, None] == anchors.label[near]) & (ids[:, None] != anchors.id[near])
            row, col = np.nonzero(fits)
            held.append((near[col], ids[row], score[row, col]))
            if sum(len(x[0]) for x in held) > _HELD:
                reduce()
        reduce()
        of, ids, score = held[0]
        yield pa.RecordBatch.from_arrays([pa.array(anchors.id[of]), pa.array(ids), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(shared, positives, dim: int, references: int, k: int, share: tuple[int, int]):
    """The rows of a task that may be among the negatives of an anchor and a positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        anchor, positive, top = positives.value  # sorted by anchor
        # Integers from share * top upwards; none where top is negative.
        low = -((-share[0] * top) // share[1])
        starts = np.searchsorted(anchor, np.arange(len(anchors.id) + 1))
        counts = np.diff(starts)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        none, every = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        least, most = np.full(len(anchors.id), none), np.full(len(anchors.id), every)
        np.maximum.at(most, anchor, top)
        np.minimum.at(least, anchor, low)

        def reduce() -> None:
            of, ids, score = (np.concatenate(x) for x in zip(*held, strict=True))
            kept = _best(of, ids, score, k)
            held[:] = [(of[kept], ids[kept], score[kept])]
            full = np.flatnonzero(np.bincount(of[kept], minlength=len(low)) == k)
            lowest = np.full(len(low), none)
            np.minimum.at(lowest, of[kept], score[kept])
            low[full] = np.maximum(low[full], lowest[full])
            least[:] = none
            np.minimum.at(least, anchor, low)

        for ids, label, v, length, angle in _runs(batches, dim, references):
            near = overlapping(anchors, length, angle, least.astype(float), most.astype(float))
            near = near[counts[near] > 0]
            if not len(near):
                continue
            score = products(v, anchors.v[near], anchors.reach * max(1.0, float(length.max())))
            fits = (score >= least[near]) & (score <= most[near]) & (label[:, None] != anchors.label[near])
            row, col = np.nonzero(fits)
            # Each of these for every positive of its anchor.
            n = counts[near[col]]
            pair = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[near[col]], n)
            mine, own = np.repeat(ids[row], n), np.repeat(score[row, col], n)
            inside = (own >= low[pair]) & (own <= top[pair])
            held.append((pair[inside], mine[inside], own[inside]))
            if sum(len(x[0]) for x in held) > _HELD:
                reduce()
        reduce()
        of, ids, score = held[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors.id[anchor[of]]), pa.array(positive[of]), pa.array(ids), pa.array(top[of]), pa.array(score)],
            names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
        )

    return run


def _first_floor(anchors: Anchors, k: int) -> np.ndarray:
    """For each anchor a score that k rows of its label reach, found among the anchors themselves."""
    floor = np.full(len(anchors.id), np.iinfo(np.int64).min)
    for start in range(0, len(floor), 512):
        part = slice(start, start + 512)
        score = products(anchors.v[part], anchors.v, anchors.reach**2)
        same = (anchors.label[part, None] == anchors.label) & (anchors.id[part, None] != anchors.id)
        score = np.where(same, score, np.iinfo(np.int64).min)
        if score.shape[1] >= k:
            floor[part] = np.partition(score, -k, axis=1)[:, -k]
    return floor


_RESULT = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    relabel_every: int = 7,
    n_labels: int = 10,
    anchor_every: int = 100,
    scale: int = 256,
    n_positives: int = 5,
    n_negatives: int = 5,
    share: tuple[int, int] = (80, 100),
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product with an anchor, a
    row whose id is a multiple of anchor_every. An anchor's positives are its n_positives other
    rows of the same label with the highest scores, equal scores by smaller id; for each, the
    n_negatives highest rows of another label with share * positive <= score <= positive are
    returned, ranked from 1 (none where the positive's score is negative). Where the id is a
    multiple of relabel_every, the label becomes (label + 1) % n_labels first.

    Rows with a null id, label or vector, or a component that is null, NaN or infinite, take no
    part. An id that comes several times counts once, with its smallest label and vector.
    Shorter vectors count as filled up with zeros. An empty table gives no rows; other columns
    are not looked at. Scores that may not fit 55 bits stop the job.

    Anchors are taken in blocks of block_anchors (by a hash of their ids); each block reads the
    laid out vectors twice. Blocks, and the positives of a block, are all that reaches the driver.
    """
    ship_package(vectors.sparkSession)
    context = vectors.sparkSession.sparkContext
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    changed = F.when(F.col("id") % relabel_every == 0, (F.col("label") + 1) % n_labels).otherwise(F.col("label"))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    rows = rows.select("id", F.struct(changed.alias("label"), whole.alias("v")).alias("row"))
    rows = staged(rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v"), "vectors")

    anchor: Column = F.col("id") % anchor_every == 0
    seen = rows.agg(F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("least"), F.count_if(anchor).alias("anchors")).first()
    if not seen["anchors"]:
        empty = rows.sparkSession.createDataFrame([], _RESULT).withColumn("rank", F.lit(1))
        return _columns(empty)
    dim = max(1, seen["most"])
    if seen["least"] < dim:
        rows = rows.withColumn("v", F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(v))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(MOST_SAMPLED).select("v").toArrow()
    references = directions(_numpy(sample["v"].combine_chunks(), dim).astype(float))
    n_ref = len(references)
    measured = rows.mapInArrow(_measure(references, dim), "id long, label long, v array<long>, length double, angles array<double>, nearest int, own double")
    # The id tells equal vectors apart, so that copies spread over the tasks.
    along = ["nearest", "own", "id"]
    laid = staged(measured.repartitionByRange(*along).sortWithinPartitions(*along), "angles")

    blocks = -(-seen["anchors"] // block_anchors)
    found = None
    for block in range(blocks):
        mine = laid.where(anchor & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).toArrow()
        if not mine.num_rows:
            continue
        anchors = Anchors(mine, dim, n_ref)
        shared = context.broadcast(anchors)
        floor = context.broadcast(_first_floor(anchors, n_positives))
        near = laid.mapInArrow(_positives(shared, dim, n_ref, n_positives, floor), "anchor_id long, positive_id long, positive_score long")
        by_score = W.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
        top = near.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= n_positives).toArrow()
        number = {a: k for k, a in enumerate(anchors.id.tolist())}
        of = np.array([number[a] for a in top["anchor_id"].to_pylist()], np.int64)
        order = np.argsort(of, kind="stable")
        pairs = context.broadcast((of[order], *(top[c].to_numpy()[order] for c in ("positive_id", "positive_score"))))
        part = laid.mapInArrow(_negatives(shared, pairs, dim, n_ref, n_negatives, share), _RESULT)
        found = part if found is None else found.unionByName(part)
    by_score = W.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= n_negatives)
    return _columns(ranked)


def _columns(df: DataFrame) -> DataFrame:
    return df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
