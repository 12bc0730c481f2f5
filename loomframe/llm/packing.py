"""Packing by patterns that non-negative least squares fits to the histogram of lengths.

Patterns are pairs and triples of lengths that fill a sequence exactly. Their repeat counts
are fitted to the numbers of pieces per length, rounded, and what is left goes into the
fullest open sequence that takes it, longest first. All this works on counts per length, so
the driver's work is bounded by the capacity and not by the corpus. Pieces then find their
places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import ship_package, slices, staged, text_or_empty
from .bpe import ENCODE_BYTES, encode_rows

_BUCKET_ROWS = 4096

Plan = list[tuple[int, tuple[int, ...]]]  # how many sequences hold these lengths


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Pairs and triples of these lengths that fill the capacity; 0 is the third of a pair."""
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    out = []
    for a in lengths[lengths * 2 <= capacity].tolist():
        if has[capacity - a]:
            out.append(np.array([[capacity - a, a, 0]]))
        b = np.arange(a, (capacity - a) // 2 + 1)
        b = b[has[b] & has[capacity - a - b]]
        out.append(np.stack([capacity - a - b, b, np.full(len(b), a)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit(shapes: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A being how often a pattern uses a length.

    Accelerated projected gradient; the lengths weigh alike.
    """
    size = len(histogram)
    flat = shapes.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        y = np.bincount(flat, np.repeat(x, 3), size)
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        return r[shapes].sum(axis=1)

    target = histogram.astype(float)
    target[0] = 0
    probe = np.ones(len(shapes))
    for _ in range(20):
        probe = back(used(probe))
        bound = np.linalg.norm(probe)
        probe /= bound
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0, y - back(used(y) - target) / (1.05 * bound))
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = after + (t - 1) / faster * (after - x)
        x, t = after, faster
    return x


def best_fit(left: dict[int, int], capacity: int) -> Plan:
    """Best fit, longest first, on counts: equal sequences are filled together."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(room: int, shape: tuple[int, ...], count: int) -> None:
        bins[room][shape] = bins[room].get(shape, 0) + count

    for length in sorted(left, reverse=True):
        count = left[length]
        for room in range(length, capacity):
            # Each sequence takes as many of this length as fit, so its room is then below the length.
            each = room // length
            while count and bins.get(room):
                shape, there = bins[room].popitem()
                whole = min(there, count // each)
                if whole:
                    put(room - each * length, shape + (length,) * each, whole)
                    count -= whole * each
                part = count if count < each and whole < there else 0
                if part:
                    put(room - part * length, shape + (length,) * part, 1)
                    count = 0
                if there > whole + (part > 0):
                    bins[room][shape] = there - whole - (part > 0)
            if not count:
                break
        each = capacity // length
        if count >= each:
            put(capacity - each * length, (length,) * each, count // each)
        if count % each:
            put(capacity - (count % each) * length, (length,) * (count % each), 1)
    return [(count, shape) for shapes in bins.values() for shape, count in shapes.items()]


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Sequences for so many pieces of each length, as few as the two ways give."""
    left = {n: c for n, c in histogram.items() if c}
    plan: Plan = []
    if full := left.pop(capacity, 0):
        plan.append((full, (capacity,)))
    alone = best_fit(left, capacity)
    counts = np.zeros(capacity + 1)
    for n, c in left.items():
        counts[n] = c
    shapes = patterns(np.array(sorted(left), np.int64), capacity)
    fitted: Plan = []
    rest = dict(left)
    if len(shapes):
        x = fit(shapes, counts)
        # Round along the list, so that fractions of neighbouring patterns add up.
        sums = np.concatenate([[0.0], np.cumsum(x)])
        repeats = np.floor(sums[1:] + 0.5) - np.floor(sums[:-1] + 0.5)
        for k in np.argsort(-repeats, kind="stable")[: int((repeats > 0).sum())]:
            shape = tuple(int(n) for n in shapes[k] if n)
            times = min([int(repeats[k]), *(rest[n] // shape.count(n) for n in shape)])
            if times:
                fitted.append((times, shape))
                for n in shape:
                    rest[n] -= times
    fitted += best_fit({n: c for n, c in rest.items() if c}, capacity)
    return plan + min(fitted, alone, key=lambda p: sum(c for c, _ in p))


class Places:
    """Where the r-th piece of a length goes: its sequence, and its offset there."""

    def __init__(self, plan: Plan) -> None:
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        number = 0
        for count, shape in plan:
            offset = 0
            for length in shape:
                rows[length].append((count, number, offset))
                offset += length
            number += count
        self.sequences = number
        self.of = {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in rows.items()}
        self.stops = {n: np.cumsum(c[0]) for n, c in self.of.items()}

    def find(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.stops[length], ranks, side="right")
        count, number, offset = (c[at] for c in self.of[length])
        return number + ranks - (self.stops[length][at] - count), offset


def _cut(tokenizer: str, end: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, counts = encode_rows(tokenizer, batch.column("text"), end)
            pieces = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = counts - (pieces - 1) * capacity
            start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[row])
            base = (np.cumsum(counts) - counts)[row] + start
            data = ids.tobytes()
            cuts = [data[4 * a : 4 * b] for a, b in zip(base.tolist(), (base + length).tolist(), strict=True)]
            columns = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end: int = 2,
    capacity: int = 1024,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids on request.

    A document is its tokens and the id `end`; one longer than capacity is cut into pieces of
    capacity tokens, the first of which may be shorter. Each sequence is filled from offset 0
    without gaps. A null text is empty (one token); repeated rows are packed each. Other
    columns are not looked at. An empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    pieces = staged(rows.mapInArrow(_cut(tokenizer, end, capacity, keep_ids), schema), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = spark.sparkContext.broadcast(Places(make_plan(histogram, capacity)))

    buckets = max(1, -(-sum(histogram.values()) // _BUCKET_ROWS))
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    bases = placed.groupBy("length", "bucket").agg(F.count("*").alias("c"))
    bases = bases.select("length", "bucket", (F.sum("c").over(W.partitionBy("length").orderBy("bucket")) - F.col("c")).alias("base"))
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = placed.withColumn("rank", inside.cast("long")).join(bases, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = places.value
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                mine = lengths == length
                sequence[mine], offset[mine] = plan.find(length, ranks[mine])
            at = batch.schema.get_field_index("rank")
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    order = [f.name for f in pieces.schema]
    return ranked.select(*order, "rank").mapInArrow(locate, schema + ", sequence_id long, offset long")
