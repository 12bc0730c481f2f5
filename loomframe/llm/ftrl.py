"""Text quality by logistic regression over hashed word n-grams.

A text is a sparse vector of its words, pairs and triples of words, hashed to a fixed number
of places. Weights are learned by follow-the-regularised-leader steps: the labelled rows are
dealt to shards by a hash of their ids, every shard makes its steps in one order from the
common state, and the shards' states are mixed place by place, each weighing by the squared
gradients that it added. A score is the logistic curve at a sparse dot product.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_text, ship_package, slices, staged, text_or_empty

#: Words are runs of letters and digits, or of signs, each by itself.
SIGNS = r"([^\pL\pM\pN_\s]+)"
LONGEST = 3
BITS = 18
_SLICE = 6 << 20
#: Places whose states travel in one row.
_CHUNK = 1 << 12
#: Odd numbers that spread the hashes of words over 64 bits, one for each place in an n-gram.
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: What stands for a word that is the same as the one before it.
_AGAIN = 1


def features(texts: pa.Array, bits: int = BITS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, place, value of every non-zero, in order of text and place. No nulls.

    A word that repeats the one before it counts as a mark of repetition. An n-gram seen c
    times weighs 1 + log(c); each text's values have a square sum of 1.
    """
    n = len(texts)
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts.cast(pa.large_string()), SIGNS, r" \1 "))
    counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    # crc32 of every different word; an empty one comes of white space at either end.
    known = np.array([zlib.crc32(w.encode()) + 2 if w else 0 for w in coded.dictionary.to_pylist()], np.uint64)
    word = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(n), counts)
    text, word = text[word > 0], word[word > 0]
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    word = np.where(same, np.uint64(_AGAIN), word)
    found = []
    with np.errstate(over="ignore"):
        for size in range(1, longest + 1):
            if len(word) < size:
                break
            at = len(word) - size + 1
            mixed = np.full(at, size, np.uint64)
            for k in range(size):
                mixed = (mixed ^ (word[k : k + at] * np.uint64(_SPREAD[k]))) * np.uint64(_SPREAD[0])
                mixed ^= mixed >> np.uint64(29)
            inside = text[:at] == text[size - 1 :]
            place = (mixed[inside] >> np.uint64(64 - bits)).astype(np.int64)
            found.append((text[:at][inside] << bits) + place)
    keys, seen = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    text, place = keys >> bits, keys & ((1 << bits) - 1)
    value = 1 + np.log(seen)
    norm = np.sqrt(np.bincount(text, value * value, n))
    return text, place, value / norm[text]


class Leader:
    """State of follow-the-regularised-leader: sums z, squared gradients n; the last place is the constant."""

    def __init__(self, z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = z, n, alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One example: different places `at`, their values x."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def _teach(state, bits: int, passes: int, settings: tuple):
    """The state of each shard after its steps; its rows come together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z0, n0 = state.value
        shard, rows = None, []

        def learned():
            leader = Leader(z0.copy(), n0.copy(), *settings)
            for _ in range(passes):
                for at, x, label in rows:
                    leader.step(at, x, label)
            starts = range(0, len(z0), _CHUNK)
            z, n = ([x[k : k + _CHUNK].tobytes() for k in starts] for x in (leader.z, leader.n))
            chunks = pa.array(np.arange(len(starts), dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), shard, np.int32)), chunks, pa.array(z), pa.array(n)], names=["shard", "chunk", "z", "n"])

        for batch in slices(batches, "text", _SLICE):
            text, place, value = features(batch.column("text"), bits)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1))
            for k, (mine, label) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                if mine != shard:
                    if rows:
                        yield learned()
                    shard, rows = mine, []
                lo, hi = ends[k], ends[k + 1]
                rows.append((np.append(place[lo:hi], 1 << bits).astype(np.int32), np.append(value[lo:hi], 1.0).astype(np.float32), label))
        if rows:
            yield learned()

    return run


def _mix(state):
    """One chunk of the common state from those of all shards."""

    def run(key, table):
        table = table.sort_by("shard")
        at = slice(key[0].as_py() * _CHUNK, (key[0].as_py() + 1) * _CHUNK)
        z0, n0 = (x[at] for x in state.value)
        z, n = (np.array([np.frombuffer(x) for x in table[c].to_pylist()]) for c in ("z", "n"))
        gain = n - n0
        whole = gain.sum(axis=0)
        share = gain / np.where(whole > 0, whole, 1)
        mixed = [np.where(whole > 0, (share * x).sum(axis=0), x0) for x, x0 in ((z, z0), (n, n0))]
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "z": [mixed[0].tobytes()], "n": [mixed[1].tobytes()]})

    return run


def _score(weights, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in slices(batches, "text", _SLICE):
            text, place, value = features(batch.column("text"), bits)
            total = np.bincount(text, w[place] * value, batch.num_rows) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p)], names=[*keep, "score"])

    return run


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_labelled: int = 200_000,
    shard_rows: int = 8_192,
    rounds: int = 2,
    passes: int = 2,
    bits: int = BITS,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.0,
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels are learned from rows whose crc32(id as text) mod 3 is not 1, at most most_labelled
    labelled ids (those with the smallest hashes). An id with several labels has the smallest;
    null labels do not count; repeated rows of an id count each. Without rows of both labels
    to learn from, the score is the share of label 1, or 0.5 if there are no labels. A null
    text is empty; an empty text's score is that of the constant. Equal texts have equal
    scores; other columns are not looked at. An empty table gives no rows.

    A shard holds the vectors of about shard_rows labelled texts; the state is 2**bits places
    at any size of the input.
    """
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(id_text("doc_id").cast("binary")), F.lit(3))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("held_out", fold == 1)
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.min(F.col(label_col).cast("int")).alias("label"))
        .where(fold != 1)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labelled)
    )
    # At most most_labelled pairs of numbers, so the texts are not shuffled for the join.
    learn = rows.join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    learn = staged(learn, "quality-labelled")
    sizes = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        score = float(max(sizes)) if sizes else 0.5
        return rows.select("doc_id", "held_out", F.lit(score).alias("score"), F.lit(int(score >= 0.5)).alias("predicted"))

    shards = -(-total // shard_rows)
    # The text decides between rows of one id, so that the order is fixed.
    dealt = F.xxhash64("doc_id", "text")
    learn = learn.withColumn("__at", dealt).withColumn("shard", F.pmod("__at", F.lit(shards)).cast("int"))
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))
        # By range, so that every shard is a task of its own.
        ordered = learn.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "__at", "doc_id").select("shard", "label", "text")
        found = ordered.mapInArrow(_teach(state, bits, passes, (alpha, beta, l1, l2)), "shard int, chunk int, z binary, n binary")
        mixed = found.groupBy("chunk").applyInArrow(_mix(state), "chunk int, z binary, n binary").toArrow().sort_by("chunk")
        z, n = (np.frombuffer(b"".join(mixed[c].to_pylist())).copy() for c in ("z", "n"))
    weights = spark.sparkContext.broadcast(Leader(z, n, alpha, beta, l1, l2).weights(slice(None)))
    scored = rows.select("doc_id", "held_out", "text").mapInArrow(
        _score(weights, bits), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
