"""Exact deduplication by Grace hashing.

Rows are spread over buckets by their content hash; the buckets are divided again and again,
sixteen ways each time, until the contents of each fit the memory set aside for one table.
A task then walks through its buckets and keeps, per bucket, an open-addressing table whose
slots compare complete contents. Spark's shuffle files are the spill files, and its sort
lays the buckets of a task one after the other.

Copies inside one input partition meet in such a table before the shuffle, so a text that
a third of all rows share is sent once per partition, and its bucket holds it once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SLICE_BYTES, ship_package, slices, staged, text_or_empty

_CLASS = "digest string, text string, keep long, n long"


class ContentTable:
    """Open addressing with linear probing; a slot matches only if the whole content does."""

    def __init__(self) -> None:
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.digests: list[str] = []
        self.texts: list[str] = []
        self.keep: list[int | None] = []
        self.n: list[int] = []
        self.bytes = 0

    def add(self, digest: str, text: str, keep: int | None, n: int) -> None:
        hashed = int(digest[:16], 16)
        mask = len(self.slots) - 1
        at = hashed & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == hashed:
                if self.texts[entry] == text:
                    self.n[entry] += n
                    if keep is not None and (self.keep[entry] is None or keep > self.keep[entry]):
                        self.keep[entry] = keep
                    return
                if self.digests[entry] == digest:
                    raise ValueError(f"two texts share the SHA-256 {digest}")
            at = (at + 1) & mask
        self.slots[at] = len(self.texts)
        self.hashes.append(hashed)
        self.digests.append(digest)
        self.texts.append(text)
        self.keep.append(keep)
        self.n.append(n)
        self.bytes += len(text)
        if 2 * len(self.texts) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def rows(self, with_text: bool) -> pa.RecordBatch:
        texts = self.texts if with_text else [None] * len(self.texts)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.digests, pa.string()), pa.array(texts, pa.string()), pa.array(self.keep, pa.int64()), pa.array(self.n, pa.int64())],
            names=["digest", "text", "keep", "n"],
        )


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within an input partition, so far as a table of bounded size sees them."""
    table = ContentTable()
    for batch in slices(batches, "text"):
        for digest, text, keep in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "id")), strict=True):
            table.add(digest, text, keep, 1)
        if table.bytes > 4 * SLICE_BYTES:
            yield table.rows(True)
            table = ContentTable()
    yield table.rows(True)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table per bucket; the buckets of a task come one after the other."""
    table, current = ContentTable(), None
    for batch in slices(batches, "text"):
        for leaf, digest, text, keep, n in zip(*(batch.column(c).to_pylist() for c in ("leaf", "digest", "text", "keep", "n")), strict=True):
            if leaf != current:
                if table.texts:
                    yield table.rows(False)
                table, current = ContentTable(), leaf
            table.add(digest, text, keep, n)
    if table.texts:
        yield table.rows(False)


def bucket_depth(contents: DataFrame, bucket_bytes: int) -> int:
    """How many sixteen-way divisions make every bucket of several contents fit.

    contents: digest, bytes, one row per content. A bucket with one content is not
    divided further, whatever its size.
    """
    depth = 0
    while depth < 15:
        worst = (
            contents.groupBy(F.substring("digest", 1, depth).alias("leaf"))
            .agg(F.sum("bytes").alias("b"), F.count("*").alias("c"))
            .agg(F.max(F.when(F.col("c") > 1, F.col("b"))))
            .first()[0]
        )
        if worst is None or worst <= bucket_bytes:
            return depth
        depth += max(1, math.floor(math.log(worst / bucket_bytes, 16)))
    return depth


def grace_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, copies.

    A null text counts as empty; empty texts are equal to each other. Of equal texts the row
    with the largest id stays; a null id is smaller than any other. Where rows repeat with
    the same id and text (`copies` of them), exactly one of them is kept. Other columns of
    docs are not looked at. An empty table gives an empty result.

    bucket_bytes: text that the table of one bucket may hold. A single longer text is a
    bucket of its own.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.sha2("text", 256))
    ids = staged(rows.select("id", "digest", F.octet_length("text").alias("bytes")), "grace-ids")
    depth = bucket_depth(ids.groupBy("digest").agg(F.max("bytes").alias("bytes")), bucket_bytes)
    classes = (
        rows.mapInArrow(_collapse, _CLASS)
        .withColumn("leaf", F.substring("digest", 1, depth))
        .repartition("leaf")
        .sortWithinPartitions("leaf")
        .mapInArrow(_buckets, _CLASS)
        .drop("text")
    )
    per_row = ids.groupBy("id", "digest").agg(F.count("*").alias("copies"))
    return (
        per_row.join(classes, "digest")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            F.col("id").alias("doc_id"),
            F.col("keep").alias("keep_id"),
            F.col("n").alias("group_size"),
            (F.col("id").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)).alias("kept"),
            F.col("digest").alias("text_sha256"),
            "copies",
        )
    )
