"""What the operators of this subpackage share: the shared folder, text slices, hot joins."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: whatever stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python step holds at once.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: spark.checkpoint.dir.

    Where the setting is absent and Spark runs in one process (tests), a new temporary
    folder takes its place; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        # Set on the running context instead.
        own = context._jsc.sc().getCheckpointDir()
        folder = own.get() if own.isDefined() else None
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(context, "_loomframe_folder"):
        context._loomframe_folder = tempfile.mkdtemp(prefix="loomframe-")
    return context._loomframe_folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """df written to the shared folder and read back: computed once, and safe from lost executors.

    large_rows: for rows of megabytes. Each is a row group of its own, as writers and readers
    hold row groups whole, however many rows a task has.
    """
    folder = new_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if large_rows:
        writer = writer.option("parquet.block.row.count.limit", "1")
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def rows_alone(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand large rows to Python one by one, and not as many as a task has at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship_package(spark: SparkSession) -> None:
    """Let workers import this package wherever they run: sent once per Spark context."""
    context = spark.sparkContext
    if not hasattr(context, "_loomframe_shipped"):
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="loomframe-code-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._loomframe_shipped = True


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_text(name: str = "doc_id") -> Column:
    """The id as text, for hashing; a null id counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
