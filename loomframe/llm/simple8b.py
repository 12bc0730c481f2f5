"""Token ids in Simple-8b files.

A 64-bit word holds a selector in its top four bits and as many ids as fit at the selector's
width. Ids too wide for any selector stand as 0 and are listed as escapes. Each file also
has, for every block of words, the number of ids before it, so that blocks decode at once or
one by one, and the ids and ends of its documents.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import new_folder, ship_package, slices, staged, text_or_empty
from .bpe import ENCODE_BYTES, encode_rows

#: Fixed by the format: ids per word and bits per id of selectors 0 to 15.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

_POWERS = np.uint64(1) << np.arange(60, dtype=np.uint64)
#: Bits of the smaller ids.
_WIDTHS = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)

MAGIC = b"LOOMS8B1"
BLOCK_WORDS = 1024
FILE_IDS = 1 << 22
#: Ids that are packed at once.
_PACK_IDS = 1 << 18


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, how many ids each holds, and positions and values of the escapes."""
    ids = np.asarray(ids, np.uint64)
    escaped = np.flatnonzero(ids >= np.uint64(1) << np.uint64(60))
    values = ids[escaped]
    words, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(ids):
        more, held = _pack_some(ids[at : at + _PACK_IDS + 240])
        words.append(more)
        counts.append(held)
        at += int(held.sum())
    return np.concatenate(words), np.concatenate(counts), escaped.astype(np.uint64), values


def _pack_some(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that begin among the first _PACK_IDS ids, with 240 more ids to look ahead."""
    n = min(len(ids), _PACK_IDS)
    padded = np.concatenate([ids, np.zeros(n + 240 - len(ids), np.uint64)])
    padded[padded >= np.uint64(1) << np.uint64(60)] = 0
    widths = _WIDTHS[np.minimum(padded, np.uint64(len(_WIDTHS) - 1))]
    wide = np.flatnonzero(padded >= len(_WIDTHS))
    widths[wide] = np.searchsorted(_POWERS, padded[wide], side="right")
    # The widest id among the next 2**k, then among the next `count` for each selector.
    selector = np.full(n, 15, np.int64)
    tops, k = [widths], 0
    for s in range(14, -1, -1):
        count = int(COUNTS[s])
        while 2 ** (k + 1) <= count:
            last = tops[-1]
            tops.append(np.maximum(last[: len(last) - 2**k], last[2**k :]))
            k += 1
        top, step = tops[-1], count - 2**k
        fits = np.maximum(top[:n], top[step : step + n]) <= BITS[s]
        if not fits.any():
            break
        selector[fits] = s
    after = (np.arange(n) + COUNTS[selector]).tolist()
    begin, at = [], 0
    while at < n:
        begin.append(at)
        at = after[at]
    begin = np.array(begin, np.int64)
    chosen = selector[begin]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if BITS[s]:
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
            words[mine] |= np.bitwise_or.reduce(padded[begin[mine][:, None] + np.arange(COUNTS[s])] << shifts, axis=1)
    return words, COUNTS[chosen]


def unpack(words: np.ndarray, n: int, escaped: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The n ids of these words."""
    words = np.asarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen):
        if BITS[s]:
            mine = np.flatnonzero(chosen == s)
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
            out[begin[mine][:, None] + np.arange(COUNTS[s])] = (words[mine][:, None] >> shifts) & np.uint64((1 << int(BITS[s])) - 1)
    out = out[:n]
    out[escaped.astype(np.int64)] = values
    return out


def to_bytes(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """A file: magic, six counts, words, ids before each block, escapes, documents."""
    words, counts, escaped, values = pack(ids)
    before = np.concatenate([[0], np.cumsum(counts)])[::BLOCK_WORDS].astype("<u8")
    head = np.array([len(doc_ids), len(ids), len(words), len(before), len(escaped), BLOCK_WORDS], "<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    out = io.BytesIO()
    for part in (head, words.astype("<u8"), before, escaped.astype("<u8"), values.astype("<u8"), numbers, np.cumsum(lengths).astype("<u8"), known):
        out.write(part.tobytes())
    return MAGIC + out.getvalue()


class TokenFile:
    """What to_bytes() wrote. ids(a, b) decodes only the blocks that hold these positions."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n, words, blocks, escapes, self.block_words = (int(x) for x in np.frombuffer(data, "<u8", 6, 8))
        at = 56

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.words, self.before = take("<u8", words), take("<u8", blocks)
        self.escaped, self.values = take("<u8", escapes), take("<u8", escapes)
        numbers, self.ends = take("<i8", docs), take("<u8", docs).astype(np.int64)
        self.doc_ids = [int(d) if ok else None for d, ok in zip(numbers, take("u1", docs), strict=True)]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n if stop is None else stop
        if start >= stop:
            return np.zeros(0, np.uint64)
        first = int(np.searchsorted(self.before, start, side="right")) - 1
        last = int(np.searchsorted(self.before, stop, side="left"))
        base = int(self.before[first])
        words = self.words[first * self.block_words : last * self.block_words]
        inside = (self.escaped >= base) & (self.escaped < stop)
        return unpack(words, stop - base, self.escaped[inside] - np.uint64(base), self.values[inside])[start - base :]


def _write(tokenizer: str, end: int, folder: str, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = fs.FileSystem.from_uri(folder)
        files.create_dir(where, recursive=True)
        context = TaskContext.get()
        part, held, seq = context.partitionId(), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, seq
            data = to_bytes(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [d for h in held for d in h[2]])
            path = f"{where}/part-{part:06d}-{seq:05d}.ls8b"
            own = f"{path}.{context.taskAttemptId()}"
            with files.open_output_stream(own) as out:
                out.write(data)
            files.move(own, path)
            row = [[part], [seq], [path], [sum(len(h[2]) for h in held)], [sum(len(h[0]) for h in held)]]
            held, seq = [], seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "n_docs", "n_ids"])

        for batch in slices(batches, "text", ENCODE_BYTES):
            ids, counts = encode_rows(tokenizer, batch.column("text"), end)
            held.append((ids, counts, batch.column("id").to_pylist()))
            if sum(len(h[0]) for h in held) >= file_ids:
                yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode docs in ascending order of id into token files, and return their manifest.

    manifest: folder, part, seq (the order of the files), path, n_docs, n_ids, before (the ids in
    earlier files). A null text is empty; null ids come first; repeated rows are all written.
    Ranges of ids are dealt to tasks, a task writes a file whenever file_ids ids are together;
    an attempt writes under its own name and moves the file when it is whole, so a repeated
    task replaces a file by the same. folder: one that all executors share, by default in
    spark.checkpoint.dir; anything that pyarrow's file systems open. An empty table has no files.
    """
    ship_package(docs.sparkSession)
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    written = rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(_write(tokenizer, end, folder, file_ids), "part int, seq int, path string, n_docs long, n_ids long")
    manifest = staged(written, "manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("base"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return manifest.withColumn("inside", inside).join(parts, "part").select(F.lit(folder).alias("folder"), "part", "seq", "path", "n_docs", "n_ids", (F.col("base") + F.col("inside")).alias("before"))


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, _ = fs.FileSystem.from_uri(row["folder"])
                with files.open_input_stream(row["path"]) as stream:
                    file = TokenFile(stream.read())
                ids = file.ids().astype("<u4")
                starts = np.concatenate([[0], file.ends[:-1]])
                data = ids.tobytes()
                columns = [
                    pa.array(file.doc_ids, pa.int64()),
                    pa.array(starts + row["before"], pa.int64()),
                    pa.array(file.ends - starts, pa.int64()),
                    pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), file.ends.tolist(), strict=True)], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, file.ends), pa.int32()), pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, and its ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    # A number of its own, as few small rows would else be read by one task.
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("folder", "path", "before").repartition(tasks, "path").mapInArrow(_read(with_ids), schema)
