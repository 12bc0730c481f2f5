"""A hidden Markov language model over words.

States emit symbols: the end of a text, each of the most frequent words, or a class of rarer
words that begin and end alike; a word of a class has its add-one share of the class. So the
model's size is bounded, while the word counts behind it grow with the corpus. Baum-Welch
counts are summed over partitions in a tree; scores are exact likelihoods of whole texts by
the scaled forward recursion.

Texts are read once, into blocks: the distinct words of a few megabytes of text and the texts
as numbers into these. Counts meet words through one window over (word, block) rows and go
back to the blocks, so no task ever holds the vocabulary.

A block is a row, and a row is copied several times on its way through the JVM, its Arrow
buffers and a Python worker. So a task holds one at a time, however many it has; numbers
travel compressed, and the words stay behind once the symbols are known.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import id_text, rows_alone, ship_package, slices, staged, text_or_empty

BLOCK_BYTES = 10 << 20
_LANE_TOKENS = 1 << 19

_BLOCK = "block long, words array<string>, kinds array<int>, n array<long>, id array<long>, held array<boolean>, length array<int>, ids binary"
_TEXTS = "block long, id array<long>, held array<boolean>, length array<int>, ids binary, types int, symbols binary"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Shape(NamedTuple):
    states: int = 8
    words: int = 2048  # symbols of single words
    classes: int = 1024
    segment: int = 256


class Model(NamedTuple):
    begin: np.ndarray  # state at the start of a text
    inside: np.ndarray  # state at the start of a later segment, for training only
    move: np.ndarray  # [from, to]
    emit: np.ndarray  # [state, symbol]
    top: dict[str, int]  # word -> symbol


def _kind(word: bytes, classes: int) -> int:
    return zlib.crc32(word[:1] + word[-2:]) % classes


def _kinds(words: pa.Array, classes: int) -> np.ndarray:
    """_kind of each word that is not empty; it is worked out once for words that begin and end alike."""
    words = words.cast(pa.string())
    if not len(words):
        return np.zeros(0, np.int32)
    cuts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8).astype(np.int32)
    first, last = data[cuts[:-1]], data[cuts[1:] - 1]
    ends = np.where(np.diff(cuts) == 1, 1 << 24 | first, first << 16 | data[np.maximum(cuts[1:] - 2, 0)] << 8 | last)
    found, which = np.unique(ends, return_inverse=True)
    # Of a word of one letter that letter alone, of others the first and the last two.
    letters = (bytes([x & 255]) if x >> 24 else x.to_bytes(3, "big") for x in found.tolist())
    return np.array([_kind(x, classes) for x in letters], np.int32)[which]


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(cell: pa.Scalar, kind: np.dtype, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(cell.as_buffer(), n * kind.itemsize, codec="zstd"), kind) if n else np.zeros(0, kind)


def _row(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _to_blocks(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        # Of the texts so far only the words are held, not what the cutting makes besides.
        chunks: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        ids_of: list[pa.Array] = []
        helds: list[pa.Array] = []
        size = 0

        def add(rows: pa.RecordBatch) -> None:
            words = pc.ascii_split_whitespace(pc.ascii_lower(rows.column("text")))
            per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = words.flatten()
            full = pc.not_equal(flat, "")
            text = np.repeat(np.arange(len(per_text)), per_text)[full.to_numpy(zero_copy_only=False)]
            chunks.append(flat.filter(full))
            lengths.append(np.bincount(text, minlength=len(per_text)))
            ids_of.append(rows.column("id"))
            helds.append(rows.column("held"))

        def flush() -> pa.RecordBatch:
            nonlocal size, task
            flat, length = pa.concat_arrays(chunks), np.concatenate(lengths)
            chunks.clear()
            lengths.clear()
            coded = flat.dictionary_encode()
            del flat
            words, numbers = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False)
            stops = np.cumsum(length + 1)
            # Number 0 is the end of a text, the words follow.
            ids = np.zeros(int(stops[-1]), np.uint32)
            inner = np.ones(len(ids), bool)
            inner[stops - 1] = False
            ids[inner] = numbers
            ids[inner] += 1
            held = pa.concat_arrays(helds)
            learn = ~held.to_numpy(zero_copy_only=False)
            n = np.bincount(ids[np.repeat(learn, length + 1)], minlength=len(words) + 1)
            task += 1
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([task], pa.int64()),
                    _row(pa.concat_arrays([pa.array([""], pa.string()), words])),
                    _row(pa.array(np.concatenate([[-1], _kinds(words, classes)]), pa.int32())),
                    _row(pa.array(n, pa.int64())),
                    _row(pa.concat_arrays(ids_of)),
                    _row(held),
                    _row(pa.array(length + 1, pa.int32())),
                    pa.array([_packed(ids)], pa.binary()),
                ],
                names=["block", "words", "kinds", "n", "id", "held", "length", "ids"],
            )
            ids_of.clear()
            helds.clear()
            size = 0
            return out

        for batch in slices(batches, "text"):
            add(batch)
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield flush()
                pa.default_memory_pool().release_unused()
        if chunks:
            yield flush()
            pa.default_memory_pool().release_unused()

    return run


def _lanes(starts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of segments, longest first, in groups of about half a million tokens."""
    order = np.argsort(-lengths, kind="stable")
    cuts = np.searchsorted(np.cumsum(lengths[order]), np.arange(_LANE_TOKENS, lengths.sum() + _LANE_TOKENS, _LANE_TOKENS))
    yield from (x for x in np.split(order, np.unique(cuts)) if len(x))


def _grid(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[step, lane] symbols of segments sorted by falling length, and how many lanes each step has."""
    steps = int(lengths[0])
    at = starts[None, :] + np.minimum(np.arange(steps)[:, None], lengths[None, :] - 1)
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
    return symbols[at], live


def count_segments(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of segments: begin, inside, move, emit and the log likelihood, in one row."""
    k, size = model.emit.shape
    begin, move, emit, total = np.zeros((2, k)), np.zeros((k, k)), np.zeros((k, size)), 0.0
    to_symbol, a = model.emit.T.astype(np.float32).copy(), model.move.astype(np.float32)
    for lanes in _lanes(starts, lengths):
        grid, live = _grid(symbols, starts[lanes], lengths[lanes])
        head = heads[lanes]
        first = np.where(head[:, None], model.begin, model.inside).astype(np.float32)
        forward = np.zeros((*grid.shape, k), np.float32)
        scale = np.ones(grid.shape, np.float32)
        for t, n in enumerate(live):
            x = (first if t == 0 else forward[t - 1, :n] @ a) * to_symbol[grid[t, :n]]
            c = x.sum(axis=1)
            forward[t, :n] = x / c[:, None]
            scale[t, :n] = c
            total += float(np.log(c, dtype=np.float64).sum())
        back = np.ones((len(lanes), k), np.float32)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            weighted = to_symbol[grid[t, :n]] * back[:n] / scale[t, :n, None]
            if t:
                move += forward[t - 1, :n].T @ weighted
            forward[t, :n] *= back[:n]
            back[:n] = weighted @ a.T
        begin[0] += forward[0][head].sum(axis=0)
        begin[1] += forward[0][~head].sum(axis=0)
        seen = np.arange(grid.shape[1])[None, :] < live[:, None]
        which = grid[seen]
        for state in range(k):
            emit[state] += np.bincount(which, forward[..., state][seen], size)
    return np.concatenate([begin.ravel(), (move * model.move).ravel(), emit.ravel(), [total]])


def log_likelihoods(model: Model, symbols: np.ndarray, lengths: np.ndarray, segment: int) -> np.ndarray:
    """Exact natural log likelihood of each text (laid end to end) by the scaled forward recursion.

    Later segments of a long text are folded to state-by-state matrices side by side and then
    applied in order, so that long texts do not run alone.
    """
    k = len(model.begin)
    to_symbol = model.emit.T.copy()
    base = np.cumsum(lengths) - lengths
    parts = -(-lengths // segment)
    text = np.repeat(np.arange(len(lengths)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = base[text] + number * segment
    size = np.minimum(lengths[text] - number * segment, segment)
    out = np.zeros(len(lengths))
    state = np.zeros((len(lengths), k))
    matrix = np.zeros((len(text), k, k))
    scales = np.zeros(len(text))
    for later in (False, True):
        chosen = np.flatnonzero((number > 0) == later)
        if not len(chosen):
            continue
        for group in _lanes(starts[chosen], size[chosen] * (k if later else 1)):
            lanes = chosen[group]
            grid, live = _grid(symbols, starts[lanes], size[lanes])
            rows = k if later else 1
            x = np.broadcast_to(np.eye(k), (len(lanes), k, k)).copy() if later else np.zeros((len(lanes), 1, k))
            log = np.zeros(len(lanes))
            for t, n in enumerate(live):
                moved = (x[:n].reshape(-1, k) @ model.move).reshape(n, rows, k) if later or t else np.broadcast_to(model.begin, (n, 1, k))
                x[:n] = moved * to_symbol[grid[t, :n]][:, None, :]
                if t % 8 == 7 or t == len(live) - 1 or live[min(t + 1, len(live) - 1)] < n:
                    c = x[:n].sum(axis=(1, 2))
                    x[:n] /= c[:, None, None]
                    log[:n] += np.log(c)
            if later:
                matrix[lanes], scales[lanes] = x, log
            else:
                state[text[lanes]], out[text[lanes]] = x[:, 0], log
    for part in range(1, int(parts.max(initial=0))):
        at = np.flatnonzero(number == part)
        x = np.einsum("ni,nij->nj", state[text[at]], matrix[at])
        c = x.sum(axis=1)
        state[text[at]] = x / c[:, None]
        out[text[at]] += np.log(c) + scales[at]
    return out + np.log(state.sum(axis=1))


def _symbol_type(shape: Shape) -> np.dtype:
    return np.dtype(np.uint16 if shape.words + 1 + shape.classes <= 1 << 16 else np.uint32)


def _symbols(shape: Shape, top: pa.Array, words: pa.Array, kinds: pa.Array) -> np.ndarray:
    """The symbols of a block's words; top: the words that are symbols, in order."""
    out = kinds.to_numpy().astype(np.int64) + (shape.words + 1)
    found = pc.index_in(words, value_set=top)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    out[known] = found.drop_null().to_numpy() + 1
    out[0] = 0
    return out.astype(_symbol_type(shape))


def _to_texts(shape: Shape, shared):
    """Blocks with the symbols of their words in place of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = pa.array(shared.value, pa.string())
        for batch in batches:
            for row in range(batch.num_rows):
                symbols = _symbols(shape, top, batch.column("words")[row].values, batch.column("kinds")[row].values)
                one = batch.slice(row, 1).select(["block", "id", "held", "length", "ids"])
                yield one.append_column("types", pa.array([len(symbols)], pa.int32())).append_column("symbols", pa.array([_packed(symbols)], pa.binary()))
            pa.default_memory_pool().release_unused()

    return run


def _count(shape: Shape, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums = shared.value, 0.0
        for batch in batches:
            for row in range(batch.num_rows):
                length = batch.column("length")[row].values.to_numpy().astype(np.int64)
                base, learn = np.cumsum(length) - length, ~batch.column("held")[row].values.to_numpy(zero_copy_only=False)
                local = _unpacked(batch.column("symbols")[row], _symbol_type(shape), batch.column("types")[row].as_py())
                symbols = local[_unpacked(batch.column("ids")[row], np.dtype(np.uint32), int(length.sum()))]
                base, length = base[learn], length[learn]
                parts = -(-length // shape.segment)
                text = np.repeat(np.arange(len(length)), parts)
                number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
                if len(text):
                    sums = sums + count_segments(model, symbols, base[text] + number * shape.segment, np.minimum(length[text] - number * shape.segment, shape.segment), number == 0)
        if not np.isscalar(sums):
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    return run


def first_model(shape: Shape, unigrams: np.ndarray, top: dict[str, int]) -> Model:
    """Symbols at their frequency, shaken differently in each state; states like to stay."""
    rng = np.random.default_rng(11)
    k = shape.states
    emit = unigrams * np.exp(rng.normal(0, 1, (k, len(unigrams))))
    move = np.full((k, k), 0.3 / k) + 0.7 * np.eye(k)
    return Model(np.full(k, 1 / k), np.full(k, 1 / k), move, emit / emit.sum(axis=1, keepdims=True), top)


def next_model(model: Model, sums: np.ndarray, unigrams: np.ndarray) -> Model:
    """The model that the counts give; each row is smoothed by one count of what it was before counting."""
    k, size = model.emit.shape
    begin, inside = sums[:k] + 1 / k, sums[k : 2 * k] + 1 / k
    move = sums[2 * k : 2 * k + k * k].reshape(k, k) + 1 / k
    emit = sums[2 * k + k * k : -1].reshape(k, size) + unigrams
    return model._replace(begin=begin / begin.sum(), inside=inside / inside.sum(), move=move / move.sum(axis=1, keepdims=True), emit=emit / emit.sum(axis=1, keepdims=True))


def _score(shape: Shape, shared):
    def run(key, blocks: pa.Table, entries: pa.Table) -> pa.Table:
        model, tokens, kinds_n, kinds_v, types = shared.value
        out = []
        for row in range(blocks.num_rows):
            length, held, ids, types_here, packed, symbols = (blocks[c].combine_chunks()[row] for c in ("length", "held", "id", "types", "ids", "symbols"))
            ids, held, length = ids.values, held.values, length.values.to_numpy().astype(np.int64)
            local = _unpacked(symbols, _symbol_type(shape), types_here.as_py()).astype(np.int64)
            count = np.zeros(len(local))
            count[entries["pos"].to_numpy()] = entries["c"].to_numpy()
            shared_symbol = local > shape.words
            inside = np.zeros(len(local))
            kind = local[shared_symbol] - (shape.words + 1)
            inside[shared_symbol] = np.log((count[shared_symbol] + 1) / (kinds_n[kind] + kinds_v[kind] + 1))
            base = np.log10((count + 1) / (tokens + types + 1))
            known = (count > 0).astype(np.int64)
            numbers = _unpacked(packed, np.dtype(np.uint32), int(length.sum()))
            stops = np.cumsum(length)
            # Some texts at a time: about half a million tokens, or one longer text.
            first = 0
            while first < len(length):
                before = stops[first] - length[first]
                last = max(first + 1, int(np.searchsorted(stops, before + _LANE_TOKENS, side="right")))
                mine, size = numbers[before : stops[last - 1]], length[first:last]
                begin = np.cumsum(size) - size
                score = (log_likelihoods(model, local[mine], size, shape.segment) + np.add.reduceat(inside[mine], begin)) / np.log(10)
                out.append(
                    pa.table(
                        [
                            ids[first:last],
                            held[first:last],
                            pa.array(size, pa.int64()),
                            pa.array(np.add.reduceat(known[mine], begin), pa.int64()),
                            pa.array(np.full(len(size), tokens), pa.int64()),
                            pa.array(np.add.reduceat(base[mine], begin)),
                            pa.array(score),
                        ],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )
                )
                first = last
            pa.default_memory_pool().release_unused()
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types_ = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.concat_tables(out) if out else pa.schema(list(zip(names, types_, strict=True))).empty_table()

    return run


class LanguageModel:
    """Blocks of the texts, their word counts and the trained model; score() scores every text."""

    def __init__(self, docs: DataFrame, shape: Shape = Shape(), rounds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> None:
        spark = docs.sparkSession
        ship_package(spark)
        self.shape = shape
        held = F.pmod(F.crc32(id_text("id").cast("binary")), F.lit(7)) == 2
        rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("held", held)
        blocks = staged(rows.mapInArrow(_to_blocks(shape.classes), _BLOCK), "lm-blocks", large_rows=True)
        local = blocks.select("block", F.posexplode(F.arrays_zip("words", "kinds", "n")).alias("pos", "w")).select("block", "pos", F.col("w.words").alias("word"), F.col("w.kinds").alias("kind"), F.col("w.n").alias("n"))
        same = W.partitionBy("word")
        counted = local.select("block", "pos", "kind", "word", F.sum("n").over(same).alias("c"), F.row_number().over(same.orderBy("block")).alias("r"))
        self.entries = staged(counted.select("block", "pos", "c", "kind", F.when(F.col("r") == 1, F.col("word")).alias("word")), "lm-words")
        words = self.entries.where("word is not null")
        self.tokens, self.types = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
        best = words.where("kind >= 0 and c > 0").orderBy(F.desc("c"), "word").limit(shape.words).select("word", "c").collect()
        top = {r["word"]: k + 1 for k, r in enumerate(best)}
        # What the classes hold besides the words that are symbols: at most one row per class.
        totals = words.where("kind >= 0").groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).collect()
        self.kinds_n, self.kinds_v = np.zeros(shape.classes), np.zeros(shape.classes)
        for r in totals:
            self.kinds_n[r["kind"]], self.kinds_v[r["kind"]] = r["n"], r["v"]
        for r in best:
            k = _kind(r["word"].encode(), shape.classes)
            self.kinds_n[k] -= r["c"]
            self.kinds_v[k] -= 1
        ends = words.where("kind < 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        unigrams = np.concatenate([[ends], [r["c"] for r in best], np.zeros(shape.words - len(best)), self.kinds_n]) + 0.1
        unigrams /= unigrams.sum()
        self.model = first_model(shape, unigrams, top)
        self.progress: list[float] = []
        k, size = self.model.emit.shape
        shared = spark.sparkContext.broadcast(list(top))
        with rows_alone(spark):
            self.texts = staged(blocks.drop("n").mapInArrow(_to_texts(shape, shared), _TEXTS), "lm-texts", large_rows=True)
        shared.unpersist()
        for _ in range(rounds if self.tokens else 0):
            shared = spark.sparkContext.broadcast(self.model)
            with rows_alone(spark):
                parts = self.texts.select("held", "length", "ids", "types", "symbols").mapInArrow(_count(shape, shared), "sums binary").rdd
                sums = parts.treeAggregate(np.zeros(2 * k + k * k + k * size + 1), lambda s, r: s + np.frombuffer(bytes(r[0])), lambda a, b: a + b, depth=2)
            self.progress.append(float(sums[-1]))
            self.model = next_model(self.model, sums, unigrams)
            shared.unpersist()

    def score(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every text."""
        spark = self.texts.sparkSession
        shared = spark.sparkContext.broadcast((self.model, self.tokens, self.kinds_n, self.kinds_v, self.types))
        blocks = self.texts.groupBy("block")
        return blocks.cogroup(self.entries.select("block", "pos", "c").groupBy("block")).applyInArrow(_score(self.shape, shared), _SCORE)


def hmm_scores(docs: DataFrame, shape: Shape = Shape(), rounds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text under a model of the texts that are not held out.

    Held out are rows whose crc32(id as text) mod 7 is 2; a null id counts as empty text.
    Letters A to Z are lowered; a text is its words between ASCII white space and one end. A
    null text is empty: it is one end. base_score adds log10((c + 1) / (N + V + 1)) over the
    tokens, score is the log10 likelihood. Training cuts texts into segments; scoring does
    not: its segments are joined exactly. Repeated rows are trained on and scored each. With
    nothing to train on, the first model is used. An empty table gives no rows. Other
    columns are not looked at.
    """
    return LanguageModel(docs, shape, rounds, id_col, text_col).score()
