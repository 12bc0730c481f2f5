"""Ranked lexical search: the highest inner products of impact vectors, by norm buckets.

A text's vector holds, for every term that any item of the query set uses, the term's impact:
its integer weight times its integer saturation in the text. The vectors are put in order of
their length and cut into buckets. An item is the vector of ones at its terms; a bucket whose
longest vector times the item's length stays below the item's threshold is passed over
(Cauchy-Schwarz), and so is one whose largest impacts at the item's terms add up to less.
Inside a bucket the item's heaviest terms are added up first; a vector is dropped when its
sum so far and the bound on the rest (its remaining length, and the largest remaining
impacts) stay below the threshold. What survives is scored exactly, in integers.

Thresholds start at the scores that a hashed part of the texts reaches and rise with each
bucket. They only ever hold scores that real rows have, so no row of the result is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import ship_package, slices, staged, text_or_empty

#: Bytes that stand between terms, as blanks; capitals as small letters.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SLICE = 8 << 20
#: Vectors of a bucket.
BUCKET_ROWS = 8_192
#: One text in so many sets the first thresholds.
FIRST_LOOK = 32
#: Items are searched for in blocks of so many, so that what is sent to the tasks is bounded.
BLOCK_ITEMS = 4_096
_HEAVY = 8


def terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of all terms in a row, the different terms, and how many terms each text has."""
    n = len(texts)
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    plain = np.frombuffer(_PLAIN, np.uint8)[data]
    plain = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(plain.tobytes())])
    split = pc.ascii_split_whitespace(plain)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # White space at either end leaves an empty piece.
    full = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)[codes] if n and len(codes) else np.zeros(0, bool)
    text = np.repeat(np.arange(n), counts)
    return codes[full], coded.dictionary, np.bincount(text[full], minlength=n)


def _counted(vocabulary):
    """Per text its number of terms, and its counts of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary.value, pa.large_string())
        for batch in slices(batches, "text", _SLICE):
            codes, words, counts = terms(batch.column("text"))
            number = pc.fill_null(pc.index_in(words, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = number[codes] if len(codes) else codes
            text = np.repeat(np.arange(batch.num_rows), counts)
            keys, tf = np.unique(text[at >= 0] * (len(wanted) + 1) + at[at >= 0], return_counts=True)
            per_text = np.bincount(keys // (len(wanted) + 1), minlength=batch.num_rows)
            offsets = pa.array(np.append(0, np.cumsum(per_text)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array((keys % (len(wanted) + 1)).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64))),
                ],
                names=["doc_id", "n", "term", "tf"],
            )

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", _SLICE):
        codes, words, counts = terms(batch.column("text"))
        of = np.repeat(np.arange(batch.num_rows), counts)
        pairs = np.unique(of * (len(words) + 1) + codes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("item").take(pa.array(pairs // (len(words) + 1))), words.take(pa.array(pairs % (len(words) + 1))).cast(pa.string())],
            names=["item", "term"],
        )


def _impacts(weights, documents: int, words: int):
    """Impact vectors and their lengths from counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            term, tf = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("term", "tf"))
            lengths = pc.list_value_length(batch.column("term")).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(batch.num_rows), lengths)
            m = 100 - 90 + (90 * batch.column("n").to_numpy() * documents) // max(words, 1)
            impact = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[of]))
            norm = np.sqrt(np.bincount(of, impact.astype(float) ** 2, batch.num_rows))
            offsets = pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(norm), pa.ListArray.from_arrays(offsets, pa.array(term)), pa.ListArray.from_arrays(offsets, pa.array(impact))],
                names=["doc_id", "norm", "term", "impact"],
            )

    return run


class Bucket:
    """Vectors of similar length, turned over: for each term the rows that have it."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, lengths: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        self.ids, self.norms = ids, norms
        order = np.argsort(term, kind="stable")
        self.row = np.repeat(np.arange(len(ids)), lengths)[order]
        self.impact = impact[order]
        self.ends = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, term, impact)
        self.longest = float(norms.max(initial=0.0))

    def search(self, item: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that score at least `threshold` (1 at least), and their scores; item: its terms, heaviest first."""
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if np.sqrt(len(item)) * self.longest * (1 + 1e-9) < threshold:
            return nothing
        most = self.most[item]
        item, most = item[most > 0], most[most > 0]
        if most.sum() < threshold:
            return nothing
        n = len(self.ids)
        score, square = np.zeros(n, np.int64), np.zeros(n)
        for t in item[:_HEAVY]:
            at = slice(self.ends[t], self.ends[t + 1])
            score[self.row[at]] += self.impact[at]
            square[self.row[at]] += self.impact[at].astype(float) ** 2
        rest = item[_HEAVY:]
        left = np.sqrt(np.maximum(self.norms**2 * (1 + 1e-9) - square, 0) * len(rest)) * (1 + 1e-9)
        alive = score + np.minimum(left, most[_HEAVY:].sum()) >= threshold
        if not alive.any():
            return nothing
        for t in rest:
            at = slice(self.ends[t], self.ends[t + 1])
            row, impact = self.row[at], self.impact[at]
            mine = alive[row]
            score[row[mine]] += impact[mine]
        found = np.flatnonzero(alive & (score >= max(threshold, 1)))
        return found, score[found]


def _search(items, n_terms: int, k: int, first):
    """The rows of a task that may be among the k best of an item, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_least = dict(first.value)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: list[pa.RecordBatch] = []

        def look() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            cut = [table[c].combine_chunks() for c in ("term", "impact")]
            lengths = pc.list_value_length(cut[0]).to_numpy(zero_copy_only=False).astype(np.int64)
            term, impact = (c.flatten().to_numpy(zero_copy_only=False) for c in cut)
            # A null id comes last among equals.
            ids = pc.fill_null(table["doc_id"], np.iinfo(np.int64).max).to_numpy()
            bucket = Bucket(ids, table["norm"].to_numpy(), lengths, term, impact, n_terms)
            for item, wanted in items.value.items():
                rows, score = bucket.search(wanted, at_least.get(item, 1))
                if not len(rows):
                    continue
                if item in best:
                    rows_ids, score = np.append(best[item][0], ids[rows]), np.append(best[item][1], score)
                else:
                    rows_ids = ids[rows]
                order = np.lexsort((rows_ids, -score))[:k]
                best[item] = rows_ids[order], score[order]
                if len(order) == k:
                    at_least[item] = max(at_least.get(item, 1), int(score[order[-1]]))

        rows = 0
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET_ROWS):
                part = batch.slice(start, BUCKET_ROWS)
                held.append(part)
                rows += part.num_rows
                if rows >= BUCKET_ROWS:
                    look()
                    rows = 0
        if held:
            look()
        if best:
            item = np.repeat(np.array(list(best), np.int64), [len(x[0]) for x in best.values()])
            ids, score = (np.concatenate([x[j] for x in best.values()]) for j in (0, 1))
            ids = pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(score)], names=["item", "doc_id", "score"])

    return run


def lexical_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: for every row of items the k rows of docs of highest score above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z as a-z.
    Equal scores go by ascending id, a null id last; ranks are unique. A null or empty text has
    no terms and is never found, an item without terms finds nothing. Repeated rows count each;
    rows of items that share an id get one ranking for all their terms together. Empty tables
    give no rows; other columns are not looked at.

    Items are taken in blocks of `block_items` by a hash of their ids; each block reads docs
    once. The terms of a block, with their weights, are all that is sent to the tasks.
    """
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item"), text_or_empty(item_text).alias("text"))
    pairs = staged(asked.where("item IS NOT NULL").mapInArrow(_item_terms, "item long, term string").distinct(), "search-items")
    n_items = pairs.select("item").distinct().count()
    blocks = -(-n_items // block_items)
    found = None
    for block in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        part = _search_block(rows, mine.toArrow(), k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def _search_block(rows: DataFrame, pairs: pa.Table, k: int) -> DataFrame:
    spark = rows.sparkSession
    context = spark.sparkContext
    if not pairs.num_rows:
        return spark.createDataFrame([], "item long, doc_id long, score long")
    coded = pairs["term"].combine_chunks().dictionary_encode()
    vocabulary = context.broadcast(coded.dictionary.to_pylist())
    n_terms = len(coded.dictionary)
    counted = staged(rows.mapInArrow(_counted(vocabulary), "doc_id long, n long, term array<int>, tf array<long>"), "search-counts")
    documents, words = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(n_terms, np.int64)
    for r in counted.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect():
        frequency[r["t"]] = r["c"]
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * frequency + 1))).astype(np.int64)
    weights = context.broadcast(weight)

    of, code = pairs["item"].to_numpy(), coded.indices.to_numpy()
    order = np.lexsort((code, -weight[code], of))
    starts = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
    item_terms = dict(zip(of[order][starts].tolist(), np.split(code[order], starts[1:]), strict=True))
    shared = context.broadcast(item_terms)

    full = counted.where(F.size("term") > 0)
    vectors = full.mapInArrow(_impacts(weights, documents, words), "doc_id long, norm double, term array<int>, impact array<long>")
    result = "item long, doc_id long, score long"
    best = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    look = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_LOOK)) == 0)
    seen = look.mapInArrow(_search(shared, n_terms, k, context.broadcast({})), result)
    tenth = seen.withColumn("r", F.row_number().over(best)).where(F.col("r") == k)
    first = {r["item"]: r["score"] for r in tenth.select("item", "score").collect()}
    # Equal lengths are told apart by id, so that copies spread over the buckets.
    ordered = vectors.repartitionByRange(F.col("norm").desc(), F.xxhash64("doc_id")).sortWithinPartitions(F.col("norm").desc(), "doc_id")
    return ordered.mapInArrow(_search(shared, n_terms, k, context.broadcast(first)), result)
