"""Quality rules on repetition inside a text, from suffix arrays.

The words of many texts are sorted together as suffixes (prefix doubling, a text never
matching another), and the longest common prefix of neighbours is read off the doubling
ranks. An interval of the suffix array whose common prefix is at least min_words long is a
repeated passage; its occurrences, each at its longest, give the repeated spans of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ship_package, slices, text_or_empty

SYMBOLS = "#*$%&|<>"

_OUT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, repeat_fraction double, spans array<struct<start:int,length:int>>, base_failed boolean, kept boolean"
)


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word position, the length of the longest passage that starts there and also
    elsewhere in the same text. words: numbers; ends: for each position, the end of its text."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    key = ends.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    fresh = np.empty(n, bool)
    fresh[0], fresh[1:] = True, key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    rank = np.empty(n, np.int64)
    rank[order] = first[group]
    sizes = np.diff(np.append(first, n))
    active = order[sizes[group] > 1]
    levels = [(rank.astype(np.int32))]
    reach = 1
    while len(active):
        behind = active + reach
        inside = behind < ends[active]
        after = np.where(inside, rank[np.where(inside, behind, 0)] + 1, 0)
        key = rank[active] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        old = rank[active]
        fresh = np.empty(len(active), bool)
        fresh[0], fresh[1:] = True, key[1:] != key[:-1]
        other = np.empty(len(active), bool)
        other[0], other[1:] = True, old[1:] != old[:-1]
        first = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        class_first = np.maximum.accumulate(np.where(other, np.arange(len(active)), 0))
        rank[active] = old + first[group] - class_first
        sizes = np.diff(np.append(first, len(active)))
        active = active[sizes[group] > 1]
        levels.append(rank.astype(np.int32))
        reach *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    at = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
    left, right = suffixes[at - 1], suffixes[at]
    common = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < ends[left]) & (b < ends[right])
        same = inside & (levels[k][np.where(inside, a, 0)] == levels[k][np.where(inside, b, 0)])
        common[same] += 1 << k
    best = np.zeros(n, np.int64)
    np.maximum.at(best, left, common)
    np.maximum.at(best, right, common)
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


class Measures:
    """What the rules look at, an array entry per text."""

    def __init__(self, texts: list[str], min_words: int) -> None:
        number: dict[bytes, int] = {}
        words, counts, symbols, lines = [], [], [], []
        for text in texts:
            mine = text.encode().split()
            counts.append(len(mine))
            words += [number.setdefault(w, len(number)) for w in mine]
            symbols.append(sum(text.count(c) for c in SYMBOLS))
            seen: set[str] = set()
            again = 0
            for line in text.split("\n") if "\n" in text else ():
                if line in seen:
                    again += bool(line.encode().split())
                seen.add(line)
            lines.append(again)
        self.n_words = np.array(counts, np.int64)
        self.n_symbols, self.n_dup_lines = np.array(symbols, np.int64), np.array(lines, np.int64)
        self.stops = np.cumsum(self.n_words)
        self.text = np.repeat(np.arange(len(texts)), self.n_words)
        ids = np.array(words, np.int64)
        letters = np.fromiter((len(w.decode()) for w in number), np.int64, len(number))
        length = letters[ids] if len(ids) else np.zeros(0, np.int64)
        best = longest_repeats(ids, np.repeat(self.stops, self.n_words))

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(self.text, values, len(texts)).astype(np.int64)

        self.word_chars = per_text(length)
        starts = np.flatnonzero(best >= 8)
        self.n_repeat_words = per_text(covered(starts, np.full(len(starts), 8), len(ids)))
        starts = np.flatnonzero(best >= min_words)
        self.inside = covered(starts, best[starts], len(ids))
        self.repeat_fraction = per_text(length * self.inside) / np.maximum(self.word_chars, 1)
        self.longest_repeat = np.zeros(len(texts), np.int64)
        np.maximum.at(self.longest_repeat, self.text, best)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)

    def kept(self, most_fraction: float, most_words: int) -> np.ndarray:
        return ~self.base_failed() & (self.repeat_fraction <= most_fraction) & (self.longest_repeat <= most_words)

    def spans(self) -> pa.ListArray:
        """Runs of repeated words, cut where the text ends."""
        inside, text = self.inside, self.text
        opens = inside.copy()
        opens[1:] &= ~(inside[:-1] & (text[1:] == text[:-1]))
        begin = np.flatnonzero(opens)
        runs = np.bincount(np.cumsum(opens)[inside] - 1, minlength=len(begin))
        base = (self.stops - self.n_words)[text[begin]]
        rows = pa.StructArray.from_arrays([pa.array(begin - base, pa.int32()), pa.array(runs, pa.int32())], ["start", "length"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, np.append(0, self.stops)), pa.int32()), rows)


def _measure(min_words: int, most_fraction: float, most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            m = Measures(batch.column("text").to_pylist(), min_words)
            columns = {
                "doc_id": batch.column("doc_id"),
                **{c: pa.array(getattr(m, c)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "repeat_fraction")},
                "spans": m.spans(),
                "base_failed": pa.array(m.base_failed()),
                "kept": pa.array(m.kept(most_fraction, most_words)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 8,
    most_fraction: float = 0.3,
    most_words: int = 100,
) -> DataFrame:
    """One row per row of docs with its measures, base_failed and the verdict kept.

    n_repeat_words counts the words in 8-word windows found twice or more, longest_repeat the
    words of the longest repeated passage (occurrences may overlap), repeat_fraction the share
    of the word characters in repeated passages of min_words or more, whose union spans lists
    (in words from 0). A text fails the base rules with fewer than 20 words or more than 30 %
    of its words in repeated windows; kept also asks for repeat_fraction <= most_fraction and
    longest_repeat <= most_words. A null or empty text has no words and fails. Repeated rows
    each give a row; other columns of docs are not looked at. Texts are whole, nothing is
    shuffled; a task holds a few megabytes of text, or one longer text.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_measure(min_words, most_fraction, most_words), _OUT)


def keep_good(docs: DataFrame, text_col: str = "text", min_words: int = 8, most_fraction: float = 0.3, most_words: int = 100) -> DataFrame:
    """The rows of docs that quality_rules() keeps, with all their columns.

    A null text counts as empty, and empty texts are not kept; repeated rows are judged each.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(Measures(texts, min_words).kept(most_fraction, most_words)))

    return docs.mapInArrow(run, docs.schema)
