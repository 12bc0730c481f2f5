"""Toxicity of texts whose words may be written in disguise.

A noisy channel writes letters as digits or signs, repeats them and puts spaces between them.
Words that look like its output become lattices of the characters that may have been meant,
and Viterbi decoding under a character trigram model of the corpus restores them. Restored
words and their beginnings are then weighed by how much more often they occur in toxic texts,
and a logistic curve, fitted on rows that the weights have not seen, turns a text's weights
into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_text, ship_package, slices, text_or_empty

#: What a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "*": "aeiouy"}

# The alphabet of the character model: 0 between words, a to z, ß to ÿ, digits, the rest.
_SIGNS = 62
_DIGIT, _OTHER = 60, 61
_NUMBER = np.full(0x110000, _OTHER, np.uint8)
_NUMBER[ord(" ")] = 0
_NUMBER[ord("a") : ord("z") + 1] = np.arange(1, 27)
_NUMBER[0xDF:0x100] = np.arange(27, 60)
_NUMBER[ord("0") : ord("9") + 1] = _DIGIT

_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_LETTER = re.compile("[a-zß-ÿ]")
_DISGUISED = re.compile(r"(?:[a-zß-ÿ" + re.escape("".join(LEET)) + r"]+)(?<!\d\d\d)$")
_SIGN = re.compile("[" + re.escape("".join(LEET)) + "]")
_REPEAT = re.compile(r"([a-zß-ÿ])\1\1")
_SWAP, _MORE, _SPACE = float(np.log(0.2)), float(np.log(0.3)), float(np.log(0.5))
#: Signs beside a word or alone, and how likely they are to be signs and no letters.
_SIGNS_ONLY = {c: float(np.log(p)) for c, p in {"!": 0.5, "*": 0.3, "|": 0.2, "+": 0.1, "@": 0.01, "$": 0.01}.items()}
_LEAD = re.compile("[" + re.escape("".join(_SIGNS_ONLY)) + "]*$")
_TRAIL = re.compile("[" + re.escape("".join(_SIGNS_ONLY)) + "]*")
_CLASS = _NUMBER.tobytes()
_EDGE_ONLY = "".join(c for c in _EDGE if c not in _SIGNS_ONLY)
_CACHED = 60
_PREFIXES = (4, 5)


def bare(token: str) -> str:
    """Without the signs around it, but for one that may be its first letter."""
    word = token.strip(_EDGE)
    lead = token[: len(token) - len(token.lstrip(_EDGE))]
    return lead[-1] + word if lead[-1:] in ("$", "@") and lead[:-1] == "" and word[:1].isalpha() else word


class Channel:
    """Restores words under log probabilities of characters given the two before them."""

    def __init__(self, trigrams: np.ndarray) -> None:
        self.cost = trigrams
        self.known: dict[tuple[str, str], str] = {}

    def __getstate__(self) -> dict:
        return {"cost": self.cost, "known": {}}

    def _best(self, steps: list[list[tuple[str, float]]]) -> str:
        """The likeliest path of a lattice: each step writes one of several strings.

        A path is a chain of what was written, shared up to where paths part, so memory grows
        with the number of steps.
        """
        if not hasattr(self, "flat"):
            self.flat = self.cost.ravel().tolist()
        cost = self.flat
        # The state is the last two characters.
        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for options in steps:
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (score, path) in states.items():
                for written, extra in options:
                    k, total = state, score + extra
                    for c in written:
                        n = _CLASS[ord(c)]
                        total += cost[k * _SIGNS + n]
                        k = k % _SIGNS * _SIGNS + n if n else 0
                    have = after.get(k)
                    if have is None or have[0] < total:
                        after[k] = (total, (path, written) if written else path)
            states = after
        ends = [(score + cost[k * _SIGNS], path) for k, (score, path) in states.items()]
        top = max(score for score, _ in ends)
        return max(_written(path) for score, path in ends if score == top)

    def _letters(self, word: str) -> list[list[tuple[str, float]]]:
        steps, at = [], 0
        while at < len(word):
            c, run = word[at], 1
            while at + run < len(word) and word[at + run] == c:
                run += 1
            meant = [(c, 0.0)] + [(m, _SWAP) for m in LEET.get(c, "")]
            if run >= 3:
                steps.append([(m * k, cost + _MORE * (k > 1)) for m, cost in meant for k in (1, 2)])
            else:
                steps += [meant] * run
            at += run
        return steps

    def _beside(self, signs: str) -> list[list[tuple[str, float]]]:
        """Signs next to a word: nothing, or the letters they may stand for."""
        steps, at = [], 0
        while at < len(signs):
            c, run = signs[at], len(signs) - at - len(signs[at:].lstrip(signs[at]))
            options = [("", _SIGNS_ONLY[c])]
            if run >= 3:
                steps.append(options + [(m * k, _SWAP + _MORE * (k > 1)) for m in LEET[c] for k in (1, 2)])
            else:
                steps += [options + [(m, _SWAP) for m in LEET[c]]] * run
            at += run
        return steps

    def word(self, token: str) -> str:
        """A token in lower case, restored.

        Restored are tokens of three and more letters, digits and signs of LEET, one of them a
        letter, that do not end in three digits, of any length. One letter alone, repeated
        more than 20 times, is no word and stays.
        """
        word = bare(token)
        if not _SIGN.search(token) and not _REPEAT.search(word):
            return word
        inner = token.strip(_EDGE)
        at = token.find(inner)
        lead, trail = _LEAD.search(token[:at]).group(), _TRAIL.match(token[at + len(inner) :]).group()
        whole = lead + inner + trail
        if (whole, word) in self.known:
            return self.known[whole, word]
        if len(self.known) > 100_000:
            self.known.clear()
        found = word
        if len(whole) >= 3 and _LETTER.search(inner) and _DISGUISED.match(inner) and (len(inner) <= 20 or inner.strip(inner[0])):
            if word != inner:  # a first sign that may be a name's own stays possible as written
                front = [[(lead, 0.0), *self._beside(lead)[0]]]
            else:
                front = self._beside(lead)
            found = self._best(front + self._letters(inner) + self._beside(trail))
        if len(whole) <= _CACHED:
            self.known[whole, word] = found
        return found

    def letter(self, token: str, word: str) -> str:
        """The letter, digit or sign that a token is, as part of a spaced word; empty if it is none."""
        if len(word) == 1 and (word.isalpha() or word in LEET):
            return word
        sign = token.strip(_EDGE_ONLY)
        return sign if sign in _SIGNS_ONLY else ""

    def spaced(self, letters: list[str]) -> list[str]:
        """Words of letters that stood one by one; each gap may be a real one."""
        steps: list[list[tuple[str, float]]] = []
        for k, c in enumerate(letters):
            if k:
                steps.append([("", _SPACE), (" ", _SPACE)])
            steps.append([("", _SIGNS_ONLY[c]) if c in _SIGNS_ONLY else (c, 0.0)] + [(m, _SWAP) for m in LEET.get(c, "")])
        return self._best(steps).split()


def _written(path: tuple | None) -> str:
    parts = []
    while path:
        path, written = path
        parts.append(written)
    return "".join(reversed(parts))


def _tokens(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens in lower case, the number of each token of the texts, tokens per text."""
    number: dict[bytes, int] = {}
    words, counts = [], []
    for text in texts:
        mine = text.lower().encode().split()
        counts.append(len(mine))
        words += [number.setdefault(w, len(number)) for w in mine]
    return [w.decode() for w in number], np.array(words, np.int64), np.array(counts, np.int64)


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character triples, each token with a gap on either side."""
    sums = np.zeros(_SIGNS**3, np.int64)
    for batch in slices(batches, "text"):
        tokens, words, _ = _tokens(batch.column("text").to_pylist())
        if not tokens:
            continue
        often = np.bincount(words, minlength=len(tokens))
        line = np.frombuffer(("  " + "  ".join(bare(t) for t in tokens) + "  ").encode("utf-32-le", "replace"), np.uint32)
        signs = _NUMBER[np.minimum(line, 0x10FFFF)].astype(np.int64)
        gap = (line[:-1] == 32) & (line[1:] == 32)
        which = np.minimum(np.cumsum(np.append(gap[1:], False))[: len(line) - 2], len(tokens) - 1)
        triples = (signs[:-2] * _SIGNS + signs[1:-1]) * _SIGNS + signs[2:]
        sums += np.bincount(triples, often[which], _SIGNS**3).astype(np.int64)
    seen = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(sums[seen])], names=["triple", "n"])


def character_model(rows: DataFrame) -> np.ndarray:
    """Log probabilities [before, last, next] from all texts; at most 62**3 counts reach the driver."""
    counted = rows.select("text").mapInArrow(_characters, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SIGNS**3)
    for r in counted.collect():
        counts[r["triple"]] = r["n"]
    counts = counts.reshape(_SIGNS, _SIGNS, _SIGNS)
    ones = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + _SIGNS)
    pairs = counts.sum(axis=0)
    pairs = (pairs + 5 * ones) / (pairs.sum(axis=1, keepdims=True) + 5)
    return np.log((counts + 5 * pairs) / (counts.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


class _Words:
    """The restored words of a slice of texts, and which text has which."""

    def __init__(self, channel: Channel, texts: list[str]) -> None:
        tokens, words, counts = _tokens(texts)
        self.n = counts
        self.words = [channel.word(t) for t in tokens]
        letters = [channel.letter(t, w) for t, w in zip(tokens, self.words, strict=True)]
        single = np.array([c != "" for c in letters], bool)
        text = np.repeat(np.arange(len(texts)), counts)
        self.number, self.text = words, text
        if not single.any():
            return
        # Three or more single letters in a row, of any number, are read again as spaced words.
        alone = single[words]
        first = alone & ~np.concatenate(([False], alone[:-1] & (text[1:] == text[:-1])))
        begin = np.flatnonzero(first)
        runs = np.bincount(np.cumsum(first)[alone] - 1, minlength=len(begin))
        more, where = [], []
        for b, n in zip(begin[runs >= 3].tolist(), runs[runs >= 3].tolist(), strict=True):
            run = tuple(letters[k] for k in words[b : b + n].tolist())
            if not any(c.isalpha() for c in run) and any(c in _SIGNS_ONLY for c in run):
                continue  # signs between numbers
            found = _spaced(channel, run) if n <= _CACHED else channel.spaced(list(run))
            more += found
            where += [text[b]] * len(found)
        if more:
            base = len(self.words)
            self.words += more
            self.number = np.append(words, base + np.arange(len(more)))
            self.text = np.append(text, np.array(where, np.int64))

    def features(self) -> Iterator[tuple[str, int]]:
        """Each word and beginning with the number of its word."""
        for k, w in enumerate(self.words):
            if len(w) > 2:
                yield w, k
                for p in _PREFIXES:
                    if len(w) > p:
                        yield w[:p] + "-", k


@lru_cache(maxsize=50_000)
def _spaced(channel: Channel, letters: tuple[str, ...]) -> list[str]:
    return channel.spaced(list(letters))


def _count(channel, wanted: dict[str, int] | None):
    """How many texts have each feature; of the wanted ones only, if any are named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            read = _Words(channel.value, batch.column("text").to_pylist())
            number: dict[str, int] = {}
            left, right = [], []
            for feature, k in read.features():
                if wanted is None or feature in wanted:
                    left.append(number.setdefault(feature, len(number)))
                    right.append(k)
            if not number:
                continue
            # Pairs of text and feature, through the words that carry the feature.
            order = np.argsort(right, kind="stable")
            left, right = np.array(left)[order], np.array(right)[order]
            words = np.unique(read.text * len(read.words) + read.number)
            text, word = words // len(read.words), words % len(read.words)
            begin, stop = np.searchsorted(right, word, "left"), np.searchsorted(right, word, "right")
            n = stop - begin
            take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
            pairs = np.unique(np.repeat(text, n) * len(number) + left[take])
            counts = np.bincount(pairs % len(number), minlength=len(number))
            yield pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(counts, pa.int64())], names=["feature", "n"])

    return run


def _measures(channel, weights):
    """Per text the largest weight of a word, the log of the sum of all, the log of the word count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in slices(batches, "text"):
            read = _Words(channel.value, batch.column("text").to_pylist())
            worth = np.zeros(len(read.words))
            for feature, k in read.features():
                w = table.get(feature)
                if w is not None and w > worth[k]:
                    worth[k] = w
            each = worth[read.number]
            top, total = np.zeros(batch.num_rows), np.bincount(read.text, each, batch.num_rows)
            np.maximum.at(top, read.text, each)
            at = batch.schema.get_field_index("text")
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(top), pa.array(np.log1p(total)), pa.array(np.log1p(read.n))], names=[*names, "top", "total", "size"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method on centred columns; the first coefficient is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_labelled: int = 200_000,
    most_features: int = 20_000,
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels are learned from rows whose crc32(id as text) mod 5 is not 0: weights where it is 1
    to 3, the curve where it is 4. At most most_labelled labelled rows are used (those with the
    smallest hashes of their ids), and of their words and beginnings the most_features that
    weigh most; the character model counts all texts. An id with several labels has the
    largest; labels that are null do not count. Without toxic and other rows to learn from,
    the score of every text is the share of toxic rows, 0 if there are none. A null text is
    empty; empty texts are scored like others. Repeated rows each give a row; only the text
    counts for a score.
    """
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(id_text("doc_id").cast("binary")), F.lit(5))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("fold", fold.cast("int"))
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .where(fold != 0)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labelled)
    )
    # At most most_labelled pairs of numbers, so the texts are not shuffled.
    labelled = rows.join(F.broadcast(known), "doc_id")
    channel = spark.sparkContext.broadcast(Channel(character_model(rows)))

    sizes = {(r["learn"], r["label"]): r["count"] for r in labelled.groupBy((F.col("fold") < 4).alias("learn"), "label").count().collect()}
    n1, n0 = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    m1, m0 = sizes.get((False, 1), 0), sizes.get((False, 0), 0)
    share = (n1 + m1) / max(1, n1 + m1 + n0 + m0)
    weights: dict[str, float] = {}
    if n1 and n0:
        learn = labelled.where("fold < 4")
        # A feature of a few toxic texts in a thousand at least, so their number is bounded.
        often = max(3, n1 // 500)
        toxic = learn.where("label = 1").select("text").mapInArrow(_count(channel, None), "feature string, n long")
        in_toxic = {r["feature"]: r["n"] for r in toxic.groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= often).collect()}
        others = learn.where("label = 0").select("text").mapInArrow(_count(channel, in_toxic), "feature string, n long")
        in_others = {r["feature"]: r["n"] for r in others.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
        for feature, a in in_toxic.items():
            b = in_others.get(feature, 0)
            ratio = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
            weight = ratio - 1.5 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if weight > 1:
                weights[feature] = float(weight)
        weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:most_features])
    shared = spark.sparkContext.broadcast(weights)
    measured = "top double, total double, size double"
    beta = np.array([np.log(share / (1 - share)) if 0 < share < 1 else 40.0 * (2 * share - 1), 0, 0, 0])
    if weights:
        check = labelled.where("fold = 4" if m1 and m0 else "fold < 4").select("text", "label").mapInArrow(_measures(channel, shared), "label int, " + measured).toPandas()
        beta = fit_logistic(check[["top", "total", "size"]].to_numpy(), check["label"].to_numpy())
    b0, b1, b2, b3 = (F.lit(float(b)) for b in beta)
    score = 1 / (1 + F.exp(-(b0 + b1 * F.col("top") + b2 * F.col("total") + b3 * F.col("size"))))
    if share in (0.0, 1.0):
        score = F.lit(share)
    return (
        rows.select("doc_id", (F.col("fold") == 0).alias("held_out"), "text")
        .mapInArrow(_measures(channel, shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, " + measured)
        .withColumn("score", score)
        .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
