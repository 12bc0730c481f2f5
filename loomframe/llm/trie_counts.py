"""Token counts of texts under a unigram vocabulary, by dynamic programming shared over a trie.

The distinct words of a slice of texts are put in order and make a trie, which is scored level
by level: the forward scores of a prefix are computed once, from those of its shorter
prefixes, and serve every word below. The pieces that end at a node come from an automaton of
the vocabulary that steps once per node. A word's end stores its token count and scores.
Vocabularies are read from a model file and never trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ship_package, slices, text_or_empty

#: What stands before each word.
BEGIN = "▁"
_SLICE = 8 << 20
#: Words of more characters are scored one by one.
_DEEPEST = 128
#: Words that a worker keeps, and the longest that it keeps.
_MOST_WORDS, _LONGEST_KEPT = 400_000, 64


def rank_scores(path: str) -> dict[str, float]:
    """Log probabilities of a vocabulary's pieces, in inverse proportion to their rank.

    The file has ranks and no probabilities. Control, unknown and byte pieces are left out.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    pieces = [model.id_to_piece(i) for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return {p: -math.log(k + 1) - norm for k, p in enumerate(pieces)}


class Pieces:
    """The vocabulary as an automaton: its states are the beginnings of pieces.

    After any characters the state is their longest end that begins a piece. From a state,
    `ends` leads along the pieces that end there, longest first: their lengths and scores.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        alphabet = sorted(set("".join(scores)))
        self.letters = np.array([ord(c) for c in alphabet], np.uint32)
        code = {c: k for k, c in enumerate(alphabet)}
        self.width = len(alphabet)
        children: list[dict[int, int]] = [{}]
        length, score = [0], [0.0]
        for piece, value in scores.items():
            state = 0
            for c in piece:
                child = children[state].get(code[c])
                if child is None:
                    child = children[state][code[c]] = len(children)
                    children.append({})
                    length.append(0)
                    score.append(0.0)
                state = child
            length[state], score[state] = len(piece), value
        fail, first = [0] * len(children), [0] * len(children)
        level = [0]
        while level:
            below = []
            for state in level:
                for c, child in children[state].items():
                    back = fail[state]
                    while back and c not in children[back]:
                        back = fail[back]
                    back = children[back].get(c, 0)
                    fail[child] = 0 if back == child else back
                    below.append(child)
            level = below
            for state in level:
                first[state] = state if length[state] else first[fail[state]]
        self.fail, self.length, self.score = np.array(fail), np.array(length), np.array(score)
        # The longest piece that ends at a state, and the next shorter one behind each of these.
        self.first = np.array(first)
        self.shorter = self.first[self.fail]
        keys = np.array([s * self.width + c for s, edges in enumerate(children) for c in edges], np.int64)
        order = np.argsort(keys)
        # A last key that no look-up asks for.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.targets = np.append(np.array([t for edges in children for t in edges.values()], np.int64)[order], 0)

    def codes(self, characters: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, characters), self.width - 1)
        return np.where(self.letters[at] == characters, at, -1)

    def advance(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after one more character each; a character of no piece leads to the start."""
        after = np.zeros(len(state), np.int64)
        todo = np.flatnonzero(code >= 0)
        state, code = state[todo], code[todo]
        while len(todo):
            key = state * self.width + code
            at = np.searchsorted(self.keys, key)
            found = self.keys[at] == key
            after[todo[found]] = self.targets[at[found]]
            more = ~found & (state > 0)
            todo, code, state = todo[more], code[more], self.fail[state[more]]
        return after


class TrieCounter:
    """Best and summed unigram scores of words, and the tokens of the best segmentation.

    A character that no piece covers costs as many tokens as it has UTF-8 bytes, each at the
    lowest score. Of equally good segmentations the one with fewer tokens counts.
    """

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.pieces = Pieces(scores)
        self.longest = max(map(len, scores))
        self.least = min(scores.values()) - 1
        self.nodes = 0
        # Short words of earlier calls, and their rows in a table.
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, 3))

    def _alone(self, word: str) -> tuple[int, float, float]:
        """A word of many levels, character by character."""
        scores, longest, least = self.scores, self.longest, self.least
        text = BEGIN + word
        path = [(0.0, 0, 0.0)]  # best score, its tokens, log of the sum over segmentations
        for i, c in enumerate(text):
            ways = []
            for j in range(i, max(0, i + 1 - longest) - 1, -1):
                s = scores.get(text[j : i + 1])
                if s is not None:
                    score, tokens, total = path[j - i - 1]
                    ways.append((score + s, tokens + 1, total + s))
            if c not in scores:
                n = len(c.encode())
                score, tokens, total = path[-1]
                ways.append((score + n * least, tokens + n, total + n * least))
            best, tokens, _ = min(ways, key=lambda w: (-w[0], w[1]))
            top = max(w[2] for w in ways)
            path.append((best, tokens, top + math.log(sum(math.exp(w[2] - top) for w in ways))))
            del path[: -longest - 1]
        self.nodes += len(text)
        return path[-1][1], path[-1][0], path[-1][2]

    def count(self, words: list[str]) -> np.ndarray:
        """tokens, best score, log of the summed score of each of these words."""
        if len(self.known) > _MOST_WORDS:
            self.known, self.table = {}, np.zeros((0, 3))
        at = list(map(self.known.get, words))
        new = list(dict.fromkeys([w for w, k in zip(words, at, strict=True) if k is None]))
        found = self._walk(new)
        kept = np.array([len(w) <= _LONGEST_KEPT for w in new], bool)
        place = dict(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        table = np.concatenate([self.table, found])
        rows = np.array([place[w] if k is None else k for w, k in zip(words, at, strict=True)], np.int64)
        if kept.all():
            self.known |= place
            self.table = table
        else:
            ours = [w for w, keep in zip(new, kept, strict=True) if keep]
            self.known |= zip(ours, range(len(self.table), len(self.table) + len(ours)), strict=True)
            self.table = np.concatenate([self.table, found[kept]])
        return table[rows]

    def _walk(self, words: list[str]) -> np.ndarray:
        """The same for different words.

        Their trie is built and scored level by level: a level holds the different
        beginnings of that length, in the order of the words.
        """
        result = np.zeros((len(words), 3))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for k in np.flatnonzero(lengths > _DEEPEST):
            result[k] = self._alone(words[k])
        short = np.flatnonzero(lengths <= _DEEPEST)
        rows = np.array(sorted(short.tolist(), key=words.__getitem__), np.int64)
        if not len(rows):
            return result
        flat = np.frombuffer("".join([BEGIN + words[k] for k in rows]).encode("utf-32-le"), np.uint32)
        lengths = lengths[rows]
        starts = np.cumsum(lengths) - lengths
        coded = self.pieces.codes(flat)
        alone = np.isin(flat, [ord(p) for p in self.scores if len(p) == 1])
        n_bytes = 1 + (flat > 0x7F) + (flat > 0x7FF) + (flat > 0xFFFF)

        alive = np.arange(len(rows))
        node_of = [np.zeros(len(rows), np.int32)]  # the node of each word, at this level and those before
        best, tokens, total = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1)]
        state = np.zeros(1, np.int64)
        for level in range(1, int(lengths.max()) + 1):
            alive = alive[lengths[alive] >= level]
            at = starts[alive] + level - 1
            above, letter = node_of[-1][alive], flat[at]
            new = np.ones(len(alive), bool)
            new[1:] = (above[1:] != above[:-1]) | (letter[1:] != letter[:-1])
            word, at, parent = alive[new], at[new], above[new]
            mine = np.zeros(len(rows), np.int32)
            mine[alive] = np.cumsum(new) - 1
            state = self.pieces.advance(state[parent], coded[at])
            top, fewest, summed = np.full(len(word), -np.inf), np.zeros(len(word), np.int64), np.full(len(word), -np.inf)

            def way(to, score, n, sum_, top=top, fewest=fewest, summed=summed):
                better = (score > top[to]) | ((score == top[to]) & (n < fewest[to]))
                top[to[better]], fewest[to[better]] = score[better], n[better]
                summed[to] = np.logaddexp(summed[to], sum_)

            piece = self.pieces.first[state]
            to = np.flatnonzero(piece)
            while len(to):
                here = piece[to]
                back, worth = self.pieces.length[here], self.pieces.score[here]
                for size in np.unique(back):
                    of = back == size
                    node = node_of[-size][word[to[of]]]
                    way(to[of], best[-size][node] + worth[of], tokens[-size][node] + 1, total[-size][node] + worth[of])
                piece[to] = self.pieces.shorter[here]
                to = to[piece[to] > 0]
            to = np.flatnonzero(~alone[at])
            n, node = n_bytes[at[to]], parent[to]
            way(to, best[-1][node] + n * self.least, tokens[-1][node] + n, total[-1][node] + n * self.least)
            for held, level_values in ((node_of, mine), (best, top), (tokens, fewest), (total, summed)):
                held.append(level_values)
                del held[: -self.longest]
            done = alive[lengths[alive] == level]
            node = mine[done]
            result[rows[done], 0], result[rows[done], 1], result[rows[done], 2] = fewest[node], top[node], summed[node]
            self.nodes += len(word)
        return result


@lru_cache(maxsize=2)
def _counter(path: str) -> TrieCounter:
    return TrieCounter(rank_scores(path))


def _run(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            split = pc.ascii_split_whitespace(batch.column("text").cast(pa.large_string()))
            counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            table = _counter(path).count(words)
            at = coded.indices.to_numpy(zero_copy_only=False)
            # White space at either end leaves an empty piece.
            full = np.array([bool(w) for w in words], bool)[at] if len(at) else np.zeros(0, bool)
            text = np.repeat(np.arange(batch.num_rows), counts)[full]
            at, counts = at[full], np.bincount(text, minlength=batch.num_rows).astype(np.int64)
            tokens, best, total = (np.bincount(text, table[at, k], batch.num_rows) for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(tokens.astype(np.int64)), pa.array(best), pa.array(total)],
                names=["doc_id", "n_pretokens", "n_tokens", "best_score", "forward_score"],
            )

    return run


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_pretokens, n_tokens, best_score, forward_score.

    Pre-tokens are words between ASCII white space with the mark of a word's beginning before
    them; n_tokens adds the tokens of their best unigram segmentations, best_score the scores
    of these and forward_score the logs of the sums over all segmentations. A null or empty
    text has none. Repeated rows each give a row; other columns of docs are not looked at.
    Nothing is shuffled; a task holds the distinct words of some megabytes of text, and of
    their trie as many levels as the longest piece has characters.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_run(model), "doc_id long, n_pretokens long, n_tokens long, best_score double, forward_score double")
