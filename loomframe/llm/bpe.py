"""Token ids of many texts by the tokenizers library, each word looked up once it is known."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

#: The split of byte-level BPE, as the vocabulary files name it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A space inside or at the end of white space, where a text must not be cut (RE2 syntax).
_SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]"
_UNCUT = f"{_SPACE} (?:{_SPACE}|$)"

#: A word that the split leaves whole but for the stop behind it: letters of one code range only,
#: which every version of the Unicode tables calls letters.
_STOPPED = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+[.,]$"

#: Words that a worker keeps, in two generations, and the longest that it keeps.
_MOST_WORDS, _LONGEST_KEPT = 250_000, 64

#: Texts are encoded in slices of so many bytes; the longer, the fewer words come twice.
ENCODE_BYTES = 8 << 20


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes bytes as letters: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class Encoder:
    """encode() gives what Tokenizer.encode(text, add_special_tokens=False) does.

    Texts are cut before spaces, where byte-level BPE always cuts. The pieces of a batch are
    counted off by Arrow; a piece not met before is split by the tokenizer's pattern and its
    parts go through the BPE model. Whatever the short cut does not cover (white space of
    several characters, letters beyond Latin, special tokens, other kinds of tokenizer) goes
    through the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.short_cut = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.space = chr(self.letters[32])
        self.split = regex.compile(PATTERN)
        self.latin = re.compile("[\x00-ɏ]*").fullmatch
        # Words of this generation and of the one before it; what is asked for again moves up.
        # A word between spaces, without its space, and a part of one as the pattern splits it.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            mapped = part.replace(" ", self.space)
        else:
            mapped = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self._ids(part)
            if len(part) <= _LONGEST_KEPT:
                self.parts[part] = ids
        return ids

    def _pieces(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of lead + word, for words without a space in them."""
        known, older = (self.known, self.older) if lead else ({}, {})
        part, split, latin, hard = self._part, self.split.findall, self.latin, []
        out = list(map(known.get, words))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            word = words[k]
            ids = older.get(word)
            if ids is None:
                if not word.isascii() and not latin(word):
                    hard.append(k)
                    continue
                if word.isalpha():
                    ids = self._ids(lead + word)
                else:
                    ids = b"".join([part(x) for x in split(lead + word)])
            out[k] = ids
            if len(word) <= _LONGEST_KEPT:
                known[word] = ids
        for k, ids in zip(hard, self._whole([lead + words[k] for k in hard]), strict=True):
            out[k] = ids
            if len(words[k]) <= _LONGEST_KEPT:
                known[words[k]] = ids
        if len(self.known) > _MOST_WORDS:
            self.known, self.older = {}, self.known
        if len(self.parts) > _MOST_WORDS:
            self.parts = {}
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many are of each text. No nulls."""
        n = len(texts)
        whole = np.full(n, not self.short_cut)
        if self.short_cut and n:
            whole = pc.match_substring_regex(texts, _UNCUT).to_numpy(zero_copy_only=False).copy()
            for special in self.specials:
                whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        if whole.all():
            ids = self._whole(texts.to_pylist())
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        heads = np.cumsum(per_text) - per_text
        coded = split.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = coded.dictionary.take(pa.array(codes[heads])).to_numpy(zero_copy_only=False).tolist()
        # Words without their stops, each once; the stops follow them as entries of their own.
        stopped = pc.match_substring_regex(coded.dictionary, _STOPPED)
        cores = pc.if_else(stopped, pc.utf8_slice_codeunits(coded.dictionary, 0, -1), coded.dictionary).dictionary_encode()
        table = self._pieces(cores.dictionary.to_numpy(zero_copy_only=False).tolist(), " ")
        n_cores = len(table)
        stop = np.where(stopped.to_numpy(zero_copy_only=False), np.where(pc.ends_with(coded.dictionary, ".").to_numpy(zero_copy_only=False), n_cores, n_cores + 1), -1)
        # The first piece of a text has no space before it and an entry of its own.
        table += [self._part("."), self._part(","), *self._pieces(firsts, "")]
        if whole.any():
            rows = np.flatnonzero(whole)
            for k, ids in zip(rows, self._whole(texts.take(pa.array(rows)).to_pylist()), strict=True):
                table[n_cores + 2 + k] = ids
        core, behind = cores.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], stop[codes]
        core[heads], behind[heads] = n_cores + 2 + np.arange(n), -1
        ends = np.cumsum(1 + (behind >= 0))
        entries = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        entries[ends - 1] = np.where(behind >= 0, behind, core)
        entries[ends[behind >= 0] - 2] = core[behind >= 0]
        # Taking rows of a binary array lays the ids of all entries end to end.
        laid = pa.array(table, pa.large_binary()).take(pa.array(entries))
        offsets = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1) >> 2
        of_text = np.append(ends[heads] - 1, len(laid)) if n else np.zeros(1, np.int64)
        return np.frombuffer(laid.buffers()[2] or b"", "<u4")[: offsets[-1]], np.diff(offsets[of_text])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process, so that its words serve all its tasks."""
    return Encoder(path)


def encode_rows(path: str, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """encode(), with the id `end` behind each text's ids."""
    ids, counts = encoder(path).encode(texts)
    stops = np.cumsum(counts + 1)
    out = np.full(int(stops[-1]) if len(stops) else 0, end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[stops - 1] = False
    out[keep] = ids
    return out, counts + 1
