"""Encoding, Simple-8b files and packing, against the tokenizers library and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomframe.llm import simple8b
from loomframe.llm.bpe import Encoder, encode_rows
from loomframe.llm.packing import Places, best_fit, make_plan, pack_documents
from loomframe.llm.simple8b import TokenFile, pack, read_tokens, to_bytes, unpack, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def same_ids(texts):
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()))
    stops = np.cumsum(counts)
    assert [ids[b - n : b].tolist() for b, n in zip(stops, counts, strict=True)] == [library(t) for t in texts]


ODD = [
    "a  b", "a   b", "a\n  b", " a", "a ", "a  ", "\n b", " \nb", "it's don't  x", "你好 世界 abc", "é 😀 <|endoftext|> x", "", "   ", "  a  b",
    "a\tb \t c", "x \x1c y", "ǅungla Ωmega 12345 ½ ²", "l'été   n'est", "a\r\n b", "   x", "x   y", "ab, cd. ef.. gh!?", "word's", "'s 's",
]


def test_odd_texts():
    same_ids(ODD)
    same_ids([])
    for text in ODD:
        same_ids([text])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sS .,\n\t\r 1é  \x1c\x85你!"), max_size=12), min_size=1, max_size=4))
def test_any_mix_of_spaces(texts):
    same_ids(texts)


def test_words_over_generations(monkeypatch, corpus):
    monkeypatch.setattr("loomframe.llm.bpe._MOST_WORDS", 50)
    texts = [r.text for r in corpus.limit(30).collect()]
    for _ in range(2):
        same_ids(texts)


def test_another_tokenizer_goes_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, counts = Encoder(path).encode(pa.array(["Hello  World", ""]))
    assert ids.tolist() == Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids and counts.tolist() == [len(ids), 0]


def test_end_ids():
    ids, counts = encode_rows(PATH, pa.array(["a b", "", "c"]), 7)
    assert ids.tolist() == [*library("a b"), 7, 7, *library("c"), 7] and counts.tolist() == [3, 1, 2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=400))
def test_round_trip(ids):
    words, counts, escaped, values = pack(np.array(ids, np.uint64))
    assert unpack(words, len(ids), escaped, values).tolist() == ids
    assert counts.sum() >= len(ids)


def test_every_selector_and_blocks(monkeypatch):
    monkeypatch.setattr(simple8b, "BLOCK_WORDS", 3)
    monkeypatch.setattr(simple8b, "_PACK_IDS", 37)
    rng = np.random.default_rng(3)
    parts = [np.zeros(700, np.uint64)] + [rng.integers(0, 1 << int(b), 50, dtype=np.uint64) for b in simple8b.BITS[2:]]
    ids = np.concatenate([*parts, np.array([2**60, 2**64 - 1, 5], np.uint64)])
    words, *_ = pack(ids)
    assert set((words >> np.uint64(60)).tolist()) == set(range(16))
    file = TokenFile(to_bytes(ids, np.array([len(ids)]), [9]))
    assert (file.ids() == ids).all()
    for a, b in ((0, 1), (5, 700), (699, 760), (len(ids) - 3, len(ids)), (4, 4)):
        assert (file.ids(a, b) == ids[a:b]).all()
    assert len(pack(np.zeros(2400, np.uint64))[0]) == 10


def expected_files(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for i, text in rows:
        ids = [*library(text), 0]
        out.append((i, at, len(ids), crc(ids), ids))
        at += len(ids)
    return out


def files(df, tmp_path, **options):
    manifest = write_tokens(df, PATH, folder=str(tmp_path / "tokens"), **options)
    got = read_tokens(manifest).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got), key=lambda r: r[1])


def test_files_of_rows(docs, tmp_path):
    got = files(docs, tmp_path, file_ids=3)
    want = expected_files([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got == want


def test_files_of_the_corpus(corpus, tmp_path):
    assert files(corpus, tmp_path, file_ids=20_000) == expected_files([tuple(r) for r in corpus.select("doc_id", "text").collect()])


def test_files_of_nothing(empty, tmp_path):
    assert files(empty, tmp_path) == []


def test_not_a_file():
    with pytest.raises(ValueError, match="not a token file"):
        TokenFile(b"x" * 80)


def check_packing(rows, out, capacity):
    pieces = defaultdict(list)
    for i, text in rows:
        ids = [*library(text), 2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            pieces[i, k, a, b - a, crc(ids[a:b])].append(0)
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in out:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32].append(0)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == pieces
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and sum(n for _, n in s) <= capacity
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
    total = sum(k[3] * len(v) for k, v in got.items())
    return len(sequences), -(-total // capacity)


def test_pack_rows(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_packing(rows, pack_documents(docs, PATH, capacity=16).collect(), 16)


def test_pack_corpus(corpus):
    rows = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    used, least = check_packing(rows, pack_documents(corpus, PATH).collect(), 1024)
    assert used <= 1.02 * least


def test_pack_with_ids(docs):
    for r in pack_documents(docs, PATH, capacity=16, keep_ids=True).collect():
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length


def test_pack_nothing(empty):
    assert pack_documents(empty, PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=25))
def test_plans(histogram):
    for plan in (make_plan(histogram, 40), best_fit(histogram, 40)):
        used = defaultdict(int)
        for count, shape in plan:
            assert count > 0 and sum(shape) <= 40
            for n in shape:
                used[n] += count
        assert used == histogram
    places = Places(make_plan(histogram, 40))
    seen = set()
    for n, c in histogram.items():
        sequence, offset = places.find(n, np.arange(c))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            spots = {(s, o + k) for k in range(n)}
            assert not spots & seen and o + n <= 40
            seen |= spots


def test_patterns_fill_sequences():
    rng = np.random.default_rng(0)
    lengths = rng.gamma(2, 150, 60_000).astype(int).clip(1, 1024)
    values, counts = np.unique(lengths, return_counts=True)
    plan = make_plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), 1024)
    assert sum(c for c, _ in plan) <= 1.002 * lengths.sum() / 1024
    assert sum(c for c, shape in plan if len(shape) <= 3 and sum(shape) == 1024) > 5_000


def test_few_dominant_lengths():
    for histogram, least in (({600: 1000, 100: 3000}, 1000), ({600: 1000, 100: 4001}, 1001), ({700: 10, 300: 7, 50: 55}, 12), ({500: 9, 8: 100}, 6), ({1000: 3, 1: 71}, 3)):
        for plan in (best_fit(histogram, 1024), make_plan(histogram, 1024)):
            used = defaultdict(int)
            for count, shape in plan:
                assert count > 0 and sum(shape) <= 1024
                for n in shape:
                    used[n] += count
            assert used == histogram
            assert sum(c for c, _ in plan) == least
