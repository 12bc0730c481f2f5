import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomframe.llm import hmm
from loomframe.llm.hmm import LanguageModel, Model, Shape, count_segments, hmm_scores, log_likelihoods

SMALL = Shape(states=3, words=20, classes=16, segment=8)


def random_model(k=3, size=7, seed=2):
    rng = np.random.default_rng(seed)

    def rows(*shape):
        x = rng.random(shape) + 0.05
        return x / x.sum(axis=-1, keepdims=True)

    return Model(rows(k), rows(k), rows(k, k), rows(k, size), {})


def forward(model, symbols, begin=None):
    x = (model.begin if begin is None else begin) * model.emit[:, symbols[0]]
    for s in symbols[1:]:
        x = (x @ model.move) * model.emit[:, s]
    return x.sum()


def test_likelihood_is_the_sum_over_paths():
    model = random_model()
    symbols = [3, 0, 6, 6, 2]
    total = 0.0
    for path in product(range(3), repeat=len(symbols)):
        p = model.begin[path[0]] * model.emit[path[0], symbols[0]]
        for a, b, s in zip(path, path[1:], symbols[1:], strict=False):
            p *= model.move[a, b] * model.emit[b, s]
        total += p
    for segment in (1, 2, 3, 5, 100):
        assert log_likelihoods(model, np.array(symbols), np.array([5]), segment)[0] == pytest.approx(math.log(total))


def test_segments_of_many_texts():
    model, rng = random_model(), np.random.default_rng(0)
    lengths = np.array([1, 8, 9, 40, 3, 17, 1, 64])
    symbols = rng.integers(0, 7, lengths.sum())
    got = log_likelihoods(model, symbols, lengths, 8)
    for n, stop, value in zip(lengths, np.cumsum(lengths), got, strict=True):
        assert value == pytest.approx(math.log(forward(model, symbols[stop - n : stop])))
    long = rng.integers(0, 7, 20_000)
    assert log_likelihoods(model, long, np.array([20_000]), 256)[0] == pytest.approx(log_likelihoods(model, long, np.array([20_000]), 20_000)[0])


def test_counts_are_expectations():
    model = random_model()
    texts = [[1, 2, 3], [4], [0, 6, 5, 5]]
    heads = np.array([True, True, False])
    begin, move, emit, total = np.zeros((2, 3)), np.zeros((3, 3)), np.zeros((3, 7)), 0.0
    for text, head in zip(texts, heads, strict=True):
        first = model.begin if head else model.inside
        whole = forward(model, text, first)
        total += math.log(whole)
        for path in product(range(3), repeat=len(text)):
            p = first[path[0]] * model.emit[path[0], text[0]]
            for a, b, s in zip(path, path[1:], text[1:], strict=False):
                p *= model.move[a, b] * model.emit[b, s]
            p /= whole
            begin[0 if head else 1, path[0]] += p
            for a, b in zip(path, path[1:], strict=False):
                move[a, b] += p
            for a, s in zip(path, text, strict=True):
                emit[a, s] += p
    lengths = np.array([len(t) for t in texts])
    got = count_segments(model, np.concatenate(texts), np.cumsum(lengths) - lengths, lengths, heads)
    assert got == pytest.approx(np.concatenate([begin.ravel(), move.ravel(), emit.ravel(), [total]]), abs=1e-4)


def base(rows):
    def tokens(text):
        return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")), None]

    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(t for (_, text), h in zip(rows, held, strict=True) if not h for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, text), h in zip(rows, held, strict=True):
        ts = tokens(text)
        out.append((i, h, len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6)))
    return sorted(out, key=repr)


def result(out):
    return sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in out), key=repr)


def test_rows(docs, monkeypatch):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = hmm_scores(docs, SMALL, rounds=2).collect()
    assert result(out) == base(rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in out)


def test_score_is_the_likelihood_of_the_words(spark):
    rows = [(k, "a b a c d" if k % 2 else "x y z x unseen" + str(k)) for k in range(40)]
    lm = LanguageModel(spark.createDataFrame(rows, "doc_id long, text string"), SMALL, rounds=3)
    held = {i for i, *rest in base(rows) if rest[0]}
    counts = Counter(w for i, t in rows if i not in held for w in t.split())
    for r in lm.score().collect():
        symbols, inside = [], 0.0
        for w in rows[r.doc_id][1].split():
            if w in lm.model.top:
                symbols.append(lm.model.top[w])
            else:
                k = hmm._kind(w.encode(), SMALL.classes)
                symbols.append(SMALL.words + 1 + k)
                inside += math.log((counts[w] + 1) / (lm.kinds_n[k] + lm.kinds_v[k] + 1))
        want = (math.log(forward(lm.model, [*symbols, 0])) + inside) / math.log(10)
        assert r.score == pytest.approx(want)


def test_corpus_beats_single_words(corpus):
    lm = LanguageModel(corpus, Shape(states=4, words=500, classes=64), rounds=6)
    assert lm.progress == sorted(lm.progress)
    out = lm.score().collect()
    assert result(out) == base([tuple(r) for r in corpus.select("doc_id", "text").collect()])
    assert sum(r.score for r in out if r.held_out) > 0.97 * sum(r.base_score for r in out if r.held_out)


def test_same_model_on_any_partitioning(corpus):
    one, many = (LanguageModel(corpus.repartition(n, "doc_id"), SMALL, rounds=2) for n in (1, 7))
    assert one.model.emit == pytest.approx(many.model.emit, rel=1e-3)


def test_nothing_to_train_on(spark, empty):
    assert hmm_scores(empty, SMALL).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = hmm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), SMALL).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(row.score)


def test_classes_of_many_words():
    words = ["a", "ab", "abc", "abcd", "é", "ü1", "日本語", "z" * 40, "a", "\x00", "\x00\x00"]
    for array in (pa.array(words), pa.array(["x", *words])[1:], pa.array(words, pa.large_string())):
        assert hmm._kinds(array, 1024).tolist() == [hmm._kind(w.encode(), 1024) for w in words]
    assert len(hmm._kinds(pa.array([], pa.string()), 1024)) == 0


def test_symbols_of_words():
    shape, words = Shape(words=3, classes=8), ["", "b", "x", "a", "yy"]
    kinds = [-1, *(hmm._kind(w.encode(), 8) for w in words[1:])]
    got = hmm._symbols(shape, pa.array(["a", "b"]), pa.array(words), pa.array(kinds, pa.int32()))
    assert got.tolist() == [0, 2, 4 + kinds[2], 1, 4 + kinds[4]]
    none = hmm._symbols(shape, pa.array([], pa.string()), pa.array(words), pa.array(kinds, pa.int32()))
    assert none.tolist() == [0, *(4 + k for k in kinds[1:])]


def test_a_task_holds_one_block(spark, monkeypatch):
    """Blocks are row groups and Arrow batches of their own, take far less than four bytes a token, and leave the words behind."""
    monkeypatch.setattr(hmm, "BLOCK_BYTES", 20_000)
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"word{x}" for x in rng.zipf(1.3, 2_000) % 100_000)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12).coalesce(1)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    sizes = spark.sparkContext.accumulator(0)
    plain = hmm._to_texts

    def watched(shape, shared):
        def run(batches):
            def seen():
                for batch in batches:
                    sizes.add(batch.num_rows > 1)
                    yield batch

            return plain(shape, shared)(seen())

        return run

    monkeypatch.setattr(hmm, "_to_texts", watched)
    try:
        lm = LanguageModel(docs, SMALL, rounds=1)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "4"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert sizes.value == 0
    texts = lm.texts.collect()
    assert len(texts) > 1 and "words" not in texts[0].asDict() and sum(len(r.id) for r in texts) == 60
    assert sum(len(r.ids) + len(r.symbols) for r in texts) < 3 * 2_001 * 60
    for name in {x.replace("file://", "") for x in lm.texts.inputFiles()}:
        groups = pq.ParquetFile(name).metadata
        assert groups.num_row_groups == groups.num_rows
    assert result(lm.score().collect()) == base(rows)
