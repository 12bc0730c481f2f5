import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm.ftrl import _SPREAD, Leader, features, quality_scores

FIELD = (1 << 64) - 1


def plain_features(text, bits=18, longest=3):
    """The same vector, word by word."""
    words = re.sub(r"([^\w\s]+)", r" \1 ", text).split()
    codes = []
    for i, w in enumerate(words):
        codes.append(1 if i and words[i - 1] == w else zlib.crc32(w.encode()) + 2)
    seen = Counter()
    for size in range(1, longest + 1):
        for i in range(len(codes) - size + 1):
            mixed = size
            for k in range(size):
                mixed = ((mixed ^ (codes[i + k] * _SPREAD[k] & FIELD)) * _SPREAD[0]) & FIELD
                mixed ^= mixed >> 29
            seen[mixed >> (64 - bits)] += 1
    raw = {p: 1 + math.log(c) for p, c in seen.items()}
    norm = math.sqrt(sum(v * v for v in raw.values()))
    return {p: v / norm for p, v in raw.items()}


TEXTS = ["a b c", "", " \n ", "one, two!! two!! two!!", "größe élan 你好 \U0001f600 end", "x " * 500, "%%% ### a%%% b"]


def test_features():
    text, place, value = features(pa.array(TEXTS))
    for k, t in enumerate(TEXTS):
        got = dict(zip(place[text == k].tolist(), value[text == k].tolist()))
        assert got == pytest.approx(plain_features(t))
    assert [len(x) for x in features(pa.array([], pa.string()))] == [0, 0, 0]


def test_steps_follow_the_regularised_leader():
    """z and n by the definition: z = sum of gradients - sum of sigma * w, with w the minimiser before each step."""
    alpha, beta, l1, l2 = 0.3, 1.0, 0.05, 0.1
    leader = Leader(np.zeros(5), np.zeros(5), alpha, beta, l1, l2)
    rng = np.random.default_rng(0)
    z, n = [0.0] * 5, [0.0] * 5
    for _ in range(200):
        at = sorted(rng.choice(5, 3, replace=False).tolist())
        x, label = rng.random(3), int(rng.random() < 0.5)
        w = {}
        for i in at:
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x))))
        for i, v in zip(at, x):
            g = (p - label) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        leader.step(np.array(at), x, label)
    assert leader.z == pytest.approx(z) and leader.n == pytest.approx(n)


def folds(ids):
    return [zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]


@pytest.fixture
def marked(spark):
    """Poor texts hold signs behind words; ids that several rows share, and labels for absent rows."""
    rng = np.random.default_rng(4)
    words = ["sun", "moon", "sea", "hill", "tree", "road", "bird", "rain"]
    rows, labels = [], []
    for i in range(600):
        poor = i % 5 == 0
        text = " ".join(w + ("!!" if poor else "") for w in rng.choice(words, 30))
        rows.append((i, text))
        labels.append((i, int(not poor)))
    rows += [(3, rows[3][1]), (None, "sun moon"), (900, None), (901, ""), (902, "sun " * 20_000)]
    labels += [(5000, 1), (None, 0), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int"), rows, labels


def test_learns_held_out(marked):
    docs, labels, rows, known = marked
    wide = docs.repartition(6).withColumns({c: F.lit("x") for c in ("label", "held_out", "score", "shard", "lang", "__at")})
    result = quality_scores(wide, labels, shard_rows=100).collect()
    assert len(result) == len(rows)
    quality = {i: q for i, q in known if q is not None}
    for r in result:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    judged = [r for r in result if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in judged]) > 0.97
    # Rows without text have one score, and copies have equal ones.
    assert len({r.score for r in result if r.doc_id in (900, 901)}) == 1
    assert len({r.score for r in result if r.doc_id == 3}) == 1


def test_same_on_any_layout(marked):
    docs, labels, *_ = marked
    runs = [sorted((str(r.doc_id), round(r.score, 12)) for r in quality_scores(docs.repartition(n), labels.repartition(n), shard_rows=64).collect()) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_held_out_labels_are_not_looked_at(spark, marked):
    docs, labels, *_ = marked
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    turned = labels.withColumn("quality", F.when(fold == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((str(r.doc_id), r.score) for r in quality_scores(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_few_labels(spark, docs, empty):
    schema = "doc_id long, quality int"
    none = spark.createDataFrame([], schema)
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(1, 10)], schema)
    assert {(r.score, r.predicted) for r in quality_scores(docs, ones).collect()} == {(1.0, 1)}
    both = spark.createDataFrame([(i, i % 2) for i in range(1, 10)], schema)
    assert quality_scores(empty, both).collect() == []
    assert len(quality_scores(docs, both).collect()) == docs.count()


def test_one_label_bound(marked):
    """most_labelled bounds the labelled ids by their hashes."""
    docs, labels, rows, _ = marked
    assert len(quality_scores(docs, labels, most_labelled=50).collect()) == len(rows)


def test_corpus(spark, corpus):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id")
    held = scored.where("held_out").select((F.col("predicted") == F.col("quality")).cast("int").alias("ok")).agg(F.avg("ok")).first()[0]
    assert held >= 0.9
