import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm.lemp import Bucket, lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    words = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, text in items:
        if i is not None:
            asked.setdefault(i, set()).update(cut(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n) // max(1, words)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms if t in bag)
            if s > 0:
                scored.append((-s, float("inf") if doc is None else doc, doc))
        scored.sort(key=lambda x: x[:2])
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


ITEMS = [(1, "A b, C!"), (2, "größe 你好 apache 2"), (3, ""), (4, None), (5, "--- ..."), (6, "word Word WORD"), (None, "a"), (7, "x"), (7, "y z")]


def test_rows(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("score", F.lit(2))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert want and got(lexical_search(docs, items)) == want
    # A block of items at a time.
    assert got(lexical_search(docs, items, block_items=2)) == want
    assert got(lexical_search(docs, items, k=2)) == plain([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 2)


def test_empty(spark, empty, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(lexical_search(empty, items)) == []
    assert got(lexical_search(docs, items.where("item_id < 0"))) == []
    assert got(lexical_search(docs, items.where("item_id IN (3, 4, 5)"))) == []


def test_corpus(spark, corpus, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in corpus.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(lexical_search(corpus, items)) == want
    assert got(lexical_search(corpus.repartition(7), items, block_items=3)) == want


def test_copies_and_ties(spark):
    """A third of the rows are copies, so thousands of scores are equal."""
    rows = [(i, "the same words again" if i % 3 == 0 else f"the other {i % 11} words") for i in range(6000)]
    items = [(1, "same words"), (2, "other 7"), (3, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(lexical_search(df, spark.createDataFrame(items, "item_id long, text string"))) == plain(rows, items)


def test_very_long_text(spark):
    rows = [(1, "spam " * 200_000 + "egg"), (2, "egg"), (3, "x" * 1_000_000), (4, "spam egg")]
    items = [(1, "egg spam"), (2, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(lexical_search(df, spark.createDataFrame(items, "item_id long, text string"))) == plain(rows, items)


@pytest.mark.parametrize("seed", range(4))
def test_bucket_loses_nothing(seed):
    rng = np.random.default_rng(seed)
    n, n_terms = 300, 60
    dense = rng.integers(1, 10**9, (n, n_terms)) * (rng.random((n, n_terms)) < 0.3)
    row, term = np.nonzero(dense)
    impact = dense[row, term].astype(np.int64)
    bucket = Bucket(np.arange(n), np.sqrt((dense.astype(float) ** 2).sum(axis=1)), np.bincount(row, minlength=n), term, impact, n_terms)
    scored = 0
    for _ in range(30):
        item = rng.choice(n_terms, rng.integers(1, 30), replace=False)
        score = dense[:, item].sum(axis=1)
        for threshold in (1, int(np.sort(score)[-10]), int(score.max()), int(score.max()) + 1):
            found, values = bucket.search(item, threshold)
            want = np.flatnonzero(score >= max(threshold, 1))
            assert found.tolist() == want.tolist() and values.tolist() == score[want].tolist()
            scored += len(found)
    assert scored


def test_buckets_out_of_reach_are_passed_over():
    bucket = Bucket(np.arange(2), np.array([5.0, 3.0]), np.array([2, 1]), np.array([0, 1, 2]), np.array([3, 4, 3]), 4)
    assert not len(bucket.search(np.array([0, 1]), 8)[0])  # sqrt(2) * 5 < 8
    assert not len(bucket.search(np.array([2, 3]), 4)[0])  # no row has more than 3
    assert bucket.search(np.array([0, 1]), 7)[1].tolist() == [7]
