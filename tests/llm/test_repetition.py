import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm.repetition import SYMBOLS, longest_repeats, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    inside = {i + k for i in range(n - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    longest = 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
    chars = sum(map(len, words))
    fraction = sum(len(words[i]) for i in inside) / max(chars, 1)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = n < 20 or 100 * len(inside) > 30 * n
    return (
        n, chars, sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(inside), longest, round(fraction, 9),
        failed, not failed and fraction <= 0.3 and longest <= 100,
    )


def result(df):
    return sorted(
        (
            (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.longest_repeat, round(r.repeat_fraction, 9), r.base_failed, r.kept)
            for r in quality_rules(df).collect()
        ),
        key=repr,
    )


def test_rows(spark, docs):
    docs = docs.where("doc_id is null or doc_id <> 7")
    extra = [(20, "one two three four five six seven eight nine\n" * 4), (21, "| # *\n| # *\n\n\nx"), (22, "p q " * 5 + " ".join(map(str, range(200))))]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    assert result(df) == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=repr)


def test_corpus(corpus):
    df = corpus.where("length(text) < 4000")
    assert result(df) == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=repr)


def test_long_text_of_one_word(docs):
    row = quality_rules(docs.where("doc_id = 7")).first()
    assert (row.n_words, row.n_repeat_words, row.longest_repeat, row.kept) == (3000, 3000, 2999, False)
    assert [tuple(s) for s in row.spans] == [(0, 3000)]


def test_long_passage_alone_rejects(spark):
    passage = " ".join(f"w{i}" for i in range(120))
    rest = " ".join(f"v{i}" for i in range(2000))
    df = spark.createDataFrame([(1, f"{passage} {rest} {passage}"), (2, f"{passage} {rest}")], "doc_id long, text string")
    rows = {r.doc_id: r for r in quality_rules(df).collect()}
    assert not rows[1].base_failed and not rows[1].kept and rows[1].longest_repeat == 120
    assert [tuple(s) for s in rows[1].spans] == [(0, 120), (2120, 120)]
    assert rows[2].kept


def test_empty(empty):
    assert quality_rules(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5))
def test_suffixes_of_several_texts(texts):
    words = np.array([w for t in texts for w in t], np.int64)
    stops = np.cumsum([len(t) for t in texts])
    ends = np.repeat(stops, [len(t) for t in texts])
    got, at = longest_repeats(words, ends), 0
    for t in texts:
        for i in range(len(t)):
            best = 0
            for j in range(len(t)):
                k = 0
                while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                    k += 1
                best = max(best, k)
            assert got[at + i] == best
        at += len(t)
