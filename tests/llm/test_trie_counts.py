import math
import re

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.llm.trie_counts import BEGIN, TrieCounter, rank_scores, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCORES = rank_scores(PATH)
LEAST = min(SCORES.values()) - 1


def brute(word, scores, least):
    """Every segmentation of one word."""
    text = BEGIN + word
    ways = [[(0.0, 0)]]
    for i in range(1, len(text) + 1):
        mine = [(s + scores[text[j:i]], n + 1) for j in range(i) if text[j:i] in scores for s, n in ways[j]]
        if text[i - 1] not in scores:
            b = len(text[i - 1].encode())
            mine += [(s + b * least, n + b) for s, n in ways[i - 1]]
        ways.append(mine)
    best, tokens = min(ways[-1], key=lambda w: (-w[0], w[1]))
    return tokens, best, math.log(sum(math.exp(s) for s, _ in ways[-1]))


def dynamic(word):
    """The best segmentation without anything shared."""
    text = BEGIN + word
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        mine = [(best[j][0] + SCORES[text[j:i]], best[j][1] + 1) for j in range(i) if text[j:i] in SCORES]
        if text[i - 1] not in SCORES:
            b = len(text[i - 1].encode())
            mine.append((best[i - 1][0] + b * LEAST, best[i - 1][1] + b))
        best.append(min(mine, key=lambda w: (-w[0], w[1])))
    return best[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abcé你", min_size=1, max_size=7), min_size=1, max_size=12))
def test_all_segmentations(words):
    scores = {BEGIN: -3.0, BEGIN + "a": -2.0, "a": -2.5, "b": -2.5, "c": -3.5, "ab": -3.0, "bc": -3.2, "abc": -4.0, "ca": -2.2, "é": -6.0}
    counter = TrieCounter(scores)
    for word, got in zip(words, counter.count(words), strict=True):
        want = brute(word, scores, min(scores.values()) - 1)
        assert got[0] == want[0] and got[1:] == pytest.approx(want[1:])


def test_prefixes_are_computed_once():
    counter = TrieCounter({BEGIN: -1.0, "a": -1.0, "b": -1.0})
    counter.count(["aaaa", "aaab", "aaaa", "ab"])
    assert counter.nodes == 1 + 4 + 1 + 1
    counter.count(["aaaa", "b"])
    assert counter.nodes == 7 + 2


def expected(rows):
    out = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = [dynamic(w) for w in words]
        out.append((i, len(words), sum(n for _, n in found), round(sum(s for s, _ in found), 5)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_pretokens, r.n_tokens, round(r.best_score, 5)) for r in token_counts(df, PATH).collect()), key=repr)


def test_rows(docs):
    rows = docs.select("doc_id", "text")
    assert result(docs) == expected([tuple(r) for r in rows.collect()])
    assert all(r.forward_score >= r.best_score - 1e-9 for r in token_counts(docs, PATH).collect())


def test_corpus(corpus):
    df = corpus.where("length(text) < 3000")
    assert result(df) == expected([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_empty(empty):
    assert token_counts(empty, PATH).collect() == []
