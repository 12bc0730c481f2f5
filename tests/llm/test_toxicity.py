import math
import random
import zlib
from itertools import product

import numpy as np
import pytest

from loomframe.llm.toxicity import _NUMBER, LEET, Channel, _Words, bare, character_model, fit_logistic, toxicity

WORDS = "the quick brown fox jumps over lazy dog and runs along some river bank while birds sing their song".split()
BAD = ["idiot", "stupid", "moron", "clown"]
DISGUISE = {"idiot": ["1d10t", "i d i o t", "idiiiiot"], "stupid": ["stup1d", "s t u p i d", "$tupid"], "moron": ["m0r0n", "mor0n", "m o r o n"], "clown": ["cl0wn", "clooown", "c l o w n"]}


def corpus_of(n=600, seed=5, disguised=False):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(3):
                bad = rng.choice(BAD)
                words.insert(rng.randrange(len(words)), rng.choice(DISGUISE[bad]) if disguised else bad)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def channel(spark):
    rows = spark.createDataFrame(corpus_of(), "doc_id long, text string, toxic int")
    return Channel(character_model(rows))


def test_character_model(spark):
    texts = ["ab ba", "Ab, é1 #", "", "ab"]
    got = character_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    counts = np.zeros((62, 62, 62))
    for t in texts:
        for w in t.lower().split():
            n = [0, 0, *(int(_NUMBER[ord(c)]) for c in bare(w)), 0, 0]
            for k in range(len(n) - 2):
                counts[n[k], n[k + 1], n[k + 2]] += 1
    # Between two tokens of a slice the gap is seen once from either side.
    assert np.allclose(np.exp(got).sum(axis=2), 1, atol=1e-4)
    a, b = int(_NUMBER[ord("a")]), int(_NUMBER[ord("b")])
    assert counts[0, a, b] == 3 and got[0, a, b] > got[0, b, a]


def test_viterbi_is_the_best_path(channel):
    def brute(steps):
        best = None
        for path in product(*steps):
            text = "".join(w for w, _ in path)
            score, a, b = sum(c for _, c in path), 0, 0
            for c in text:
                n = int(_NUMBER[ord(c)])
                score += channel.cost[a, b, n]
                a, b = (0, 0) if n == 0 else (b, n)
            score += channel.cost[a, b, 0]
            best = max(best or (-math.inf, ""), (score, text))
        return best[1]

    for word in ("1d10t", "m0r0n", "5tupid", "clooown", "$ong", "l4zy"):
        assert channel._best(channel._letters(word)) == brute(channel._letters(word))


def test_restores(channel):
    assert [channel.word(w) for w in ("1d10t", "STUP1D".lower(), "cl0wn!!", "clooown", "(moron),", "river", "the%%%", "")] == ["idiot", "stupid", "clown", "clown", "moron", "river", "the", ""]
    assert channel.spaced(list("idiot")) == ["idiot"]
    assert channel.word("password=18a0165473c0330cab") == "password=18a0165473c0330cab"
    assert channel.word("a" * 5000) == "a" * 5000
    assert set("".join(LEET.values())) <= set("abcdefghijklmnopqrstuvwxyz")


def result(docs, labels):
    return {r.doc_id: r for r in toxicity(docs, labels).collect()}


def test_held_out_and_disguised(spark):
    plain, hidden = corpus_of(), [(10_000 + k, t, y) for k, t, y in corpus_of(seed=6, disguised=True)]
    docs = spark.createDataFrame(plain + hidden, "doc_id long, text string, toxic int")
    got = result(docs.drop("toxic"), docs.where("doc_id < 10000").select("doc_id", "toxic"))
    for k, _, y in plain + hidden:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert 0 <= got[k].score <= 1 and got[k].predicted == (got[k].score >= 0.5)
    held = [(got[k].predicted, y) for k, _, y in plain if got[k].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert sum(got[k].predicted == y for k, _, y in hidden) / len(hidden) > 0.95


def test_held_out_labels_do_not_count(spark):
    docs = spark.createDataFrame(corpus_of(200), "doc_id long, text string, toxic int")
    other = docs.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    first, second = result(docs, docs.select("doc_id", "toxic")), result(docs, other)
    assert {k: r.score for k, r in first.items()} == {k: r.score for k, r in second.items()}


def test_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    out = toxicity(docs, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out if r.doc_id is not None) == sorted((False, r.doc_id) for r in docs.collect() if r.doc_id is not None)
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    none = labels.where("false")
    assert {r.score for r in toxicity(docs, none).collect()} == {0.0}
    assert {r.score for r in toxicity(docs, labels.where("doc_id = 1")).collect()} == {1.0}


def test_empty(spark, empty):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity(empty, labels).collect() == []


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = rng.random(4000) < 1 / (1 + np.exp(-(x @ np.array([2.0, -1.0]) + 0.5)))
    assert np.allclose(fit_logistic(x, y.astype(int)), [0.5, 2, -1], atol=0.2)


@pytest.fixture(scope="module")
def rude(spark):
    text = "dumbass ass arse stupid idiot moron shit the has as that pass this use house grass class a part or are sea these " * 50
    return Channel(character_model(spark.createDataFrame([(text,)], "text string")))


def test_long_spaced_text_is_read_whole(rude):
    words = (["stupid", "idiot", "moron", "dumbass", "this"] * 400)[:1999]
    text = " ".join(" ".join(w) for w in words)
    read = _Words(rude, [text])
    assert read.words[-len(words) :] == words and len(read.words) == len(set(text.split())) + len(words)


def test_repeats_of_any_length(rude):
    assert rude.word("st" + "u" * 22 + "pid") == "stupid"
    assert rude.word("sss" + "t" * 500 + "uuu" + "p" * 40 + "iiid") == "stupid"
    assert rude.word("5tup1d1d10tm0r0nstup1d1d10t") == "stupididiotmoronstupididiot"


def test_few_letters_and_signs_at_the_edge(rude):
    tokens = ("a55", "4r53", "dumba$$", "a$$", "(a$$),", "shi+", "$tupid!!", "stupid!", "*moron*", "|stupid|", "the**", "455", "$100")
    assert [rude.word(t) for t in tokens] == ["ass", "arse", "dumbass", "ass", "ass", "shit", "stupid", "stupid", "moron", "stupid", "the", "455", "100"]
    read = _Words(rude, ["you d u m b a $ $ you", "$ t u p i d"])
    assert read.words.count("dumbass") == 1 and read.words.count("stupid") == 1
