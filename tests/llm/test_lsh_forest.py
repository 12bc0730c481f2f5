import re
from collections import defaultdict

from pyspark.sql import functions as F

from loomframe.llm import lsh_forest
from loomframe.llm.components import components
from loomframe.llm.lsh_forest import meeting, ngram_join, prefix_depth, shortened, similar_pairs


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, similarity=0.8):
    texts = sorted({t or "" for _, t in rows})
    sets = [grams(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    where = {t: k for k, t in enumerate(texts)}
    ids, copies = defaultdict(list), defaultdict(int)
    for i, t in rows:
        ids[find(where[t or ""])].append(i)
        copies[t or ""] += 1
    out = []
    for i, t in rows:
        known = [x for x in ids[find(where[t or ""])] if x is not None]
        out.append((i, min(known, default=None), links[where[t or ""]], copies[t or ""]))
    return sorted(out, key=repr)


def edited(k, n=60):
    words = [f"w{i}" for i in range(n)]
    words[k % n] = f"x{k}"
    return " ".join(words)


def result(df, **options):
    return sorted((tuple(r) for r in ngram_join(df, **options).collect()), key=repr)


def test_rows(spark, docs):
    near = [(100 + k, edited(k)) for k in range(25)] + [(200, edited(3)), (201, "a b c d"), (202, "a b c d\n"), (203, " a b  c d")]
    passage = " ".join(f"p{i}" for i in range(60))
    near += [(300 + k, " ".join(f"q{k}-{i}" for i in range(80)) + " " + passage) for k in range(12)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    want = brute([tuple(r) for r in df.collect()])
    assert result(df) == want
    assert result(df, part_texts=4) == want  # large sets of candidates in parts


def test_corpus(corpus):
    rows = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    want = brute(rows)
    assert any(r[2] for r in want)
    assert result(corpus) == want


def test_empty(empty):
    assert ngram_join(empty).collect() == []


def test_pairs_at_the_bound():
    a = " ".join(f"w{i}" for i in range(9))
    texts = [a, a + " w9", "z", "z", "", a + " w9 x y z"]
    for s in (5 / 6, 5 / 6 + 1e-9, 0.5, 1.0):
        sets = [grams(t) for t in texts]
        want = {(i, j) for i in range(6) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= s}
        assert {(max(p), min(p)) for p in similar_pairs(texts, s, 5)} == want


def test_depth():
    assert prefix_depth(0.8, 0.9999, 32, 12) == 6
    assert 1 - (1 - 0.8**6) ** 32 >= 0.9999 > 1 - (1 - 0.8**7) ** 32
    assert prefix_depth(1.0, 0.9999, 32, 12) == 12
    assert prefix_depth(0.1, 0.9999, 2, 12) == 1


def test_shortened():
    loss = {6: 1e-5, 7: 5e-4, 8: 2e-3, 9: 7e-3, 10: 2e-2}
    assert [shortened(10, 6, loss, a) for a in (0.1, 1e-2, 1e-3, 1e-4, 0)] == [10, 9, 7, 6, 6]
    assert shortened(7, 6, loss, 0.1) == 7
    assert meeting(1.0, 10, 4) == 1 and abs(meeting(0.8, 1, 2) - 0.96) < 1e-12


def cut(k, changed, n=100):
    """A text of its own words, and the same with its last words changed."""
    words = [f"c{k}-{i}" for i in range(n)]
    return [" ".join(words), " ".join(words[: n - changed] + [f"d{k}-{i}" for i in range(changed)])]


def test_prefixes_shorten_with_the_data(spark, monkeypatch):
    """Links far above the bound need no shorter prefixes; links at it do, and none is lost."""
    depths, below = [], lsh_forest._below_nodes

    def noted(trie, longest, depth, sets):
        depths.append(depth)
        return below(trie, longest, depth, sets)

    monkeypatch.setattr(lsh_forest, "_below_nodes", noted)
    close = list(enumerate(edited(k, 200) for k in range(40)))
    assert result(spark.createDataFrame(close, "doc_id long, text string"), recall=0.999) == brute(close)
    assert depths == [10]
    depths.clear()
    rows = close + [(1000 + 2 * k + j, t) for k in range(120) for j, t in enumerate(cut(k, 9 + k % 2))]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert depths[0] == 10 and depths[-1] == 6 and len(depths) <= 3
    # Former sets of several parts, joined to others by shorter prefixes.
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), part_texts=6) == brute(rows)


def test_merged_sets_compare_only_across(spark):
    """Large and small former sets merge: every pair of texts of different ones meets once."""
    former = {f"{k:02}".encode(): w for k, w in enumerate([b"00"] * 9 + [b"09"] * 8 + [b"17"] * 2 + [b"19", b"20", b"21"])}
    text = " ".join(f"w{i}" for i in range(60))
    data = [(int(k), f"{text} e{int(k)}", k) for k in former]
    rows = spark.createDataFrame(data, "id long, text string, key binary")
    texts = rows.select("key", F.col("id").alias("first_id"))
    candidates = spark.createDataFrame([(k, w, b"00") for k, w in former.items()], "node binary, was binary, root binary")
    got = {}
    verify = lsh_forest._verify(0.8, 5, 32, 6, 10, 6)
    for r in lsh_forest._joined(rows, texts, candidates, 4, verify).collect():
        got[bytes(r.key)] = got.get(bytes(r.key), 0) + r.links
    assert got == {k: sum(w != v for v in former.values()) for k, w in former.items()}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(100, 100), (101, 100), (102, 100)}
