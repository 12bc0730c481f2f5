"""The pipeline's stages against plain Python."""

import hashlib
from collections import Counter, defaultdict

from .test_lsh_forest import grams
from .test_mixing import targets
from .test_repetition import brute as measures
from .test_tokens import check_packing

import corpus_pipeline
from loomframe.llm import stages

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sample(spark, corpus):
    near = " ".join(f"w{i}" for i in range(60))
    extra = [
        (900, near, "en", "src0", 1),
        (901, near + " more", "en", "src0", 1),
        (902, near, "de", "src1", 2),
        (902, near, "de", "src1", 2),
        (None, " ".join(f"v{i}" for i in range(30)), None, None, None),
        (903, None, None, "src2", 0),
        (904, "", "en", None, 0),
        (904, " ".join(f"u{i}" for i in range(40)), "en", None, 0),
        (904, " ".join(f"t{i}" for i in range(40)), "en", None, 0),
    ]
    return corpus.where("length(text) < 2500").select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(extra, COLUMNS))


def test_quality(spark, corpus):
    docs = sample(spark, corpus)
    assert rows_of(stages.quality(spark, docs, "")) == sorted((tuple(r) for r in docs.collect() if measures(r.text)[-1]), key=repr)


def test_exact(spark, corpus):
    docs = sample(spark, corpus)
    best = {}
    for r in docs.collect():
        text = r.text or ""
        if text not in best or (r.doc_id is not None and (best[text].doc_id is None or r.doc_id > best[text].doc_id)):
            best[text] = r
    assert rows_of(stages.exact(spark, docs, "")) == sorted(map(tuple, best.values()), key=repr)


def test_near(spark, corpus):
    docs = stages.exact(spark, sample(spark, corpus), "")
    rows = docs.collect()
    sets = [grams(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                parent[find(a)] = find(b)
    classes = defaultdict(list)
    for k, r in enumerate(rows):
        key = hashlib.sha256((r.text or "").encode()).digest()[:16]
        classes[find(k)].append((r.doc_id is None, r.doc_id or 0, key, tuple(r)))
    assert any(len(c) > 1 for c in classes.values())
    assert rows_of(stages.near(spark, docs, "")) == sorted((min(c)[-1] for c in classes.values()), key=repr)


def test_mix(spark, corpus):
    docs = sample(spark, corpus)
    rows = [tuple(r) for r in docs.collect()]
    size = {r: len((r[1] or "").encode().split()) for r in rows}
    per = Counter()
    for r in rows:
        per[r[3]] += size[r]
    out = Counter(rows_of(stages.mix(spark, docs, "")))
    there = Counter(rows)
    got, largest = Counter(), Counter()
    for r, n in out.items():
        assert n <= 3 * there[r]
        got[r[3]] += n * size[r]
        largest[r[3]] = max(largest[r[3]], size[r])
    for source, target in targets(dict(per)).items():
        assert target - 0.5 <= got[source] <= target + 0.5 + max((size[r] for r in rows if r[3] == source), default=0)


def test_whole_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == before.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = corpus_pipeline.run(spark, folder).collect()
    used, least = check_packing(rows, out, 1024)
    assert used <= 1.05 * least


def test_empty(spark, empty):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").collect() == []
