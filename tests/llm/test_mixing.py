import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomframe.llm.mixing import mix_sources, source_targets


def targets(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop at most times the size, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
        open_ -= over
    return out


def check(df, mix):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = targets(sizes)
    taken = mix.taken().collect()
    assert len(taken) == len(rows)
    per = defaultdict(int)
    for r in taken:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        per[r.source] += r.taken
    for s, t in want.items():
        assert per[s] == pytest.approx(t, abs=0.5)
    # The order of a source's rows is that of the MD5 of their ids.
    first = defaultdict(list)
    for r in taken:
        first[r.source].append((hashlib.md5(str("" if r.id is None else r.id).encode()).hexdigest(), r.start, r.size))
    for x in first.values():
        assert [p[1] for p in sorted(x)] == sorted(p[1] for p in x)
    return taken


def test_rows(docs):
    check(docs, mix_sources(docs, block=7))


def test_corpus(corpus):
    mix = mix_sources(corpus, block=64)
    taken = check(corpus, mix)
    again = mix_sources(corpus.repartition(5), block=64).taken().collect()
    assert sorted(map(tuple, taken)) == sorted(map(tuple, again))


def test_schedule_is_even(corpus):
    """Any run of slots holds each source in its share, up to the discrepancy of the sequence."""
    mix = mix_sources(corpus, block=64)
    rows = mix.schedule.join(mix.placed.select("source_no", "target").distinct(), "source_no").select("slot", "source_no", "block", "target").distinct().collect()
    total = sum({r.source_no: r.target for r in rows}.values())
    slots = sorted(rows)
    # Every slot number once and none left out.
    assert [r.slot for r in slots] == list(range(len(slots)))
    for s in {r.source_no for r in rows}:
        mine = [r for r in slots if r.source_no == s]
        assert [r.block for r in mine] == list(range(len(mine)))
        for r in mine:
            assert abs(r.block - r.slot * r.target / total) < 6


def test_empty(empty):
    mix = mix_sources(empty)
    assert mix.taken().collect() == [] and mix.schedule.collect() == []


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mix_sources(df).taken().select("id", "size", "target", "taken").collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_targets_with_caps(spark):
    sizes = {"a": 1000, "b": 5, "c": 7, "d": 300, None: 2}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert source_targets(df.where(F.lit(False))).collect() == []
