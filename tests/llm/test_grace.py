import hashlib
from collections import defaultdict

from loomframe.llm import grace
from loomframe.llm.grace import ContentTable, bucket_depth, grace_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_rows(docs):
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert result(grace_dedup(docs)) == want
    assert result(grace_dedup(docs, bucket_bytes=4)) == want


def test_corpus_in_small_buckets(corpus):
    rows = [tuple(r) for r in corpus.select("doc_id", "text").collect()]
    assert result(grace_dedup(corpus, bucket_bytes=20_000)) == brute(rows)


def test_empty(empty):
    assert grace_dedup(empty).collect() == []


def test_table_compares_whole_contents():
    table = ContentTable()
    for k in range(200):
        digest = f"{k % 3:016x}" + f"{k:048x}"  # hashes collide, contents differ
        table.add(digest, f"text {k}", k, 1)
        table.add(digest, f"text {k}", None, 2)
    assert table.n == [3] * 200
    assert table.keep == list(range(200))


def test_depth(spark):
    rows = [(f"{k:02x}" + "0" * 62, 100) for k in range(256)]
    contents = spark.createDataFrame(rows, "digest string, bytes long")
    assert bucket_depth(contents, 25_600) == 0
    assert bucket_depth(contents, 1_600) == 1
    assert bucket_depth(contents, 50) == 2  # single contents are not divided


def test_collapse_in_map_tasks(docs):
    from pyspark.sql import functions as F

    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256)).coalesce(1)
    out = rows.mapInArrow(grace._collapse, "digest string, text string, keep long, n long").collect()
    assert sorted(r.n for r in out) == [1, 1, 1, 1, 1, 2, 4]
