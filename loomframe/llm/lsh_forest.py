"""N-gram Jaccard join by a forest of MinHash tries, with exact verification.

Each text's word n-grams give one label of MinHash values per tree. The labels of a tree, in
order, are its trie: a prefix of a label is a node, and the texts below a node are candidates.
The first values, by which a pair exactly at the threshold still meets in some tree with the
target probability, are one compressed edge (the head); the values after them are a byte each
(the tail). Labels alone under their head meet nobody at any depth and leave first.

Candidates start below the longest prefixes. Each connected set of them is joined exactly, by
a prefix filter over its own n-gram counts, which leaves passages shared by many texts to the
end. The similarities of the links found tell how many links a depth still loses, as a pair's
chance to meet follows from its similarity; prefixes are shortened until the expected loss is
within the target, at most down to the head. A shorter prefix merges sets that are joined
already, so only the texts of different former sets are compared.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import ship_package, slices, staged, text_or_empty
from .components import components

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def prefix_depth(similarity: float, recall: float, trees: int, longest: int) -> int:
    """The longest prefix by which a pair at this similarity meets in some tree with the recall."""
    depth = longest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def meeting(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The probability that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(depth: int, floor: int, loss: dict[int, float], allowed: float) -> int:
    """The longest prefix, at most depth and at least floor, whose loss is allowed."""
    return next((d for d in range(depth, floor, -1) if loss[d] <= allowed), floor)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


def shingle_rows(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the word counts of texts laid end to end: for each n-gram its text and its n word
    positions, -1 where a text of fewer than n words has none (it is one n-gram)."""
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), grams)
    base = np.cumsum(counts) - counts
    first = np.cumsum(grams) - grams
    start = base[text] + np.arange(len(text)) - first[text]
    at = start[:, None] + np.arange(n)
    at[at >= (base + counts)[text][:, None]] = -1
    return text, at, grams


def _sign(n: int, trees: int, floor: int, longest: int):
    rng = np.random.default_rng(20240607)
    factors = rng.integers(1, 2**63, size=trees * longest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salts = rng.integers(0, 2**63, size=trees * longest, dtype=np.uint64)
    powers = rng.integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            number: dict[bytes, int] = {}
            words, counts = [], []
            for text in batch.column("text").to_pylist():
                mine = text.encode().split()
                counts.append(len(mine))
                words += [number.setdefault(w, len(number)) for w in mine]
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
            flat = np.append(hashes[np.array(words, np.int64)], np.uint64(0))
            _, at, grams = shingle_rows(np.array(counts, np.int64), n)
            gram = np.zeros(len(at), np.uint64)
            for k in range(n):
                gram = gram * powers[k] + flat[at[:, k]]
            gram = _mix(gram)
            full = np.flatnonzero(grams > 0)
            starts = (np.cumsum(grams) - grams)[full]
            heads, tails = np.zeros((len(full), trees), np.uint64), np.zeros((len(full), trees), np.uint64)
            if len(full):
                for t in range(trees):
                    head = np.full(len(full), np.uint64(t))
                    for k in range(longest):
                        j = t * longest + k
                        low = np.minimum.reduceat((gram ^ salts[j]) * factors[j] >> np.uint64(32), starts)
                        if k < floor:
                            head = _mix(head * _MIX2 + low + np.uint64(1))
                        else:
                            tails[:, t] = tails[:, t] << np.uint64(8) | _mix(low) & np.uint64(255)
                    heads[:, t] = head
            sizes = np.zeros(len(counts) + 1, np.int64)
            sizes[full + 1] = trees
            ends = pa.array(np.cumsum(sizes), pa.int32())
            labels = [pa.ListArray.from_arrays(ends, pa.array(x.ravel().view(np.int64))) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), *labels], names=["key", "id", "heads", "tails"])

    return run


def similar_pairs(texts: list[str], similarity: float, n: int, *apart: list) -> Iterator[tuple[int, int]]:
    """All pairs of texts with Jaccard similarity of their word n-grams at or above the bound;
    with apart, only those that differ in each of these lists. Exact."""
    return ((a, b) for a, b, _ in scored_pairs(texts, similarity, n, *apart))


def scored_pairs(texts: list[str], similarity: float, n: int, *apart: list) -> Iterator[tuple[int, int, float]]:
    """The pairs of similar_pairs() with their similarity."""
    number: dict[bytes, int] = {}
    words, counts = [], []
    for text in texts:
        mine = text.encode().split()
        counts.append(len(mine))
        words += [number.setdefault(w, len(number) + 1) for w in mine]
    flat = np.append(np.array(words, np.int64), 0)
    owner, at, _ = shingle_rows(np.array(counts, np.int64), n)
    if not len(owner):
        return
    gram = flat[at[:, 0]]
    for k in range(1, n):
        gram = np.unique(gram * (len(number) + 1) + flat[at[:, k]], return_inverse=True)[1]
    gram = np.unique(gram, return_inverse=True)[1]
    kinds = int(gram.max()) + 1
    owned = np.unique(owner * kinds + gram)
    owner, gram = owned // kinds, owned % kinds
    # Rare n-grams first, small texts first.
    rank = np.empty(kinds, np.int64)
    rank[np.argsort(np.bincount(gram, minlength=kinds), kind="stable")] = np.arange(kinds)
    size = np.bincount(owner, minlength=len(texts))
    order = np.argsort(size, kind="stable")
    place = np.empty(len(texts), np.int64)
    place[order] = np.arange(len(texts))
    pairs = np.sort(place[owner] * kinds + rank[gram])
    flat, size = pairs % kinds, size[order]
    stop = np.cumsum(size)
    begin = stop - size
    index: dict[int, list[int]] = {}
    sides = list(zip(*apart, strict=True)) if apart else [()] * len(texts)
    sides = [sides[k] for k in order.tolist()]
    mark = np.zeros(kinds, bool)
    for x in range(len(texts)):
        m = int(size[x])
        if m == 0:
            continue
        mine = flat[begin[x] : stop[x]]
        head = mine[: m - math.ceil(similarity * m - 1e-9) + 1].tolist()
        least = int(np.searchsorted(size, similarity * m - 1e-9, side="left"))
        near = {y for g in head for y in index.get(g, ()) if y >= least}
        near = sorted(y for y in near if all(map(operator.ne, sides[x], sides[y])))
        for g in head:
            index.setdefault(g, []).append(x)
        if not near:
            continue
        mark[mine] = True
        if len(near) * 4 > x - near[0]:
            low = near[0]
            both = np.add.reduceat(mark[flat[begin[low] : stop[x - 1]]].astype(np.int64), begin[low:x] - begin[low])[np.array(near) - low]
        else:
            both = [int(mark[flat[begin[y] : stop[y]]].sum()) for y in near]
        mark[mine] = False
        for y, common in zip(near, both, strict=True):
            if common / (m + size[y] - common) >= similarity:
                yield int(order[x]), int(order[y]), common / (m + size[y] - common)


def _verify(similarity: float, n: int, trees: int, floor: int, longest: int, depth: int):
    # Links are counted by similarity, rounded down; a link found is worth 1 / its chance at depth.
    steps = np.linspace(similarity, 1, 51)
    losses = np.array([[(1 - meeting(x, d, trees)) / meeting(x, depth, trees) for d in range(floor, longest + 1)] for x in steps])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        apart = [list(pdf["was"])]
        if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
            apart.append(pdf["part"].tolist())
        keys = list(pdf["key"])
        counts, parent = np.zeros((len(keys), len(steps)), np.int64), list(range(len(keys)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b, alike in scored_pairs(list(pdf["text"]), similarity, n, *apart):
            step = int((alike - similarity) / (1 - similarity) * 50) if similarity < 1 else 50
            counts[a, step] += 1
            counts[b, step] += 1
            parent[find(a)] = find(b)
        return pd.DataFrame({"key": keys, "links": counts.sum(axis=1), "to": [keys[find(k)] for k in range(len(keys))], "lost": list(counts @ losses)})

    return run


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _below_nodes(trie: DataFrame, longest: int, depth: int, sets: DataFrame | None) -> DataFrame:
    """node, root: connected sets of what shares a prefix of this depth in some tree. A node is
    a text, or a former set (node, was) of texts under its name."""
    paths = trie.select("head", F.shiftright("tail", 8 * (longest - depth)).alias("step"), F.col("key").alias("node"))
    if sets is not None:
        paths = paths.join(sets, "node", "left").select("head", "step", F.coalesce("was", "node").alias("node"))
    nodes = paths.groupBy("head", "step").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("head", "step", "low")
    return components(paths.join(nodes, ["head", "step"]).where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")))


def _merged(sets: DataFrame | None, joined: DataFrame) -> DataFrame:
    """node, was, root for every text in a set: the name of its former set (its own if it was
    in none) and that of the set it is in now, null where the former set stays as it is."""
    alone = joined.select("node", F.col("node").alias("was"), "root")
    if sets is None:
        return alone
    return sets.join(joined.withColumnRenamed("node", "was"), "was", "left").select("node", "was", "root").unionByName(alone.join(sets, "node", "left_anti"))


def _joined(rows: DataFrame, texts: DataFrame, candidates: DataFrame, part_texts: int, verify) -> DataFrame:
    """The exact join of the different former sets inside each connected set.

    Former sets of more than part_texts texts are cut into parts of their own, the others of a
    connected set are dealt over parts together. Each two parts are a task, but for those of
    one former set, whose texts have been compared.
    """
    former = candidates.groupBy("root", "was").agg(F.count("*").alias("texts"))
    former = former.withColumn("large", F.col("texts") > part_texts)
    cut = F.ceil(F.col("texts") / F.lit(part_texts)).cast("int")
    total = former.groupBy("root").agg(
        F.ceil(F.coalesce(F.sum(F.when(~F.col("large"), F.col("texts"))), F.lit(0)) / F.lit(part_texts)).cast("int").alias("shared"),
        F.coalesce(F.sum(F.when(F.col("large"), cut)), F.lit(0)).cast("int").alias("owned"),
    )
    running = F.sum("own_parts").over(W.partitionBy("root").orderBy("was")) - F.col("own_parts")
    large = former.where("large").withColumn("own_parts", cut).withColumn("before", running.cast("int")).select("was", "own_parts", "before")
    chosen = (
        candidates.join(total, "root")
        .join(large, "was", "left")
        .join(texts.select("key", "first_id"), F.col("node") == F.col("key"))
        .select("root", "was", "shared", "owned", "own_parts", "before", "first_id", F.col("key").alias("own"))
    )
    spot = F.xxhash64("key")
    other = F.sequence(F.lit(0), F.col("shared") + F.col("owned") - 1)
    mine = F.col("shared") + F.col("before")
    members = (
        rows.join(chosen, (rows["key"] == chosen["own"]) & rows["id"].eqNullSafe(chosen["first_id"]))
        .dropDuplicates(["key"])
        .withColumn("part", F.coalesce(mine + F.pmod(spot, "own_parts"), F.pmod(spot, "shared")).cast("int"))
        .withColumn("other", F.explode(other))
        .where(F.coalesce((F.col("other") < mine) | (F.col("other") >= mine + F.col("own_parts")), F.lit(True)))
        .select("root", "was", "key", "text", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    )
    return staged(members.groupBy("root", "lo", "hi").applyInPandas(verify, "key binary, links long, to binary, lost array<double>"), "links")


def _loss(checked: DataFrame, similarity: float, trees: int, floor: int, longest: int) -> dict[int, float]:
    """By depth: the expected share of links lost, as the mean over texts with links.

    One text with one link at the bound counts beside those seen. A link keeps the weight of
    the depth that found it, so that after a shortening the loss is rather over-estimated.
    """
    depths = range(floor, longest + 1)
    per_text = checked.groupBy("key").agg(F.sum("links").alias("links"), *(F.sum(F.col("lost")[k]).alias(f"lost{k}") for k in range(len(depths))))
    row = per_text.where("links > 0").agg(F.count("*"), *(F.coalesce(F.sum(F.col(f"lost{k}") / F.col("links")), F.lit(0.0)) for k in range(len(depths)))).first()
    return {d: float(row[k + 1] + 1 - meeting(similarity, d, trees)) / (row[0] + 1) for k, d in enumerate(depths)}


def ngram_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
    n: int = 5,
    recall: float = 0.9999,
    trees: int = 32,
    longest: int = 10,
    part_texts: int = 1000,
) -> DataFrame:
    """One row per different text: key (text_key of it), class_id, n_links, n_copies, stays.

    What ngram_join() says of rows, for texts. stays holds for one text of each class, that
    with the smallest id (of those without, the smallest key).

    Labels have `longest` values, seven more than the head at most. `recall` is the expected
    share of links found, as the mean over the texts that have any; no link's own chance is
    below that of the longest prefixes, and where shortening goes down to the head, each has
    the target's.
    """
    ship_package(docs.sparkSession)
    floor = prefix_depth(similarity, recall, trees, longest)
    longest = min(longest, floor + 7)  # the tail is seven bytes of a long
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("key", text_key(F.col("text")))
    texts = staged(
        rows.mapInArrow(_sign(n, trees, floor, longest), "key binary, id long, heads array<long>, tails array<long>")
        .groupBy("key")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("n_copies"), F.first("heads").alias("heads"), F.first("tails").alias("tails")),
        "labels",
    )
    labels = texts.select("key", F.explode(F.arrays_zip("heads", "tails")).alias("label")).select("key", F.col("label.heads").alias("head"), F.col("label.tails").alias("tail"))
    several = texts.select("key", F.explode("heads").alias("head")).groupBy("head").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high")
    trie = staged(labels.join(several.select("head"), "head").sortWithinPartitions("head", "tail"), "forest")

    depth, checked, sets = longest, None, None
    while True:
        merged = staged(_merged(sets, _below_nodes(trie, longest, depth, sets)), "sets")
        verify = _verify(similarity, n, trees, floor, longest, depth)
        joined = _joined(rows, texts, merged.where("root is not null"), part_texts, verify)
        checked = joined if checked is None else checked.unionByName(joined)
        shorter = shortened(depth, floor, _loss(checked, similarity, trees, floor, longest), 1 - recall)
        if shorter == depth:
            break
        depth, sets = shorter, merged.select("node", F.coalesce("root", "was").alias("was"))

    links = checked.groupBy("key").agg(F.sum("links").alias("n_links"))
    classes = components(checked.select(F.col("key").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "key")

    rooted = texts.select("key", "first_id", "n_copies").join(classes, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key")).alias("first")
    named = rooted.groupBy("root").agg(first).select("root", F.col("first.first_id").alias("class_id"), F.col("first.key").alias("stay"))
    return (
        rooted.join(named, "root")
        .join(links, "key", "left")
        .select("key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", (F.col("key") == F.col("stay")).alias("stays"))
    )


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_copies.

    Texts are linked if the sets of their word n-grams have a Jaccard similarity of at least
    `similarity`; words stand between ASCII white space, as they are written. n_links counts
    the other texts linked to a row's text, n_copies the rows with exactly its text; classes
    are the connected components of links and copies, named after their smallest id (null if
    all ids are null). A text of fewer than n words is one n-gram; texts without words, null
    among them, link to nothing and share a class only as copies. Repeated rows count as
    copies. Other columns of docs are not looked at. options: those of ngram_classes().

    Copies are joined once. A set of connected candidates of more than part_texts texts is cut
    into parts, and each pair of parts is a task of its own, unless both are of one set that
    longer prefixes had connected; pairs are counted, not emitted.
    """
    classes = ngram_classes(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_or_empty(text_col)).alias("key"))
    return rows.join(classes, "key").select("doc_id", "class_id", "n_links", "n_copies")
