"""Mixing sources to target weights by a low-discrepancy schedule.

A mix is a row of slots, each worth one block of words. The points of a golden-ratio
sequence, mapped through the cumulative target shares, say which source fills which slot;
the slots of a source are ranked, and its r-th slot takes the r-th block of the source's
shuffled words. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import WORD, id_text, staged, text_or_empty

#: 2**44 divided by the golden ratio, made odd: its multiples visit every 44-bit number once.
_PERIOD, _STEP = 1 << 44, 10872568911861
_CELLS = 1024
_CHUNK = 1 << 16
_BUCKET_ROWS = 4096


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_passes: int = 3) -> DataFrame:
    """source, source_no, source_size, target, need from rows (source, size); one row per source.

    Sources in code point order, null last, take the weights in turn. Targets share all
    words by weight but stop at `most_passes` times the source; the excess goes to the others
    by weight until none is above: the level is that of the first source, by capacity per
    weight, which need not stop. The windows below see one row per source.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    by_room = W.orderBy("room", "source_no")
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    cap = F.lit(most_passes) * F.col("source_size")
    turn = F.array(*(F.lit(w) for w in weights))
    rated = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(everything))
        .withColumn("weight", F.get(turn, (F.col("source_no") - 1) % len(weights)))
        .withColumn("room", cap.cast("double") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("share", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("share"))
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("room"), F.col("level")), F.when(F.col("level") <= F.col("room"), F.struct("room", "source_no"))).over(whole))
    )
    return rated.withColumn("target", F.least(cap.cast("double"), F.col("level") * F.col("weight"))).select(
        "source", "source_no", "source_size", "target", F.least(cap, F.floor(F.col("target") + 0.5)).cast("long").alias("need")
    )


def place(sized: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Each row's place (start) in the shuffled words of its source.

    The order is that of the ids' MD5. A source is cut by the leading digits, so that even
    one with a third of all rows is numbered by many tasks.
    """
    digits = 1
    while 16**digits * _BUCKET_ROWS < rows and digits < 8:
        digits += 1
    keyed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    keyed = keyed.withColumn("key", F.md5(id_text("id"))).withColumn("bucket", F.substring("key", 1, digits))
    bases = (
        keyed.groupBy("source_no", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("base", F.sum("words").over(W.partitionBy("source_no").orderBy("bucket")) - F.col("words"))
        .drop("words")
    )
    inside = W.partitionBy("source_no", "bucket").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    return (
        keyed.withColumn("start", F.sum("size").over(inside) - F.col("size"))
        .join(bases, ["source_no", "bucket"])
        .withColumn("start", F.col("start") + F.col("base"))
        .drop("base", "bucket", "key")
    )


def slots(sources: DataFrame, block: int) -> DataFrame:
    """slot, source_no, block: the schedule of all blocks that the sources need.

    A source that needs b of all B blocks owns b of the B equal cells of the unit interval,
    and the i-th point of the golden-ratio sequence, frac((i + 1) / golden ratio), draws the
    owner of the cell it falls in. Points of sources that have all their blocks are passed
    over; the sequence goes on until every source has its blocks. That takes at most 3 * B
    points: N points leave no gap as wide as 3 / N. The drawn slots are numbered from 0
    without holes.
    """
    spark = sources.sparkSession
    needs = sources.where("need > 0").select("source_no", F.ceil(F.col("need") / F.lit(block)).cast("long").alias("blocks"))
    total = needs.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    width = -(-total // _CELLS) or 1
    hi = F.sum("blocks").over(W.orderBy("source_no").rowsBetween(W.unboundedPreceding, 0))
    cells = needs.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("blocks"))
    cells = cells.withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    drawn = (
        spark.range(3 * total)
        .withColumn("at", F.floor(_point(F.col("id") + 1) * F.lit(total)))
        .withColumn("cell", F.expr(f"at div {width}"))
        .join(cells, "cell")
        .where("lo <= at and at < hi")
        .select("id", "source_no", "blocks", F.floor(F.col("id") / _CHUNK).alias("chunk"))
    )
    ranked = drawn.withColumn("r", F.row_number().over(W.partitionBy("source_no", "chunk").orderBy("id")) - 1)
    counts = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("c"))
    bases = counts.withColumn("base", F.sum("c").over(W.partitionBy("source_no").orderBy("chunk")) - F.col("c")).drop("c")
    used = ranked.join(bases, ["source_no", "chunk"]).withColumn("block", F.col("r") + F.col("base")).where("block < blocks")
    used = used.select("id", "source_no", "block", "chunk")
    # One row per chunk of 65,536 points.
    kept = used.groupBy("chunk").agg(F.count("*").alias("c"))
    firsts = kept.withColumn("first", F.sum("c").over(W.orderBy("chunk")) - F.col("c")).drop("c")
    inside = F.row_number().over(W.partitionBy("chunk").orderBy("id")) - 1
    numbered = used.withColumn("n", inside).join(firsts, "chunk")
    return numbered.select((F.col("first") + F.col("n")).alias("slot"), "source_no", "block")


def _point(i: Column) -> Column:
    """frac(i / golden ratio): i times the step modulo the period, in pieces that fit a long."""
    parts = [
        F.pmod(F.shiftright(i, 18 * k).bitwiseAND(F.lit((1 << 18) - 1)) * F.lit((_STEP << 18 * k) % _PERIOD), F.lit(_PERIOD))
        for k in range(3)
    ]
    return F.pmod(parts[0] + parts[1] + parts[2], F.lit(_PERIOD)).cast("double") / F.lit(float(_PERIOD))


def _pieces(placed: DataFrame, block: int, most_passes: int) -> DataFrame:
    """What each row gives to each block: source_no, block, pass, from_word, words."""
    size, start, need = F.col("size"), F.col("start"), F.col("need")
    at: Column = F.col("pass") * F.col("source_size") + start
    return (
        placed.where((size > 0) & (start < need))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most_passes - 1))))
        .withColumn("at", at)
        .where(F.col("at") < need)
        .withColumn("end", F.least(F.col("at") + size, need))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
        .withColumn("first", F.greatest(F.col("at"), F.col("block") * block))
        .withColumn("last", F.least(F.col("end"), (F.col("block") + 1) * block))
        .withColumn("from_word", F.col("first") - F.col("at"))
        .withColumn("words", F.col("last") - F.col("first"))
        .drop("at", "end", "first", "last")
    )


class Mix:
    """placed: id, source, size, source_size, target, start of every row. schedule: slot, source_no,
    block, id, pass, from_word, words, the mix in order of (slot, source_no, start, pass)."""

    def __init__(self, placed: DataFrame, schedule: DataFrame) -> None:
        self.placed, self.schedule = placed, schedule

    def taken(self) -> DataFrame:
        """placed with `taken`, the words that the mix takes of each row, repeats counted;
        `first_slot`, where it first does (null: never), and `n_slots`, in how many slots."""
        key = ["source_no", "start", "size"]
        sums = self.schedule.groupBy(*key).agg(
            F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.size(F.collect_set("slot")).cast("long").alias("n_slots")
        )
        return self.placed.join(sums, key, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("taken", "n_slots")})


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    most_passes: int = 3,
    block: int = 256,
) -> Mix:
    """The mix of docs whose sources share all words by weight.

    A row's size is its number of words, 0 for a null or empty text; such rows are placed but
    never taken. A null source is a source. A source's taken words are its target, rounded;
    its words are walked through in one order, at most `most_passes` times, so that no row is
    taken more often. Repeated rows count each. The order depends on ids and sizes only, so
    reruns agree. An empty table gives empty frames. Other columns are not looked at.
    """
    sized = staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    rows = sized.count()
    sources = staged(source_targets(sized, weights, most_passes), "mix-sources")
    placed = staged(place(sized, sources, rows), "mix-places")
    schedule = slots(sources, block).join(_pieces(placed, block, most_passes), ["source_no", "block"])
    return Mix(placed, schedule.select("slot", "source_no", "block", "id", "start", "size", "pass", "from_word", "words"))
