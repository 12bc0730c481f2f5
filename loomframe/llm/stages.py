"""The stages of the corpus pipeline: operators of this subpackage, applied to whole rows.

A null text counts as empty in every stage, an empty table gives none, and columns beside
doc_id, text and source are carried along whatever their names (but for names that start with
two underscores); texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import WORD, text_or_empty
from .grace import grace_dedup
from .lsh_forest import ngram_classes, text_key
from .mixing import mix_sources
from .packing import pack_documents
from .repetition import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the repetition rules; repeated rows are judged each, empty texts go."""
    return keep_good(docs)


def _first_of(rows: DataFrame, *key: str) -> DataFrame:
    """One of the rows that agree in key; they differ at most in what no decision looks at."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(*key))).where("__r = 1").drop("__r")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id, a null id last; of rows that share both, one."""
    kept = grace_dedup(docs).where("kept").select(F.col("keep_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    rows = docs.withColumn("__own", F.sha2(text_or_empty(), 256))
    # The id is part of the key, so that copies spread over the tasks.
    same = rows.join(kept, (F.col("__own") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return _first_of(same, "doc_id", "__own").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that of the text which ngram_classes lets stay; of
    several rows with this text, one. A text in no class stays."""
    stays = ngram_classes(docs).where("stays").select(F.col("key").alias("__key"))
    rows = docs.withColumn("__own", text_key(text_or_empty()))
    return _first_of(rows.join(stays, F.col("__own") == F.col("__key"), "left_semi"), "__own").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix walks through it; where the mix ends inside a text, the text is whole.

    Rows without a word are never taken. A null source is a source; repeated rows count each.
    """
    taken = mix_sources(docs).taken().where("taken > 0").select("id", "source", "size", "start", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    # Rows that agree in id, source and size are told apart by a number.
    number = F.row_number().over(W.partitionBy("id", "source", "size").orderBy("start"))
    taken = taken.withColumn("__n", number).select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__words"), "__n", "__times")
    rows = docs.withColumn("__size", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long"))
    rows = rows.withColumn("__row", F.row_number().over(W.partitionBy("doc_id", "source", "__size").orderBy(F.xxhash64("text"))))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__size") == F.col("__words")) & (F.col("__row") == F.col("__n"))
    repeated = rows.join(taken, on).withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return repeated.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences of 1024 tokens; repeated rows each
    have their pieces, and an empty text the end id alone."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
