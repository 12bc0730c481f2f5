"""A corpus pipeline over documents: quality rules, exact and near deduplication, mixing, packing.

Each stage takes the documents that its predecessor kept and returns documents with the same
columns; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import stages
from loomframe.llm.base import staged

STAGES = [
    ("quality_rules", stages.quality),
    ("exact_dedup", stages.exact),
    ("near_dedup", stages.near),
    ("mix_sources", stages.mix),
    ("pack", stages.pack),
]

#: Signatures and the fitted packing plan have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
