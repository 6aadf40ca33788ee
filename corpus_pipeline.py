"""From raw documents to sharded training data: five stages, each one of the operators in waveloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveloom.llm import decontam, langid, mixing, ngramjoin, sharding
from waveloom.llm.base import settle

STAGES = [
    ("language ID", langid.language_stage),
    ("n-gram Jaccard join", ngramjoin.dedup_stage),
    ("decontamination", decontam.decontaminate_stage),
    ("source mix", mixing.mix_stage),
    ("sharding", sharding.shard_stage),
]

# A trained network, spaced hashes and label propagation have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the table documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
