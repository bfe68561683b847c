"""A training corpus from raw documents: quality, exact dedup, near-dedup, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runwarden.llm import stages
from runwarden.llm.common import staged

STAGES = [
    ("quality classifier", stages.keep_quality),
    ("exact dedup", stages.drop_exact),
    ("SimHash near-dedup", stages.drop_near),
    ("mixing sources to target weights", stages.mix_sources),
    ("byte-level BPE", stages.to_tokens),
]

#: The classifier's decisions are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{i}")
    return docs
