"""The corpus pipeline: documents to packed sequences, one operator a stage.

Each stage works on all that the one before it kept; its result is written to the shared folder as
Parquet and read again.  SQL can't express the pipeline; tests/llm holds it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import stages
from marlstone.llm.shared import forget, staged, table

STAGES = [
    ("quality", stages.drop_low_quality),
    ("exact_dedup", stages.drop_exact_copies),
    ("near_dedup", stages.drop_near_copies),
    ("decontamination", stages.drop_benchmark_leaks),
    ("packing", stages.pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
