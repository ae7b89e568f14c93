"""A corpus from raw documents: language, quality, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartmill.llm import pipeline_stages

STAGES = [
    ("language", pipeline_stages.language_stage),
    ("quality", pipeline_stages.quality_stage),
    ("near_duplicates", pipeline_stages.near_duplicates_stage),
    ("packing", pipeline_stages.packing_stage),
]
#: SQL has no form for the model and signature stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline_stages.run(spark, sf_dir, STAGES)
