"""A corpus from documents to packed sequences: five stages, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import stages
from lodestrata.llm.common import drop_dir, stored, work_dir

STAGES = [
    ("quality classifier", stages.quality_filter),
    ("line dedup", stages.line_filter),
    ("near duplicates", stages.near_duplicates),
    ("decontamination", stages.decontaminate),
    ("packing", stages.pack),
]
#: Classifier and packing have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each stage's rows are written as Parquet and read again by the next."""
    folder = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"{folder}/{k}")
            if k:
                drop_dir(spark, f"{folder}/{k - 1}")
    return docs
