"""The training-data pipeline: stages over the table of documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import documents, written
from plumbline.llm.stages import coded, known_language, mixed, near_duplicates, without_benchmark

STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_files", coded),
]

#: No stage can be stated in SQL: hashes, models and codecs are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
