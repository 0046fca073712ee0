"""What the operators share: table reads, written intermediate tables, small column helpers."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import read_table, work_dir


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows of a frame, written once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = work_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def map_arrow(frame: DataFrame, schema, function, *args) -> DataFrame:
    """``mapInArrow`` with bound arguments; functions are pickled by name, so workers import this package."""
    return frame.mapInArrow(functools.partial(_call, function, args), schema)


def _call(function, args, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return function(batches, *args)


def text_columns(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only id and text, under fixed names, so other columns of the input cannot clash."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
