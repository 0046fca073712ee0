"""Many cases one part after the other, so that what is shuffled for a part is gone before the next one begins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, replace
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import shuffles_freed, work_dir

#: Cases up to which all are taken at once, cases of a part beyond that, and parts at most.
AT_ONCE, PART_CASES, PARTS = 10_000_000, 2_500_000, 16

Tables = TypeVar("Tables")  # a dataclass of tables that all have a case_id


def parts_of(cases: DataFrame) -> int:
    """Number of parts; 1 for cases that are taken at once."""
    count = cases.select(F.lit(1)).count()
    return 1 if count <= AT_ONCE else min(PARTS, -(-count // PART_CASES))


def in_part(parts: int) -> Column:
    """The part of a row, by its case alone: a part has all rows of its cases."""
    return F.pmod(F.xxhash64("case_id"), F.lit(parts)).cast("int")


def cut(table: DataFrame, parts: int, purpose: str) -> list[DataFrame]:
    """The rows of each part, written once for all of them."""
    spark, path = table.sparkSession, work_dir(table.sparkSession, purpose)
    with shuffles_freed(spark):
        table.withColumn("_part", in_part(parts)).write.partitionBy("_part").option("compression", "zstd").parquet(path)
    whole = spark.read.schema(table.withColumn("_part", in_part(parts)).schema).parquet(path)
    return [whole.filter(F.col("_part") == i).drop("_part") for i in range(parts)]


def by_part(tables: Tables, parts: int, make: Callable[[Tables], DataFrame], purpose: str) -> DataFrame:
    """The rows that ``make`` gives for the cases of every part, for results whose rows depend on one case alone."""
    names = [f.name for f in fields(tables) if isinstance(getattr(tables, f.name), DataFrame)]
    dealt = {name: cut(getattr(tables, name), parts, f"{purpose}-{name}") for name in names}
    return one_by_one([lambda i=i: make(replace(tables, **{name: dealt[name][i] for name in names})) for i in range(parts)], purpose)


def one_by_one(results: list[Callable[[], DataFrame]], purpose: str) -> DataFrame:
    """The rows of all results, each made and written before the next one is begun."""
    path = None
    for result in results:
        df = result()
        spark, path = df.sparkSession, path or work_dir(df.sparkSession, purpose)
        with shuffles_freed(spark):
            df.write.mode("append").parquet(path)
    return spark.read.parquet(path)
