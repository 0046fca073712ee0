"""JSON lines and JSON documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_lines(lines: DataFrame, schema: T.StructType | str, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows out of a text column: blank lines are skipped, bad lines keep their text and error.

    Good rows get a ``value`` struct next to the other input columns.
    """
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*struct.fields, T.StructField("_corrupt_record", T.StringType())])
    kept = lines.filter(~F.col(text).rlike(r"^\s*$"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    # generated, not projected: filters and fields of the value would each parse the line again
    parsed = kept.withColumn("value", F.explode_outer(F.array(F.from_json(text, marked, options))))
    is_bad = F.col("value._corrupt_record").isNotNull() | F.col("value").isNull()
    good = parsed.filter(~is_bad).withColumn("value", F.col("value").dropFields("_corrupt_record"))
    bad = parsed.filter(is_bad).drop("value").withColumn("error", F.lit("malformed JSON"))
    return good, bad


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, line numbers from 1 inside each file.

    A file is split by Spark; each split is numbered by itself and then shifted by the rows of the earlier
    splits of its file, so a huge file is never one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("rid"), F.col("value").alias("line"),
    )
    per_block = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_rid"))
    from pyspark.sql import Window as W

    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    # one row per split, so no line has to travel
    return raw.join(F.broadcast(offsets), ["path", "block"]).select(
        "path", (F.col("before") + F.col("rid") - F.col("first_rid") + 1).alias("line_no"), "line"
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows with path and line number."""
    return parse_lines(read_lines(spark, path), schema)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Fails on the first malformed line with its file and line number."""
    good, bad = read_jsonl(spark, path, schema)
    first = bad.orderBy("path", "line_no").select("path", "line_no").first()
    if first is not None:
        raise ValueError(f"malformed JSON at {first['path']}:{first['line_no']}")
    return good


def read_json_doc(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """A whole JSON document, or None when the path does not exist."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(jvm_path):
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def json_paths(column: Column, *paths: str) -> Column:
    """First present JSON path of a text column."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.get_json_object(column, p) for p in paths])


def write_jsonl(df: DataFrame, path: str, by: tuple[str, ...] = ("domain", "split"), order: str = "case_id", force: bool = False) -> None:
    """JSON lines per (domain, split), sorted by id inside each file; refuses existing output unless forced.

    Rows are ranged over (partition columns, id), so a large split is written by several tasks in id order.
    """
    out = df.repartitionByRange(*by, order).sortWithinPartitions(*by, order)
    out.write.partitionBy(*by).mode("overwrite" if force else "errorifexists").json(path)
