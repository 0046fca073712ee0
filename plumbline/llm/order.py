"""Places of rows within groups of any size: a range sort, one row per piece of a group, no group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import written

#: Bits that number the rows of a partition in Spark's increasing ids.
ROW_BITS = 33


def placed(rows: DataFrame, group: str, order: Sequence[str], purpose: str) -> DataFrame:
    """``rows`` with part, place and n: the place (from zero) of a row within its group in ascending order, nulls first, and the
    rows of the group.

    Rows are range-partitioned by group and order and written sorted; ``part`` is the partition. A group has one piece per
    partition that holds it, so its offsets are a window over at most as many rows as there are partitions. ``group`` must not
    be null. Rows that are equal in group and order get their places in any order.
    """
    by = [F.col(group), *(F.col(c).asc_nulls_first() for c in order)]
    numbered = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row_id", F.monotonically_increasing_id()), purpose)
    numbered = numbered.withColumn("part", F.shiftright("row_id", ROW_BITS).cast("int"))
    pieces = numbered.groupBy(group, "part").agg(F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("piece"))
    whole = Window.partitionBy(group)
    offsets = pieces.select(
        group, "part", "first_id", F.sum("piece").over(whole).alias("n"),
        F.coalesce(F.sum("piece").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    place = (F.col("before") + F.col("row_id") - F.col("first_id")).alias("place")
    return numbered.join(offsets, [group, "part"]).select(*rows.columns, "part", place, "n")
