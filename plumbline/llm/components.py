"""Connected components of a table of links, by minimum labels and pointer jumps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """One row (node, root) per node that occurs in ``links`` (a, b); root is the smallest node reachable.

    Each round takes the smallest label of all neighbours (a minimum, combined map-side, so a hub is no single task),
    then follows the label's own label. Labels only fall, and the loop ends when no label fell. Every round is written
    to the shared folder; only the number of changed labels reaches the driver.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "labels")
    while True:
        heard = both.join(labels, both.b == labels.node).select(both.a.alias("node"), "root")
        lowest = heard.union(labels).groupBy("node").agg(F.min("root").alias("low"))
        target = labels.select(F.col("node").alias("low"), F.col("root").alias("beyond"))
        moved = written(
            lowest.join(target, "low", "left").join(labels, "node")
            .select("node", F.least("low", "beyond").alias("root"), (F.least("low", "beyond") < F.col("root")).alias("fell")),
            "labels",
        )
        fell = moved.where("fell").count()
        labels = moved.select("node", "root")
        if not fell:
            return labels
