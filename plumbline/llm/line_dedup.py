"""Removal of boilerplate lines that spread over many sites.

A line counts by the number of different sites that have it, not by its copies. HyperLogLog sketches of the sites per line
hash merge by aggregation; lines whose estimate is within the sketch's error of the threshold get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Sites from which a line is boilerplate; log2 of the sketch's registers; standard errors that count as near.
SITES, REGISTERS_LOG2, NEAR = 5, 10, 4.0


def _line_hash(line):
    return F.xxhash64(F.trim(line))


def _lines(docs: DataFrame) -> DataFrame:
    """(row_key, site, place, line): the lines that are more than spaces, as hashes. Rows equal in id and text share a key."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    return rows.where(F.trim("raw") != "").select("row_key", "site", "place", _line_hash(F.col("raw")).alias("line"))


def boilerplate_lines(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """The hashes of lines that at least ``sites`` different sites have; a null site is not counted."""
    lines = lines.where("site is not null").select("line", "site")
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(REGISTERS_LOG2)).alias("sketch"), F.count("*").alias("n"))
    # the sketch's error is relative; below the threshold's lower margin there is no need to look again
    error = NEAR * 1.04 / 2 ** (REGISTERS_LOG2 / 2)
    rated = written(
        sketches.where(F.col("n") >= sites).select("line", F.hll_sketch_estimate("sketch").alias("about"))
        .where(F.col("about") >= sites * (1 - error) - 1),
        "spread-lines",
    )
    sure = rated.where(F.col("about") > sites * (1 + error) + 1).select("line")
    near = written(rated.where(F.col("about") <= sites * (1 + error) + 1).select("line"), "near-lines")
    exact = lines.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").count()
    return sure.unionByName(exact.where(F.col("count") >= sites).select("line"))


def without_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """(row, n_lines, n_removed, kept_text): each row as a struct, its lines and what is left of its text.

    Lines are separated by line feeds, compared without spaces at their ends, and removed wherever they stand, in every row.
    Lines of spaces only stay. A null text has no lines and stays null; an empty text is one empty line. Repeated rows are
    treated alike and all returned. An empty table gives an empty table.
    """
    lines = _lines(docs.select("doc_id", "text", "source"))
    spread = written(boilerplate_lines(lines, sites), "boilerplate")
    removed = written(lines.join(spread, "line").groupBy("row_key").agg(F.collect_set("place").alias("places")), "removed-lines")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = packed.withColumn("row_key", F.xxhash64("row.doc_id", "row.text"))
    # the list grows with the texts: one way of joining at every size
    joined = keyed.join(removed.hint("merge"), "row_key", "left").withColumn("parts", F.split("row.text", "\n"))
    kept = F.array_join(F.filter("parts", lambda part, place: ~F.array_contains("places", place)), "\n")
    return joined.select(
        "row", F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_removed"),
        F.when(F.col("places").isNull(), F.col("row.text")).otherwise(kept).alias("kept_text"),
    )
