"""Cases part by part: the same rows as at once, and nothing that was shuffled stays."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import parts as P
from plumbline.session import stored
from plumbline.sources import jsonl
from plumbline.suite import QUERIES

ROOT = "/root/testdata/sf0.001"
IDS = [f"c{i}" for i in range(12)]


def shuffle_files(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_a_part_has_all_rows_of_its_cases(spark):
    table = spark.createDataFrame([(c, i) for c in [None, *IDS] for i in range(3)], "case_id string, i int")
    dealt = P.cut(table, 4, "dealt")
    assert rows(dealt[0].union(dealt[1]).union(dealt[2]).union(dealt[3])) == rows(table)
    assert sum(d.select("case_id").distinct().count() for d in dealt) == 13 and all(d.schema.names == table.schema.names for d in dealt)
    assert [d.count() for d in P.cut(table.filter("false"), 2, "none")] == [0, 0]


def test_what_is_stored_leaves_no_shuffle_files(spark):
    counted = spark.range(1000).repartition(4).groupBy(F.col("id") % 7).count()
    before = shuffle_files(spark)
    assert stored(counted, "counted")._jdf.inputFiles()
    assert shuffle_files(spark) <= before


def test_lines_do_not_travel(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("a\nb\n")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = jsonl.read_lines(spark, str(tmp_path / "x.jsonl"))
        assert "SortMergeJoin" not in lines._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["line_no"], r["line"]) for r in lines.collect()) == [(1, "a"), (2, "b")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_documents_by_part(spark, monkeypatch):
    at_once = rows(QUERIES["evaluate_documents"](spark, ROOT))
    monkeypatch.setattr(P, "AT_ONCE", 100)
    monkeypatch.setattr(P, "PART_CASES", 800)
    assert rows(QUERIES["evaluate_documents"](spark, ROOT)) == at_once
