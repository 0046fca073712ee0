"""Scores and details part by part: the same rows as at once."""

from __future__ import annotations

import pytest

from plumbline.operators import metrics as M
from plumbline.operators import parts as P
from plumbline.operators.details import metric_details
from test_metrics import cases, dims, package, runtime

IDS = [f"c{i}" for i in range(12)]


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(P, "AT_ONCE", 2)
    monkeypatch.setattr(P, "PART_CASES", 4)


def some_package(spark):
    some = [None, *IDS[:7]]  # rows without a case and a case that comes twice
    pkg = package(
        spark, cases=cases(*IDS, IDS[0], None), runtime=runtime(*IDS, memo="## Triage\nAB-1", letter="x"),
        gold_bylaws=[(c, b) for c in some for b in "AAB"], cited=[(c, 0, "A") for c in some], evidence=[(c, "A", "k") for c in some[:4]],
        gold_gaps=[(c, "g") for c in some], reported_gaps=[(c, 0, "g", 5.0, 7.0, 2.0) for c in some[:3]],
        packet_numbers=[(c, f, v) for c in some for f, v in (("p", 5.0), ("r", 7.0))], flags=[(c, "next-step-ambiguous") for c in some],
        redline_scores=[(c, i, 0.5) for c in some for i in range(2)], text_scores=[(c, "staff", 1.0) for c in some],
    )
    pkg.redlines = spark.createDataFrame([(c, i, "g", "A", f) for c in some for i, f in enumerate(("p", "absent"))],
                                         "case_id string, seq int, addresses_gap string, cited_bylaw_id string, field string")
    pkg.packet_fields = pkg.packet_numbers.select("case_id", "field")
    return pkg, dims(spark, evidence=[("A", "k"), ("A", "l")], truth=[("g", "p", "r", 0.0)])


def rows(df):
    return sorted(map(repr, df.collect()))


def test_scores_by_part(spark, small_parts):
    pkg, dimensions = some_package(spark)
    by_part = M.score_cases(pkg, dimensions)
    assert "Exchange" not in by_part._jdf.queryExecution().executedPlan().toString()
    assert rows(by_part) == rows(M.score_cases(pkg, dimensions, parts=1)) and by_part.count() == 13


def test_details_by_part(spark, small_parts):
    pkg, dimensions = some_package(spark)
    by_part = metric_details(pkg, dimensions, ["M12"])
    assert "Exchange" not in by_part._jdf.queryExecution().executedPlan().toString()
    assert rows(by_part) == rows(metric_details(pkg, dimensions, ["M12"], parts=1)) and by_part.filter("kind = 'judged_redlines'").count() == 7
