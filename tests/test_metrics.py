"""Empty-set branches, duplicates and gates of the metrics on small hand-written cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions import scalar as S
from plumbline.operators import metrics as M
from plumbline.operators.details import metric_details

BYLAW = "case_id string, bylaw_id string"
CITED = "case_id string, seq int, bylaw_id string"


def package(spark, **tables):
    """A package whose missing tables are empty."""
    schemas = {
        "cases": "case_id string, domain string, split string, pathway_class string, gold_stage1_complete boolean",
        "runtime": "case_id string, predicted_pathway string, stage1_complete boolean, memo_markdown string, letter_markdown string",
        "gold_bylaws": BYLAW, "cited": CITED, "evidence": "case_id string, bylaw_id string, evidence_key string",
        "gold_gaps": "case_id string, gap_id string",
        "reported_gaps": "case_id string, seq int, gap_id string, proposed_value double, required_value double, delta double",
        "packet_numbers": "case_id string, field string, value double",
        "redlines": "case_id string, seq int, addresses_gap string, cited_bylaw_id string, field_exists boolean",
        "gold_missing": "case_id string, document_id string", "missing": "case_id string, document_id string",
        "gold_flags": "case_id string, flag string", "flags": "case_id string, flag string",
    }
    extra = {"redline_scores": "case_id string, seq int, score double", "text_scores": "case_id string, audience string, score double"}
    out = M.Package(**{name: spark.createDataFrame(tables.get(name, []), schema) for name, schema in schemas.items()})
    for name, schema in extra.items():
        if name in tables:
            setattr(out, name, spark.createDataFrame(tables[name], schema))
    return out


def dims(spark, corpus=("A", "B"), evidence=(), truth=()):
    truth_schema = "gap_id string, proposed_field string, required_field string, tolerance double"
    return M.Dimensions(
        corpus=spark.createDataFrame([(b,) for b in corpus], "bylaw_id string"),
        evidence_map=spark.createDataFrame(list(evidence), "bylaw_id string, evidence_key string"),
        truth=None if truth is None else spark.createDataFrame(list(truth), truth_schema),
    )


def cases(*ids, pathway="heritage", complete=True):
    return [(i, "d", "train", pathway, complete) for i in ids]


def runtime(*ids, memo="", letter="", pathway="heritage", complete=True):
    return [(i, pathway, complete, memo, letter) for i in ids]


def score(spark, metric, dimensions=None, **tables):
    rows = M.score_cases(package(spark, **tables), dimensions or dims(spark), [metric]).collect()
    return {r["case_id"]: (r[metric] if r[metric] is None else round(r[metric], 6), r[f"{metric}_branch"]) for r in rows}


def test_m2_only_the_literal_escalates(spark):
    got = score(
        spark, "M2", cases=[("a", "d", "train", "heritage", True), ("b", "d", "train", "specialist-required", True)],
        runtime=runtime("a", pathway="floodplain") + runtime("b", pathway="heritage"),
    )
    assert got == {"a": (1.0, "standard"), "b": (0.0, "standard")}


def test_m3_slices_before_it_drops_duplicates(spark):
    ranked = [("a", i, "X") for i in range(9)] + [("a", 9, "A"), ("a", 10, "B")]
    got = score(
        spark, "M3", cases=cases("a", "b"), runtime=runtime("a", "b"), gold_bylaws=[("a", "A"), ("a", "B"), ("a", "A")], cited=ranked,
    )
    assert got == {"a": (0.5, "standard"), "b": (1.0, "vacuous_one_gold_empty")}


@pytest.mark.parametrize("table, row", [
    ("evidence", ("a", "Z", None)), ("redlines", ("a", 0, "g", "Z", True)), ("runtime", ("a", "p", True, "see ZZ-9 here", "")),
])
def test_m4_invalid_id_in_any_source(spark, table, row):
    tables = {"cases": cases("a", "b"), "runtime": runtime("a", "b")}
    tables[table] = [row] + (runtime("b") if table == "runtime" else [])
    assert score(spark, "M4", **tables) == {"a": (0.0, "standard"), "b": (1.0, "vacuous_one_empty_both")}


def test_m5_keeps_repeats_and_scores_unlisted_as_one(spark):
    d = dims(spark, evidence=[("A", "x"), ("A", "y")])
    got = score(
        spark, "M5", d, cases=cases("a", "b"), runtime=runtime("a", "b"), gold_bylaws=[("a", "A"), ("a", "A"), ("a", "C")],
        evidence=[("a", "A", "x"), ("a", "B", "y"), ("a", "A", "x")],
    )
    assert got == {"a": (round(2 / 3, 6), "standard"), "b": (1.0, "vacuous_one_gold_empty")}


TRUTH = [("g", "p", "r", 0.01), ("h", "p", "r", 0.01), ("e", "p", "r", 0.01)]


@pytest.mark.parametrize("report, reason, raw", [
    ((5.0, 7.0, 2.0), "ok", 1.0), ((5.5, 7.0, 2.0), "provided_out_of_tolerance", 0.0), ((5.0, 7.5, 2.0), "required_out_of_tolerance", 0.0),
    ((5.0, 7.0, -2.0), "delta_out_of_tolerance", 0.0),
])
def test_m6_tolerances_and_sign(spark, report, reason, raw):
    tables = {
        "cases": cases("a"), "runtime": runtime("a"), "gold_gaps": [("a", "g")], "packet_numbers": [("a", "p", 5.0), ("a", "r", 7.0)],
        "reported_gaps": [("a", 0, "g", 0.0, 0.0, 0.0), ("a", 1, "g", *report), ("a", 2, "unlisted", 1.0, 1.0, 0.0)],
    }
    d = dims(spark, truth=TRUTH)
    assert score(spark, "M6", d, **tables)["a"] == (raw, "standard")
    verdict = M.gap_verdicts(package(spark, **tables), d).filter("gap_id = 'g'").first()
    assert verdict["reason"] == reason


def test_m6_extras_missing_fields_and_empty(spark):
    d = dims(spark, truth=TRUTH)
    got = score(
        spark, "M6", d, cases=cases("extra", "nofield", "none", "only_told"), runtime=runtime("extra", "nofield", "none", "only_told"),
        gold_gaps=[("extra", "g"), ("nofield", "g")], packet_numbers=[("extra", "p", 5.0), ("extra", "r", 7.0)],
        reported_gaps=[("extra", 0, "g", 5.0, 7.0, 2.0), ("extra", 1, "h", 5.0, 7.0, 2.0), ("extra", 2, "h", 5.0, 7.0, 2.0),
                       ("nofield", 0, "g", 5.0, 7.0, 2.0), ("only_told", 0, "e", 1.0, 1.0, 0.0)],
    )
    assert got == {
        "extra": (round(1 / 3, 6), "standard"), "nofield": (0.0, "standard"), "none": (1.0, "vacuous_one_empty_both"),
        "only_told": (0.0, "zero_predicted_nonempty_gold_empty"),
    }


def test_m6_without_truth_map_matches_ids(spark):
    got = score(
        spark, "M6", dims(spark, truth=None), cases=cases("a"), runtime=runtime("a"), gold_gaps=[("a", "gap-fsr-over"), ("a", "other"), ("a", "told")],
        reported_gaps=[("a", 0, "told", 0.0, 0.0, 0.0), ("a", 1, "more", 0.0, 0.0, 0.0)],
    )
    assert got["a"] == (round(1 / 3, 6), "standard")


def test_m7_sets_ignore_order_and_repeats(spark):
    got = score(
        spark, "M7", cases=cases("a", "b", "c"), runtime=runtime("a", "b") + runtime("c", complete=False),
        gold_missing=[("a", "x"), ("a", "y")], missing=[("a", "y"), ("a", "x"), ("a", "y"), ("b", "z")],
    )
    assert {k: v[0] for k, v in got.items()} == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_m8_branches(spark):
    got = score(
        spark, "M8", cases=cases("both", "told", "gold", "over"), runtime=runtime("both", "told", "gold", "over"),
        gold_gaps=[("gold", "g"), ("over", "g"), ("over", "h")],
        redlines=[("told", 0, "g", "A", True)] + [("over", i, "g", "A", True) for i in range(3)] + [("over", 3, "h", "Z", True), ("over", 4, "h", "A", False)],
    )
    assert got == {
        "both": (1.0, "vacuous_one_empty_both"), "told": (0.0, "zero_predicted_nonempty_gold_empty"),
        "gold": (0.0, "zero_gold_nonempty_predicted_empty"), "over": (0.2, "standard"),
    }


MEMO = "\n".join(f"## {h}" for h in V.MEMO_SECTIONS)
LETTER = "\n".join(f"## {h}" for h in V.LETTER_SECTIONS)


@pytest.mark.parametrize("memo, letter, raw", [
    (MEMO, LETTER, 1.0),
    (MEMO.replace("## Gaps", "## Gaps ##  "), LETTER, 1.0),
    (MEMO + "\n## Recommendation", LETTER, 1.0),
    (MEMO + "\n## Triage", LETTER, 0.0),
    (MEMO.replace("## Gaps\n", ""), LETTER, 0.0),
    (MEMO.replace("## Gaps\n", "") + "\n see  gaps", LETTER, 0.0),
    (MEMO + "\nper ZZ-1", LETTER, 0.0),
    (MEMO, LETTER + "\nper AB-1", 0.0),
    (MEMO.replace("## Triage", "### Triage"), LETTER, 0.0),
])
def test_m9_structure(spark, memo, letter, raw):
    assert score(spark, "M9", dims(spark, corpus=["AB-1"]), cases=cases("a"), runtime=runtime("a", memo=memo, letter=letter))["a"] == (raw, "standard")


def test_m10_m11_unknown_flags_are_dropped_from_predictions_only(spark):
    first = V.SUPPORT_FLAGS[0]
    tables = {
        "cases": cases("none", "told", "gold", "odd"), "runtime": runtime("none", "told", "gold", "odd"), "flags": [("told", first), ("odd", "strange"), ("odd", first), ("odd", first)],
        "gold_flags": [("gold", first), ("odd", "strange"), ("odd", first)],
    }
    assert score(spark, "M10", **tables) == {
        "none": (1.0, "vacuous_one_empty_both"), "told": (0.0, "standard"), "gold": (0.0, "zero_gold_nonempty_predicted_empty"), "odd": (1.0, "standard"),
    }
    assert score(spark, "M11", **tables) == {
        "none": (1.0, "vacuous_one_empty_both"), "told": (0.0, "zero_predicted_nonempty_gold_empty"), "gold": (0.0, "standard"), "odd": (0.5, "standard"),
    }


def test_m12_judge_off_comes_before_the_empty_branches(spark):
    tables = {"cases": cases("a"), "runtime": runtime("a")}
    assert score(spark, "M12", **tables)["a"] == (None, "not_applicable")
    assert score(spark, "M12", redline_scores=[], **tables)["a"] == (1.0, "vacuous_one_empty_both")


def test_m12_scores_valid_redlines_and_stops_on_an_error(spark):
    tables = {
        "cases": cases("a", "b"), "runtime": runtime("a", "b"), "gold_gaps": [("a", "g"), ("b", "g")],
        "redlines": [("a", 0, "g", "A", True), ("a", 1, "g", "Z", True), ("b", 0, "g", "A", True)],
        "redline_scores": [("a", 0, 0.5), ("a", 1, 1.0), ("b", 0, None)],
    }
    assert score(spark, "M12", **tables) == {"a": (0.25, "standard"), "b": (None, "not_applicable")}


@pytest.mark.parametrize("memo, judged, expected", [
    ("", False, (0.0, "gate_failed")), ("", True, (0.0, "gate_failed")), (MEMO, False, (None, "not_applicable")), (MEMO, True, (round(0.67 * 0.5 + 0.33, 6), "standard")),
])
def test_m13_gate_comes_before_judge_off(spark, memo, judged, expected):
    tables = {"cases": cases("a"), "runtime": runtime("a", memo=memo, letter=LETTER)}
    if judged:
        tables["text_scores"] = [("a", "staff", 0.5), ("a", "applicant", 1.0)]
    assert score(spark, "M13", **tables)["a"] == expected


def test_composites_and_range_guard(spark):
    assert sum(V.WEIGHTS.values()) == 100 and sum(V.WEIGHTS[m] for m in V.DETERMINISTIC) == V.DETERMINISTIC_MAX
    perfect = spark.createDataFrame([("a", *[1.0] * 13)], ["case_id", *V.METRICS])
    row = M.with_composites(perfect).first()
    assert (row["deterministic_prqs"], row["partial_full_prqs_lower_bound"], row["full_prqs"]) == (pytest.approx(100), 85, 100)
    long = spark.createDataFrame([("a", "M6", 1.5), ("a", "M1", None), ("a", "M12", None), ("a", "M2", 1.0)], "case_id string, metric string, raw double")
    assert {(r["metric"], r["problem"]) for r in M.range_violations(long).collect()} == {("M6", "raw_out_of_range"), ("M1", "raw_is_null")}
    with pytest.raises(Exception, match="metric M1"):
        M.require_valid(perfect.withColumn("M1", F.lit(None).cast("double"))).collect()


def test_row_order_and_hot_case_do_not_matter(spark):
    """One case with most rows, tables shuffled: same scores."""
    gold = [("hot", f"B{i}") for i in range(3000)] + [("cold", "A")]
    ranked = [("hot", i, f"B{i}") for i in range(3000)] + [("cold", 0, "A")]
    tables = {"cases": cases("hot", "cold"), "runtime": runtime("hot", "cold"), "gold_bylaws": gold, "cited": ranked}
    got = score(spark, "M3", **tables)
    tables["gold_bylaws"], tables["cited"] = gold[::-1], ranked[::-1]
    assert got == score(spark, "M3", **tables) == {"hot": (round(10 / 3000, 6), "standard"), "cold": (1.0, "standard")}


def test_details_name_what_the_scores_count(spark):
    tables = {
        "cases": cases("a", "b"), "runtime": runtime("a", "b", memo="## Triage\nsee Gaps and ZZ-9"),
        "gold_bylaws": [("a", "A"), ("a", "A"), ("a", "B")], "cited": [("a", 0, "A"), ("a", 1, "X")], "evidence": [("a", "A", "x")],
        "flags": [("a", "odd"), ("a", V.SUPPORT_FLAGS[0])], "gold_flags": [("a", V.SUPPORT_FLAGS[0])],
        "gold_missing": [("a", "d1")], "missing": [("a", "d2")],
    }
    d = dims(spark, evidence=[("A", "x"), ("A", "y")])
    rows = metric_details(package(spark, **tables), d, ["M3", "M4", "M5", "M7", "M9", "M10"]).collect()
    got = {(r["case_id"], r["metric"], r["kind"], r["item"], r["part"], r["value"]) for r in rows}
    assert len(got) == len(rows)
    assert got >= {
        ("a", "M3", "missing_bylaw_ids", "B", None, None), ("a", "M3", "gold_count", None, None, 2.0), ("b", "M3", "gold_count", None, None, 0.0),
        ("a", "M4", "invalid_ids", "X", None, None), ("a", "M4", "invalid_ids", "ZZ-9", None, None), ("a", "M5", "per_bylaw_scores", "A", None, 0.5),
        ("a", "M5", "per_bylaw_scores", "B", None, 1.0), ("a", "M5", "missing_evidence", "A", "y", None), ("a", "M5", "gold_bylaw_count", None, None, 3.0),
        ("a", "M7", "omitted_missing", "d1", None, None), ("a", "M7", "unexpected_missing", "d2", None, None), ("a", "M7", "set_match", None, None, 0.0),
        ("a", "M9", "broken_cross_refs", "Gaps", None, None), ("b", "M9", "memo_sections_missing", "Evidence", None, None),
        ("a", "M9", "invalid_memo_bylaw_ids", "ZZ-9", None, None), ("a", "M10", "dropped_for_taxonomy", "odd", None, None),
        ("a", "M10", "intersection_count", None, None, 1.0),
    }


def test_details_make_an_item_table_once(spark, monkeypatch):
    calls = []
    fold = M._fold
    monkeypatch.setattr(M, "_fold", lambda *a: calls.append(a[1]) or fold(*a))
    p = package(spark, gold_bylaws=[("c1", "AB-1")], cited=[("c1", 0, "AB-2")], runtime=[("c1", "x", True, "per AB-3", "")])
    metric_details(p, M.Dimensions(corpus=spark.createDataFrame([("AB-1",)], "bylaw_id string")), ["M3", "M4", "M9"])
    assert len(calls) == 1


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_sections_are_ranked_twice_at_most(spark):
    """the ranks of all headings were worked out again for every heading."""
    rows = spark.createDataFrame([(["A", "B"],), (["B", "A"],), (["A", "x", "A", "B"],), (["A"],), (["A", "B", "A"],), ([],), (None,)], "h array<string>")
    out = rows.select(S.sections_in_order(F.col("h"), ["A", "B"]).alias("ok"))
    assert [r["ok"] for r in out.collect()] == [True, False, True, False, False, False, None]
    assert optimized(out).count("array_position") <= 2


def test_gaps_are_folded_by_hash_and_numbers_are_read_once(spark):
    """rows of gaps were sorted for their last report, packet numbers read once per side."""
    from plumbline.suite.scoring import dimensions, package

    root = "/root/testdata/sf0.001"
    items = M.gap_items(M.read_by(package(spark, root), ["M6"]), dimensions(spark, root))
    assert "SortAggregate" not in items._jdf.queryExecution().executedPlan().toString()
    assert optimized(items).count("Aggregate [l_orderkey") <= 2


def test_citations_of_redlines_need_no_check_of_fields(spark):
    """M4 joined redlines with packet numbers and read the texts once for each."""
    from plumbline.suite.scoring import package

    items = M.bylaw_items(M.read_by(package(spark, "/root/testdata/sf0.001"), ["M4"]))
    plan = optimized(items)
    assert "l_suppkey % 13" not in plan and "min(" not in plan.replace("partial_", "")
    assert plan.count("Generate") == 1


def test_hashed_join_keeps_rows_and_columns(spark):
    """sorts compared ids that all begin alike."""
    from plumbline.operators.joins import hashed_join

    left = spark.createDataFrame([("case-1", 0, "a"), ("case-1", 1, "b"), ("case-2", 0, "c"), (None, 0, "d")], "case_id string, seq int, x string")
    right = spark.createDataFrame([("case-1", 0, 1.0), ("case-1", 0, 2.0), (None, 0, 3.0), ("case-3", 0, 4.0)], "case_id string, seq int, score double")
    got, want = hashed_join(left, right, ["case_id", "seq"], "left"), left.join(right, ["case_id", "seq"], "left")
    assert got.columns == want.columns and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
