"""Documents to scores: nested JSON lines written from the tables, read strictly, scored and aggregated."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.parts import cut, parts_of
from plumbline.plans.evaluate import CASE_SCHEMA, RUNTIME_SCHEMA, evaluate
from plumbline.session import shuffles_freed, work_dir
from plumbline.sources.jsonl import read_jsonl_strict
from plumbline.suite.registry import load, query
from plumbline.suite.scoring import DET_SQL, PART_SQL, SCORE_JOIN, SCORE_SQL, dimensions


def listed(source: str, item: str, order: str) -> str:
    """(case_id, x): the items of a case as an array in a fixed order."""
    rows = f"array_sort(collect_list(struct({order} as o, {item} as x)))"
    return f"(select case_id, transform({rows}, e -> e.x) as x from {source} group by case_id)"


def nested(base: str, columns: str, lists: dict[str, str]) -> str:
    joins = " ".join(f"left join {sql} j{i} on j{i}.case_id = b.case_id" for i, sql in enumerate(lists.values()))
    picked = ", ".join(f"j{i}.x as {name}" for i, name in enumerate(lists))
    return f"select b.case_id, {columns}, {picked} from {base} b {joins}"


CASES = nested("fx_case", "b.domain, b.split, b.pathway_class, b.gold_stage1_complete", {
    "application_packet": f"(select case_id, map_from_entries(x) as x from {listed('fx_packet_number', 'struct(field, value)', 'field')})",
    "bylaws_to_cite": listed("fx_gold", "bylaw_id", "pos"),
    "expected_gap_ids": listed("fx_gold_gap", "gap_id", "gap_id"),
    "stage1_missing": listed("fx_gold_missing", "document_id", "document_id"),
    "expected_applicant_support_flags": listed("fx_gold_flag", "flag", "flag"),
})
EVIDENCE = "(select case_id, bylaw_id, array_sort(collect_list(evidence_key)) as keys from fx_evidence group by 1, 2)"
PAYLOADS = nested("fx_runtime", "b.predicted_pathway, b.stage1_complete, b.memo_markdown, b.letter_markdown", {
    "cited_bylaw_ids": listed("fx_cited", "bylaw_id", "seq"),
    "evidence_fields_by_bylaw": f"(select case_id, map_from_entries(x) as x from {listed(EVIDENCE, 'struct(bylaw_id, keys)', 'bylaw_id')})",
    "reported_numeric_gaps": listed("fx_reported_gap", "struct(gap_id, proposed_value, required_value, delta)", "seq"),
    "stage1_missing": listed("fx_missing", "document_id", "document_id"),
    "applicant_support_flags": listed("fx_flag", "flag", "flag"),
    "redlines": listed("fx_redline", "struct(field, addresses_gap, cited_bylaw_id)", "seq"),
})
LABELS = ("bylaws_to_cite", "expected_gap_ids", "stage1_missing", "expected_applicant_support_flags")


def inputs_by_part(spark: SparkSession, root: str) -> list[dict[str, DataFrame]]:
    """The inputs of the documents for each part of the cases; none are given where all cases are taken at once."""
    parts = parts_of(load(spark, root, "fx_case"))
    if parts == 1:
        return [{}]
    dealt = {name: cut(load(spark, root, name), parts, name) for name in sorted(set(re.findall(r"\bfx_\w+", CASES + PAYLOADS)))}
    return [{name: rows[i] for name, rows in dealt.items()} for i in range(parts)]


@query("evaluate_documents", f"{SCORE_SQL} select sM1.case_id, {DET_SQL} as deterministic_prqs, {PART_SQL} as partial_full_prqs_lower_bound {SCORE_JOIN}")
def evaluate_documents(spark: SparkSession, root: str) -> DataFrame:
    """Every case and payload as a JSON document, through the strict reader and the whole evaluation."""
    labels = F.struct(*LABELS, F.col("gold_stage1_complete").alias("stage1_complete")).alias("gold_labels")
    folders = work_dir(spark, "cases"), work_dir(spark, "payloads")
    for given in inputs_by_part(spark, root):
        with shuffles_freed(spark):
            cases = load(spark, root, CASES, given).select("case_id", "domain", "split", "pathway_class", "application_packet", labels)
            cases.write.mode("append").json(folders[0], compression="gzip")
            load(spark, root, PAYLOADS, given).write.mode("append").json(folders[1], compression="gzip")
    cases = read_jsonl_strict(spark, folders[0], CASE_SCHEMA).select("value.*")
    runtime = read_jsonl_strict(spark, folders[1], RUNTIME_SCHEMA).select(F.col("line_no").alias("seq"), "value.*")
    scores, _ = evaluate(cases, runtime, dimensions(spark, root))
    names = ("deterministic_prqs", "partial_full_prqs_lower_bound")
    return scores.select("case_id", *[F.round(n, 6).alias(n) for n in names])
