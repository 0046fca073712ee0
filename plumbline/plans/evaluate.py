"""From nested package documents to scores: explode once, then score the long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions import documents as D
from plumbline.operators.joins import reconcile
from plumbline.operators.metrics import (
    Dimensions, Package, require_valid, score_cases, with_composites,
)
from plumbline.operators.stats import split_aggregate
from plumbline.session import stored

GOLD_LABELS = (
    "struct<bylaws_to_cite:array<string>,evidence_to_surface:array<string>,expected_gap_ids:array<string>,"
    "expected_redlines_min:int,expected_redlines_max:int,stage1_complete:boolean,stage1_missing:array<string>,"
    "expected_applicant_support_flags:array<string>,reference_memo_ids:array<string>,reference_letter_ids:array<string>,"
    "derivation_source:string,label_confidence:double,label_review_status:string>"
)
CASE_SCHEMA = (
    "case_id string, domain string, split string, address_stub string, outcome_class string, pathway_class string,"
    "gap_severity_bucket string, edge_case_family string, application_packet string, content_fingerprint string,"
    "entity_fingerprint string, document_stub_fingerprints array<string>, scenario_fingerprint string, "
    f"gold_labels {GOLD_LABELS}"
)
RUNTIME_SCHEMA = (
    "case_id string, predicted_pathway string, predicted_outcome string, cited_bylaw_ids array<string>,"
    "evidence_fields_by_bylaw map<string,array<string>>,"
    "reported_numeric_gaps array<struct<gap_id:string,field:string,proposed_value:double,required_value:double,delta:double,unit:string>>,"
    "stage1_complete boolean, stage1_missing array<string>, applicant_support_flags array<string>, equity_notes array<string>,"
    "redlines array<struct<field:string,current_value:string,proposed_value:string,addresses_gap:string,cited_bylaw_id:string,rationale:string>>,"
    "memo_markdown string, letter_markdown string"
)


def packet_numbers(cases: DataFrame) -> DataFrame:
    """(case_id, field, value) of top-level JSON numbers of the packet; numeric text does not count."""
    entries = cases.select("case_id", F.explode(F.from_json("application_packet", "map<string,variant>")).alias("field", "v"))
    numeric = F.schema_of_variant("v").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return entries.filter(numeric).select("case_id", "field", F.try_variant_get("v", "$", "double").alias("value"))


def explode_package(cases: DataFrame, runtime: DataFrame) -> Package:
    """Nested case and payload documents to the long tables of the metrics.

    Arrays of one document are bounded by its size, so every step is a narrow projection; only the redlines
    meet their packet through one equi-join on the case.
    """
    def items(df: DataFrame, array: str, name: str, position: str | None = None) -> DataFrame:
        if position:
            return df.select("case_id", F.posexplode(array).alias(position, name))
        return df.select("case_id", F.explode(array).alias(name))

    evidence = runtime.select("case_id", F.explode("evidence_fields_by_bylaw").alias("bylaw_id", "keys")).select(
        "case_id", "bylaw_id", F.explode_outer("keys").alias("evidence_key")
    )
    gaps = runtime.select("case_id", F.posexplode("reported_numeric_gaps").alias("seq", "g")).select("case_id", "seq", "g.*")
    redlines = (
        # joined before they are exploded: a packet travels once, and the redlines of a case stay neighbours
        runtime.filter(F.size("redlines") > 0).select("case_id", "redlines")
        .join(cases.select("case_id", "application_packet"), "case_id")
        .select("case_id", "application_packet", F.posexplode("redlines").alias("seq", "r"))
        .select("case_id", "application_packet", "seq", "r.field", "r.addresses_gap", "r.cited_bylaw_id")
        .withColumn("field_exists", D.json_path_exists("application_packet", "field"))
        .drop("application_packet", "field")
    )
    return Package(
        cases=cases.select("case_id", "domain", "split", "pathway_class", F.col("gold_labels.stage1_complete").alias("gold_stage1_complete")),
        runtime=runtime.select("case_id", "predicted_pathway", "stage1_complete", "memo_markdown", "letter_markdown"),
        gold_bylaws=items(cases, "gold_labels.bylaws_to_cite", "bylaw_id"),
        cited=items(runtime, "cited_bylaw_ids", "bylaw_id", "seq"),
        evidence=evidence,
        gold_gaps=items(cases, "gold_labels.expected_gap_ids", "gap_id"),
        reported_gaps=gaps,
        packet_numbers=packet_numbers(cases),
        redlines=redlines,
        gold_missing=items(cases, "gold_labels.stage1_missing", "document_id"),
        missing=items(runtime, "stage1_missing", "document_id"),
        gold_flags=items(cases, "gold_labels.expected_applicant_support_flags", "flag"),
        flags=items(runtime, "applicant_support_flags", "flag"),
    )


def evaluate(cases: DataFrame, runtime: DataFrame, dims: Dimensions, strict: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(per-case scores, split aggregate). Strict: both sides must hold the same ids, scores must be in range.

    ``runtime`` needs ``seq``; of several payloads for one case the last counts.
    """
    # written once, so that the many readers of a document do not parse and match it again
    cases, runtime = stored(cases, "parsed-cases"), stored(runtime, "parsed-payloads")
    ids = runtime.groupBy("case_id").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("copies"))
    pairs, report = reconcile(cases.select("case_id"), ids)
    found = report.first()
    if strict and not found["matched"]:
        raise ValueError(
            f"missing payload for {found['missing_count']} case(s) {found['missing_first']}, "
            f"{found['extra_count']} extra payload(s) {found['extra_first']}"
        )
    if found["extra_count"] or not pairs.filter("copies > 1").isEmpty():
        matched = stored(reconcile(cases.select("case_id"), runtime)[0], "matched-payloads")
    else:
        matched = runtime.drop("seq")
    scores = score_cases(explode_package(cases, matched), dims)
    if strict:
        scores = require_valid(scores, V.METRICS)
    scores = stored(with_composites(scores), "scores")
    return scores, split_aggregate(scores, V.METRICS, **options)
