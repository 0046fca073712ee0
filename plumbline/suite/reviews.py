"""Review packages over packets derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import review as P
from plumbline.suite.registry import load, query

# Document flags of the packet and what they stand for.
DOCUMENT_FLAGS = {
    "d0": "arch-set-v2", "d1": "site-survey-bcls", "d2": "energy-report", "d3": "tree-assessment",
    "d4": "form-1-owner-consent", "d5": "neighbour-notification", "d6": "heritage-conservation-plan",
}


def packets(spark: SparkSession, root: str) -> DataFrame:
    have = F.array_compact(F.array(*[F.when(F.col(c) == 1, d) for c, d in DOCUMENT_FLAGS.items()]))
    gone = F.array_compact(F.array(*[F.when(F.col(c) == 0, d) for c, d in DOCUMENT_FLAGS.items()]))
    return load(spark, root, "fx_packet").withColumns({"submitted_documents": have, "missing_documents": gone})


PATHWAY_SQL = """case when heritage_overlay then 'heritage' when floodplain_overlay then 'floodplain' when tod_overlay then 'tod-overlap'
   when zoning_district = 'R1-1' and units_proposed <= 6 then 'as-of-right-ssmuh' else 'discretionary' end"""
QUEUE_SQL = "heritage_overlay or floodplain_overlay or tod_overlay"
GAP_ROWS = """
 g as (select case_id, 1 as pos, 'GAP-FSR' as gap_id, 'fsr_proposed' as field, 'ratio' as unit, fsr_proposed as provided, fsr_allowed as required from fx_packet where fsr_proposed > fsr_allowed
   union all select case_id, 2, 'GAP-REAR-SETBACK', 'rear_setback_m', 'm', rear_setback_m, rear_setback_required_m from fx_packet where rear_setback_m < rear_setback_required_m
   union all select case_id, 3, 'GAP-SIDE-SETBACK', 'side_setback_m', 'm', side_setback_m, side_setback_required_m from fx_packet where side_setback_m < side_setback_required_m
   union all select case_id, 4, 'GAP-HEIGHT', 'height_proposed_m', 'm', height_proposed_m, height_allowed_m from fx_packet where height_proposed_m > height_allowed_m
   union all select case_id, 5, 'GAP-PARKING', 'parking_spaces_proposed', 'spaces', parking_spaces_proposed, parking_spaces_required from fx_packet where parking_spaces_proposed < parking_spaces_required),
 n as (select p.*, (select count(*) from g where g.case_id = p.case_id) as gaps from fx_packet p)"""
MISSING_SQL = """list_concat(list_filter(['form-1-owner-consent', 'site-survey-bcls', 'energy-report', 'tree-assessment', 'neighbour-notification'],
   lambda x: not list_contains(list_filter([case when d4 = 1 then 'form-1-owner-consent' end, case when d1 = 1 then 'site-survey-bcls' end, case when d2 = 1 then 'energy-report' end,
     case when d3 = 1 then 'tree-assessment' end, case when d5 = 1 then 'neighbour-notification' end], lambda y: y is not null), x)),
   case when heritage_overlay and d6 = 0 then ['heritage-conservation-plan'] else [] end)"""


@query("review_pathway", f"""
 select case_id, {PATHWAY_SQL} as pathway, case when heritage_overlay then 0.92 when floodplain_overlay then 0.9 when tod_overlay then 0.85
     when zoning_district = 'R1-1' and units_proposed <= 6 then 0.95 else 0.6 end as confidence,
   case when {QUEUE_SQL} then 'specialist-queue' else 'staff-pre-review' end as routing from fx_packet""")
def review_pathway(spark: SparkSession, root: str) -> DataFrame:
    return P.review_packages(packets(spark, root), "pathway").select("case_id", "pathway.pathway", "pathway.confidence", "pathway.routing")


@query("review_bylaws", """
 with b as (select case_id, unnest(list_filter(['ZDB-R1-1-FSR', 'ZDB-R1-1-REAR-SETBACK', 'ZDB-R1-1-PARKING', 'ZDB-R1-1-HEIGHT', 'BC-STEP-CODE-3',
     case when heritage_overlay then 'VAN-HERITAGE-PROCEDURE' end, 'VAN-TREE-BYLAW', 'SSMUH-DESIGN-GUIDELINES'], lambda x: x is not null)) as bylaw_id from fx_packet)
 select bylaw_id, count(*) as n from b group by 1""")
def review_bylaws(spark: SparkSession, root: str) -> DataFrame:
    rows = P.review_packages(packets(spark, root), "bylaws").select(F.explode("bylaws.bylaw_id").alias("bylaw_id"))
    return rows.groupBy("bylaw_id").agg(F.count(F.lit(1)).alias("n"))


@query("review_bylaw_reasons", """
 select case_id, printf('Applicant proposes FSR %.2f against allowed %.2f.', fsr_proposed, fsr_allowed) as fsr_reason,
   concat('Applicant proposes Step ', cast(energy_step_code_proposed::int as string), '; required ≥ Step ', cast(energy_step_code_required::int as string), '.') as step_reason from fx_packet""")
def review_bylaw_reasons(spark: SparkSession, root: str) -> DataFrame:
    rows = P.review_packages(packets(spark, root), "bylaws")
    why = lambda i: F.filter("bylaws", lambda b: b["bylaw_id"] == i)[0]["why_relevant"]
    return rows.select("case_id", why("ZDB-R1-1-FSR").alias("fsr_reason"), why("BC-STEP-CODE-3").alias("step_reason"))


@query("review_ledger", f"""
 with {GAP_ROWS} select case_id, gap_id, field, unit, provided, required, round(provided - required, 3) as delta from g""")
def review_ledger(spark: SparkSession, root: str) -> DataFrame:
    rows = P.review_packages(packets(spark, root), "numeric_gaps").select("case_id", F.inline("numeric_gaps"))
    return rows.drop("bylaw_id")


@query("review_evidence", """
 select case_id, 'fsr_proposed' as field, d0 = 1 as present from fx_packet union all select case_id, 'rear_setback_m', d1 = 1 from fx_packet union all
 select case_id, 'energy_step_code_proposed', d2 = 1 from fx_packet union all select case_id, 'tree_assessment', d3 = 1 from fx_packet union all
 select case_id, 'neighbour_notification', d5 = 1 from fx_packet""")
def review_evidence(spark: SparkSession, root: str) -> DataFrame:
    return P.review_packages(packets(spark, root), "document_evidence").select("case_id", F.inline("document_evidence")).select("case_id", "field", "present")


@query("review_redlines", f"""
 with {GAP_ROWS}, r as (select *, row_number() over (partition by case_id order by pos) as i from g)
 select case_id, concat('RL-', cast(i as string)) as redline_id, gap_id as addresses_gap, field,
   case when unit = 'spaces' then concat(cast(provided::int as string), ' spaces') else concat(printf('%.2f', provided), ' ', unit) end as current_value,
   case unit when 'spaces' then concat(cast(required::int as string), ' spaces') when 'ratio' then printf('%.2f', required) else printf('%.2f m', required) end as proposed_value from r""")
def review_redlines(spark: SparkSession, root: str) -> DataFrame:
    rows = P.review_packages(packets(spark, root), "redlines").select("case_id", F.inline("redlines"))
    return rows.drop("bylaw_citation", "rationale")


@query("review_completeness", f"""
 with m as (select *, {MISSING_SQL} as gone from fx_packet)
 select case_id, len(gone) = 0 as stage1_complete, array_to_string(gone, ',') as stage1_missing,
   array_to_string(list_filter([case when applicant_type = 'owner-builder' and prior_permits = 0 then 'first-time-applicant' end, case when len(gone) >= 2 then 'multi-gap-letter-needed' end,
     case when {QUEUE_SQL} then 'specialist-handoff-needed' end], lambda x: x is not null), ',') as flags, case when language_preference <> 'en' then 1 else 0 end as notes from m""")
def review_completeness(spark: SparkSession, root: str) -> DataFrame:
    c = P.review_packages(packets(spark, root), "completeness")
    return c.select(
        "case_id", "completeness.stage1_complete", F.array_join("completeness.stage1_missing", ",").alias("stage1_missing"),
        F.array_join("completeness.applicant_support_flags", ",").alias("flags"), F.size("completeness.equity_notes").alias("notes"),
    )


@query("review_verdict", f"""
 with {GAP_ROWS}
 select case_id, case when {QUEUE_SQL} then 'COMPLEX-REQUIRES-SPECIALIST' when gaps = 0 and len({MISSING_SQL}) = 0 then 'READY-FOR-DETAILED-REVIEW' else 'NEEDS-CLARIFICATION' end as verdict from n""")
def review_verdict(spark: SparkSession, root: str) -> DataFrame:
    return P.review_packages(packets(spark, root), "verdict").select("case_id", "verdict")


@query("review_stages", f"""
 with {GAP_ROWS}, m as (select *, {MISSING_SQL} as gone from n),
 s as (select case_id, case when {QUEUE_SQL} then 'warn' else 'ok' end as s1, case when gaps = 0 then 'ok' when gaps >= 3 then 'block' else 'warn' end as s3, case when gaps = 0 then 'ok' else 'warn' end as s4,
   case when len(gone) > 0 then 'block' when ({QUEUE_SQL}) or (applicant_type = 'owner-builder' and prior_permits = 0) then 'warn' else 'ok' end as s5 from m)
 select case_id, 'scope-pathway-classifier' as agent_id, s1 as status from s union all select case_id, 'bylaw-retriever', 'ok' from s union all
 select case_id, 'compliance-evidence-compiler', s3 from s union all select case_id, 'redline-generator', s4 from s union all
 select case_id, 'completeness-applicant-support-auditor', s5 from s union all select case_id, 'pre-review-memo-writer', 'ok' from s""")
def review_stages(spark: SparkSession, root: str) -> DataFrame:
    return P.review_packages(packets(spark, root), "stages").select("case_id", F.inline("stages")).drop("summary")


@query("review_memo_head", f"""
 with {GAP_ROWS}
 select case_id, concat_ws(chr(10), concat('# ', case_id), concat('address: ', address_stub), concat('zoning: ', zoning_district), concat('project: ', project_type),
     concat('units: ', cast(units_proposed::int as string)), concat('lot_sqm: ', cast(lot_area_sqm::int as string)), concat('applicant: ', applicant_type),
     concat('prior_permits: ', cast(prior_permits as string))) as head,
   (select count(*) from g where g.case_id = n.case_id) + 2 * (select count(*) from g where g.case_id = n.case_id) as gap_mentions from n""")
def review_memo_head(spark: SparkSession, root: str) -> DataFrame:
    """PL7: the memo's first block, and how often it names a gap (once in the ledger, twice with its redline)."""
    rows = P.review_packages(packets(spark, root))
    gaps = F.regexp_count("memo", F.lit("(?m)^- GAP-")) + 2 * F.regexp_count("memo", F.lit("(?m)^- RL-"))
    return rows.select("case_id", F.split("memo", "\nverdict: ")[0].alias("head"), gaps.alias("gap_mentions"))


@query("review_letter_asks", f"""
 with {GAP_ROWS}, m as (select *, {MISSING_SQL} as gone from n)
 select case_id, gaps + len(gone) as asks, applicant_type = 'owner-builder' and prior_permits = 0 as welcomes, gaps = 0 and len(gone) = 0 as clean from m""")
def review_letter_asks(spark: SparkSession, root: str) -> DataFrame:
    rows = P.review_packages(packets(spark, root))
    return rows.select(
        "case_id", F.regexp_count("letter", F.lit("(?m)^- ")).alias("asks"), F.col("letter").contains("first-time-applicant").alias("welcomes"),
        (F.regexp_count("letter", F.lit("(?m)^- ")) == 0).alias("clean"),
    )


def envelope_part(label: str, field: str, limit: str | None, mode: str) -> str:
    if limit is None:
        return f"select case_id, '{label}' as measure, {field} as proposed, cast(null as double) as \"limit\", 'neutral' as status, cast(null as double) as delta, 100.0 as fill_percent from fx_packet"
    side = f"when {field} > {limit} then 'over'" if mode == "max" else f"when {field} < {limit} then 'under'"
    fill = f"greatest(floor(least({field} / {limit}, 1.0) * 100 + 0.5), case when {field} > 0 then 6 else 0 end)"
    return f"select case_id, '{label}', {field}, {limit}, case {side} else 'neutral' end, round({field} - {limit}, 9), case when {limit} <= 0 then 100 else {fill} end from fx_packet"


@query("numeric_envelope", " union all ".join(envelope_part(*row) for row in P.ENVELOPE))
def numeric_envelope(spark: SparkSession, root: str) -> DataFrame:
    return P.numeric_envelope(packets(spark, root)).withColumn("delta", F.round("delta", 9))
