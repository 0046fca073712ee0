"""AG12, UD4: all assertions over all pools, and again with other bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions import scalar as S
from plumbline.operators import governance as G
from plumbline.plans.validate import NEEDS, Pools, validate
from plumbline.suite import governance as Q
from plumbline.suite.inputs import case_key
from plumbline.suite.registry import ORACLES, load, query, with_inputs

LINES = """
 select concat('line-', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as id, concat('part-', cast(l_partkey % 3 as string)) as path,
   l_orderkey * 1000 + row_number() over (partition by l_partkey % 3, l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as line
 from lineitem"""
RULES = "select distinct lower(p_type) as domain, concat('RULE-', p_brand) as rule_id from part"
KNOWN_EVIDENCE = """select distinct c.domain, m.bylaw_id from fx_cited x join fx_case c on c.case_id = x.case_id
   join fx_evidence_map m on m.bylaw_id = x.bylaw_id where c.domain <> 'household'"""
KNOWN_GAPS = """select distinct c.domain, t.gap_id from fx_reported_gap r join fx_case c on c.case_id = r.case_id
   join fx_truth t on t.gap_id = r.gap_id where c.domain <> 'building'"""
OUTPUTS = """select case_id, domain, concat('memo-', cast(ck % 40 as string)) as output from fx_case
   union all select case_id, domain, concat('letter-', cast(k % 30 as string)) from fx_case"""
KNOWN_OUTPUTS = """select distinct domain, concat('memo-', cast(ck % 37 as string)) as output from fx_case
   union select distinct domain, concat('letter-', cast(ck % 28 as string)) from fx_case where domain <> 'furniture'"""
DISCOVERED = "select case_id from fx_case where k % 11 <> 0"


def pools(spark: SparkSession, root: str) -> Pools:
    t = lambda statement: load(spark, root, statement)
    c = F.col
    sha = lambda table, key, column: t(table).select(c(key).alias(column), S.prefixed_sha256(c("text")).alias("content_fingerprint"))
    entity = S.entity_fingerprint(c("applicant_type"), F.when(c("ck") % 2 == 1, "ACME"), c("address_stub"), (300 + c("ck") % 400).cast("double"), (1 + c("k") % 3).cast("double"))
    stubs = t(f"select {case_key('l_orderkey')} as case_id, concat(cast(l_partkey as string), '/', cast(cast(l_quantity as int) as string)) as stub from lineitem")
    sealed = t("pages").select(c("url").alias("path"), "page_id", S.prefixed_sha256(c("html")).alias("sha256"))
    return Pools(
        cases=t("fx_case"), case_documents=t(Q.CASE_DOCUMENTS[0]), few_shot_documents=t(Q.FEW_SHOT_DOCUMENTS[0]), id_lines=t(LINES),
        content_references=G.fingerprint_references(sha("documents", "doc_id", "case_id"), sha("benchmark", "item_id", "few_shot_id"), "content_fingerprint"),
        entity_references=G.fingerprint_references(t("fx_case").select("case_id", entity.alias("entity_fingerprint")), None, "entity_fingerprint"),
        stub_references=G.fingerprint_references(stubs.select("case_id", F.array(S.prefixed_sha256(c("stub"))).alias("document_stub_fingerprints")), None, "document_stub_fingerprints"),
        scenarios=t("fx_scenario_coarse"), few_shots=Q.few_shots(spark, root), cited_bylaws=t(Q.CITED_IN_DOMAIN), known_bylaws=t(Q.DOMAIN_CORPUS),
        receipts=t("select concat('d', cast(page_id % 7 as string)) as domain, array(concat('datasets/policy-corpus/', case when page_id % 10 = 3 then 'oracle/' else 'public/' end, cast(page_id as string))) as indexed_paths from pages"),
        diversity_cases=t(Q.LOPSIDED_CASES), corpus_files=t(Q.FILES_SQL), rules=t(RULES), register=t(f"{RULES} where p_size > 48"),
        named_outputs=t(OUTPUTS), known_outputs=t(KNOWN_OUTPUTS), needed_evidence=t(Q.CITED_IN_DOMAIN), known_evidence=t(KNOWN_EVIDENCE),
        named_gaps=t(Q.GAPS_IN_DOMAIN), known_gaps=t(KNOWN_GAPS), flags=t("fx_flag"), manifest=t(Q.MANIFEST_SQL), manifest_counts=t(Q.COUNTS_SQL), discovered=t(DISCOVERED),
        split_sizes=t("select domain, split, count(*) as n from fx_case group by domain, split"), listing=t(Q.LISTING), sealed_cases=t(Q.ONE_SIDED_CASES),
        sealed_receipt=sealed.select("path", F.when(c("page_id") % 7 == 2, "sha256:0").otherwise(c("sha256")).alias("sha256")),
        sealed_files=sealed.filter("page_id % 9 <> 4").select("path", "sha256"),
    )


# what is violated is stated by the query of each assertion; here only its rows are counted
STATED = {
    "A01": "a01_case_documents", "A02": "a02_few_shot_documents", "A03": "a03_duplicate_ids", "A04": "a04_content_collisions", "A05": "a05_entity_collisions",
    "A06": "a06_document_stub_collisions", "A07": "a07_copied_scenarios", "A08": "a08_few_shot_leakage", "A09": "a09_review_status", "A10": "a10_unknown_bylaws",
    "A11": "a11_oracle_not_indexed", "A12": "a12_diversity", "A13": "a13_corpus_fields", "A14": "a14_rule_register", "A15": "a15_reference_outputs",
    "A16": "a16_evidence_coverage", "A18": "a18_orphan_gaps", "A19": "a19_flag_taxonomy", "A20": "a20_manifest", "A22": "a22_sealed_hygiene",
    "A23": "a23_receipt_mismatches", "A24": "a24_sealed_diversity",
}
A21_SQL = with_inputs(f"""
 with m as (select distinct case_id from ({Q.MANIFEST_SQL})), d as ({DISCOVERED})
 select coalesce(m.case_id, d.case_id) as case_id from m full outer join d on m.case_id = d.case_id where m.case_id is null or d.case_id is null""")


def counted(statements: dict[str, str]) -> str:
    return " union all ".join(f"select '{a}' as assertion, (select count(*) from ({sql})) as violations" for a, sql in statements.items())


ALL_SQL = counted({**{a: ORACLES[name] for a, name in STATED.items()}, "A21": A21_SQL})


@query("validation_of_all_pools", f"select assertion, case when violations > 0 then 'failed' else 'passed' end as status, violations from ({ALL_SQL})")
def validation_of_all_pools(spark: SparkSession, root: str) -> DataFrame:
    """AG12: all 23 assertions."""
    return validate(pools(spark, root)).select("assertion", "status", "violations")


#: Other bounds than the protocol's: twice the tolerance between generators, a wider band of edge cases.
WIDE = {**V.BOUNDS, "edge_ratio": (0.05, 0.6), "generator_tolerance": 2 * V.BOUNDS["generator_tolerance"]}
WIDE_SQL = counted({
    "A12": with_inputs(f"""with pool as ({Q.LOPSIDED_CASES}) {Q.shares_sql('pool', "split <> 'gold-holdout'",
        {'outcome': ('outcome_class', WIDE['outcome']), 'applicant': ('applicant_type', WIDE['applicant'])}, True, WIDE)}"""),
    "A24": with_inputs(f"""with pool as ({Q.ONE_SIDED_CASES}), big as (select domain, split from pool group by 1, 2 having count(*) >= 10),
        sized as (select pool.* from pool join big using (domain, split)) {Q.shares_sql('sized', 'true', {'outcome': ('outcome_class', WIDE['outcome'])}, False, WIDE)}"""),
})


@query("validation_with_other_bounds", f"""
 with w as ({WIDE_SQL}), n as (select unnest([{", ".join(f"'{a}'" for a in NEEDS)}]) as assertion)
 select n.assertion, case when violations > 0 then 'failed' when w.assertion is null then 'skipped' else 'passed' end as status, coalesce(violations, 0) as violations
 from n left join w on w.assertion = n.assertion""")
def validation_with_other_bounds(spark: SparkSession, root: str) -> DataFrame:
    """UD4: the caller's bounds; assertions without their pools are skipped."""
    some = Pools(diversity_cases=load(spark, root, Q.LOPSIDED_CASES), sealed_cases=load(spark, root, Q.ONE_SIDED_CASES))
    return validate(some, WIDE).select("assertion", "status", "violations")
