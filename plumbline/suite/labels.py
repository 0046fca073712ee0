"""Rule evaluation, labels, fingerprints, sampling, and scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions import documents as D
from plumbline.functions import scalar as S
from plumbline.operators import labels as L
from plumbline.suite.registry import load, query

# --- rules -------------------------------------------------------------------------------------------------------------

# (rule, condition, citations, evidence, gap)
RULES = [
    ("R-01", "fsr_proposed > 1.0", ["B-FSR"], ["fsr_proposed", "lot_area_sqm"], "gap-fsr-over"),
    ("R-02", "rear_setback_m_proposed < 7.6", ["B-REAR"], ["rear_setback_m_proposed"], "gap-rear-setback-short"),
    ("R-03", "side_setback_m_proposed < 1.2", ["B-SIDE"], ["side_setback_m_proposed"], "gap-side-setback-short"),
    ("R-04", "informational front setback check: below 6.1 m when given", ["B-FRONT"], ["zoning_district"], "gap-front-setback-short"),
    ("R-05", "height_m_proposed > 11.5", ["B-HEIGHT"], ["height_m_proposed"], "gap-height-over"),
    ("R-06", "units_proposed > 4", ["B-UNITS"], ["units_proposed"], "gap-units-over"),
    ("R-07", "parking_spaces_proposed < units_proposed", ["B-PARK", "B-UNITS"], ["parking_spaces_proposed"], "gap-parking-short"),
    ("R-08", "energy_step_code_proposed < 3", ["B-STEP"], ["energy_step_code_proposed"], "gap-energy-step-low"),
    ("R-09", "tree-assessment is in missing_documents and tree_inventory_count > 0", ["B-TREE"], ["tree_inventory_count"], "gap-tree-assessment-missing"),
    ("R-10", "neighbour-notification is in missing_documents", ["B-UNITS"], ["neighbour-notification"], "gap-neighbour-notification-missing"),
    ("R-11", "energy-compliance-report is not in submitted_documents", ["B-STEP"], ["energy-compliance-report"], "gap-energy-report-missing"),
    ("R-12", "architectural-set is not in submitted_documents", ["B-PART9"], ["architectural-set"], "gap-architectural-set-missing"),
    ("R-13", "something no one can check", ["B-X"], ["x"], "gap-x"),
]
GRID = """
 select case_id, domain, k, ck, cast(70 + ck % 60 as double) / 100 as fsr_proposed, cast(60 + k % 30 as double) / 10 as rear_setback_m_proposed,
   cast(9 + ck % 6 as double) / 10 as side_setback_m_proposed, case when k % 3 = 0 then cast(50 + ck % 30 as double) / 10 end as front_setback_m_proposed,
   cast(100 + k % 40 as double) / 10 as height_m_proposed, cast(1 + k % 7 as double) as units_proposed, cast(ck % 8 as double) as parking_spaces_proposed,
   cast(1 + ck % 5 as double) as energy_step_code_proposed, cast(k % 2 as double) as tree_inventory_count,
   k % 4 = 0 as no_tree, ck % 5 = 0 as no_notice, ck % 3 <> 0 as has_report, k % 5 <> 0 as has_set from fx_case"""
MATCH_SQL = " union all ".join([
    "select case_id, 'R-01' as rule_id from g where fsr_proposed > 1.0", "select case_id, 'R-02' from g where rear_setback_m_proposed < 7.6",
    "select case_id, 'R-03' from g where side_setback_m_proposed < 1.2", "select case_id, 'R-04' from g where front_setback_m_proposed < 6.1",
    "select case_id, 'R-05' from g where height_m_proposed > 11.5", "select case_id, 'R-06' from g where units_proposed > 4",
    "select case_id, 'R-07' from g where parking_spaces_proposed < units_proposed", "select case_id, 'R-08' from g where energy_step_code_proposed < 3",
    "select case_id, 'R-09' from g where no_tree and tree_inventory_count > 0", "select case_id, 'R-10' from g where no_notice",
    "select case_id, 'R-11' from g where not has_report", "select case_id, 'R-12' from g where not has_set",
])
GRID_FACTS = [
    "fsr_proposed", "rear_setback_m_proposed", "side_setback_m_proposed", "front_setback_m_proposed", "height_m_proposed",
    "units_proposed", "parking_spaces_proposed", "energy_step_code_proposed", "tree_inventory_count",
]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, condition string, bylaw_ids array<string>, evidence_keys array<string>, emits_gap string")


def grid_cases(spark: SparkSession, root: str) -> DataFrame:
    entry = [F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in GRID_FACTS]
    chosen = lambda *pairs: F.array_compact(F.array(*[F.when(test, name) for test, name in pairs]))
    return load(spark, root, GRID).withColumns({
        "facts": F.map_from_entries(F.filter(F.array(*entry), lambda e: e["value"].isNotNull())),
        "missing_documents": chosen((F.col("no_tree"), "tree-assessment"), (F.col("no_notice"), "neighbour-notification")),
        "submitted_kinds": chosen((F.col("has_report"), "energy-compliance-report"), (F.col("has_set"), "architectural-set")),
    })


@query("rule_matches", f"with g as ({GRID}), m as ({MATCH_SQL}) select case_id, rule_id from m")
def rule_matches(spark: SparkSession, root: str) -> DataFrame:
    return L.matched_rules(grid_cases(spark, root), rules_table(spark)).select("case_id", "rule_id")


RULE_VALUES = ", ".join(f"('{r}', '{g}')" for r, _, _, _, g in RULES)
RULE_BYLAWS = ", ".join(f"('{r}', '{b}')" for r, _, bs, _, _ in RULES for b in bs)
RULE_KEYS = ", ".join(f"('{r}', '{e}')" for r, _, _, es, _ in RULES for e in es)
# B-UNITS and B-STEP also require keys of the evidence map.
EVIDENCE_MAP = [("B-UNITS", "units_proposed"), ("B-UNITS", "zoning_district"), ("B-STEP", "step-report")]


@query("derived_labels", f"""
 with g as ({GRID}), m as ({MATCH_SQL}), r(rule_id, gap) as (values {RULE_VALUES}), rb(rule_id, bylaw) as (values {RULE_BYLAWS}), rk(rule_id, key) as (values {RULE_KEYS}),
 em(bylaw, key) as (values {", ".join(str(e) for e in EVIDENCE_MAP)}),
 gaps as (select case_id, string_agg(distinct gap, ',' order by gap) as v, count(distinct gap) as n from m join r using (rule_id) group by 1),
 laws as (select distinct case_id, bylaw from m join rb using (rule_id)),
 keys as (select case_id, key from m join rk using (rule_id) union select case_id, key from laws join em using (bylaw)),
 ids as (select case_id, string_agg(distinct rule_id, '+' order by rule_id) as v from m group by 1)
 select g.case_id, coalesce((select string_agg(bylaw, ',' order by bylaw) from laws where laws.case_id = g.case_id), '') as bylaws, coalesce((select string_agg(key, ',' order by key) from keys
     where keys.case_id = g.case_id), '') as evidence, coalesce(gaps.v, '') as gaps, coalesce(gaps.n, 0) as redlines_min,
   case when coalesce(gaps.n, 0) = 0 then 0 else gaps.n + 2 end as redlines_max, not no_tree and not no_notice as stage1_complete,
   array_to_string(list_filter([case when no_notice then 'neighbour-notification' end, case when no_tree then 'tree-assessment' end], lambda x: x is not null), ',') as stage1_missing,
   concat('oracle-rule:', coalesce(ids.v, 'NO-GAP')) as source
 from g left join gaps on gaps.case_id = g.case_id left join ids on ids.case_id = g.case_id""")
def derived_labels(spark: SparkSession, root: str) -> DataFrame:
    evidence = spark.createDataFrame(EVIDENCE_MAP, "bylaw_id string, evidence_key string")
    out = L.derive_labels(grid_cases(spark, root), rules_table(spark), evidence)
    text = lambda c: F.array_join(c, ",")
    return out.select(
        "case_id", text("bylaws_to_cite").alias("bylaws"), text("evidence_to_surface").alias("evidence"), text("expected_gap_ids").alias("gaps"),
        F.col("expected_redlines_min").alias("redlines_min"), F.col("expected_redlines_max").alias("redlines_max"), "stage1_complete",
        text("stage1_missing").alias("stage1_missing"), F.col("derivation_source").alias("source"),
    )


@query("projected_facts", """
 select case_id, coalesce(case when ck % 3 = 0 then null when ck % 3 = 1 then ck % 50 end, case when k % 2 = 0 then k % 9 + 0.5 end, 1.0) as fsr_allowed,
   case when k % 5 = 0 then 11.5 else k % 20 end as height_m_max from fx_case""")
def projected_facts(spark: SparkSession, root: str) -> DataFrame:
    """RUL3: facts with aliases and defaults; text that is no number falls through."""
    grid = load(spark, root, """
        select case_id, case when ck % 3 = 0 then 'n/a' when ck % 3 = 1 then cast(ck % 50 as string) end as fsr_allowed,
          case when k % 2 = 0 then concat(' ', cast(k % 9 as string), '.5 ') end as fsr_cap, case when k % 5 <> 0 then k % 20 end as height_m_allowed from fx_case""")
    out = L.project_facts(
        grid, {"fsr_allowed": ["fsr_allowed", "fsr_cap"], "height_m_max": ["height_m_max", "height_m_allowed"]}, {"fsr_allowed": 1.0, "height_m_max": 11.5}
    )
    return out.select("case_id", "fsr_allowed", "height_m_max")


SCENARIO_ROWS = """
 select case_id, domain, outcome_class, gap_severity_bucket, applicant_type, edge_case_family, concat('R1-', cast(ck % 3 as string)) as zoning_district,
   cast(1 + k % 8 as double) as units_proposed, cast(300 + ck % 400 as double) + case when k % 2 = 0 then 0.5 else 0.0 end as lot_area_sqm,
   cast(k % 64 as double) / 64 as fsr_proposed, case when ck % 4 <> 0 then cast(ck % 32 as double) / 32 end as fsr_allowed,
   case when k % 7 <> 0 then cast(k % 80 as double) / 8 end as rear_setback_m_proposed, cast(null as double) as rear_setback_m_required,
   cast(ck % 24 as double) / 8 as side_setback_m_proposed, cast(1.5 as double) as side_setback_m_required, cast(k % 6 as double) as parking_spaces_proposed,
   case when ck % 2 = 0 then cast(2 as double) end as parking_spaces_required, cast(8 + k % 30 as double) / 2 as height_m_proposed, cast(null as double) as height_m_max,
   cast(ck % 5 as double) as energy_step_code_proposed, k % 4 = 0 as no_tree, ck % 5 = 0 as no_notice, address_stub, k from fx_case"""


def steps_sql(value: str, step: float, digits: int) -> str:
    r = f"(floor(({value}) / {step}::double + 0.5) * {step}::double)"
    return f"case when abs({r}) < 2.2e-16 then '0' when {r} > 0 then concat('+', printf('%.{digits}f', {r})) else printf('%.{digits}f', {r}) end"


SCENARIO_SQL = f"""concat('vec:zone=', zoning_district, '|units=', cast(units_proposed::int as string), '|lot=', cast((floor(lot_area_sqm / 50) * 50)::int as string), '-',
   cast((floor(lot_area_sqm / 50) * 50)::int + 49 as string), '|fsr=', {steps_sql("fsr_proposed - coalesce(fsr_allowed, 1::double)", 0.05, 2)},
   '|rear-setback=', {steps_sql("coalesce(rear_setback_m_proposed, 0::double) - 7.6::double", 0.1, 1)}, '|side-setback=', {steps_sql("side_setback_m_proposed - 1.5::double", 0.1, 1)},
   '|parking=', case when parking_spaces_proposed > coalesce(parking_spaces_required, units_proposed) then '+' else '' end,
   cast((parking_spaces_proposed - coalesce(parking_spaces_required, units_proposed))::int as string), '|height=', {steps_sql("height_m_proposed - 11.5::double", 0.5, 1)},
   '|energy-step=', cast(energy_step_code_proposed::int as string), '|stage1-missing=',
   case when no_notice and no_tree then 'neighbour-notification,tree-assessment' when no_notice then 'neighbour-notification' when no_tree then 'tree-assessment' else 'none' end,
   '|trap-families=', coalesce(edge_case_family, 'none'), '|outcome=', outcome_class, '|gap-severity=', gap_severity_bucket, '|applicant-type=', applicant_type)"""


def scenario_rows(spark: SparkSession, root: str) -> DataFrame:
    missing = F.array_compact(F.array(F.when(F.col("no_tree"), "tree-assessment"), F.when(F.col("no_notice"), "neighbour-notification")))
    return load(spark, root, SCENARIO_ROWS).withColumn("missing_documents", missing)


@query("scenario_fingerprints", f"with r as ({SCENARIO_ROWS}) select case_id, {SCENARIO_SQL} as scenario_fingerprint from r")
def scenario_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """FP4 with FN7 - FN10."""
    return scenario_rows(spark, root).select("case_id", S.scenario_fingerprint(L.scenario_facts()).alias("scenario_fingerprint"))


@query("case_fingerprints", """
 select case_id, concat('sha256:', sha256(concat('{"a":"', address_stub, '","z":{"k":', cast(k as string), '}}'))) as content_fingerprint,
   concat('sha256:', sha256(concat(applicant_type, '|null|', address_stub, '|', cast(300 + ck % 400 as string), case when k % 2 = 0 then '.5' else '' end, '|', cast(1 + k % 8 as string)))) as entity_fingerprint,
   concat('sha256:', sha256(concat('doc-', cast(ck % 9 as string)))) as first_stub from fx_case""")
def case_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """FP1 - FP3: canonical JSON sorts the keys before hashing."""
    rows = load(spark, root, """select case_id, applicant_type, address_stub, concat('doc-', cast(ck % 9 as string)) as stub,
        concat('{ "z": {"k": ', cast(k as string), '}, "a" : "', address_stub, '"}') as packet,
        cast(300 + ck % 400 as double) + case when k % 2 = 0 then 0.5 else 0.0 end as area, cast(1 + k % 8 as double) as units from fx_case""")
    c = F.col
    return rows.select(
        "case_id", S.prefixed_sha256(D.canonical_json("packet")).alias("content_fingerprint"),
        S.entity_fingerprint(c("applicant_type"), F.lit(None).cast("string"), c("address_stub"), c("area"), c("units")).alias("entity_fingerprint"),
        F.transform(F.array("stub"), S.prefixed_sha256)[0].alias("first_stub"),
    )


@query("canonical_json", """
 select event_id, concat('{"a":', cast(event_id as string), ',"b":{"c":[1,null,"x"],"d":', cast(event_id % 10 as string), '.5},"z":true}') as canonical,
   concat('{"a":', cast(event_id as string), ',"z":true}') as stripped from events""")
def canonical_json(spark: SparkSession, root: str) -> DataFrame:
    """FN4, PF3."""
    rows = load(spark, root, """
        select event_id, concat('{"z": true, "b": {"d": ', cast(event_id % 10 as string), '.50, "c": [1.0, null, "x"]}, "a": ', cast(event_id as string), '}') as doc,
          concat('{"z": true, "provenance": {"x": 1}, "content_fingerprint": "f", "a": ', cast(event_id as string), '}') as generated from events""")
    return rows.select("event_id", D.canonical_json("doc").alias("canonical"), D.without_generated_fields("generated").alias("stripped"))


@query("provenance_rows", """
 select event_id, concat('sha256:', sha256(props)) as raw_request_hash, concat('sha256:', sha256(event_type)) as raw_response_hash, 'v1.0.0' as case_schema_version,
   've' as reviewer, true as human_reviewed, concat('u', cast(user_id as string)) as generator_id from events""")
def provenance_rows(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "events")
    p = L.provenance(F.col("props"), F.col("event_type"), generator_id=F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return rows.select("event_id", p.alias("p")).select(
        "event_id", *[f"p.{c}" for c in ("raw_request_hash", "raw_response_hash", "case_schema_version", "reviewer", "human_reviewed", "generator_id")]
    )


@query("built_cases", f"""
 with r as ({SCENARIO_ROWS}), m as (select case_id, (fsr_proposed > 1)::int + (coalesce(rear_setback_m_proposed, 0) < 7.6)::int + (side_setback_m_proposed < 1.2)::int + (height_m_proposed > 11.5)::int
   + (units_proposed > 4)::int + (parking_spaces_proposed < units_proposed)::int + (energy_step_code_proposed < 3)::int + no_notice::int + 2 as gaps from r)
 select case when k % 2 = 0 then case_id else concat(domain, '-', case when k >= 9999 then cast(k + 1 as string) else lpad(cast(k + 1 as string), 4, '0') end) end as case_id,
   {SCENARIO_SQL} as scenario_fingerprint, gaps, concat('sha256:', sha256(concat(applicant_type, '|null|', address_stub, '|', case when lot_area_sqm = floor(lot_area_sqm)
     then cast(lot_area_sqm::int as string) else cast(lot_area_sqm as string) end, '|', cast(units_proposed::int as string)))) as entity_fingerprint, 71 as hash_length
 from r join m using (case_id)""")
def built_cases(spark: SparkSession, root: str) -> DataFrame:
    """GEN1: ids, labels, fingerprints and provenance of grid rows (no documents submitted)."""
    grid = scenario_rows(spark, root).withColumns({
        "given_id": F.when(F.col("k") % 2 == 0, F.col("case_id")), "row_index": F.col("k"), "represented_by": F.lit(None).cast("string"),
        "submitted_documents": F.array().cast("array<string>"), "submitted_kinds": F.array().cast("array<string>"),
    }).drop("case_id", "k", "no_tree", "no_notice")
    evidence = spark.createDataFrame(EVIDENCE_MAP, "bylaw_id string, evidence_key string")
    out = L.build_cases(grid, rules_table(spark), evidence, "2026-06-07")
    return out.select(
        "case_id", "scenario_fingerprint", F.size("expected_gap_ids").alias("gaps"), "entity_fingerprint",
        F.length("provenance.raw_response_hash").alias("hash_length"),
    )


FEW_SHOT_REQUESTS = """
 select concat('q', cast(event_id as string)) as request_id, event_id, case event_id % 3 when 0 then 'redline-generator' when 1 then 'bylaw-retriever' else 'pre-review-memo-writer' end as agent,
   concat('case-', lpad(cast(user_id * 7 as string), 9, '0')) as first_parent, concat('case-', lpad(cast(user_id * 7 + event_id % 2 as string), 9, '0')) as second_parent from events"""


@query("few_shot_refusals", f"""
 with q as ({FEW_SHOT_REQUESTS}), j as (select q.request_id, a.split as s1, b.split as s2, a.domain as d1, b.domain as d2 from q left join fx_case a on a.case_id = q.first_parent
   left join fx_case b on b.case_id = q.second_parent)
 select request_id, case when s1 is null or s2 is null then 'parent not found' when s1 <> 'train' or s2 <> 'train' then 'parent outside train' else 'parents of several domains' end as reason
 from j where s1 is null or s2 is null or s1 <> 'train' or s2 <> 'train' or d1 <> d2""")
def few_shot_refusals(spark: SparkSession, root: str) -> DataFrame:
    return few_shot_build(spark, root)[1]


def few_shot_build(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    requests = load(spark, root, FEW_SHOT_REQUESTS).select(
        "request_id", "agent", F.array(F.concat(F.lit(" "), "first_parent"), "second_parent", F.lit(" ")).alias("inspired_by_train_case_ids"),
        F.lit('{"b":1,"a":2}').alias("input"), F.to_json(F.struct((F.col("event_id") % 5).alias("n"))).alias("output"), F.lit("note").alias("rationale_note"),
    )
    return L.build_few_shots(requests, load(spark, root, "select c.case_id, c.domain, c.split, s.scenario_fingerprint from fx_case c join fx_scenario s using (case_id)"))


@query("few_shots_built", f"""
 with q as ({FEW_SHOT_REQUESTS}), ok as (select q.* from q join fx_case a on a.case_id = q.first_parent join fx_case b on b.case_id = q.second_parent
   where a.split = 'train' and b.split = 'train' and a.domain = b.domain),
 h as (select distinct agent, first_parent, concat('sha256:', sha256(concat('{{"agent":"', agent, '","input":{{"a":2,"b":1}},"inspired_by_train_case_ids":["', first_parent, '","', second_parent,
   '"],"output":{{"n":', cast(event_id % 5 as string), '}},"rationale_note":"note"}}'))) as fp from ok)
 select concat('fs-', agent, '-', substr(fp, 8, 8)) as few_shot_id, agent, fp as content_fingerprint, concat('sha256:', sha256(concat('few-shot|', agent, '|', fp))) as entity_fingerprint,
   s.scenario_fingerprint from h join fx_scenario s on s.case_id = h.first_parent""")
def few_shots_built(spark: SparkSession, root: str) -> DataFrame:
    """FS1."""
    return few_shot_build(spark, root)[0].select("few_shot_id", "agent", "content_fingerprint", "entity_fingerprint", "scenario_fingerprint")


# --- corpus hashes --------------------------------------------------------------------------------------------------------

CORPUS = """select concat(source, '/', lang) as domain, concat('p', lpad(cast(doc_id as string), 12, '0')) as path, text as content from documents"""


@query("corpus_hashes", f"""
 with c as ({CORPUS}), f as (select domain, sha256(path)[1:6] as place, path as name, concat('sha256:', sha256(coalesce(content, ''))) as digest from c),
 leaves as (select domain, place, concat('sha256:', sha256(string_agg(concat(digest, ' ', name), chr(10) order by name, digest))) as digest, count(*) as files from f group by domain, place),
 nodes as (select domain, place[1:3] as place, concat('sha256:', sha256(string_agg(concat(digest, ' ', place), chr(10) order by place))) as digest, sum(files) as files from leaves group by domain, place[1:3])
 select domain, concat('sha256:', sha256(string_agg(concat(digest, ' ', place), chr(10) order by place))) as corpus_hash, cast(sum(files) as bigint) as files from nodes group by domain""")
def corpus_hashes(spark: SparkSession, root: str) -> DataFrame:
    """AG13: one digest per source and language."""
    return L.corpus_hash(load(spark, root, CORPUS))


@query("refreshed_manifest", """
 with f as (select doc_id, concat('p', cast(doc_id as string)) as path, concat('sha256:', sha256(text)) as h from documents)
 select path, case when doc_id % 6 = 5 then 'sha256:gone' else h end as content_hash,
   case when doc_id % 5 = 4 and doc_id % 6 <> 5 then 'no_entry' when doc_id % 6 = 5 then 'no_file' when doc_id % 7 = 0 then 'changed' else 'same' end as status
 from f where not (doc_id % 5 = 4 and doc_id % 6 = 5)""")
def refreshed_manifest(spark: SparkSession, root: str) -> DataFrame:
    """CR1."""
    docs = load(spark, root, "select doc_id, concat('p', cast(doc_id as string)) as path, text as content from documents")
    entries = docs.filter("doc_id % 5 <> 4").withColumn(
        "content_hash", F.when(F.col("doc_id") % 6 == 5, "sha256:gone").when(F.col("doc_id") % 7 == 0, "sha256:old").otherwise(S.prefixed_sha256(F.col("content")))
    )
    return L.refreshed_manifest(docs.filter("doc_id % 6 <> 5"), entries)


@query("seed_receipt", """
 select lang as domain, concat('public/', lang, '/', cast(doc_id as string)) as path, concat('sha256:', sha256(text)) as sha256 from documents where doc_id % 3 <> 1 and source <> 'src3'""")
def seed_receipt(spark: SparkSession, root: str) -> DataFrame:
    """CR2, PF4: public files only."""
    files = load(spark, root, """select lang as domain, text as content, concat(case when doc_id % 3 = 1 then 'private/' else 'public/' end, lang, case when source = 'src3' then '/oracle/' else '/' end,
        cast(doc_id as string)) as path from documents""")
    return L.seed_receipt(files, "public/")


# --- agreement and sampling ---------------------------------------------------------------------------------------------------

VOTES = "select l_partkey as case_id, l_returnflag as label from lineitem"


@query("majority_labels", f"""
 with c as (select case_id, label, count(*) as votes from ({VOTES}) group by 1, 2), r as (select *, row_number() over (partition by case_id order by votes desc, label) as n,
   count(*) over (partition by case_id) as labels, sum(votes) over (partition by case_id) as voters from c)
 select case_id, label, labels, voters, case when labels = 1 then 'agreed' else 'needs-human' end as review_status, labels = 1 as kept from r where n = 1""")
def majority_labels(spark: SparkSession, root: str) -> DataFrame:
    """XR7."""
    return L.majority_labels(load(spark, root, VOTES), "case_id", "label")


@query("stratified_splits", """
 with r as (select case_id, row_number() over (partition by outcome_class, gap_severity_bucket order by md5(concat('7:', case_id)), case_id) as rank,
   count(*) over (partition by outcome_class, gap_severity_bucket) as n from fx_case)
 select case_id, case when (rank - 1) / n < 0.58 then 'train' when (rank - 1) / n < 0.83 then 'dev' else 'holdout' end as split from r""")
def stratified_splits(spark: SparkSession, root: str) -> DataFrame:
    """XR6."""
    cases = load(spark, root, "fx_case").drop("split")
    return L.stratified_splits(cases, "case_id", ["outcome_class", "gap_severity_bucket"], [("train", 0.58), ("dev", 0.25), ("holdout", 0.17)], 7).select("case_id", "split")


@query("spot_check_sample", """
 with r as (select case_id, row_number() over (partition by domain, split order by md5(concat('11:', case_id)), case_id) as rank, count(*) over (partition by domain, split) as n from fx_case)
 select case_id from r where rank <= ceil(n * 0.15)""")
def spot_check(spark: SparkSession, root: str) -> DataFrame:
    """XR8."""
    return L.stratified_sample(load(spark, root, "fx_case"), "case_id", ["domain", "split"], 0.15, 11).select("case_id")


# --- scalar functions -------------------------------------------------------------------------------------------------------------

@query("json_path_existence", """
 select event_id, case event_id % 8 when 0 then true when 1 then true when 2 then false when 3 then false when 4 then true when 5 then event_id % 3 > 0 when 6 then false else false end as found from events""")
def json_path_existence(spark: SparkSession, root: str) -> DataFrame:
    """FN1: a JSON null exists, an absent key does not; malformed paths find nothing."""
    rows = load(spark, root, """
        select event_id, case event_id % 8 when 0 then 'k' when 1 then 'a.b[1]' when 2 then 'a.c' when 3 then 'a..b' when 4 then 'n' when 5 then 'a.l[1]' when 6 then 'a.b[01]' else 'k.x' end as path,
          concat('{"k":', cast(event_id as string), ',"n":null,"a":{"b":[1,null],"l":[', case when event_id % 3 > 0 then '5,6' else '5' end, ']}}') as doc from events""")
    return rows.select("event_id", D.json_path_exists("doc", "path").alias("found"))


@query("citation_ids", r"""
 with f as (select doc_id, unnest(regexp_extract_all(memo_markdown, '\b[A-Z]{2,4}-[A-Z]?[0-9]+(?:-[A-Z0-9]+)*\b')) as id from fx_doc)
 select doc_id, id, count(*) > 0 as found from f group by 1, 2""")
def citation_ids(spark: SparkSession, root: str) -> DataFrame:
    """FN2 over whole texts."""
    return load(spark, root, "fx_doc").select("doc_id", F.explode(S.citation_ids(F.col("memo_markdown"))).alias("id"), F.lit(True).alias("found"))


@query("markdown_headings", r"""
 with l as (select doc_id, unnest(str_split(memo_markdown, chr(10))) as line, generate_subscripts(str_split(memo_markdown, chr(10)), 1) as i from fx_doc),
 h as (select doc_id, i, trim(regexp_replace(trim(substr(line, 3)), '\s+#+\s*$', '')) as heading from l where regexp_matches(line, '^##\s+\S'))
 select doc_id, row_number() over (partition by doc_id order by i) - 1 as position, heading from h""")
def markdown_headings(spark: SparkSession, root: str) -> DataFrame:
    """FN3."""
    return load(spark, root, "fx_doc").select("doc_id", F.posexplode(S.headings(F.col("memo_markdown"))).alias("position", "heading"))


@query("hashes", "select doc_id, concat('sha256:', sha256(text)) as hash from documents")
def hashes(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "documents").select("doc_id", S.prefixed_sha256(F.col("text")).alias("hash"))


@query("number_formats", f"""
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat(cast((floor(l_extendedprice / 50) * 50)::bigint as string), '-', cast((floor(l_extendedprice / 50) * 50)::bigint + 49 as string)) as lot,
   case when l_quantity < 10 then 'lt10' when l_quantity < 25 then 'lt25' else 'gte25' end as bucket, floor((l_quantity / 8) * 100 + 0.5) / 100 as half_up,
   case when l_quantity > 25 then concat('+', cast((l_quantity - 25)::int as string)) else cast((l_quantity - 25)::int as string) end as signed from lineitem""")
def number_formats(spark: SparkSession, root: str) -> DataFrame:
    """FN7 - FN9."""
    q = F.col("l_quantity")
    return load(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.lot_bucket(F.col("l_extendedprice")).alias("lot"), S.edge_bucket(q, [10, 25]).alias("bucket"),
        S.half_up(q / 8, 2).alias("half_up"), S.signed_number(q - 25).alias("signed"),
    )


@query("rule_thresholds", """
 select p_partkey, case p_partkey % 4 when 0 then p_size + 0.5 when 1 then p_size when 2 then 7.5 else 7.5 end as threshold from part""")
def rule_thresholds(spark: SparkSession, root: str) -> DataFrame:
    """FN13."""
    rows = load(spark, root, """select p_partkey, case p_partkey % 4 when 0 then concat('height > ', cast(p_size as string), '.5 m') when 1 then concat('a <', cast(p_size as string), ' and b > 3')
        when 2 then 'check 12 by hand' else 'x > y' end as condition from part""")
    return rows.select("p_partkey", S.rule_threshold(F.col("condition"), F.lit(7.5)).alias("threshold"))


@query("lenient_numbers", """
 select event_id, case event_id % 7 when 0 then event_id when 1 then event_id + 0.25 when 2 then null when 3 then null when 4 then event_id * 100.0 when 5 then null else -event_id end as number from events""")
def lenient_numbers(spark: SparkSession, root: str) -> DataFrame:
    """FN14."""
    rows = load(spark, root, """select event_id, case event_id % 7 when 0 then cast(event_id as string) when 1 then concat('  ', cast(event_id as string), '.25 ') when 2 then '   ' when 3 then '12px'
        when 4 then concat(cast(event_id as string), 'e2') when 5 then 'Infinity' else concat('-', cast(event_id as string)) end as raw from events""")
    return rows.select("event_id", S.lenient_number(F.col("raw")).alias("number"))


@query("status_vocabulary", """
 select event_id, case when status in ('Completed', 'ok', 'success') then 'done' when status = 'ERRORED' then 'failed' when status = 'pending' then 'queued' else 'running' end as status
 from (select seq as event_id, status from fx_agent_event)""")
def status_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """FN15."""
    return load(spark, root, "fx_agent_event").select(F.col("seq").alias("event_id"), S.agent_status(F.col("status")).alias("status"))


@query("trap_families", """
 select case_id, case when edge_case_family is not null then edge_case_family when k % 3 = 0 then null when k % 3 = 1 then 'a-tag,b-tag' else 'c-tag' end as family from fx_case""")
def trap_families(spark: SparkSession, root: str) -> DataFrame:
    """FN18."""
    rows = load(spark, root, "select case_id, k, coalesce(edge_case_family, case when k % 2 = 0 then 'none' end) as single from fx_case")
    tags = F.when(F.col("k") % 3 == 0, F.array(F.lit("none"), F.lit(""))).when(F.col("k") % 3 == 1, F.array(F.lit("b-tag"), F.lit("none"), F.lit("a-tag"))).otherwise(F.array(F.lit("c-tag")))
    return rows.select("case_id", S.trap_family(F.col("single"), tags).alias("family"))


@query("date_texts", """
 select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y-%m-%dT00:00:00.000Z') as midnight, concat('round-', lpad(cast(o_orderkey % 500 as string), 3, '0'), '-fleet') as folder,
   o_orderkey % 500 as round, case when o_orderkey % 3 = 0 then 'given' when o_orderkey + 1 > 9999 then concat('d-', cast(o_orderkey + 1 as string)) else concat('d-', lpad(cast(o_orderkey + 1 as string), 4, '0')) end as minted from orders""")
def date_texts(spark: SparkSession, root: str) -> DataFrame:
    """FN19, FN20, FN23."""
    k = F.col("o_orderkey")
    folder = S.round_folder(k % 500)
    return load(spark, root, "orders").select(
        "o_orderkey", S.date_only(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"), S.iso_midnight(F.col("o_orderdate")).alias("midnight"),
        folder.alias("folder"), S.round_number(folder).alias("round"), S.minted_id(F.when(k % 3 == 0, "given").otherwise("  "), F.lit("d"), k + 1).alias("minted"),
    )


@query("applicant_types", """
 select event_id, case event_id % 4 when 0 then 'developer' when 1 then '_unknown_' when 2 then '_unknown_' else '_unknown_' end as applicant_type from events""")
def applicant_types(spark: SparkSession, root: str) -> DataFrame:
    """FN21."""
    rows = load(spark, root, """select event_id, case event_id % 4 when 0 then '{"applicant_profile":{"type":"developer"}}' when 1 then '{"applicant_profile":{"type":""}}' when 2 then '{"applicant_profile":null}'
        else '{}' end as packet from events""")
    return rows.select("event_id", S.applicant_type(F.col("packet")).alias("applicant_type"))


@query("array_sets", """
 with g as (select case_id, list(distinct flag order by flag) as gold from fx_gold_flag group by 1), p as (select case_id, list(distinct flag order by flag) as told from fx_flag group by 1)
 select g.case_id, g.gold = p.told as same, array_to_string(list_filter(gold, lambda x: list_contains(told, x)), ',') as both_, array_to_string(list_filter(gold, lambda x: not list_contains(told, x)), ',') as only_gold,
   len(gold) as gold_n from g join p using (case_id)""")
def array_sets(spark: SparkSession, root: str) -> DataFrame:
    """ST1, ST2, ST4, ST5 on the flag lists of a case (at most the taxonomy plus one)."""
    listed = lambda name, out: load(spark, root, name).distinct().groupBy("case_id").agg(F.collect_list("flag").alias(out))
    both = listed("fx_gold_flag", "gold").join(listed("fx_flag", "told"), "case_id")
    gold, told = S.sorted_unique(F.concat("gold", F.array(F.lit("")))), F.array_distinct(F.concat("told", "told"))
    return both.select(
        "case_id", S.same_set(gold, told).alias("same"), F.array_join(F.array_intersect(gold, told), ",").alias("both_"),
        F.array_join(F.array_except(gold, told), ",").alias("only_gold"), F.size(gold).alias("gold_n"),
    )


# --- projections and limits -----------------------------------------------------------------------------------------------------------

@query("numeric_gap_prefixes", """
 select case_id, gap_id, gap_id like 'gap-fsr%' or gap_id like 'gap-height%' or gap_id like 'gap-units%' or gap_id like 'gap-rear-setback%' or gap_id like 'gap-parking%' as numeric_gap from fx_gold_gap""")
def numeric_gap_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """PF6."""
    return load(spark, root, "fx_gold_gap").select("case_id", "gap_id", S.is_numeric_gap(F.col("gap_id")).alias("numeric_gap"))


@query("case_selection", "select case_id from fx_case where split = 'dev' order by case_id limit 25")
def case_selection(spark: SparkSession, root: str) -> DataFrame:
    """PF2, TK3, TK6: the first n ids of a split."""
    return load(spark, root, "fx_case").filter(F.col("split") == "dev").select("case_id").orderBy("case_id").limit(25)


@query("allowed_values", "select case_id, split, outcome_class in ('ready', 'needs-clarification', 'complex-requires-specialist') as known from fx_case")
def allowed_values(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "fx_case").select("case_id", "split", F.col("outcome_class").isin(V.OUTCOMES).alias("known"))
