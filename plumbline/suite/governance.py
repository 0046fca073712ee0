"""Dataset assertions, similarity and the diversity report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions import scalar as S
from plumbline.operators import governance as G
from plumbline.operators import similarity as N
from plumbline.suite.inputs import case_key
from plumbline.suite.registry import load, query

def found(df: DataFrame) -> DataFrame:
    return df.select("subject", "message")


# --- A01 / A02: constraints on dirty rows ------------------------------------------------------------------------

DIRTY_CASE = """
 select case_id, case when k % 53 = 0 then '' else domain end as domain, case when k % 47 = 0 then 'test' else split end as split,
   case when ck % 43 = 0 then null else outcome_class end as outcome_class, pathway_class,
   case when ck % 59 = 0 then 'huge' else gap_severity_bucket end as gap_severity_bucket,
   cast(k % 5 - case when k % 61 = 0 then 9 else 0 end as int) as expected_redlines_min, 6 as expected_redlines_max,
   case when k % 67 = 0 then 1.5 else label_confidence end as label_confidence, label_review_status from fx_case"""


@query("a01_case_schema", f"""
 with d as ({DIRTY_CASE})
 select case_id as subject, 'domain: required' as message from d where domain = '' union all
 select case_id, 'split: unknown value' from d where split not in ('train', 'dev', 'holdout', 'gold-holdout') union all
 select case_id, 'outcome_class: unknown value' from d where outcome_class is null union all
 select case_id, 'gap_severity_bucket: unknown value' from d where gap_severity_bucket = 'huge' union all
 select case_id, 'expected_redlines_min: not a count' from d where expected_redlines_min < 0 union all
 select case_id, 'label_confidence: outside 0..1' from d where label_confidence > 1""")
def a01(spark: SparkSession, root: str) -> DataFrame:
    return found(G.constraint_errors(load(spark, root, DIRTY_CASE), "A01", "case_id", G.case_rules()))


@query("a02_few_shot_schema", f"""
 select concat('fs-', cast(o_custkey as string)) as subject, 'agent: unknown value' as message from orders where o_orderpriority = '3-MEDIUM' and o_custkey % 7 = 6
 union all select concat('fs-', cast(o_custkey as string)), 'rationale_note: required' from orders where o_orderpriority = '3-MEDIUM' and o_orderkey % 9 = 0""")
def a02(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, f"""
        select concat('fs-', cast(o_custkey as string)) as few_shot_id, case when o_orderkey % 9 = 0 then '' else 'note' end as rationale_note,
          case o_custkey % 7 when 0 then 'scope-pathway-classifier' when 6 then 'stranger' else 'bylaw-retriever' end as agent
        from orders where o_orderpriority = '3-MEDIUM'""")
    rules = {
        "few_shot_id: required": F.length("few_shot_id") > 0, "agent: unknown value": F.col("agent").isin(V.AGENTS),
        "rationale_note: required": F.length("rationale_note") > 0,
    }
    return found(G.constraint_errors(rows, "A02", "few_shot_id", rules))


COUNTS, LISTS = ("expected_redlines_min", "expected_redlines_max", "seed", "max_tokens"), (*V.GOLD_LISTS, "document_stub_fingerprints", "inspired_by_train_case_ids")


def dirty_document(groups: dict[str, list[str]], source: str, subject: str) -> tuple[str, str]:
    """A document with every field null in some rows, and the rows that break a rule; field i is null where (k + i) % 83 is 0."""
    known = {"split": "train", "outcome_class": "ready", "pathway_class": "tod", "gap_severity_bucket": "none", "label_review_status": "spot-checked"}
    columns, broken = [], []

    def found_row(message: str, where: str) -> str:
        return f"select {subject} as subject, '{path}: {message}' as message from d where {where}"

    for i, (group, field) in enumerate((g, f) for g, fs in groups.items() for f in fs):
        path, off = f"{group}.{field}" if group else field, f"(k + {i}) % 83 = 0"
        if field in LISTS:
            value = f"array('a', case when (k + {i}) % 89 = 0 then null else 'b' end)"
            broken.append(found_row("null item", f"(k + {i}) % 89 = 0 and not ({off})"))
        elif field in COUNTS:
            value = f"k % 7 - {2 if field == 'max_tokens' else 0}"
            broken += [found_row("not positive", f"k % 7 <= 2 and not ({off}) and k % 5 <> 0")] if field == "max_tokens" else []
        elif field in ("label_confidence", "temperature", "top_p"):
            value = "k % 11 / 10.0D + 0.15D" if field == "label_confidence" else "0.5D"
            broken += [found_row("outside 0..1", f"k % 11 >= 9 and not ({off})")] if field == "label_confidence" else []
        elif field in ("stage1_complete", "human_reviewed"):
            value = "k % 2 = 0"
        else:
            value = subject if path in ("case_id", "few_shot_id") else f"'{known.get(field, 'text')}'"
            broken += [found_row("unknown value", f"not ({off})")] if field == "pathway_class" else []
        if path not in ("case_id", "few_shot_id"):
            there = " and k % 5 <> 0" if group == "provenance.decoding" else ""
            broken.append(found_row("required", f"{off}{there}"))
            value = f"case when not ({off}) then {value} end"
        columns.append((group, field, value))
    struct = lambda g: "named_struct(" + ", ".join(f"'{f}', {v}" for h, f, v in columns if h == g)
    decoding = f"'decoding', case when k % 5 <> 0 then {struct('provenance.decoding')}) end)"
    flat = ", ".join(f"{v} as {f}" for g, f, v in columns if not g)
    nested = ", ".join(f"{struct(g)}{', ' + decoding if g == 'provenance' else ')'} as {g}" for g in groups if g and "." not in g)
    return f"with d as ({source}) select {flat}, {nested} from d", f"with d as ({source}) " + " union all ".join(broken)


PROVENANCE = {"provenance": V.PROVENANCE_FIELDS, "provenance.decoding": V.DECODING_FIELDS}
CASE_DOCUMENTS = dirty_document({"": V.CASE_FIELDS, "gold_labels": V.GOLD_FIELDS, **PROVENANCE}, "select case_id, k from fx_case", "case_id")
FEW_SHOT_DOCUMENTS = dirty_document({"": V.FEW_SHOT_FIELDS, **PROVENANCE}, "select few_shot_id, pos as k from fx_few_shot", "few_shot_id")


@query("a01_case_documents", CASE_DOCUMENTS[1])
def a01_documents(spark: SparkSession, root: str) -> DataFrame:
    """A01 on whole documents: required fields at every depth, list items, enumerations, numbers."""
    return found(G.constraint_errors(load(spark, root, CASE_DOCUMENTS[0]), "A01", "case_id", G.case_document_rules()))


@query("a02_few_shot_documents", FEW_SHOT_DOCUMENTS[1])
def a02_documents(spark: SparkSession, root: str) -> DataFrame:
    return found(G.constraint_errors(load(spark, root, FEW_SHOT_DOCUMENTS[0]), "A02", "few_shot_id", G.few_shot_document_rules()))


@query("a03_duplicate_ids", """
 with p as (select concat('line-', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as id, concat('part-', cast(l_partkey % 3 as string)) as path,
     l_orderkey * 1000 + row_number() over (partition by l_partkey % 3, l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as line from lineitem),
 r as (select id, path, line, row_number() over (partition by id order by path, line) as n,
     first_value(path) over (partition by id order by path, line) as fp, first_value(line) over (partition by id order by path, line) as fl from p)
 select id as subject, concat('duplicate at ', path, ':', cast(line as string), ' (first seen ', fp, ':', cast(fl as string), ')') as message from r where n > 1""")
def a03(spark: SparkSession, root: str) -> DataFrame:
    pool = load(spark, root, """
        select concat('line-', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as id, concat('part-', cast(l_partkey % 3 as string)) as path,
          l_orderkey * 1000 + row_number() over (partition by l_partkey % 3, l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as line
        from lineitem""")
    return found(G.duplicate_ids(pool, "id"))


# --- A04 - A06 ------------------------------------------------------------------------------------------------------

@query("a04_content_collisions", """
 with f as (select concat('sha256:', sha256(text)) as fp, concat('case ', cast(doc_id as string)) as ref from documents union all
   select concat('sha256:', sha256(text)), concat('few-shot ', cast(item_id as string)) from benchmark),
 n as (select fp, count(*) as owners_n from f group by fp having count(*) > 1)
 select fp as subject, concat(ref, ' is one of ', cast(owners_n as string), ' owners') as message from f join n using (fp)""")
def a04(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "documents").select(F.col("doc_id").alias("case_id"), S.prefixed_sha256(F.col("text")).alias("content_fingerprint"))
    shots = load(spark, root, "benchmark").select(F.col("item_id").alias("few_shot_id"), S.prefixed_sha256(F.col("text")).alias("content_fingerprint"))
    return found(G.collision_violations(G.fingerprint_references(docs, shots, "content_fingerprint"), "A04"))


@query("a05_entity_collisions", """
 with f as (select concat('sha256:', sha256(concat(applicant_type, '|', case when ck % 2 = 0 then 'null' else 'ACME' end, '|', address_stub, '|', cast(300 + ck % 400 as string), '|',
     cast(1 + k % 3 as string)))) as fp, case_id from fx_case),
 n as (select fp, count(*) as n from f group by fp having count(*) > 1)
 select fp as subject, concat('case ', case_id, ' is one of ', cast(n as string), ' owners') as message from f join n using (fp)""")
def a05(spark: SparkSession, root: str) -> DataFrame:
    c = F.col
    cases = load(spark, root, "fx_case").select("case_id", S.entity_fingerprint(
        c("applicant_type"), F.when(c("ck") % 2 == 1, "ACME"), c("address_stub"), (300 + c("ck") % 400).cast("double"), (1 + c("k") % 3).cast("double"),
    ).alias("entity_fingerprint"))
    return found(G.collision_violations(G.fingerprint_references(cases, None, "entity_fingerprint"), "A05"))


@query("a06_document_stub_collisions", f"""
 with f as (select concat('sha256:', sha256(concat(cast(l_partkey as string), '/', cast(cast(l_quantity as int) as string)))) as fp, {case_key('l_orderkey')} as case_id from lineitem),
 n as (select fp, count(*) as n from f group by fp having count(*) > 1)
 select fp as subject, concat('case ', case_id, ' is one of ', cast(n as string), ' owners') as message from f join n using (fp)""")
def a06(spark: SparkSession, root: str) -> DataFrame:
    stubs = load(spark, root, f"""select {case_key('l_orderkey')} as case_id, concat(cast(l_partkey as string), '/', cast(cast(l_quantity as int) as string)) as stub from lineitem""")
    rows = stubs.select("case_id", F.array(S.prefixed_sha256(F.col("stub"))).alias("document_stub_fingerprints"))
    return found(G.collision_violations(G.fingerprint_references(rows, None, "document_stub_fingerprints"), "A06"))


# --- A07 and similarity ------------------------------------------------------------------------------------------------

FACTS_SQL = ", ".join(f"regexp_extract(scenario_fingerprint, '(?:^vec:|\\|){n}=([^|]*)', 1) as f{i}" for i, n in enumerate(V.FACTS))
CHANGED_SQL = " + ".join(f"(a.f{i} <> b.f{i})::int" for i in range(len(V.FACTS)))
DISTINCT_SQL = f"""
 d as (select scenario_fingerprint as fp, split, count(*) as n, min(case_id) as first_case, {FACTS_SQL} from {{source}} group by scenario_fingerprint, split),
 p as (select a.fp as fingerprint_a, a.split as split_a, a.n as cases_a, b.fp as fingerprint_b, b.split as split_b, b.n as cases_b, {CHANGED_SQL} as changed
       from d a join d b on a.split <> b.split and (a.fp < b.fp or (a.fp = b.fp and a.split < b.split)) where {CHANGED_SQL} <= 4)"""


@query("scenario_close_pairs", f"""
 with {DISTINCT_SQL.format(source='fx_scenario')}
 select fingerprint_a, split_a, fingerprint_b, split_b, round(changed / 14.0, 6) as distance, cases_a * cases_b as case_pairs from p""")
def scenario_close_pairs(spark: SparkSession, root: str) -> DataFrame:
    """JN8: pairs of distinct scenarios below the distance floor."""
    out = N.scenario_violations(load(spark, root, "fx_scenario"))
    return out.select("fingerprint_a", "split_a", "fingerprint_b", "split_b", F.round("distance", 6).alias("distance"), "case_pairs")


A07_SQL = """
 with {distinct},
 s as (select fingerprint_a as fp, split_a as split, changed, cases_b as partners from p union all select fingerprint_b, split_b, changed, cases_a from p),
 m as (select fp, split, min(changed) as changed, sum(partners) as partners from s group by 1, 2)
 select c.case_id, c.split, round(m.changed / 14.0, 6) as nearest_distance, m.partners as partner_cases
 from {source} c join m on m.fp = c.scenario_fingerprint and m.split = c.split"""


def near(spark: SparkSession, root: str, source: str) -> DataFrame:
    out = N.near_cases(load(spark, root, source))
    return out.select("case_id", "split", F.round("nearest_distance", 6).alias("nearest_distance"), "partner_cases")


@query("a07_scenario_distance", A07_SQL.format(distinct=DISTINCT_SQL.format(source="fx_scenario"), source="fx_scenario"))
def a07(spark: SparkSession, root: str) -> DataFrame:
    """A07 on scenarios that nearly all differ."""
    return near(spark, root, "fx_scenario")


@query("a07_copied_scenarios", A07_SQL.format(distinct=DISTINCT_SQL.format(source="fx_scenario_coarse"), source="fx_scenario_coarse"))
def a07_copies(spark: SparkSession, root: str) -> DataFrame:
    """A07 on many copies of few scenarios."""
    return near(spark, root, "fx_scenario_coarse")


@query("a07_jaccard", A07_SQL.format(distinct=DISTINCT_SQL.format(source="fx_scenario").replace("<= 4)", "<= 2)"), source="fx_scenario")
       .replace("round(m.changed / 14.0, 6)", "round(2.0 * m.changed / (14 + m.changed), 6)"))
def a07_jaccard(spark: SparkSession, root: str) -> DataFrame:
    """A07 by the Jaccard distance of fingerprint tokens: up to two of fourteen facts changed are below the floor."""
    cases = load(spark, root, "fx_scenario")
    out = N.violating_cases(cases, N.jaccard_violations(cases))
    return out.select("case_id", "split", F.round("nearest_distance", 6).alias("nearest_distance"), "partner_cases")


PAIR_SQL = f"""
 c as materialized (select case_id, domain, split, scenario_fingerprint as fp, {FACTS_SQL} from fx_scenario),
 p as (select a.domain, a.case_id as case_a, b.case_id as case_b, a.split as split_a, b.split as split_b, a.fp as fa, b.fp as fb, {CHANGED_SQL} as changed
       from c a join c b on a.domain = b.domain and a.split <> b.split and a.case_id < b.case_id),
 top as (select * from p order by changed, case_a, case_b limit {{k}})"""


@query("nearest_ten_pairs", f"""
 with {PAIR_SQL.format(k=10)}
 select case_a, case_b, round(changed / 14.0, 6) as distance, abs(changed / 14.0 - 0.35) <= 0.005 as at_floor from top""")
def nearest_ten(spark: SparkSession, root: str) -> DataFrame:
    out = N.flag_near_floor(N.nearest_pairs(load(spark, root, "fx_scenario"), 10))
    return out.select("case_a", "case_b", F.round("distance", 6).alias("distance"), "at_floor")


@query("nearest_five_shared_facts", f"""
 with {PAIR_SQL.format(k=5)}
 select case_a, split_a, case_b, split_b, round(changed / 14.0, 6) as distance,
   array_to_string(list_filter(str_split(substr(fa, 5), '|'), lambda x: list_contains(str_split(substr(fb, 5), '|'), x)), ', ') as shared from top""")
def nearest_five(spark: SparkSession, root: str) -> DataFrame:
    out = N.nearest_pairs(load(spark, root, "fx_scenario"), 5)
    shared = N.shared_facts(F.col("fingerprint_a"), F.col("fingerprint_b"))
    return out.select("case_a", "split_a", "case_b", "split_b", F.round("distance", 6).alias("distance"), shared.alias("shared"))


BUCKETS = {c: next(e for e in V.DISTANCE_EDGES if c / 14 <= e + 1e-12) for c in range(15)}


def bucket_name(edge: float) -> str:
    return f"le_{edge:g}".replace(".", "_")


@query("distance_histogram", f"""
 with d as (select domain, scenario_fingerprint as fp, split, count(*) as n, {FACTS_SQL} from fx_scenario_coarse group by domain, scenario_fingerprint, split),
 p as (select a.domain, least(a.split, b.split) as split_a, greatest(a.split, b.split) as split_b, a.n * b.n as pairs, {CHANGED_SQL} as changed
       from d a join d b on a.domain = b.domain and a.split < b.split)
 select domain, split_a, split_b, {", ".join(
     f"sum(case when changed in ({', '.join(str(c) for c in BUCKETS if BUCKETS[c] == e) or '-1'}) then pairs else 0 end)::bigint as {bucket_name(e)}"
     for e in V.DISTANCE_EDGES)}
 from p group by 1, 2, 3""")
def distance_histogram(spark: SparkSession, root: str) -> DataFrame:
    return N.distance_histogram(load(spark, root, "fx_scenario_coarse"))


@query("scenario_distances_of_neighbours", f"""
 with c as (select case_id, scenario_fingerprint as fp, lead(scenario_fingerprint) over (order by case_id) as nfp from fx_scenario),
 a as (select case_id, {FACTS_SQL.replace('scenario_fingerprint', 'fp')} from c where nfp is not null), b as (select case_id, {FACTS_SQL.replace('scenario_fingerprint', 'nfp')} from c where nfp is not null),
 m as (select a.case_id, {CHANGED_SQL} as changed from a join b on a.case_id = b.case_id)
 select case_id, round(changed / 14.0, 9) as fact_distance, round(2.0 * changed / (14 + changed), 9) as jaccard_distance from m""")
def neighbour_distances(spark: SparkSession, root: str) -> DataFrame:
    """FN11, FN12: both distances of each case to the next one by id."""
    rows = load(spark, root, """
        select a.case_id, a.scenario_fingerprint as l, b.scenario_fingerprint as r from (select f.*, c.k from fx_scenario f join fx_case c using (case_id)) a
        join (select f.*, c.k from fx_scenario f join fx_case c using (case_id)) b on b.k = a.k + 1""")
    return rows.select(
        "case_id", F.round(S.fact_distance(F.col("l"), F.col("r")), 9).alias("fact_distance"),
        F.round(S.jaccard_distance(F.col("l"), F.col("r")), 9).alias("jaccard_distance"),
    )


# --- A08 - A11 ------------------------------------------------------------------------------------------------------------

def few_shots(spark: SparkSession, root: str) -> DataFrame:
    """Few-shots with their parents as a list; one row per parent keeps the list bounded."""
    return load(spark, root, "fx_few_shot").select("few_shot_id", "agent", F.array("case_id").alias("inspired_by_train_case_ids"))


@query("a08_few_shot_leakage", """
 select f.few_shot_id, f.case_id, c.split from fx_few_shot f join fx_case c on c.case_id = f.case_id where c.split <> 'train'""")
def a08(spark: SparkSession, root: str) -> DataFrame:
    return G.few_shot_leaks(few_shots(spark, root), load(spark, root, "fx_case"))


@query("a08_benchmark_leakage", """
 with ngram as (select doc_id, trim(line) as line from (select doc_id, unnest(str_split(text, chr(10))) as line from documents) where trim(line) <> ''),
 bench as (select distinct item_id, trim(line) as line from (select item_id, unnest(str_split(text, chr(10))) as line from benchmark) where trim(line) <> '')
 select distinct doc_id, item_id from ngram join bench using (line)""")
def benchmark_leakage(spark: SparkSession, root: str) -> DataFrame:
    """JN6 on texts: documents that hold a whole line of a benchmark item."""
    def lines(table: str, key: str) -> DataFrame:
        rows = load(spark, root, table).select(key, F.explode(F.split("text", "\n")).alias("line"))
        return rows.select(key, F.trim("line").alias("line")).filter(F.col("line") != "")

    from plumbline.operators.joins import salted_join

    return salted_join(lines("documents", "doc_id"), lines("benchmark", "item_id").distinct(), ["line"], "inner").select("doc_id", "item_id").distinct()


@query("a09_review_status", """
 select case_id as subject, concat(split, ' label is ', label_review_status) as message from fx_case where split <> 'train' and label_review_status <> 'human-verified'""")
def a09(spark: SparkSession, root: str) -> DataFrame:
    return found(G.unreviewed_labels(load(spark, root, "fx_case")))


DOMAIN_CORPUS = """
 select distinct lower(c_mktsegment) as domain, concat('BR-N', substr(p_brand, 7)) as bylaw_id from lineitem join part on l_partkey = p_partkey
 join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey where c_mktsegment <> 'MACHINERY' and l_partkey % 5 <> 0 and l_quantity > 45"""
CITED_IN_DOMAIN = "select distinct g.case_id, c.domain, g.bylaw_id from fx_gold g join fx_case c on c.case_id = g.case_id"


@query("a10_unknown_bylaws", f"""
 with known as ({DOMAIN_CORPUS}), r as ({CITED_IN_DOMAIN})
 select case_id as subject, concat('unknown ', bylaw_id) as message from r where domain in (select domain from known)
   and not exists (select 1 from known where known.domain = r.domain and known.bylaw_id = r.bylaw_id)
 union all select case_id, concat('domain ', domain, ' has no entries') from fx_case where domain not in (select domain from known)""")
def a10(spark: SparkSession, root: str) -> DataFrame:
    return found(G.unknown_in_domain(load(spark, root, "fx_case"), load(spark, root, CITED_IN_DOMAIN), load(spark, root, DOMAIN_CORPUS), "bylaw_id", "A10"))


@query("a11_oracle_not_indexed", """
 select concat('d', cast(page_id % 7 as string)) as subject, concat('indexed oracle path ', 'datasets/policy-corpus/oracle/', cast(page_id as string)) as message
 from pages where page_id % 10 = 3""")
def a11(spark: SparkSession, root: str) -> DataFrame:
    receipts = load(spark, root, """
        select concat('d', cast(page_id % 7 as string)) as domain, concat('datasets/policy-corpus/', case when page_id % 10 = 3 then 'oracle/' else 'public/' end,
          cast(page_id as string)) as path from pages""").select("domain", F.array("path").alias("indexed_paths"))
    return found(G.indexed_oracle_paths(receipts))


# --- A12, A24, distributions -----------------------------------------------------------------------------------------------------

def shares_sql(source: str, where: str, checks: dict[str, tuple[str, dict]], generator: bool, limits: dict = V.BOUNDS) -> str:
    low, high = limits["edge_ratio"]
    parts = [f"""select domain, split, 'edge_ratio' as check, cast(null as string) as value, ratio as share from
      (select domain, split, avg(case when coalesce(edge_case_family, '_none_') <> '_none_' then 1.0 else 0.0 end) as ratio from {source} where {where} group by 1, 2)
      where ratio < {low} or ratio > {high}"""]
    for check, (column, bounds) in checks.items():
        listed = ", ".join(f"('{v}', {lo}, {hi})" for v, (lo, hi) in bounds.items())
        body = f"""(select g.domain, g.split, b.v, b.lo, b.hi, (select count(*) from {source} x where x.domain = g.domain and x.split = g.split and x.{column} = b.v) * 1.0 / g.n as share
          from (select domain, split, count(*) as n from {source} where {where} group by 1, 2) g, (values {listed}) b(v, lo, hi))"""
        parts.append(f"select domain, split, '{check}_below', v, share from {body} where share < lo")
        parts.append(f"select domain, split, '{check}_above', v, share from {body} where share > hi")
    if generator:
        parts.append(f"""select domain, split, 'generator', generator_id, share from (
          select domain, split, generator_id, count(*) * 1.0 / sum(count(*)) over (partition by domain, split) as share, 1.0 / count(*) over (partition by domain, split) as expected
          from {source} where {where} group by 1, 2, 3) where abs(share - expected) > {limits['generator_tolerance']}""")
        for check, column in (("gap_severity_degenerate", "gap_severity_bucket"), ("stage1_degenerate", "stage1_complete")):
            parts.append(f"""select domain, split, '{check}', cast(min({column}) as string), null from {source} where {where}
              group by domain, split having count(distinct {column}) = 1 and count(*) > 1""")
    return " union all ".join(parts)


LOPSIDED_CASES = """select case_id, domain, split, outcome_class, edge_case_family, applicant_type, generator_id,
   case when domain = 'building' then 'none' else gap_severity_bucket end as gap_severity_bucket,
   case when domain = 'machinery' then true else gold_stage1_complete end as stage1_complete from fx_case"""


@query("a12_diversity", f"""with pool as ({LOPSIDED_CASES}), f as ({shares_sql('pool', "split <> 'gold-holdout'",
    {'outcome': ('outcome_class', V.BOUNDS['outcome']), 'applicant': ('applicant_type', V.BOUNDS['applicant'])}, True)})
 select domain, split, check_, value, round(share, 9) as share from (select domain, split, f."check" as check_, value, share from f)""")
def a12(spark: SparkSession, root: str) -> DataFrame:
    out = G.diversity_violations(load(spark, root, LOPSIDED_CASES))
    return out.select("domain", "split", F.col("check").alias("check_"), "value", F.round("share", 9).alias("share"))


ONE_SIDED_CASES = """select case_id, domain, split, case when domain = 'building' then 'ready' else outcome_class end as outcome_class,
   case when domain = 'machinery' then '_none_' else edge_case_family end as edge_case_family from fx_case"""


@query("a24_sealed_diversity", f"""with pool as ({ONE_SIDED_CASES}), big as (select domain, split from pool group by 1, 2 having count(*) >= 10),
 sized as (select pool.* from pool join big using (domain, split)), f as ({shares_sql('sized', 'true', {'outcome': ('outcome_class', V.BOUNDS['outcome'])}, False)})
 select domain, split, check_, value, round(share, 9) as share from (select domain, split, f."check" as check_, value, share from f)""")
def a24(spark: SparkSession, root: str) -> DataFrame:
    out = G.sealed_diversity_violations(load(spark, root, ONE_SIDED_CASES))
    return out.select("domain", "split", F.col("check").alias("check_"), "value", F.round("share", 9).alias("share"))


def count_columns(column: str, listed: list[str]) -> str:
    return ", ".join(f"""count_if({column} = '{v}') as "{v}" """ for v in listed)


for _name, _column, _values in (
    ("outcome_distribution", "outcome_class", V.OUTCOMES), ("pathway_distribution", "pathway_class", V.PATHWAYS),
    ("severity_distribution", "gap_severity_bucket", V.GAP_SEVERITIES), ("applicant_distribution", "applicant_type", [*V.BOUNDS["applicant"], "_unknown_"]),
):
    def _distribution(spark: SparkSession, root: str, column=_column, listed=_values) -> DataFrame:
        return G.class_distribution(load(spark, root, "fx_case"), column, listed)

    query(_name, f"select domain, split, {count_columns(_column, _values)}, count(*) as n from fx_case group by domain, split")(_distribution)


@query("generator_shares", """
 select domain, split, generator_id, count(*) as count, round(count(*) * 1.0 / sum(count(*)) over (partition by domain, split), 9) as share
 from fx_case group by 1, 2, 3""")
def generator_shares(spark: SparkSession, root: str) -> DataFrame:
    return G.class_shares(load(spark, root, "fx_case"), "generator_id").withColumn("share", F.round("share", 9))


@query("source_language_shares", """
 select source, lang, count(*) as count, round(count(*) * 1.0 / sum(count(*)) over (partition by source), 9) as share from documents group by 1, 2""")
def source_language_shares(spark: SparkSession, root: str) -> DataFrame:
    return G.class_shares(load(spark, root, "documents"), "lang", ["source"]).withColumn("share", F.round("share", 9))


@query("degenerate_groups", f"""
 with pool as ({LOPSIDED_CASES})
 select domain, split, count(*) as n, min(gap_severity_bucket) as only_value from pool group by 1, 2 having count(*) > 1 and count(distinct gap_severity_bucket) = 1""")
def degenerate(spark: SparkSession, root: str) -> DataFrame:
    return G.degenerate_groups(load(spark, root, LOPSIDED_CASES), "gap_severity_bucket")


# --- A13 - A22 ----------------------------------------------------------------------------------------------------------------------

FILES_SQL = """select split_part(split_part(url, '//', 2), '/', 1) as domain, url as path, case when page_id % 4 = 0 then null else 'MIT' end as license,
   case when page_id % 6 = 0 then '' else '2026-01-01' end as vintage_date, concat('sha256:', cast(page_id as string)) as content_hash from pages"""


@query("a13_corpus_fields", f"""
 with f as ({FILES_SQL})
 select domain, path, array_to_string(list_filter([case when coalesce(license, '') = '' then 'license' end, case when coalesce(vintage_date, '') = '' then 'vintage_date' end],
   lambda x: x is not null), ', ') as missing from f where coalesce(license, '') = '' or coalesce(vintage_date, '') = ''""")
def a13(spark: SparkSession, root: str) -> DataFrame:
    return G.incomplete_corpus_files(load(spark, root, FILES_SQL))


@query("a14_rule_register", """
 with rules as (select distinct lower(p_type) as domain, concat('RULE-', p_brand) as rule_id from part),
 have as (select distinct lower(p_type) as domain, concat('RULE-', p_brand) as rule_id from part where p_size > 48)
 select domain as subject, concat('rule ', rule_id, ' is not in the register') as message from rules
 where not exists (select 1 from have where have.domain = rules.domain and have.rule_id = rules.rule_id)""")
def a14(spark: SparkSession, root: str) -> DataFrame:
    rules = load(spark, root, "select distinct lower(p_type) as domain, concat('RULE-', p_brand) as rule_id from part")
    have = load(spark, root, "select distinct lower(p_type) as domain, concat('RULE-', p_brand) as rule_id from part where p_size > 48")
    return found(G.unregistered_rules(rules, have))


@query("a15_reference_outputs", """
 with want as (select case_id, domain, concat('memo-', cast(ck % 40 as string)) as memo, concat('letter-', cast(k % 30 as string)) as letter from fx_case),
 memos as (select distinct domain, concat('memo-', cast(ck % 37 as string)) as id from fx_case),
 letters as (select distinct domain, concat('letter-', cast(ck % 28 as string)) as id from fx_case where domain <> 'furniture')
 select case_id as subject, concat('unknown ', memo) as message from want where not exists (select 1 from memos m where m.domain = want.domain and m.id = want.memo)
 union all select case_id, concat('unknown ', letter) from want where not exists (select 1 from letters l where l.domain = want.domain and l.id = want.letter)""")
def a15(spark: SparkSession, root: str) -> DataFrame:
    cases = load(spark, root, "fx_case")
    parts = []
    for word, column, modulus, known_modulus, but in (("memo", "ck", 40, 37, ""), ("letter", "k", 30, 28, " where domain <> 'furniture'")):
        known = load(spark, root, f"select distinct domain, concat('{word}-', cast(ck % {known_modulus} as string)) as {word} from fx_case{but}")
        wanted = cases.select("case_id", "domain", F.concat(F.lit(f"{word}-"), (F.col(column) % modulus).cast("string")).alias(word))
        parts.append(G.unknown_in_domain(cases, wanted, known, word, "A15", "none"))
    return found(G.union_all(parts))


@query("a16_evidence_coverage", f"""
 with known as (select distinct bylaw_id from fx_evidence_map), r as ({CITED_IN_DOMAIN})
 select case_id as subject, concat('unknown ', bylaw_id) as message from r where domain <> 'household' and bylaw_id not in (select bylaw_id from known)
 union all select case_id, concat('domain ', domain, ' has no entries') from fx_case where domain = 'household'""")
def a16(spark: SparkSession, root: str) -> DataFrame:
    known = load(spark, root, """select distinct c.domain, m.bylaw_id from fx_cited x join fx_case c on c.case_id = x.case_id
        join fx_evidence_map m on m.bylaw_id = x.bylaw_id where c.domain <> 'household'""")
    return found(G.unknown_in_domain(load(spark, root, "fx_case"), load(spark, root, CITED_IN_DOMAIN), known, "bylaw_id", "A16"))


GAPS_IN_DOMAIN = "select g.case_id, c.domain, g.gap_id from fx_gold_gap g join fx_case c on c.case_id = g.case_id"


@query("a18_orphan_gaps", f"""
 with r as ({GAPS_IN_DOMAIN})
 select case_id as subject, concat('unknown ', gap_id) as message from r where domain <> 'building' and gap_id not in (select gap_id from fx_truth)
 union all select distinct case_id, concat('domain ', domain, ' has no entries') from r where domain = 'building'""")
def a18(spark: SparkSession, root: str) -> DataFrame:
    known = load(spark, root, """select distinct c.domain, t.gap_id from fx_reported_gap r join fx_case c on c.case_id = r.case_id
        join fx_truth t on t.gap_id = r.gap_id where c.domain <> 'building'""")
    return found(G.unknown_in_domain(load(spark, root, "fx_case"), load(spark, root, GAPS_IN_DOMAIN), known, "gap_id", "A18", "referencing"))


@query("a19_flag_taxonomy", "select case_id as subject, concat('unknown flag ', flag) as message from fx_flag where flag = 'tone-odd'")
def a19(spark: SparkSession, root: str) -> DataFrame:
    return found(G.unknown_flags(load(spark, root, "fx_flag")))


MANIFEST_SQL = """select split, case_id from fx_case union all select 'holdout' as split, case_id from fx_case where k % 71 = 0"""
COUNTS_SQL = "select split, count(*) + case when split = 'dev' then 2 else 0 end as declared from ({m}) m group by split".format(m=MANIFEST_SQL)


@query("a20_manifest", f"""
 with m as ({MANIFEST_SQL})
 select split as subject, concat('declares ', cast(count(*) + 2 as string), ' ids, lists ', cast(count(*) as string)) as message from m where split = 'dev' group by split
 union all select case_id, concat('listed ', cast(count(*) as string), ' times') from m group by case_id having count(*) > 1""")
def a20(spark: SparkSession, root: str) -> DataFrame:
    return found(G.manifest_violations(load(spark, root, MANIFEST_SQL), load(spark, root, COUNTS_SQL)))


@query("a21_declared_vs_discovered", """
 select case_id, 'extra' as side from fx_case where k % 13 = 0 and k % 11 <> 0 union all select case_id, 'missing' from fx_case where k % 13 <> 0 and k % 11 = 0""")
def a21(spark: SparkSession, root: str) -> DataFrame:
    cases = load(spark, root, "fx_case")
    return G.declared_vs_discovered(cases.filter("k % 11 <> 0"), cases.filter("k % 13 <> 0"))


LISTING = """select distinct concat('datasets/cases/', domain, '.', split, case when ck % 2 = 0 then '.jsonl' else '.jsonl.age' end) as path from fx_case
   where (domain in ('building', 'furniture') and split = 'holdout') or (domain = 'machinery' and ck % 2 = 0) or (domain = 'household' and ck % 2 = 1)"""


@query("a22_sealed_hygiene", """
 select distinct domain, split, 'clear copy present' as problem from fx_case where domain in ('building', 'furniture') and split = 'holdout' union all
 select distinct domain, split, 'missing sealed file' from fx_case where (domain in ('building', 'furniture') and split = 'gold-holdout') or
   (domain = 'automobile' and split in ('holdout', 'gold-holdout'))""")
def a22(spark: SparkSession, root: str) -> DataFrame:
    sizes = load(spark, root, "select domain, split, count(*) as n from fx_case group by domain, split")
    return G.sealed_hygiene(sizes, load(spark, root, LISTING))


@query("a23_receipt_mismatches", """
 select url as path, case when page_id % 9 = 4 then 'missing' else 'mismatch' end as problem from pages where page_id % 9 = 4 or page_id % 7 = 2""")
def a23(spark: SparkSession, root: str) -> DataFrame:
    """JN14: receipt rows against the hashes of the contents."""
    pages = load(spark, root, "pages")
    sealed = S.prefixed_sha256(F.col("html"))
    receipt = pages.select(F.col("url").alias("path"), F.when(F.col("page_id") % 7 == 2, "sha256:0").otherwise(sealed).alias("sha256"))
    actual = pages.filter(F.col("page_id") % 9 != 4).select(F.col("url").alias("path"), sealed.alias("sha256"))
    return G.receipt_mismatches(receipt, actual).select("path", "problem")


CHECKED_SQL = """
 select 'A09' as assertion, (select count(*) from fx_case where split <> 'train' and label_review_status <> 'human-verified') as violations, (select count(*) from fx_case) as input_rows
 union all select 'A11', 0, 0
 union all select 'A14', (select count(*) from (select lower(p_type), p_brand from part group by 1, 2 having max(p_size) <= 48)), (select count(*) from part)
 union all select 'A19', (select count(*) from fx_flag where flag = 'tone-odd'), (select count(*) from fx_flag)
 union all select 'A20', (select count(*) from (select split from ({m}) m where split = 'dev' group by split)) + (select count(*) from (select case_id from ({m}) m group by case_id having count(*) > 1)),
   (select count(*) from ({m}) m)""".format(m=MANIFEST_SQL)
STATUS_OF = "case when violations > 0 then 'failed' when input_rows = 0 then 'skipped' else 'passed' end"


@query("validation_summary", f"select assertion, {STATUS_OF} as status, violations from ({CHECKED_SQL})")
def validation_summary(spark: SparkSession, root: str) -> DataFrame:
    """AG12: status per assertion out of the violations and the input of its own run."""
    cases, flags = load(spark, root, "fx_case"), load(spark, root, "fx_flag")
    rules = load(spark, root, "select distinct lower(p_type) as domain, concat('RULE-', p_brand) as rule_id from part")
    have = load(spark, root, "select distinct lower(p_type) as domain, concat('RULE-', p_brand) as rule_id from part where p_size > 48")
    receipts = spark.createDataFrame([], "domain string, indexed_paths array<string>")
    manifest = load(spark, root, MANIFEST_SQL)
    return G.summarize({
        "A09": (G.unreviewed_labels(cases), cases), "A11": (G.indexed_oracle_paths(receipts), receipts),
        "A14": (G.unregistered_rules(rules, have), load(spark, root, "part")), "A19": (G.unknown_flags(flags), flags),
        "A20": (G.manifest_violations(manifest, load(spark, root, COUNTS_SQL)), manifest),
    })


@query("validation_status_counts", f"""
 select count(*) filter (where s = 'passed') as passed, count(*) filter (where s = 'failed') as failed, count(*) filter (where s = 'skipped') as skipped
 from (select {STATUS_OF} as s from ({CHECKED_SQL}))""")
def validation_status_counts(spark: SparkSession, root: str) -> DataFrame:
    return G.status_counts(validation_summary(spark, root))


@query("trap_family_coverage", f"""
 with d as (select distinct domain from fx_case), f as (select distinct coalesce(edge_case_family, '_none_') as family from fx_case)
 select d.domain, f.family, {", ".join(f'''count(*) filter (where c.split = '{s}') as "{s}"''' for s in V.SPLITS)}
 from d cross join f left join fx_case c on c.domain = d.domain and coalesce(c.edge_case_family, '_none_') = f.family group by 1, 2""")
def trap_family_coverage(spark: SparkSession, root: str) -> DataFrame:
    return G.coverage_matrix(load(spark, root, "fx_case"))


@query("few_shot_domains", """
 with p as (select few_shot_id, case when pos % 9 = 0 then 'gone' else case_id end as case_id from fx_few_shot),
 m as (select distinct p.few_shot_id, c.domain from p join fx_case c on c.case_id = p.case_id)
 select distinct p.few_shot_id, coalesce(m.domain, 'unknown') as domain from p left join m on m.few_shot_id = p.few_shot_id""")
def few_shot_domains(spark: SparkSession, root: str) -> DataFrame:
    shots = load(spark, root, "select few_shot_id, case when pos % 9 = 0 then 'gone' else case_id end as case_id from fx_few_shot")
    return G.few_shot_domains(shots.select("few_shot_id", F.array("case_id").alias("inspired_by_train_case_ids")), load(spark, root, "fx_case"))


@query("few_shot_counts", """
 select c.domain, f.agent, count(distinct f.few_shot_id) as few_shots from fx_few_shot f join fx_case c on c.case_id = f.case_id group by 1, 2""")
def few_shot_counts(spark: SparkSession, root: str) -> DataFrame:
    """DQR: few-shots per domain and agent."""
    shots = few_shots(spark, root)
    domains = G.few_shot_domains(shots, load(spark, root, "fx_case"))
    return domains.join(shots.select("few_shot_id", "agent").distinct(), "few_shot_id").groupBy("domain", "agent").agg(
        F.count_distinct("few_shot_id").alias("few_shots")
    )


DOMAIN_INPUTS = [
    "select lower(c_mktsegment) as domain from customer", "select lang as domain from documents", "select lower(p_type) as domain from part",
    "select lower(n_name) as domain from nation", "select lower(r_name) as domain from region", "select source as domain from documents",
    "select split_part(split_part(url, '//', 2), '/', 1) as domain from pages", "select event_type as domain from events",
]


@query("all_domains", " union ".join(DOMAIN_INPUTS))
def all_domains(spark: SparkSession, root: str) -> DataFrame:
    """AG20: eight inputs."""
    return G.all_domains(*[load(spark, root, sql) for sql in DOMAIN_INPUTS])


INVENTORY_FILES = "select lower(p_type) as domain, p_partkey from part where p_size > 25"
INVENTORY_RULES = "select distinct lower(p_type) as domain, concat('RULE-', p_brand) as rule_id from part"
INVENTORY_SHOTS = "select distinct c.domain, f.few_shot_id from fx_few_shot f join fx_case c on c.case_id = f.case_id"


@query("inventory", f"""
 with r as (select domain, split as kind from fx_case union all select domain, 'corpus_files' from ({INVENTORY_FILES}) union all
   select domain, 'rules' from ({INVENTORY_RULES}) union all select domain, 'few_shots' from ({INVENTORY_SHOTS}))
 select domain, {", ".join(f'count(*) filter (where kind = ' + repr(k) + f') as "{k}"' for k in [*V.SPLITS, "corpus_files", "rules", "few_shots"])} from r group by domain""")
def inventory(spark: SparkSession, root: str) -> DataFrame:
    """DQR: what the report counts per domain."""
    t = lambda sql: load(spark, root, sql)
    return G.inventory(t("fx_case"), t(INVENTORY_FILES), t(INVENTORY_RULES), t(INVENTORY_SHOTS))


@query("id_pool_union_except", """
 (select case_id, 'only_gold' as pool from (select case_id from fx_gold_gap except all select case_id from fx_gold_missing)) union all
 (select case_id, 'either' as pool from (select case_id from fx_gold_gap union select case_id from fx_gold_missing))""")
def id_pools(spark: SparkSession, root: str) -> DataFrame:
    """ST7: union and multiset difference of id pools."""
    a, b = load(spark, root, "fx_gold_gap").select("case_id"), load(spark, root, "fx_gold_missing").select("case_id")
    return a.exceptAll(b).withColumn("pool", F.lit("only_gold")).unionByName(a.union(b).distinct().withColumn("pool", F.lit("either")))
