"""Metrics and composites over the shared inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.operators import metrics as M
from plumbline.suite.registry import load, query


def package(spark: SparkSession, root: str, judge: bool = False) -> M.Package:
    t = lambda name: load(spark, root, name)
    return M.Package(
        cases=t("fx_case").select("case_id", "domain", "split", "pathway_class", "gold_stage1_complete"),
        runtime=load(spark, root, "fx_runtime").drop("k", "ck"),
        gold_bylaws=t("fx_gold"), cited=t("fx_cited"), evidence=t("fx_evidence"),
        gold_gaps=t("fx_gold_gap"), reported_gaps=t("fx_reported_gap"), packet_numbers=t("fx_packet_number"),
        redlines=t("fx_redline"), packet_fields=t("fx_packet_number").select("case_id", "field"), gold_missing=t("fx_gold_missing"), missing=t("fx_missing"),
        gold_flags=t("fx_gold_flag"), flags=t("fx_flag"),
        redline_scores=t("fx_redline_score") if judge else None, text_scores=t("fx_text_score") if judge else None,
    )


def dimensions(spark: SparkSession, root: str, truth: bool = True) -> M.Dimensions:
    return M.Dimensions(
        corpus=load(spark, root, "fx_corpus"), evidence_map=load(spark, root, "fx_evidence_map"),
        truth=load(spark, root, "fx_truth") if truth else None,
    )


def one_metric(name: str, judge: bool = False):
    def run(spark: SparkSession, root: str) -> DataFrame:
        scores = M.score_cases(package(spark, root, judge), dimensions(spark, root), [name], keep=["case_id"])
        return scores.select("case_id", F.round(name, 9).alias("raw"), F.col(f"{name}_branch").alias("branch"))

    return run


# --- oracle pieces: each metric from its own joins -----------------------------------------------------------

M3_SQL = """
 select c.case_id, case when count(g.bylaw_id) = 0 then 1.0 else round(count(t.bylaw_id) * 1.0 / count(g.bylaw_id), 9) end as raw,
        case when count(g.bylaw_id) = 0 then 'vacuous_one_gold_empty' else 'standard' end as branch
 from fx_case c
 left join (select distinct case_id, bylaw_id from fx_gold) g on g.case_id = c.case_id
 left join (select distinct case_id, bylaw_id from fx_cited where seq < 10) t on t.case_id = g.case_id and t.bylaw_id = g.bylaw_id
 group by c.case_id"""

IDS = r"'\b[A-Z]{2,4}-[A-Z]?[0-9]+(?:-[A-Z0-9]+)*\b'"
M4_SQL = f"""
 with used as (
   select case_id, bylaw_id from fx_cited union select case_id, bylaw_id from fx_evidence union select case_id, cited_bylaw_id from fx_redline
   union select case_id, unnest(regexp_extract_all(memo_markdown, {IDS})) from fx_runtime)
 select c.case_id, case when count(u.bylaw_id) = count(k.bylaw_id) then 1.0 else 0.0 end as raw,
        case when count(u.bylaw_id) = 0 then 'vacuous_one_empty_both' else 'standard' end as branch
 from fx_case c left join used u on u.case_id = c.case_id left join fx_corpus k on k.bylaw_id = u.bylaw_id group by c.case_id"""

M5_SQL = """
 with gold as (select case_id, pos, bylaw_id from fx_gold),
 need as (select g.case_id, g.pos, m.evidence_key, e.evidence_key as have
          from gold g left join fx_evidence_map m on m.bylaw_id = g.bylaw_id
          left join fx_evidence e on e.case_id = g.case_id and e.bylaw_id = g.bylaw_id and e.evidence_key = m.evidence_key),
 per_bylaw as (select case_id, pos, case when count(evidence_key) = 0 then 1.0 else count(have) * 1.0 / count(evidence_key) end as s from need group by 1, 2)
 select c.case_id, case when count(p.pos) = 0 then 1.0 else round(avg(p.s), 9) end as raw,
        case when count(p.pos) = 0 then 'vacuous_one_gold_empty' else 'standard' end as branch
 from fx_case c left join per_bylaw p on p.case_id = c.case_id group by c.case_id"""

M6_SQL = """
 with last_report as (
   select * from (select *, row_number() over (partition by case_id, gap_id order by seq desc) as rn from fx_reported_gap) where rn = 1),
 expected as (
   select g.case_id, g.gap_id, case when r.gap_id is not null and a.value is not null and b.value is not null
        and abs(r.proposed_value - a.value) <= t.tolerance and abs(r.required_value - b.value) <= t.tolerance
        and abs(r.delta - (b.value - a.value)) <= t.tolerance then 1 else 0 end as ok
   from fx_gold_gap g join fx_truth t on t.gap_id = g.gap_id
   left join last_report r on r.case_id = g.case_id and r.gap_id = g.gap_id
   left join fx_packet_number a on a.case_id = g.case_id and a.field = t.proposed_field
   left join fx_packet_number b on b.case_id = g.case_id and b.field = t.required_field),
 predicted as (select r.case_id, r.gap_id, e.gap_id as hit from fx_reported_gap r join fx_truth t on t.gap_id = r.gap_id
               left join expected e on e.case_id = r.case_id and e.gap_id = r.gap_id),
 o as (select case_id, count(*) as n, sum(ok) as hits from expected group by 1),
 p as (select case_id, count(*) as n, count(*) - count(hit) as extra from predicted group by 1)
 select c.case_id,
   case when coalesce(o.n, 0) = 0 then case when coalesce(p.n, 0) = 0 then 1.0 else 0.0 end
        else round(o.hits * 1.0 / (o.n + coalesce(p.extra, 0)), 9) end as raw,
   case when coalesce(o.n, 0) > 0 then 'standard' when coalesce(p.n, 0) = 0 then 'vacuous_one_empty_both'
        else 'zero_predicted_nonempty_gold_empty' end as branch
 from fx_case c left join o on o.case_id = c.case_id left join p on p.case_id = c.case_id"""

M6_NO_TRUTH_SQL = """
 with expected as (
   select distinct g.case_id, g.gap_id, r.gap_id is not null as told from fx_gold_gap g
   left join (select distinct case_id, gap_id from fx_reported_gap) r on r.case_id = g.case_id and r.gap_id = g.gap_id
   where r.gap_id is not null or g.gap_id like 'gap-fsr%' or g.gap_id like 'gap-height%' or g.gap_id like 'gap-units%'
      or g.gap_id like 'gap-rear-setback%' or g.gap_id like 'gap-side-setback%' or g.gap_id like 'gap-front-setback%'
      or g.gap_id like 'gap-parking%' or g.gap_id like 'gap-energy-step%'),
 o as (select case_id, count(*) as n, count(*) filter (where told) as hits from expected group by 1),
 p as (select r.case_id, count(*) as n, count(*) - count(e.gap_id) as extra from fx_reported_gap r
       left join expected e on e.case_id = r.case_id and e.gap_id = r.gap_id group by 1)
 select c.case_id,
   case when coalesce(o.n, 0) = 0 then case when coalesce(p.n, 0) = 0 then 1.0 else 0.0 end
        else round(o.hits * 1.0 / (o.n + coalesce(p.extra, 0)), 9) end as raw,
   case when coalesce(o.n, 0) > 0 then 'standard' when coalesce(p.n, 0) = 0 then 'vacuous_one_empty_both'
        else 'zero_predicted_nonempty_gold_empty' end as branch
 from fx_case c left join o on o.case_id = c.case_id left join p on p.case_id = c.case_id"""

M7_SQL = """
 with diff as (
   select coalesce(g.case_id, p.case_id) as case_id, count(*) as n from fx_gold_missing g
   full outer join fx_missing p on p.case_id = g.case_id and p.document_id = g.document_id
   where g.case_id is null or p.case_id is null group by 1)
 select c.case_id, case when c.gold_stage1_complete = r.stage1_complete and d.n is null then 1.0 else 0.0 end as raw, 'standard' as branch
 from fx_case c join fx_runtime r on r.case_id = c.case_id left join diff d on d.case_id = c.case_id"""

REDLINE_COUNTS = """
 valid as (select r.case_id, r.seq, r.addresses_gap from fx_redline_checked r join fx_corpus k on k.bylaw_id = r.cited_bylaw_id
           join fx_gold_gap g on g.case_id = r.case_id and g.gap_id = r.addresses_gap where r.field_exists),
 gold as (select case_id, count(distinct gap_id) as n from fx_gold_gap group by 1),
 emitted as (select case_id, count(*) as n from fx_redline group by 1)"""
REDLINE_CASES = """
   case when coalesce(g.n, 0) > 0 and coalesce(e.n, 0) = 0 then 'zero_gold_nonempty_predicted_empty'
        when coalesce(g.n, 0) = 0 and coalesce(e.n, 0) = 0 then 'vacuous_one_empty_both'
        when coalesce(g.n, 0) = 0 then 'zero_predicted_nonempty_gold_empty' """
M8_SQL = f"""
 with {REDLINE_COUNTS}, hits as (select case_id, count(distinct addresses_gap) as n from valid group by 1)
 select c.case_id,
   case when coalesce(g.n, 0) = 0 and coalesce(e.n, 0) = 0 then 1.0 when coalesce(g.n, 0) = 0 or coalesce(e.n, 0) = 0 then 0.0
        else round(coalesce(h.n, 0) * 1.0 / greatest(g.n, e.n), 9) end as raw,
   {REDLINE_CASES} else 'standard' end as branch
 from fx_case c left join gold g on g.case_id = c.case_id left join emitted e on e.case_id = c.case_id left join hits h on h.case_id = c.case_id"""

M12_SQL = f"""
 with {REDLINE_COUNTS},
 judged as (select v.case_id, sum(s.score) as total, count(*) - count(s.score) as errors from valid v
            join fx_redline_score s on s.case_id = v.case_id and s.seq = v.seq group by 1)
 select c.case_id,
   case when coalesce(g.n, 0) = 0 and coalesce(e.n, 0) = 0 then 1.0 when coalesce(g.n, 0) = 0 or coalesce(e.n, 0) = 0 then 0.0
        when coalesce(j.errors, 0) > 0 then null else round(coalesce(j.total, 0) / greatest(g.n, e.n), 9) end as raw,
   {REDLINE_CASES} when coalesce(j.errors, 0) > 0 then 'not_applicable' else 'standard' end as branch
 from fx_case c left join gold g on g.case_id = c.case_id left join emitted e on e.case_id = c.case_id left join judged j on j.case_id = c.case_id"""

MEMO_LIST = "['Triage', 'Applicable bylaws', 'Evidence', 'Gaps', 'Recommendation']"
LETTER_LIST = "['Summary', 'What to fix before resubmitting', 'Optional improvements', 'Next step']"


def text_sql(source: str, key: str) -> str:
    """Sections, order, ids and cross references of both texts, line by line."""
    def heads(column: str, listed: str, name: str) -> str:
        return f"""
 {name}_line as (select {key}, unnest(str_split({column}, chr(10))) as line, generate_subscripts(str_split({column}, chr(10)), 1) as i from {source}),
 {name}_head as (select {key}, i, trim(regexp_replace(trim(substr(line, 3)), '\\s+#+\\s*$', '')) as h from {name}_line where regexp_matches(line, '^##\\s+\\S')),
 {name}_rank as (select {key}, i, list_position({listed}, h) as r, h from {name}_head where list_contains({listed}, h)),
 {name}_step as (select {key}, h, r, lag(r) over (partition by {key} order by i) as before from {name}_rank),
 {name}_ok as (select {key}, count(distinct h) = {5 if name == 'memo' else 4} and not bool_or(coalesce(r < before, false)) as ok, list(distinct h) as present
              from {name}_step group by 1)"""
    return f"""
 with {heads('memo_markdown', MEMO_LIST, 'memo')}, {heads('letter_markdown', LETTER_LIST, 'letter')},
 memo_id as (select {key}, unnest(regexp_extract_all(memo_markdown, {IDS})) as bylaw_id from {source}),
 bad_id as (select distinct {key} from memo_id where bylaw_id not in (select bylaw_id from fx_corpus)),
 ref as (select t.{key} from {source} t left join memo_ok o on o.{key} = t.{key}, (select unnest({MEMO_LIST}) as s) l
         where regexp_matches(t.memo_markdown, '(?i)\\bsee\\s+' || l.s || '\\b') and not coalesce(list_contains(o.present, l.s), false)),
 judged as (select t.{key}, coalesce(m.ok, false) and coalesce(l.ok, false) and t.{key} not in (select {key} from bad_id)
     and len(regexp_extract_all(t.letter_markdown, {IDS})) = 0 and t.{key} not in (select {key} from ref) as ok
   from {source} t left join memo_ok m on m.{key} = t.{key} left join letter_ok l on l.{key} = t.{key})"""


M9_SQL = text_sql("fx_runtime", "case_id") + " select case_id, case when ok then 1.0 else 0.0 end as raw, 'standard' as branch from judged"

FLAG_PIECES = """
 known as (select unnest(['jargon-density-high', 'required-vs-optional-unclear', 'missing-document-specificity-low', 'next-step-ambiguous',
   'first-time-applicant-tone-mismatch', 'numeric-gap-not-quantified', 'bylaw-citation-leaked-to-applicant']) as flag),
 told as (select distinct case_id, f.flag from fx_flag f join known using (flag)),
 gold as (select distinct case_id, flag from fx_gold_flag),
 n as (select c.case_id, count(distinct t.flag) as told, count(distinct g.flag) as gold, count(distinct case when t.flag = g.flag then t.flag end) as hit
       from fx_case c left join told t on t.case_id = c.case_id left join gold g on g.case_id = c.case_id group by 1)"""
M10_SQL = f"""
 with {FLAG_PIECES}
 select case_id, case when told = 0 and gold = 0 then 1.0 when told = 0 then 0.0 else round(hit * 1.0 / told, 9) end as raw,
   case when told = 0 and gold = 0 then 'vacuous_one_empty_both' when told = 0 then 'zero_gold_nonempty_predicted_empty' else 'standard' end as branch
 from n"""
M11_SQL = f"""
 with {FLAG_PIECES}
 select case_id, case when told = 0 and gold = 0 then 1.0 when gold = 0 then 0.0 else round(hit * 1.0 / gold, 9) end as raw,
   case when told = 0 and gold = 0 then 'vacuous_one_empty_both' when gold = 0 then 'zero_predicted_nonempty_gold_empty' else 'standard' end as branch
 from n"""
M1_SQL = """
 select c.case_id, case when c.pathway_class = r.predicted_pathway then 1.0 else 0.0 end as raw, 'standard' as branch
 from fx_case c join fx_runtime r on r.case_id = c.case_id"""
M2_SQL = """
 select c.case_id, case when (c.pathway_class = 'specialist-required') = (r.predicted_pathway = 'specialist-required') then 1.0 else 0.0 end as raw,
        'standard' as branch
 from fx_case c join fx_runtime r on r.case_id = c.case_id"""


def nested(sql: str) -> str:
    return f"({sql})"


M13_SQL = f"""
 with m4 as {nested(M4_SQL)}, m9 as {nested(M9_SQL)},
 s as (select case_id, max(case when audience = 'staff' then score end) as staff, max(case when audience = 'applicant' then score end) as applicant
       from fx_text_score group by 1)
 select m4.case_id, case when m4.raw <> 1 or m9.raw <> 1 then 0.0 else round(0.67 * staff + 0.33 * applicant, 9) end as raw,
   case when m4.raw <> 1 or m9.raw <> 1 then 'gate_failed' when 0.67 * staff + 0.33 * applicant is null then 'not_applicable' else 'standard' end as branch
 from m4 join m9 using (case_id) join s using (case_id)"""

METRIC_SQL = {
    "M1": M1_SQL, "M2": M2_SQL, "M3": M3_SQL, "M4": M4_SQL, "M5": M5_SQL, "M6": M6_SQL, "M7": M7_SQL,
    "M8": M8_SQL, "M9": M9_SQL, "M10": M10_SQL, "M11": M11_SQL, "M12": M12_SQL, "M13": M13_SQL,
}
METRIC_NAMES = {
    "M1": "m1_pathway", "M2": "m2_escalation", "M3": "m3_recall_at_10", "M4": "m4_citation_validity", "M5": "m5_evidence_coverage",
    "M6": "m6_numeric_gaps", "M7": "m7_stage1", "M8": "m8_redlines", "M9": "m9_text_structure", "M10": "m10_flag_precision",
    "M11": "m11_flag_recall", "M12": "m12_judged_redlines", "M13": "m13_judged_texts",
}
for _metric, _name in METRIC_NAMES.items():
    query(_name, METRIC_SQL[_metric])(one_metric(_metric, judge=_metric in ("M12", "M13")))


@query("m6_numeric_gaps_without_truth", M6_NO_TRUTH_SQL)
def m6_without_truth(spark: SparkSession, root: str) -> DataFrame:
    scores = M.score_cases(package(spark, root), dimensions(spark, root, truth=False), ["M6"], keep=["case_id"])
    return scores.select("case_id", F.round("M6", 9).alias("raw"), F.col("M6_branch").alias("branch"))


@query("m9_text_structure_documents", text_sql("fx_doc", "doc_id") + " select doc_id, case when ok then 1.0 else 0.0 end as raw from judged")
def m9_documents(spark: SparkSession, root: str) -> DataFrame:
    docs = load(spark, root, "fx_doc").select(F.col("doc_id").alias("case_id"), "memo_markdown", "letter_markdown")
    pkg = M.Package(cases=docs.select("case_id"), runtime=docs)
    dims = M.Dimensions(corpus=load(spark, root, "fx_corpus"))
    return M.score_cases(pkg, dims, ["M9"], keep=["case_id"]).select(F.col("case_id").alias("doc_id"), F.col("M9").alias("raw"))


# --- composites -------------------------------------------------------------------------------------------------

WEIGHT = {m: V.WEIGHTS[m] for m in V.METRICS}
EXACT_SQL = {m: re.sub(r"round\(([^\n]+?), 9\)", r"(\1)", sql) for m, sql in METRIC_SQL.items()}
SCORE_SQL = "with " + ", ".join(f"s{m} as {nested(EXACT_SQL[m])}" for m in V.METRICS)
SCORE_JOIN = " from sM1 " + " ".join(f"join s{m} using (case_id)" for m in V.METRICS[1:])
DET_SQL = "round((" + " + ".join(f"s{m}.raw * {WEIGHT[m]}" for m in V.DETERMINISTIC) + ") / 71 * 100, 6)"
PART_SQL = "round(" + " + ".join(f"s{m}.raw * {WEIGHT[m]}" for m in V.NON_JUDGE) + ", 6)"
FULL_SQL = "round(" + " + ".join(f"s{m}.raw * {WEIGHT[m]}" for m in V.METRICS) + ", 6)"
COMPOSITE_SQL = f"""{SCORE_SQL} select sM1.case_id, {DET_SQL} as deterministic_prqs, {PART_SQL} as partial_full_prqs_lower_bound,
 {FULL_SQL} as full_prqs {SCORE_JOIN}"""


def all_scores(spark: SparkSession, root: str, judge: bool = False) -> DataFrame:
    return M.score_cases(package(spark, root, judge), dimensions(spark, root))


@query("composite_scores", COMPOSITE_SQL)
def composite_scores(spark: SparkSession, root: str) -> DataFrame:
    scored = M.with_composites(all_scores(spark, root, judge=True))
    names = ["deterministic_prqs", "partial_full_prqs_lower_bound", "full_prqs"]
    return scored.select("case_id", *[F.round(n, 6).alias(n) for n in names])


@query("score_judge_off", f"""{SCORE_SQL.replace('sM12 as ' + nested(EXACT_SQL['M12']), 'dummy as (select 1 as x)').replace(', sM13 as ' + nested(EXACT_SQL['M13']), '')}
 select case_id, cast(null as double) as m12, 'not_applicable' as m12_branch,
   case when sM4.raw <> 1 or sM9.raw <> 1 then 0.0 end as m13, case when sM4.raw <> 1 or sM9.raw <> 1 then 'gate_failed' else 'not_applicable' end as m13_branch,
   {DET_SQL} as deterministic_prqs from sM1 {" ".join(f"join s{m} using (case_id)" for m in V.METRICS[1:11])}""")
def score_judge_off(spark: SparkSession, root: str) -> DataFrame:
    scored = M.with_composites(all_scores(spark, root))
    return scored.select(
        "case_id", F.col("M12").alias("m12"), F.col("M12_branch").alias("m12_branch"), F.col("M13").alias("m13"),
        F.col("M13_branch").alias("m13_branch"), F.round("deterministic_prqs", 6).alias("deterministic_prqs"),
    )


@query("score_range_violations", f"""
 with m6 as {nested(M6_SQL.replace('fx_gold_gap', 'fx_gold_gap_repeated').replace('select r.case_id, r.gap_id, e.gap_id as hit', 'select distinct r.case_id, r.seq, r.gap_id, e.gap_id as hit').replace('count(*) as n, sum(ok)', 'count(distinct gap_id) as n, sum(ok)'))}
 select case_id, 'M6' as metric, raw, 'raw_out_of_range' as problem from m6 where raw > 1""")
def range_violations(spark: SparkSession, root: str) -> DataFrame:
    pkg = package(spark, root)
    pkg.gold_gaps = load(spark, root, "fx_gold_gap_repeated")
    scores = M.score_cases(pkg, dimensions(spark, root), ["M6"], keep=["case_id"])
    return M.range_violations(M.to_long(scores, ["M6"])).select("case_id", "metric", F.round("raw", 9).alias("raw"), "problem")


@query("scorer_map_swapped", """
 select c.case_id, case when c.pathway_class = r.predicted_pathway then 0.5 else 0.0 end as m1, cast(null as double) as m12, 'not_applicable' as m12_branch
 from fx_case c join fx_runtime r on r.case_id = c.case_id""")
def swapped_scorer(spark: SparkSession, root: str) -> DataFrame:
    """UD1: any metric can be replaced in the table handed to ``score_cases``."""
    half = M.Metric(lambda: (M._m1()[0] * 0.5, F.lit("standard")))
    scores = M.score_cases(package(spark, root), dimensions(spark, root), ["M1", "M12"], {**M.METRIC_TABLE, "M1": half}, ["case_id"])
    return scores.select("case_id", F.col("M1").alias("m1"), F.col("M12").alias("m12"), F.col("M12_branch").alias("m12_branch"))


@query("redline_invalid_reasons", """
 with r as (select x.*, k.bylaw_id is null as no_bylaw, g.gap_id is null as no_gap from fx_redline_checked x
   left join fx_corpus k on k.bylaw_id = x.cited_bylaw_id left join fx_gold_gap g on g.case_id = x.case_id and g.gap_id = x.addresses_gap)
 select 'field_not_found' as reason, count_if(not field_exists) as n from r union all
 select 'gap_not_expected', count_if(no_gap) from r union all select 'bylaw_not_found', count_if(no_bylaw) from r""")
def invalid_reasons(spark: SparkSession, root: str) -> DataFrame:
    sums = M.gap_sums(M.read_by(package(spark, root), ["M8"]), dimensions(spark, root))
    names = ["field_not_found", "gap_not_expected", "bylaw_not_found"]
    totals = sums.agg(*[F.sum(f"{n}_n").alias(n) for n in names])
    return totals.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("reason", "n"))


@query("numeric_gap_reasons", """
 with last_report as (
   select * from (select *, row_number() over (partition by case_id, gap_id order by seq desc) as rn from fx_reported_gap) where rn = 1),
 v as (
   select case when r.gap_id is null then 'not_reported' when a.value is null or b.value is null then 'application_packet_missing_truth_field'
     when abs(r.proposed_value - a.value) > t.tolerance then 'provided_out_of_tolerance'
     when abs(r.required_value - b.value) > t.tolerance then 'required_out_of_tolerance'
     when abs(r.delta - (b.value - a.value)) > t.tolerance then 'delta_out_of_tolerance' else 'ok' end as reason
   from fx_gold_gap g join fx_truth t on t.gap_id = g.gap_id
   left join last_report r on r.case_id = g.case_id and r.gap_id = g.gap_id
   left join fx_packet_number a on a.case_id = g.case_id and a.field = t.proposed_field
   left join fx_packet_number b on b.case_id = g.case_id and b.field = t.required_field)
 select reason, count(*) as n from v group by reason""")
def gap_reasons(spark: SparkSession, root: str) -> DataFrame:
    """JN4: expected gaps with their truth row and the reason of the numeric check."""
    rows = M.gap_verdicts(M.read_by(package(spark, root), ["M6"]), dimensions(spark, root)).filter(F.col("oracle"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("citation_sources", """
 select case_id, bylaw_id, max(r) as ranked, max(e) as evidence, max(d) as redline from (
   select case_id, bylaw_id, 1 as r, 0 as e, 0 as d from fx_cited union all
   select case_id, bylaw_id, 0, 1, 0 from fx_evidence union all select case_id, cited_bylaw_id, 0, 0, 1 from fx_redline)
 group by 1, 2""")
def citation_sources(spark: SparkSession, root: str) -> DataFrame:
    """ST3: union of citations with the sources that name them."""
    p = package(spark, root)
    parts = [
        M._marked(p.cited, F.col("bylaw_id"), "bylaw_id", ranked=1), M._marked(p.evidence, F.col("bylaw_id"), "bylaw_id", evidence=1),
        M._marked(p.redlines, F.col("cited_bylaw_id"), "bylaw_id", redline=1),
    ]
    return M._fold(parts, ["case_id", "bylaw_id"], ["ranked", "evidence", "redline"])
