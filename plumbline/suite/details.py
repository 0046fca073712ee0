"""Details behind the scores of metrics M3-M13, each against its own joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.details import metric_details
from plumbline.suite.registry import query
from plumbline.suite.scoring import FLAG_PIECES, IDS, LETTER_LIST, M4_SQL, M9_SQL, MEMO_LIST, REDLINE_COUNTS, dimensions, nested, package, text_sql


def item(kind: str, source: str, column: str, part: str = "null", value: str = "null") -> str:
    return f"""select case_id, '{kind}' as kind, cast({column} as string) as item, cast({part} as string) as part,
  round(cast({value} as double), 9) as value from {source}"""


def count(kind: str, source: str, value: str) -> str:
    return item(kind, source, "null", value=value)


def one(*parts: str) -> str:
    return " union all ".join(parts)


M3_DETAILS = f"""
 with gold as (select distinct case_id, bylaw_id from fx_gold), top as (select distinct case_id, bylaw_id from fx_cited where seq < 10),
 miss as (select * from gold where not exists (select 1 from top where top.case_id = gold.case_id and top.bylaw_id = gold.bylaw_id)),
 n as (select c.case_id, count(g.bylaw_id) as gold, count(t.bylaw_id) as hit from fx_case c left join gold g on g.case_id = c.case_id
   left join top t on t.case_id = g.case_id and t.bylaw_id = g.bylaw_id group by 1)
 {one(item("missing_bylaw_ids", "miss", "bylaw_id"), count("gold_count", "n", "gold"), count("recovered_count", "n", "hit"))}"""

USED = M4_SQL[M4_SQL.index("used as"):M4_SQL.index("select c.case_id")]
M4_DETAILS = f"""
 with {USED}, n as (select c.case_id, count(u.bylaw_id) as n from fx_case c left join used u on u.case_id = c.case_id group by 1)
 {one(item("invalid_ids", "used where bylaw_id not in (select bylaw_id from fx_corpus)", "bylaw_id"), count("cited_total", "n", "n"))}"""

M5_DETAILS = f"""
 with need as (select g.case_id, g.pos, g.bylaw_id, m.evidence_key, e.evidence_key as have
   from fx_gold g left join fx_evidence_map m on m.bylaw_id = g.bylaw_id
   left join fx_evidence e on e.case_id = g.case_id and e.bylaw_id = g.bylaw_id and e.evidence_key = m.evidence_key),
 scores as (select case_id, bylaw_id, case when count(evidence_key) = 0 then 1.0 else count(have) * 1.0 / count(evidence_key) end as s from need group by 1, 2),
 miss as (select distinct case_id, bylaw_id, evidence_key from need where evidence_key is not null and have is null),
 n as (select c.case_id, count(g.pos) as n from fx_case c left join fx_gold g on g.case_id = c.case_id group by 1)
 {one(item("per_bylaw_scores", "scores", "bylaw_id", value="s"), item("missing_evidence", "miss", "bylaw_id", "evidence_key"),
      count("gold_bylaw_count", "n", "n"))}"""

M6_DETAILS = f"""
 with last_report as (
   select * from (select *, row_number() over (partition by case_id, gap_id order by seq desc) as rn from fx_reported_gap) where rn = 1),
 v as (
   select g.case_id, g.gap_id, r.gap_id is not null as told,
     case when r.gap_id is null then 'not_reported' when a.value is null or b.value is null then 'application_packet_missing_truth_field'
       when abs(r.proposed_value - a.value) > t.tolerance then 'provided_out_of_tolerance'
       when abs(r.required_value - b.value) > t.tolerance then 'required_out_of_tolerance'
       when abs(r.delta - (b.value - a.value)) > t.tolerance then 'delta_out_of_tolerance' else 'ok' end as reason
   from fx_gold_gap g join fx_truth t on t.gap_id = g.gap_id
   left join last_report r on r.case_id = g.case_id and r.gap_id = g.gap_id
   left join fx_packet_number a on a.case_id = g.case_id and a.field = t.proposed_field
   left join fx_packet_number b on b.case_id = g.case_id and b.field = t.required_field),
 p as (select r.case_id, r.gap_id, v.gap_id as hit from fx_reported_gap r join fx_truth t on t.gap_id = r.gap_id
   left join v on v.case_id = r.case_id and v.gap_id = r.gap_id),
 extra as (select case_id, gap_id, count(*) as n from p where hit is null group by 1, 2),
 vn as (select case_id, count(*) as n, count(*) filter (where reason = 'ok') as ok from v group by 1), pn as (select case_id, count(*) as n from p group by 1),
 n as (select c.case_id, coalesce(vn.n, 0) as oracle, coalesce(vn.ok, 0) as ok, coalesce(pn.n, 0) as told
   from fx_case c left join vn on vn.case_id = c.case_id left join pn on pn.case_id = c.case_id)
 {one(item("per_gap", "v", "gap_id", "reason", "case when reason = 'ok' then 1 else 0 end"), item("missing_gaps", "v where not told", "gap_id"),
      item("wrong_value_gaps", "v where told and reason <> 'ok'", "gap_id"), item("extra_gaps", "extra", "gap_id", value="n"),
      count("oracle_numeric_count", "n", "oracle"), count("predicted_numeric_count", "n", "told"), count("correct_count", "n", "ok"))}"""

M7_DETAILS = f"""
 with diff as (
   select coalesce(g.case_id, p.case_id) as case_id, coalesce(g.document_id, p.document_id) as id, g.case_id is null as unexpected from fx_gold_missing g
   full outer join fx_missing p on p.case_id = g.case_id and p.document_id = g.document_id where g.case_id is null or p.case_id is null),
 n as (select c.case_id, case when c.gold_stage1_complete = r.stage1_complete then 1 else 0 end as same,
   case when c.case_id in (select case_id from diff) then 0 else 1 end as sets from fx_case c join fx_runtime r on r.case_id = c.case_id)
 {one(item("unexpected_missing", "diff where unexpected", "id"), item("omitted_missing", "diff where not unexpected", "id"),
      count("boolean_match", "n", "same"), count("set_match", "n", "sets"))}"""

REDLINES = f"""{REDLINE_COUNTS}, vn as (select case_id, count(*) as n, count(distinct addresses_gap) as gaps from valid group by 1),
 n as (select c.case_id, coalesce(vn.n, 0) as valid, coalesce(e.n, 0) as emitted, coalesce(g.n, 0) as gold, coalesce(vn.gaps, 0) as gaps
   from fx_case c left join vn on vn.case_id = c.case_id left join emitted e on e.case_id = c.case_id left join gold g on g.case_id = c.case_id),
 why as (select x.case_id, x.field_exists, k.bylaw_id is null as no_bylaw, g.gap_id is null as no_gap from fx_redline_checked x
   left join fx_corpus k on k.bylaw_id = x.cited_bylaw_id left join fx_gold_gap g on g.case_id = x.case_id and g.gap_id = x.addresses_gap),
 reasons as (select case_id, 'field_not_found' as reason, count(*) as n from why where not field_exists group by 1 union all
   select case_id, 'gap_not_expected', count(*) from why where no_gap group by 1 union all
   select case_id, 'bylaw_not_found', count(*) from why where no_bylaw group by 1)"""
REDLINE_ROWS = one(item("invalid_reasons", "reasons", "reason", value="n"), count("valid_redline_count", "n", "valid"),
                   count("emitted_count", "n", "emitted"), count("gold_gap_count", "n", "gold"))
M8_DETAILS = f"with {REDLINES} {one(REDLINE_ROWS, count('distinct_gaps_addressed', 'n', 'gaps'))}"
M12_DETAILS = f"""
 with {REDLINES}, judged as (select v.*, s.score from valid v join fx_redline_score s on s.case_id = v.case_id and s.seq = v.seq)
 {one(REDLINE_ROWS, item("judged_redlines", "judged", "seq", "addresses_gap", "score"))}"""

M9_DETAILS = text_sql("fx_runtime", "case_id") + f""",
 lists as (select t.case_id, m.ok as m_ok, l.ok as l_ok, m.present as m_have, l.present as l_have, t.memo_markdown as memo
   from fx_runtime t left join memo_ok m on m.case_id = t.case_id left join letter_ok l on l.case_id = t.case_id),
 memo_want as (select lists.*, unnest({MEMO_LIST}) as s from lists), letter_want as (select lists.*, unnest({LETTER_LIST}) as s from lists),
 letter_id as (select distinct case_id, unnest(regexp_extract_all(letter_markdown, {IDS})) as bylaw_id from fx_runtime),
 broken as (select * from memo_want where regexp_matches(memo, '(?i)\\bsee\\s+' || s || '\\b') and not coalesce(list_contains(m_have, s), false))
 {one(item("memo_sections_missing", "memo_want where not coalesce(list_contains(m_have, s), false)", "s"),
      item("letter_sections_missing", "letter_want where not coalesce(list_contains(l_have, s), false)", "s"),
      item("broken_cross_refs", "broken", "s"), item("letter_contains_bylaw_ids", "letter_id", "bylaw_id"),
      item("invalid_memo_bylaw_ids", "(select distinct * from memo_id) where bylaw_id not in (select bylaw_id from fx_corpus)", "bylaw_id"),
      count("memo_section_order_ok", "lists", "coalesce(m_ok, false)"), count("letter_section_order_ok", "lists", "coalesce(l_ok, false)"))}"""

FLAG_DETAILS = f"""
 with {FLAG_PIECES}, dropped as (select distinct case_id, flag from fx_flag where flag not in (select flag from known))
 {one(item("dropped_for_taxonomy", "dropped", "flag"), count("predicted_count", "n", "told"), count("gold_count", "n", "gold"),
      count("intersection_count", "n", "hit"))}"""

M13_DETAILS = f"""
 with m4 as {nested(M4_SQL)}, m9 as {nested(M9_SQL)},
 s as (select case_id, max(case when audience = 'staff' then score end) as staff, max(case when audience = 'applicant' then score end) as applicant
       from fx_text_score group by 1)
 {one(count("m4_raw", "m4", "raw"), count("m9_raw", "m9", "raw"), count("staff_score", "s", "staff"), count("applicant_score", "s", "applicant"))}"""

DETAILS = {
    "M3": M3_DETAILS, "M4": M4_DETAILS, "M5": M5_DETAILS, "M6": M6_DETAILS, "M7": M7_DETAILS, "M8": M8_DETAILS, "M9": M9_DETAILS,
    "M10": FLAG_DETAILS, "M11": FLAG_DETAILS, "M12": M12_DETAILS, "M13": M13_DETAILS,
}


def details_of(metric: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        rows = metric_details(package(spark, root, judge=metric in ("M12", "M13")), dimensions(spark, root), [metric])
        return rows.drop("metric").withColumn("value", F.round("value", 9))

    return run


for _metric, _sql in DETAILS.items():
    query(f"details_{_metric.lower()}", _sql)(details_of(_metric))
