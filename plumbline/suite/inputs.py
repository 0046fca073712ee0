"""Shared inputs as portable SQL over the given tables: the same text runs in Spark and in the oracle.

Cases come from orders, citations, gaps and flags from lineitem, texts from documents, agent events from
events. Arrays of a case are long tables, ordered by explicit positions.
"""

from plumbline.values import AGENTS, PATHWAYS
from plumbline.values import GAP_SEVERITIES as SEVERITIES
from plumbline.values import SUPPORT_FLAGS as FLAGS


def case_key(column: str) -> str:
    return f"concat('case-', lpad(cast({column} as string), 9, '0'))"


def choose(index: str, values: list[str]) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {index} {whens} end"


APPLICANTS = ["owner-builder"] * 4 + ["developer"] * 3 + ["agent-of-record", "architect-of-record", "first-time-applicant", "_unknown_"]
GAPS = [
    "gap-fsr-over", "gap-height-over", "gap-units-over", "gap-rear-setback-short",
    "gap-parking-short", "gap-tree-assessment-missing", "gap-neighbour-notification-missing",
]
DOCUMENTS = ["tree-assessment", "site-survey-bcls", "energy-report", "neighbour-notification"]
LINE_ORDER = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
BRAND = "concat('BR-N', substr(p_brand, 7))"
LINE_GAP = choose("l_linenumber - 1", GAPS)
NL = "chr(10)"

INPUTS = {
    "fx_case": f"""
        select {case_key('o_orderkey')} as case_id, o_orderkey as k, o_custkey as ck, lower(c_mktsegment) as domain,
               case when o_orderkey % 10 < 6 then 'train' when o_orderkey % 10 < 8 then 'dev'
                    when o_orderkey % 10 = 8 then 'holdout' else 'gold-holdout' end as split,
               {choose('o_orderkey % 7', PATHWAYS)} as pathway_class,
               case when o_custkey % 10 < 4 then 'ready' when o_custkey % 10 < 8 then 'needs-clarification'
                    else 'complex-requires-specialist' end as outcome_class,
               {choose('o_orderkey % 6', SEVERITIES)} as gap_severity_bucket,
               case o_custkey % 12 when 0 then 'heritage-lane' when 1 then 'corner-lot' when 2 then '_none_'
                    when 3 then 'floodway' when 4 then 'corner-lot' end as edge_case_family,
               {choose('(o_custkey + o_orderkey) % 11', APPLICANTS)} as applicant_type,
               concat('gen-', cast(case when o_custkey % 7 = 0 then 0 else o_custkey % 3 end as string)) as generator_id,
               o_orderkey % 4 <> 0 as gold_stage1_complete,
               case when o_orderkey % 37 = 0 then 'spot-checked' when o_orderkey % 41 = 0 then 'needs-human'
                    else 'human-verified' end as label_review_status,
               cast(o_orderkey % 100 as double) / 100 as label_confidence,
               concat('lot-', cast(o_custkey as string)) as address_stub, o_totalprice as price, o_orderdate as opened
        from orders join customer on o_custkey = c_custkey""",
    "fx_runtime": f"""
        select case_id, k, ck,
               {choose('(k + case when ck % 5 = 0 then 1 else 0 end) % 7', PATHWAYS)} as predicted_pathway,
               gold_stage1_complete or ck % 6 = 0 as stage1_complete,
               concat_ws({NL}, '# Memo', case when k % 19 = 0 then '## Gaps' end, '## Triage', 'NEEDS-CLARIFICATION',
                 case when k % 13 <> 0 then '## Applicable bylaws' end,
                 concat('- BR-N', cast(ck % 25 as string), case when k % 17 = 0 then ' and BR-N99' else '' end),
                 '##  Evidence  ', case when k % 29 = 0 then 'For the rest see Gaps.' else 'Plain facts.' end,
                 case when k % 19 <> 0 and k % 29 <> 0 then '## Gaps ##' end, 'None.', '## Recommendation', 'Go on.') as memo_markdown,
               concat_ws({NL}, '# Letter', '## Summary', case when k % 23 = 0 then 'See BR-N1.' else 'All fine.' end,
                 '## What to fix before resubmitting', '- Nothing.', '## Optional improvements', 'None at this stage.',
                 case when k % 31 <> 0 then '## Next step' end, 'Send it again.') as letter_markdown
        from fx_case""",
    "fx_gold": f"""
        select {case_key('l_orderkey')} as case_id, row_number() over ({LINE_ORDER}) - 1 as pos, {BRAND} as bylaw_id
        from lineitem join part on l_partkey = p_partkey where cast(l_quantity as int) % 5 <> 0""",
    "fx_cited": f"""
        select {case_key('l_orderkey')} as case_id, row_number() over ({LINE_ORDER}) - 1 as seq,
               case when l_partkey % 61 = 0 then 'BR-N99' else {BRAND} end as bylaw_id
        from lineitem join part on l_partkey = p_partkey where cast(l_quantity as int) % 7 <> 0""",
    "fx_corpus": f"select distinct {BRAND} as bylaw_id from part",
    "fx_evidence_map": f"""
        select distinct {BRAND} as bylaw_id, concat('key-', cast(p_size % 4 as string)) as evidence_key
        from part where p_size % 4 < cast(substr(p_brand, 7) as int) % 5""",
    "fx_evidence": f"""
        select distinct {case_key('l_orderkey')} as case_id, {BRAND} as bylaw_id, concat('key-', cast(l_suppkey % 4 as string)) as evidence_key
        from lineitem join part on l_partkey = p_partkey where l_discount < 0.08""",
    "fx_truth": f"""
        select {choose('n - 1', GAPS)} as gap_id, concat('f', cast(n as string), '_proposed') as proposed_field,
               concat('f', cast(n as string), '_required') as required_field, cast(0.01 as double) as tolerance, 'm' as unit
        from (select distinct p_size % 5 + 1 as n from part) sizes""",
    "fx_gold_gap": f"""
        select distinct {case_key('l_orderkey')} as case_id, {LINE_GAP} as gap_id from lineitem where l_returnflag = 'R'""",
    "fx_gold_gap_repeated": f"""
        select {case_key('l_orderkey')} as case_id, {LINE_GAP} as gap_id from lineitem where l_returnflag = 'R'""",
    "fx_packet_number": f"""
        select {case_key('l_orderkey')} as case_id, concat('f', cast(l_linenumber as string), '_proposed') as field,
               min(l_quantity) - l_linenumber as value
        from lineitem group by l_orderkey, l_linenumber having min(l_suppkey) % 13 <> 0
        union all
        select {case_key('l_orderkey')} as case_id, concat('f', cast(l_linenumber as string), '_required') as field, min(l_quantity) as value
        from lineitem group by l_orderkey, l_linenumber""",
    "fx_reported_gap": f"""
        select {case_key('l_orderkey')} as case_id, row_number() over ({LINE_ORDER}) - 1 as seq, {LINE_GAP} as gap_id,
               l_quantity - l_linenumber + case when l_partkey % 3 = 0 then 1 else 0 end as proposed_value,
               l_quantity as required_value, cast(l_linenumber as double) as delta
        from lineitem where l_returnflag <> 'A' or l_linestatus = 'F'""",
    "fx_redline": f"""
        select {case_key('l_orderkey')} as case_id, row_number() over ({LINE_ORDER}) - 1 as seq, {LINE_GAP} as addresses_gap,
               case when l_partkey % 31 = 0 then 'BR-N99' else {BRAND} end as cited_bylaw_id,
               case when l_suppkey % 9 = 0 then 'absent.path' else concat('f', cast(l_linenumber as string), '_required') end as field
        from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R' or l_suppkey % 10 = 0""",
    "fx_redline_checked": """
        select r.case_id, r.seq, r.addresses_gap, r.cited_bylaw_id, p.field is not null as field_exists
        from fx_redline r left join fx_packet_number p on r.case_id = p.case_id and r.field = p.field""",
    "fx_gold_missing": f"""
        select distinct {case_key('l_orderkey')} as case_id, {choose('l_partkey % 4', DOCUMENTS)} as document_id
        from lineitem where l_returnflag = 'A' and l_discount >= 0.08""",
    "fx_missing": f"""
        select distinct {case_key('l_orderkey')} as case_id, {choose('l_partkey % 4', DOCUMENTS)} as document_id
        from lineitem where l_returnflag = 'A' and l_discount >= 0.08 and l_suppkey % 8 <> 0""",
    "fx_gold_flag": f"""
        select {case_key('l_orderkey')} as case_id, {choose('l_linenumber - 1', FLAGS)} as flag
        from lineitem where l_discount >= 0.07""",
    "fx_flag": f"""
        select {case_key('l_orderkey')} as case_id, case when l_suppkey % 17 = 0 then 'tone-odd' else {choose('l_linenumber - 1', FLAGS)} end as flag
        from lineitem where l_discount >= 0.06""",
    "fx_redline_score": """
        select case_id, seq, case when seq % 11 = 10 then null else cast(seq % 5 as double) / 4 end as score from fx_redline""",
    "fx_text_score": """
        select case_id, 'staff' as audience, cast(k % 9 as double) / 8 as score from fx_case
        union all
        select case_id, 'applicant' as audience, case when k % 47 = 0 then null else cast(ck % 7 as double) / 6 end as score from fx_case""",
    # facts of many values: nearly all fingerprints differ
    "fx_scenario": """
        select case_id, domain, split,
               concat('vec:zone=R1-', cast(ck % 4 as string), '|units=', cast(k % 6 as string), '|lot=', cast(ck % 9 as string),
                 '|fsr=', cast(cast(floor(price / 100) as bigint) % 7 as string), '|rear-setback=', cast(cast(floor(price / 10) as bigint) % 5 as string),
                 '|side-setback=', cast(ck % 3 as string), '|parking=', cast(k % 5 as string), '|height=', cast(cast(floor(price) as bigint) % 4 as string),
                 '|energy-step=', cast(k % 3 as string), '|stage1-missing=', cast(ck % 5 as string), '|trap-families=', coalesce(edge_case_family, 'none'),
                 '|outcome=', outcome_class, '|gap-severity=', gap_severity_bucket, '|applicant-type=', applicant_type) as scenario_fingerprint
        from fx_case""",
    # facts of few values: many copies of few fingerprints
    "fx_scenario_coarse": """
        select case_id, domain, split,
               concat('vec:zone=R', cast(ck % 2 as string), '|units=', cast(k % 3 as string), '|lot=', cast(ck % 4 as string),
                 '|fsr=', cast(k % 3 as string), '|rear-setback=', cast((ck + 1) % 4 as string), '|side-setback=0|parking=', cast(k % 7 as string),
                 '|height=1|energy-step=', cast(ck % 2 as string), '|stage1-missing=none|trap-families=', cast(k % 3 as string),
                 '|outcome=', cast((k + ck) % 2 as string), '|gap-severity=', cast(k % 7 as string), '|applicant-type=', cast(ck % 4 as string)) as scenario_fingerprint
        from fx_case""",
    "fx_few_shot": f"""
        select concat('fs-', cast(o_custkey as string)) as few_shot_id, {choose('o_custkey % 6', AGENTS)} as agent,
               {case_key('o_orderkey')} as case_id, o_orderkey as pos
        from orders where o_orderpriority = '1-URGENT'""",
    "fx_round_score": """
        select cast(year(opened) * 12 + month(opened) - 23941 as bigint) as round, case_id, k, ck, domain,
               cast((k * 7 + ck * 13) % 101 as double) / 101 as m1, cast((k * 3 + ck) % 97 as double) / 97 as m3,
               cast((k * 5 + ck * 11 + month(opened) * 17) % 89 as double) * 100 / 89 as score
        from fx_case""",
    "fx_agent_event": f"""
        select cast(user_id as string) as run_id, event_id as seq, {choose('event_id % 6', AGENTS)} as agent_id,
               case event_type when 'purchase' then 'Completed' when 'error' then case when event_id % 5 = 0 then 'ERRORED' else 'pending' end
                    when 'click' then 'ok' when 'view' then 'working' else 'success' end as status,
               concat('{{"k":', cast(event_id % 97 as string),
                 case when event_id % 3 = 0 then concat(',"summary":"s', cast(event_id as string), '"') else '' end,
                 case when event_id % 4 = 0 then concat(',"elapsedSeconds":', cast(event_id % 50 as string)) else '' end,
                 case when event_id % 7 = 0 then concat(',"label":"L', cast(event_id % 11 as string), '"') else '' end, '}}') as payload,
               ts, event_type
        from events""",
    "fx_attempt": """
        select cast(user_id as string) as request_id, row_number() over (partition by user_id order by event_id) as attempt,
               event_id, event_type, value, props from events""",
    "fx_packet": f"""
        select case_id, domain, k, ck, split, outcome_class, gap_severity_bucket, edge_case_family, address_stub,
               case when k % 9 = 0 then 'R1-2' else 'R1-1' end as zoning_district, 'multiplex' as project_type,
               cast(1 + k % 8 as double) as units_proposed, 300 + cast(ck % 400 as double) as lot_area_sqm,
               cast(80 + ck % 45 as double) / 100 as fsr_proposed, cast(1 as double) as fsr_allowed,
               cast(15 + k % 20 as double) / 10 as rear_setback_m, cast(2.4 as double) as rear_setback_required_m,
               cast(9 + ck % 7 as double) / 10 as side_setback_m, cast(1.2 as double) as side_setback_required_m,
               cast(95 + k % 25 as double) / 10 as height_proposed_m, cast(10.7 as double) as height_allowed_m,
               cast(k % 6 as double) as parking_spaces_proposed, cast(3 as double) as parking_spaces_required,
               cast(1 + ck % 5 as double) as energy_step_code_proposed, cast(3 as double) as energy_step_code_required,
               k % 2 = 0 as in_ptaa, ck % 23 = 0 as heritage_overlay, ck % 29 = 0 as floodplain_overlay, ck % 31 = 0 as tod_overlay,
               applicant_type, cast(k % 3 as int) as prior_permits, case when ck % 6 = 0 then 'pa' else 'en' end as language_preference,
               case when k % 3 = 0 then 1 else 0 end as d0, case when k % 4 <> 0 then 1 else 0 end as d1, case when ck % 5 <> 0 then 1 else 0 end as d2,
               case when ck % 3 <> 0 then 1 else 0 end as d3, case when k % 11 <> 0 then 1 else 0 end as d4, case when ck % 2 = 0 then 1 else 0 end as d5,
               case when k % 5 <> 0 then 1 else 0 end as d6
        from fx_case""",
    "fx_doc": f"""
        select doc_id, lang, source, text,
               concat_ws({NL}, case when doc_id % 6 = 5 then '## Gaps' end, '## Triage', text,
                 case when doc_id % 7 <> 0 then '## Applicable bylaws' end, concat('ZDB-R1-', cast(doc_id % 9 as string), ' per BR-N', cast(doc_id % 25 as string)),
                 '## Evidence', '## Gaps', case when doc_id % 5 = 0 then 'see  Recommendation' else 'none' end,
                 case when doc_id % 10 <> 0 then '## Recommendation  ##' end, 'end') as memo_markdown,
               concat_ws({NL}, '## Summary', text, '## What to fix before resubmitting', '## Optional improvements',
                 case when doc_id % 8 <> 3 then '## Next step' end, case when doc_id % 12 = 1 then 'as BR-N3 says' end) as letter_markdown
        from documents""",
}
