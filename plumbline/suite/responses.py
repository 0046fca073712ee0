"""Model request and response tables built from events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalar as S
from plumbline.operators import responses as R
from plumbline.suite.registry import load, query


@query("scorer_view", "select case_id, address_stub, concat('{\"k\":', cast(k as string), '}') as application_packet from fx_case")
def scorer_view(spark: SparkSession, root: str) -> DataFrame:
    """PF1."""
    return R.scorer_view(load(spark, root, "select *, concat('{\"k\":', cast(k as string), '}') as application_packet from fx_case"))


@query("case_summaries", """
 select case_id, concat('{"case_id":"', case_id, '","domain":"', domain, '","pathway_class":"', pathway_class, '","outcome_class":"', outcome_class, '","gap_severity_bucket":"', gap_severity_bucket,
   '","edge_case_family":', case when edge_case_family is null then 'null' else concat('"', edge_case_family, '"') end, ',"address_stub":"', address_stub, '","application_packet":{"k":', cast(k as string), '}}') as summary
 from fx_case""")
def case_summaries(spark: SparkSession, root: str) -> DataFrame:
    """PF7."""
    rows = load(spark, root, "select *, concat('{\"k\": ', cast(k as string), '}') as application_packet from fx_case")
    return rows.select("case_id", R.case_summary().alias("summary"))


# Replies as a model wraps them: fenced, in prose, plain, cut, or empty.
REPLIES = """select event_id, case event_id % 6 when 0 then concat('Sure. ```json ', props, ' ``` done') when 1 then concat('The answer is ', props, ' as asked') when 2 then concat('  ', props, ' ')
   when 3 then 'no object here' when 4 then concat('``` ', props, '```') else concat('}', props) end as reply, props from events"""


@query("json_from_text", f"""
 with r as ({REPLIES}) select event_id, case when event_id % 6 = 3 then 'no object here' when event_id % 6 = 5 then props else props end as payload from r""")
def json_from_text(spark: SparkSession, root: str) -> DataFrame:
    """FN16."""
    return load(spark, root, REPLIES).select("event_id", S.json_object_text(F.col("reply")).alias("payload"))


SCORES = """select event_id, case event_id % 8 when 0 then '{"score":0.5,"rationale":"fine"}' when 1 then '{"score":1,"rationale":"top"}' when 2 then '{"score":1.2,"rationale":"over"}' when 3 then '{"score":"0.5","rationale":"text"}'
   when 4 then '{"score":0.25,"rationale":""}' when 5 then '{"score":0.25}' when 6 then '{"score":0,"rationale":"none"}' else 'broken' end as payload from events"""


@query("score_payloads", """
 select event_id, case event_id % 8 when 0 then 0.5 when 1 then 1.0 when 6 then 0.0 end as score, case event_id % 8 when 0 then 'fine' when 1 then 'top' when 6 then 'none' end as rationale from events""")
def score_payloads(spark: SparkSession, root: str) -> DataFrame:
    """FN17."""
    return load(spark, root, SCORES).select("event_id", S.valid_score_payload(F.col("payload")).alias("p")).select("event_id", "p.score", "p.rationale")


JUDGE_OUT = """select event_id, case event_id % 8
   when 0 then concat('{"testResults":[{"modelResponse":"I say {\\\\"score\\\\":0.', cast(event_id % 10 as string), ',\\\\"rationale\\\\":\\\\"r\\\\"} so"}]}')
   when 1 then concat('{"score":0.', cast(event_id % 10 as string), ',"rationale":"direct"}')
   when 2 then concat('{"other":{"deep":["x","the {\\\\"score\\\\":0.', cast(event_id % 10 as string), ',\\\\"rationale\\\\":\\\\"deep\\\\"}"]}}')
   when 3 then '{"testResults":[{"modelResponse":"{\\\\"score\\\\":7,\\\\"rationale\\\\":\\\\"bad\\\\"}"},{"modelResponse":"{\\\\"score\\\\":0.75,\\\\"rationale\\\\":\\\\"second\\\\"}"}]}'
   when 4 then '{"testResults":[{"modelResponse":5}],"score":0.5,"rationale":"top level"}' when 5 then 'not json {"score":0.5,"rationale":"x"}' when 6 then '{"testResults":[]}' else '' end as stdout from events"""


@query("judge_responses", """
 select event_id, case event_id % 8 when 0 then event_id % 10 / 10.0 when 1 then event_id % 10 / 10.0 when 2 then event_id % 10 / 10.0 when 3 then 0.75 when 4 then 0.5 end as score,
   case event_id % 8 when 0 then 'r' when 1 then 'direct' when 2 then 'deep' when 3 then 'second' when 4 then 'top level' end as rationale from events""")
def judge_responses(spark: SparkSession, root: str) -> DataFrame:
    """EXT2."""
    rows = load(spark, root, JUDGE_OUT).select("event_id", R.parsed_judgement(F.col("stdout")).alias("p"))
    return rows.select("event_id", "p.score", "p.rationale")


ATTEMPTS = """select request_id, cast(attempt as int) as attempt, event_id, case event_id % 9 when 0 then '' when 1 then 'prose only' when 2 then 'x' when 3 then 'y' else concat('ok ', props) end as stdout,
   case event_id % 9 when 2 then 'HTTP 429' when 3 then 'HTTP 4290' else '' end as stderr, case when event_id % 9 in (2, 3) then 1 when event_id % 9 in (4, 5) then cast(null as int) else 0 end as status,
   case when event_id % 9 = 5 then 'SIGKILL' end as signal, case event_id % 9 when 4 then 'ETIMEDOUT' when 6 then 'ENOENT' end as spawn_error, props from fx_attempt"""
STAGE_SQL = "case event_id % 9 when 4 then 'timeout' when 6 then 'spawn' when 2 then 'exit' when 3 then 'exit' when 5 then 'exit' when 0 then 'parse' when 1 then 'parse' else 'ok' end"


@query("attempt_stages", f"""select request_id, attempt, {STAGE_SQL} as stage, event_id % 9 in (0, 1, 2) as retry from fx_attempt""")
def attempt_stages(spark: SparkSession, root: str) -> DataFrame:
    """EXT3: error class of each attempt."""
    return R.classify_attempts(load(spark, root, ATTEMPTS)).select("request_id", "attempt", "stage", "retry")


@query("resolved_attempts", f"""
 with a as (select request_id, attempt, {STAGE_SQL} as stage, event_id % 9 in (0, 1, 2) as retry, props from fx_attempt where attempt <= 3),
 p as (select *, row_number() over (partition by request_id order by case when retry then 1 else 0 end, case when retry then -attempt else attempt end) as n from a)
 select request_id, stage = 'ok' as ok, stage, attempt as attempts, case when stage = 'ok' then props end as payload from p where n = 1""")
def resolved_attempts(spark: SparkSession, root: str) -> DataFrame:
    """WN4: first attempt that may not be retried, else the last one."""
    return R.resolve_attempts(R.classify_attempts(load(spark, root, ATTEMPTS)))


@query("last_replies", """
 select conv_id, max(turn) as turn, max_by(text, turn) as reply from conversations where role = 'assistant' group by conv_id""")
def last_replies(spark: SparkSession, root: str) -> DataFrame:
    """The last assistant turn of each conversation: the reply a response table keeps."""
    rows = load(spark, root, "conversations").filter(F.col("role") == "assistant")
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("reply"))


STAGE_OUTPUTS = """
 select case_id, k, 'scope-pathway-classifier' as agent, k % 41 <> 3 as ok, case when k % 41 = 3 then 'exit' end as reason,
   concat('{"pathway":"', pathway_class, '","confidence":', case when k % 8 = 0 then '1.5' else '0.9' end, ',"rationale":"', case when k % 9 = 0 then '' else 'r' end, '","routing":"staff-pre-review"', case when k % 10 = 0 then ',"extra":1' else '' end, '}') as output from fx_case
 union all select case_id, k, 'bylaw-retriever', k % 43 <> 3, case when k % 43 = 3 then 'parse' end, case when k % 7 = 0 then '{"cited_bylaw_ids":"B"}' else concat('{"cited_bylaw_ids":["B', cast(k as string), '"],"snippet_pack":[]}') end from fx_case
 union all select case_id, k, 'compliance-evidence-compiler', true, null, '{"evidence_fields_by_bylaw":{"B":["x"]},"numeric_gaps":[],"incomplete_reasons":[]}' from fx_case where k % 31 <> 5
 union all select case_id, k, 'completeness-applicant-support-auditor', k % 47 <> 1, case when k % 47 = 1 then 'timeout' end, '{"stage1_complete":true,"stage1_missing":[],"applicant_support_flags":["f"],"equity_notes":[]}' from fx_case
 union all select case_id, k, 'redline-generator', true, null, concat('{"redlines":[{"field":"a.b","addresses_gap":"g","cited_bylaw_id":"B","rationale":"r","current_value":', cast(k as string), ',"proposed_value":"x"}]}') from fx_case
 union all select case_id, k, 'pre-review-memo-writer', k % 53 <> 2, case when k % 53 = 2 then 'spawn' end, concat('{"outcome":"', case when k % 6 = 0 then 'done' else outcome_class end, '","memo_markdown":"m","letter_markdown":"l"}') from fx_case"""


@query("stage_contract_errors", """
 select case_id, 'scope-pathway-classifier' as agent, 'unexpected extra' as error from fx_case where k % 10 = 0 union all
 select case_id, 'scope-pathway-classifier', 'confidence has a bad value' from fx_case where k % 8 = 0 union all
 select case_id, 'scope-pathway-classifier', 'rationale has a bad value' from fx_case where k % 9 = 0 union all
 select case_id, 'bylaw-retriever', 'missing snippet_pack' from fx_case where k % 7 = 0 union all select case_id, 'bylaw-retriever', 'cited_bylaw_ids is not array' from fx_case where k % 7 = 0 union all
 select case_id, 'pre-review-memo-writer', 'outcome has a bad value' from fx_case where k % 6 = 0""")
def stage_contract_errors(spark: SparkSession, root: str) -> DataFrame:
    """EXT4."""
    checked = R.check_contracts(load(spark, root, STAGE_OUTPUTS))
    # outer: a plain explode would have Spark put a filter on the errors in front, which works them out again
    return checked.select("case_id", "agent", F.explode_outer("errors").alias("error")).filter(F.col("error").isNotNull())


@query("stitched_failures", """
 select case_id, case when k % 41 = 3 then 'scope-pathway-classifier' when k % 43 = 3 then 'bylaw-retriever' when k % 31 = 5 then 'compliance-evidence-compiler'
   when k % 47 = 1 then 'completeness-applicant-support-auditor' else 'pre-review-memo-writer' end as failed_agent,
   case when k % 41 = 3 then 'exit' when k % 43 = 3 then 'parse' when k % 31 = 5 then 'no output' when k % 47 = 1 then 'timeout' else 'spawn' end as reason
 from fx_case where k % 41 = 3 or k % 43 = 3 or k % 31 = 5 or k % 47 = 1 or k % 53 = 2""")
def stitched_failures(spark: SparkSession, root: str) -> DataFrame:
    """JN13: first failing stage in dependency order."""
    return R.stitch_payloads(load(spark, root, "fx_case"), load(spark, root, STAGE_OUTPUTS))[1]


@query("stitched_payloads", """
 select case_id, pathway_class as predicted_pathway, case when k % 6 = 0 then 'done' else outcome_class end as predicted_outcome, case when k % 7 = 0 then null else concat('B', cast(k as string)) end as first_citation,
   'x' as evidence, true as stage1_complete, 'f' as flag, cast(k as string) as current_value
 from fx_case where not (k % 41 = 3 or k % 43 = 3 or k % 31 = 5 or k % 47 = 1 or k % 53 = 2)""")
def stitched_payloads(spark: SparkSession, root: str) -> DataFrame:
    out = R.stitch_payloads(load(spark, root, "fx_case"), load(spark, root, STAGE_OUTPUTS))[0]
    return out.select(
        "case_id", "predicted_pathway", "predicted_outcome", F.get("cited_bylaw_ids", F.lit(0)).alias("first_citation"),
        F.col("evidence_fields_by_bylaw")["B"][0].alias("evidence"), "stage1_complete", F.col("applicant_support_flags")[0].alias("flag"),
        F.col("redlines")[0]["current_value"].alias("current_value"),
    )


@query("judge_request_counts", """
 with v as (select r.case_id from fx_redline_checked r join fx_corpus k on k.bylaw_id = r.cited_bylaw_id join fx_gold_gap g on g.case_id = r.case_id and g.gap_id = r.addresses_gap where r.field_exists),
 q as (select case_id, 'redline' as kind from v union all select case_id, 'staff' from fx_runtime union all select case_id, 'applicant' from fx_runtime)
 select q.case_id, q.kind, count(*) as n, any_value(concat('"domain":"', c.domain, '"')) as context_part from q join fx_case c on c.case_id = q.case_id group by 1, 2""")
def judge_request_counts(spark: SparkSession, root: str) -> DataFrame:
    """EXT1: one request per valid redline, memo and letter, with the case context."""
    cases = load(spark, root, "select *, concat('{\"k\":', cast(k as string), '}') as application_packet from fx_case")
    valid = load(spark, root, """
        select r.case_id, r.seq, concat('{"addresses_gap":"', r.addresses_gap, '"}') as redline from fx_redline_checked r join fx_corpus k on k.bylaw_id = r.cited_bylaw_id
        join fx_gold_gap g on g.case_id = r.case_id and g.gap_id = r.addresses_gap where r.field_exists""")
    runtime = load(spark, root, "fx_runtime")
    texts = runtime.select("case_id", F.inline(F.array(
        F.struct(F.lit("staff").alias("audience"), F.col("memo_markdown").alias("text")),
        F.struct(F.lit("applicant").alias("audience"), F.col("letter_markdown").alias("text")),
    )))
    part = F.regexp_extract("case_context", r'("domain":"[^"]*")', 1)
    return R.request_counts(cases, valid.withColumn("seq", F.col("seq").cast("int")), texts, part)


@query("reference_bodies", """
 with w as (select case_id, domain, 0 as pos, concat('memo-', cast(ck % 9 as string)) as id from fx_case union all select case_id, domain, 1, concat('memo-', cast(k % 4 as string)) from fx_case),
 o as (select distinct domain, concat('memo-', cast(ck % 6 as string)) as id, concat('body of ', cast(ck % 6 as string)) as body from fx_case)
 select w.case_id, string_agg(concat(w.id, '=', coalesce(o.body, '?')), ';' order by w.pos) as refs from w left join o on o.domain = w.domain and o.id = w.id group by 1""")
def reference_bodies(spark: SparkSession, root: str) -> DataFrame:
    """JN11: reference texts in id-list order."""
    cases = load(spark, root, "fx_case").select("case_id", "domain", F.array(
        F.concat(F.lit("memo-"), (F.col("ck") % 9).cast("string")), F.concat(F.lit("memo-"), (F.col("k") % 4).cast("string"))).alias("reference_memo_ids"))
    outputs = load(spark, root, "select distinct domain, concat('memo-', cast(ck % 6 as string)) as id, concat('body of ', cast(ck % 6 as string)) as body from fx_case")
    text = F.array_join(F.transform("references", lambda r: F.concat(r["id"], F.lit("="), F.coalesce(r["body"], F.lit("?")))), ";")
    return R.reference_bodies(cases, outputs, "reference_memo_ids").select("case_id", text.alias("refs"))


LETTERS = """select cast(doc_id as string) as case_id, doc_id, concat_ws(chr(10), case when doc_id % 3 = 0 then 'FSR and setbacks' end, text, case when doc_id % 3 = 0 then 'PTAA fascia' end,
   case when doc_id % 4 = 1 then 'fsr, FSR (setback) ptaa.' end, '## Next step', case when doc_id % 5 = 0 then 'We will be in touch.' else 'Send it again.' end,
   case when doc_id % 6 = 0 then 'See ZDB-R1-2.' end, concat('now 1.', cast(doc_id % 7 as string), ' limit 1.5')) as letter from documents"""


@query("letter_flags", r"""
 with l as (select * from (""" + LETTERS + r""")),
 w as (select case_id, unnest(regexp_split_to_array(trim(letter, ' ' || chr(9) || chr(10) || chr(13)), '\s+')) as word, generate_subscripts(regexp_split_to_array(trim(letter, ' ' || chr(9) || chr(10) || chr(13)), '\s+'), 1) as i from l),
 h as (select case_id, i, lead(i, 3) over (partition by case_id order by i) as fourth from w where regexp_matches(word, '(?i)\b(FSR|PTAA|setback|fascia)s?\b')),
 j as (select distinct case_id from h where fourth - i < 200)
 select l.case_id, l.case_id in (select case_id from j) as jargon, l.doc_id % 5 = 0 as vague, len(regexp_extract_all(letter, '\b[A-Z]{2,4}-[A-Z]?[0-9]+(?:-[A-Z0-9]+)*\b')) > 0 as leaked,
   not (contains(letter, concat('1.', cast(doc_id % 7 as string))) and contains(letter, case when doc_id % 2 = 0 then '1.5' else '9.87654' end)) as unquantified from l""")
def letter_flags(spark: SparkSession, root: str) -> DataFrame:
    """EXT5: the detectors with a countable rule, over whole letters."""
    letters = load(spark, root, LETTERS)
    gaps = letters.select("case_id", F.concat(F.lit("1."), (F.col("doc_id") % 7).cast("string")).alias("proposed"),
                          F.when(F.col("doc_id") % 2 == 0, "1.5").otherwise("9.87654").alias("required"))
    out = R.letter_flags(letters.select("case_id", "letter"), gaps)
    return out.select(
        "case_id", F.col("`jargon-density-high`").alias("jargon"), F.col("`next-step-ambiguous`").alias("vague"),
        F.col("`bylaw-citation-leaked-to-applicant`").alias("leaked"), F.col("`numeric-gap-not-quantified`").alias("unquantified"),
    )
