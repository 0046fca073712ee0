"""Tables of model requests and responses: request batches, response parsing, contracts, stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions import documents as D
from plumbline.functions import scalar as S
from plumbline.operators.joins import salted_join

MAX_ATTEMPTS = 3

# The fields a scorer's context may show; gold labels are not among them.
SUMMARY_FIELDS = [
    "case_id", "domain", "pathway_class", "outcome_class", "gap_severity_bucket",
    "edge_case_family", "address_stub", "application_packet",
]
SCORER_FIELDS = ["case_id", "address_stub", "application_packet"]


def scorer_view(cases: DataFrame) -> DataFrame:
    """Strict projection of the fields a scorer may see."""
    view = cases.select(*SCORER_FIELDS)
    if any(c.startswith("gold") or "label" in c for c in view.columns):
        raise ValueError("gold labels may not reach a scorer")
    return view


def case_summary() -> Column:
    """Case context as JSON; nulls are kept, the packet (json text) is nested as a document."""
    fields = [F.try_parse_json(F.col(c)).alias(c) if c == "application_packet" else F.col(c) for c in SUMMARY_FIELDS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def reference_bodies(cases: DataFrame, outputs: DataFrame, ids: str) -> DataFrame:
    """Reference outputs of a case in id-list order: array of (id, body). An unknown id keeps a null body."""
    wanted = cases.select("case_id", "domain", F.posexplode(ids).alias("pos", "id"))
    found = salted_join(wanted, outputs.select("domain", "id", "body"), ["domain", "id"], "left")
    return found.groupBy("case_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "id", "body"))), lambda x: F.struct(x["id"].alias("id"), x["body"].alias("body"))
        ).alias("references")
    )


def case_contexts(cases: DataFrame) -> DataFrame:
    """(case_id, case_context) of every case."""
    return cases.select("case_id", case_summary().alias("case_context"))


def request_rows(redlines: DataFrame, texts: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """One row per valid redline, per memo and per letter, without the case context. Arguments as in ``judge_requests``."""
    redline_rows = redlines.select(
        "case_id", F.lit("redline").alias("kind"), "seq", F.col("redline").alias("artifact"), F.lit("[]").alias("references")
    )
    text_rows = texts
    if references is not None:
        text_rows = texts.join(references, ["case_id", "audience"], "left")
    else:
        text_rows = texts.withColumn("references", F.lit("[]"))
    text_rows = text_rows.select(
        "case_id", F.col("audience").alias("kind"), F.lit(0).alias("seq"), F.col("text").alias("artifact"),
        F.coalesce("references", F.lit("[]")).alias("references"),
    )
    return redline_rows.unionByName(text_rows)


def judge_requests(cases: DataFrame, redlines: DataFrame, texts: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """One request row per valid redline, per memo and per letter.

    ``redlines``: case_id, seq, redline (json), already valid; ``texts``: case_id, audience, text;
    ``references``: case_id, audience, references (json).
    """
    return request_rows(redlines, texts, references).join(case_contexts(cases), "case_id")


def request_counts(cases: DataFrame, redlines: DataFrame, texts: DataFrame, part: Column) -> DataFrame:
    """(case_id, kind, n, context_part) of the requests that ``judge_requests`` makes; ``part`` is an expression over case_context.

    Requests are counted and the part is cut out before they meet, so no task sorts contexts or artifacts.
    """
    counts = request_rows(redlines, texts).groupBy("case_id", "kind").agg(F.count(F.lit(1)).alias("_n"))
    parts = case_contexts(cases).select("case_id", part.alias("_part"))
    # a case that is listed twice makes every request twice
    parts = parts.groupBy("case_id").agg(F.count(F.lit(1)).alias("_cases"), F.min("_part").alias("context_part"))
    return counts.join(parts, "case_id").select("case_id", "kind", (F.col("_n") * F.col("_cases")).alias("n"), "context_part")


def parsed_judgement(stdout: Column) -> Column:
    """(score, rationale) of a judge response, null if none is valid.

    Tried in order: the envelope's model responses, the document itself, any string that mentions a score.
    """
    envelope = F.from_json(stdout, "struct<testResults:array<struct<modelResponse:variant>>>")
    replies = F.transform(
        F.filter(F.coalesce(envelope["testResults"], F.from_json(F.lit("[]"), "array<struct<modelResponse:variant>>")),
                 lambda e: F.schema_of_variant(e["modelResponse"]) == "STRING"),
        lambda e: F.try_variant_get(e["modelResponse"], "$", "string"),
    )
    is_document = F.try_parse_json(stdout).isNotNull()
    candidates = F.concat(
        F.transform(replies, S.brace_slice), F.array(stdout), F.transform(D.score_strings(stdout), S.brace_slice)
    )
    valid = F.filter(F.transform(F.array_compact(candidates), S.valid_score_payload), lambda p: p.isNotNull())
    return F.when(is_document, F.get(valid, F.lit(0)))


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """Stage of each attempt (ok, timeout, spawn, exit, parse) and whether it may be retried.

    ``attempts``: request_id, attempt, stdout, stderr, status, signal, spawn_error.
    """
    payload = S.json_object_text(F.col("stdout"))
    stage = (
        F.when(F.col("spawn_error") == "ETIMEDOUT", "timeout")
        .when(F.col("spawn_error").isNotNull(), "spawn")
        .when(F.coalesce(F.col("status") != 0, F.lit(True)) | F.col("signal").isNotNull(), "exit")
        .when(F.coalesce(F.trim("stdout"), F.lit("")) == "", "parse")
        .when(F.try_parse_json(payload).isNull(), "parse")
        .otherwise("ok")
    )
    output = F.concat_ws("\n", "stderr", "stdout")
    throttled = output.rlike(r"(^|[^0-9])429([^0-9]|$)")
    return attempts.withColumn("stage", stage).withColumn(
        "retry", (F.col("stage") == "parse") | ((F.col("stage") == "exit") & throttled)
    ).withColumn("payload", F.when(F.col("stage") == "ok", payload))


def resolve_attempts(classified: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The attempt that decides each request: the first that may not be retried, else the last one allowed.

    A min/max aggregate per request, so no request is sorted.
    """
    used = classified.filter(F.col("attempt") <= max_attempts)
    body = F.struct("attempt", "stage", "payload")
    return used.groupBy("request_id").agg(
        F.coalesce(
            F.min_by(body, F.when(~F.col("retry"), F.col("attempt"))), F.max_by(body, F.col("attempt"))
        ).alias("r")
    ).select("request_id", (F.col("r.stage") == "ok").alias("ok"), F.col("r.stage").alias("stage"),
             F.col("r.attempt").alias("attempts"), F.col("r.payload").alias("payload"))


# --- stage contracts -------------------------------------------------------------------------------------

_JSON = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def _typed(document: Column, key: str, kind: str) -> Column:
    """Whether a top-level key of a parsed document holds a value of the JSON type."""
    shape = F.schema_of_variant(F.try_variant_get(document, f"$.{key}", "variant"))
    return F.coalesce(shape.rlike(_JSON[kind]), F.lit(False))


# Keys and types of each stage's output ("?" marks an optional key).
CONTRACTS = {
    "scope-pathway-classifier": {"pathway": "string", "confidence": "number", "rationale": "string", "routing": "string"},
    "bylaw-retriever": {"cited_bylaw_ids": "array", "snippet_pack": "array"},
    "compliance-evidence-compiler": {"evidence_fields_by_bylaw": "object", "numeric_gaps": "array", "incomplete_reasons?": "array"},
    "redline-generator": {"redlines": "array"},
    "completeness-applicant-support-auditor": {
        "stage1_complete": "boolean", "stage1_missing": "array", "applicant_support_flags": "array", "equity_notes": "array",
    },
    "pre-review-memo-writer": {"outcome": "string", "memo_markdown": "string", "letter_markdown": "string"},
}


def contract_errors(output: Column, agent: str, keys: Column, document: Column) -> Column:
    """Array of contract violations of one stage's output: keys, types, value ranges.

    ``keys`` and ``document`` are the output's top-level keys and the parsed output, see ``check_contracts``.
    """
    fields = CONTRACTS[agent]
    required = [k for k in fields if not k.endswith("?")]
    allowed = [k.rstrip("?") for k in fields]
    problems = [
        F.transform(F.array_except(S.lit_array(required), keys), lambda k: F.concat(F.lit("missing "), k)),
        F.transform(F.array_except(keys, S.lit_array(allowed)), lambda k: F.concat(F.lit("unexpected "), k)),
    ]
    found = []
    for name, kind in fields.items():
        key = name.rstrip("?")
        found.append(F.when(F.array_contains(keys, key) & ~_typed(document, key, kind), F.lit(f"{key} is not {kind}")))
    text = lambda key: F.get_json_object(output, f"$.{key}")
    rules = {
        "scope-pathway-classifier": [
            ("pathway", text("pathway").isin(V.PATHWAYS)), ("confidence", text("confidence").try_cast("double").between(0, 1)),
            ("rationale", F.length(text("rationale")) > 0), ("routing", text("routing").isin(V.ROUTINGS)),
        ],
        "pre-review-memo-writer": [("outcome", text("outcome").isin(V.OUTCOMES))],
    }.get(agent, [])
    for key, ok in rules:
        found.append(F.when(F.array_contains(keys, key) & ~F.coalesce(ok, F.lit(False)), F.lit(f"{key} has a bad value")))
    return F.concat(*problems, F.array_compact(F.array(*found)))


def check_contracts(outputs: DataFrame) -> DataFrame:
    """Adds ``errors`` to stage outputs (case_id, agent, output). An output's keys are read once and it is parsed once."""
    errors = F.array(F.lit("unknown agent"))
    for agent in CONTRACTS:
        checked = contract_errors(F.col("output"), agent, F.col("_keys"), F.col("_document"))
        errors = F.when(F.col("agent") == agent, F.when(F.col("_keys").isNull(), F.array(F.lit("not an object"))).otherwise(checked)).otherwise(errors)
    read = {"_keys": F.json_object_keys("output"), "_document": F.try_parse_json("output")}
    return outputs.withColumns(read).withColumn("errors", errors).drop(*read)


# Order in which the stages depend on each other.
STAGE_ORDER = [
    "scope-pathway-classifier", "bylaw-retriever", "compliance-evidence-compiler",
    "completeness-applicant-support-auditor", "redline-generator", "pre-review-memo-writer",
]


def stitch_payloads(cases: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payloads, failures) per case out of stage outputs (case_id, agent, ok, reason, output).

    The first failing or absent stage in dependency order is the failure; later stages are not used.
    """
    stage = lambda a: F.max(F.when(F.col("agent") == a, F.struct("ok", "reason", "output"))).alias(f"s{STAGE_ORDER.index(a)}")
    wide = cases.select("case_id").join(outputs.groupBy("case_id").agg(*[stage(a) for a in STAGE_ORDER]), "case_id", "left")
    failed, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, agent in reversed(list(enumerate(STAGE_ORDER))):
        bad = F.coalesce(~F.col(f"s{i}.ok"), F.lit(True))
        failed = F.when(bad, agent).otherwise(failed)
        reason = F.when(bad, F.coalesce(F.col(f"s{i}.reason"), F.lit("no output"))).otherwise(reason)
    wide = wide.withColumn("failed_agent", failed).withColumn("reason", reason)
    take = lambda i, key: F.get_json_object(f"s{i}.output", f"$.{key}")
    strings = lambda i, key: F.from_json(take(i, key), "array<string>").alias(key)
    payloads = wide.filter(F.col("failed_agent").isNull()).select(
        "case_id",
        take(0, "pathway").alias("predicted_pathway"), take(5, "outcome").alias("predicted_outcome"),
        strings(1, "cited_bylaw_ids"),
        F.from_json(take(2, "evidence_fields_by_bylaw"), "map<string,array<string>>").alias("evidence_fields_by_bylaw"),
        F.from_json(
            take(2, "numeric_gaps"),
            "array<struct<gap_id:string,field:string,proposed_value:double,required_value:double,delta:double,unit:string>>",
        ).alias("reported_numeric_gaps"),
        take(3, "stage1_complete").cast("boolean").alias("stage1_complete"),
        strings(3, "stage1_missing"), strings(3, "applicant_support_flags"), strings(3, "equity_notes"),
        F.from_json(
            take(4, "redlines"),
            "array<struct<field:string,current_value:string,proposed_value:string,addresses_gap:string,cited_bylaw_id:string,rationale:string>>",
        ).alias("redlines"),
        take(5, "memo_markdown").alias("memo_markdown"), take(5, "letter_markdown").alias("letter_markdown"),
    )
    return payloads, wide.filter(F.col("failed_agent").isNotNull()).select("case_id", "failed_agent", "reason")


# --- letter detectors ----------------------------------------------------------------------------------------

def jargon_dense(letter: Column, terms: int = 4, window: int = 200) -> Column:
    """Whether any stretch of ``window`` words holds at least ``terms`` regulatory terms.

    Only the word positions of the terms are kept; the closest span of ``terms`` hits decides.
    """
    words = F.split(F.trim(letter), r"\s+")
    pattern = "(?i)(?<![0-9A-Za-z_])(" + "|".join(V.JARGON_TERMS) + ")s?(?![0-9A-Za-z_])"
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(pattern), i)), lambda i: i.isNotNull())
    spans = F.transform(hits, lambda h, i: F.get(hits, i + (terms - 1)) - h)
    return F.exists(spans, lambda s: F.coalesce(s < window, F.lit(False)))


def letter_flags(letters: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Detectors with a countable rule over letters (case_id, letter); ``gaps``: case_id, proposed, required (text)."""
    letter = F.col("letter")
    out = letters.select(
        "case_id",
        jargon_dense(letter).alias("jargon-density-high"),
        letter.rlike(r"(?is)##\s+Next step.*(we will be in touch|in due course|shortly)").alias("next-step-ambiguous"),
        (F.size(S.citation_ids(letter)) > 0).alias("bylaw-citation-leaked-to-applicant"),
        "letter",
    )
    if gaps is None:
        return out.drop("letter")
    told = salted_join(gaps, out.select("case_id", "letter"), ["case_id"], "inner").withColumn(
        "untold", ~(F.col("letter").contains(F.col("proposed")) & F.col("letter").contains(F.col("required")))
    )
    per_case = told.groupBy("case_id").agg(F.max("untold").alias("numeric-gap-not-quantified"))
    return out.drop("letter").join(per_case, "case_id", "left").fillna(False, subset=["numeric-gap-not-quantified"])
