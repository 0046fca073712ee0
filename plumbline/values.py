"""These must equal the published protocol for results to be comparable."""

# --- enumerations -----------------------------------------------------------------------------
OUTCOMES = ["ready", "needs-clarification", "complex-requires-specialist"]
PATHWAYS = [
    "as-of-right-ssmuh", "discretionary", "heritage", "tod-overlap",
    "floodplain", "specialist-required", "out-of-scope",
]
GAP_SEVERITIES = ["none", "minor-single", "minor-multi", "major-single", "major-multi", "blocking"]
REVIEW_STATUSES = ["human-verified", "spot-checked", "needs-human"]
SPLITS = ["train", "dev", "holdout", "gold-holdout"]
SEALED_SPLITS = ["holdout", "gold-holdout"]
ROUTINGS = ["staff-pre-review", "specialist-queue", "out-of-scope"]
BRANCHES = [
    "standard", "vacuous_one_empty_both", "vacuous_one_gold_empty",
    "zero_gold_nonempty_predicted_empty", "zero_predicted_nonempty_gold_empty",
    "zero_gate_fail", "gate_failed", "not_applicable",
]
AGENTS = [
    "scope-pathway-classifier", "bylaw-retriever", "compliance-evidence-compiler",
    "redline-generator", "completeness-applicant-support-auditor", "pre-review-memo-writer",
]
AGENT_LABELS = {
    "scope-pathway-classifier": "Scope pathway classifier",
    "bylaw-retriever": "Bylaw retriever",
    "compliance-evidence-compiler": "Compliance evidence compiler",
    "redline-generator": "Redline generator",
    "completeness-applicant-support-auditor": "Completeness and applicant support auditor",
    "pre-review-memo-writer": "Pre-review memo writer",
}
RUN_STATUSES = ["queued", "running", "done", "failed"]

# --- fields of case and few-shot documents that must be there ---------------------------------
GOLD_FIELDS = [
    "bylaws_to_cite", "evidence_to_surface", "expected_gap_ids", "expected_redlines_min", "expected_redlines_max",
    "stage1_complete", "stage1_missing", "expected_applicant_support_flags", "reference_memo_ids", "reference_letter_ids",
    "derivation_source", "label_confidence", "label_review_status",
]
GOLD_LISTS = [
    "bylaws_to_cite", "evidence_to_surface", "expected_gap_ids", "stage1_missing", "expected_applicant_support_flags",
    "reference_memo_ids", "reference_letter_ids",
]
PROVENANCE_FIELDS = [
    "generator_id", "provider", "model_snapshot", "api_version", "system_prompt_hash", "generator_few_shots_hash",
    "policy_corpus_hash_at_gen_time", "case_schema_version", "raw_request_hash", "raw_response_hash", "package_lockfile_hash",
    "generated_at", "reviewer", "human_reviewed", "review_notes",
]
DECODING_FIELDS = ["temperature", "top_p", "max_tokens", "seed"]
CASE_FIELDS = [
    "case_id", "domain", "split", "address_stub", "outcome_class", "pathway_class", "gap_severity_bucket",
    "content_fingerprint", "entity_fingerprint", "document_stub_fingerprints", "scenario_fingerprint",
]
FEW_SHOT_FIELDS = [
    "few_shot_id", "agent", "inspired_by_train_case_ids", "rationale_note", "content_fingerprint", "entity_fingerprint", "scenario_fingerprint",
]

# --- scoring ----------------------------------------------------------------------------------
WEIGHTS = {
    "M1": 9, "M2": 4, "M3": 13, "M4": 8, "M5": 11, "M6": 8, "M7": 8,
    "M8": 8, "M9": 6, "M10": 5, "M11": 5, "M12": 6, "M13": 9,
}
METRICS = list(WEIGHTS)
DETERMINISTIC = ["M1", "M3", "M4", "M5", "M6", "M7", "M8", "M9"]
NON_JUDGE = METRICS[:11]
DETERMINISTIC_MAX = 71
STAFF_WEIGHT, APPLICANT_WEIGHT = 0.67, 0.33
RECALL_DEPTH = 10
BOOTSTRAP_RESAMPLES, BOOTSTRAP_SEED, BOOTSTRAP_ALPHA = 1000, 4242, 0.05
ACCEPTANCE_GAIN = 1.5
ERROR_RATE_LIMIT = 0.25
NUMERIC_GAP_PREFIXES = [
    "gap-fsr", "gap-height", "gap-units", "gap-rear-setback",
    "gap-side-setback", "gap-front-setback", "gap-parking", "gap-energy-step",
]
SUPPORT_FLAGS = [
    "jargon-density-high", "required-vs-optional-unclear", "missing-document-specificity-low",
    "next-step-ambiguous", "first-time-applicant-tone-mismatch", "numeric-gap-not-quantified",
    "bylaw-citation-leaked-to-applicant",
]
JARGON_TERMS = ["FSR", "PTAA", "setback", "fascia"]
MEMO_SECTIONS = ["Triage", "Applicable bylaws", "Evidence", "Gaps", "Recommendation"]
LETTER_SECTIONS = ["Summary", "What to fix before resubmitting", "Optional improvements", "Next step"]

# --- governance -------------------------------------------------------------------------------
FACTS = [
    "zone", "units", "lot", "fsr", "rear-setback", "side-setback", "parking", "height",
    "energy-step", "stage1-missing", "trap-families", "outcome", "gap-severity", "applicant-type",
]
MIN_SCENARIO_DISTANCE = 0.35
DISTANCE_EDGES = [0.0, 0.1, 0.2, 0.3, 0.35, 0.4, 0.5, 0.7, 1.0]
BOUNDS = {
    "edge_ratio": (0.2, 0.4),
    "generator_tolerance": 0.1,
    "outcome": {
        "ready": (0.2, 0.5),
        "needs-clarification": (0.3, 0.6),
        "complex-requires-specialist": (0.1, 0.4),
    },
    "applicant": {
        "owner-builder": (0.1, 0.6),
        "developer": (0.1, 0.6),
        "agent-of-record": (0.05, 0.5),
        "architect-of-record": (0.05, 0.5),
        "first-time-applicant": (0.05, 0.5),
    },
}
SMALL_SPLIT = 10
FEW_SHOT_KEYS = [
    "few_shot_id", "agent", "inspired_by_train_case_ids", "input", "output", "rationale_note",
    "content_fingerprint", "entity_fingerprint", "scenario_fingerprint", "provenance",
]

# --- text patterns ------------------------------------------------------------------------------
# ASCII word boundaries are written out, because Java's \b follows Unicode letters.
CITATION_PATTERN = r"(?<![0-9A-Za-z_])[A-Z]{2,4}-[A-Z]?[0-9]+(?:-[A-Z0-9]+)*(?![0-9A-Za-z_])"
HEADING_PATTERN = r"(?m)^##\s+(.+?)\s*$"

# --- status vocabulary ----------------------------------------------------------------------------
DONE_WORDS = ["done", "complete", "completed", "succeeded", "success", "ok"]
FAILED_WORDS = ["failed", "error", "errored", "blocked"]
QUEUED_WORDS = ["queued", "pending"]
