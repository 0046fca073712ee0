"""Scalar column functions: text, numbers, hashes, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import values as V


def lit_array(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


# --- text ---------------------------------------------------------------------------------------

def citation_ids(text: Column) -> Column:
    """Distinct citation ids in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(V.CITATION_PATTERN), F.lit(0)))


def headings(markdown: Column) -> Column:
    """Second-level headings in document order, trailing hash marks removed."""
    found = F.regexp_extract_all(markdown, F.lit(V.HEADING_PATTERN), F.lit(1))
    return F.transform(found, lambda h: F.trim(F.when(h.contains("#"), F.regexp_replace(h, r"\s+#+\s*$", "")).otherwise(h)))


def missing_sections(present: Column, required: Sequence[str]) -> Column:
    return F.array_except(lit_array(required), present)


def sections_in_order(present: Column, required: Sequence[str]) -> Column:
    """Every required heading is there and required headings never step back (repeats allowed)."""
    rank = F.transform(present, lambda h: F.array_position(lit_array(required), h))
    known = F.filter(rank, lambda r: r > 0)
    return (F.size(missing_sections(present, required)) == 0) & (known == F.sort_array(known))


def broken_cross_refs(markdown: Column, present: Column, required: Sequence[str]) -> Column:
    """Required sections that the text points at ("see X") although they are absent."""
    def points_at(section: str) -> Column:
        body = "".join("\\" + c if c in r".*+?^${}()|[]\-" else c for c in section)
        lead = "(?<![0-9A-Za-z_])"
        tail = "(?![0-9A-Za-z_])" if section[-1:].isalnum() else "(?=[0-9A-Za-z_])"
        return markdown.rlike(f"(?i){lead}see\\s+{body}{tail}")

    hits = [F.when(~F.array_contains(present, s) & points_at(s), F.lit(s)) for s in required]
    return F.array_compact(F.array(*hits))


def json_object_text(text: Column) -> Column:
    """JSON object out of free text: a fenced block first, else first "{" to last "}", else the text."""
    fence = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)```", 1)
    braces = brace_slice(text)
    return F.when(fence != "", F.trim(fence)).otherwise(F.coalesce(braces, F.trim(text)))


def brace_slice(text: Column) -> Column:
    """First "{" to last "}", or null when there is no such span."""
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    found = (first > 0) & (F.instr(text, "}") > 0) & (last > first)
    return F.when(found, F.substring(text, first, last - first + 1))


def valid_score_payload(payload: Column) -> Column:
    """(score, rationale) when the score is a number in 0..1 and the rationale is not empty, else null."""
    score_node = F.try_variant_get(F.try_parse_json(payload), "$.score", "variant")
    numeric = F.schema_of_variant(score_node).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    score = F.when(numeric, F.try_variant_get(F.try_parse_json(payload), "$.score", "double"))
    why_node = F.try_variant_get(F.try_parse_json(payload), "$.rationale", "variant")
    why = F.when(F.schema_of_variant(why_node) == "STRING", F.get_json_object(payload, "$.rationale"))
    ok = score.between(0, 1) & (F.length(why) > 0)
    return F.when(ok, F.struct(score.alias("score"), why.alias("rationale")))


# --- numbers --------------------------------------------------------------------------------------

def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding with ties toward positive infinity."""
    scale = 10 ** digits
    return F.floor(value * scale + 0.5).cast("double") / scale


def number_text(value: Column) -> Column:
    """Shortest decimal text of a double: whole numbers without a fraction."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, F.floor(value).cast("bigint").cast("string")).otherwise(value.cast("string"))


def lenient_number(text: Column) -> Column:
    """Double out of a number or numeric text; blank, malformed and non-finite values give null."""
    trimmed = F.trim(text)
    numeric = trimmed.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    value = F.when(numeric, trimmed).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def signed_steps(value: Column, step: float, digits: int) -> Column:
    """Value rounded to a step (ties up), with sign: "+0.05", "-0.1", "0"."""
    rounded = F.floor(value / step + 0.5) * F.lit(step)
    text = F.format_string(f"%.{digits}f", rounded)
    return (
        F.when(F.abs(rounded) < 2.220446049250313e-16, F.lit("0"))
        .when(rounded > 0, F.concat(F.lit("+"), text))
        .otherwise(text)
    )


def signed_number(value: Column) -> Column:
    text = number_text(value)
    return F.when(value > 0, F.concat(F.lit("+"), text)).otherwise(text)


def lot_bucket(area: Column, width: int = 50) -> Column:
    start = (F.floor(area / width) * width).cast("bigint")
    return F.concat(start.cast("string"), F.lit("-"), (start + (width - 1)).cast("string"))


def edge_bucket(value: Column, edges: Sequence[float]) -> Column:
    """"lt<edge>" of the first edge above the value, "gte<last>" beyond."""
    ladder = F.when(value < edges[0], F.lit(f"lt{edges[0]:g}"))
    for edge in edges[1:]:
        ladder = ladder.when(value < edge, F.lit(f"lt{edge:g}"))
    return ladder.otherwise(F.lit(f"gte{edges[-1]:g}"))


def rule_threshold(condition: Column, fallback: Column) -> Column:
    """First number after a comparison sign in a rule text, else the fallback."""
    found = F.regexp_extract(condition, r"[<>]\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(F.when(found != "", found).try_cast("double"), fallback)


# --- vocabularies -----------------------------------------------------------------------------------

def agent_status(word: Column) -> Column:
    lowered = F.lower(word)
    return (
        F.when(lowered.isin(V.DONE_WORDS), "done")
        .when(lowered.isin(V.FAILED_WORDS), "failed")
        .when(lowered.isin(V.QUEUED_WORDS), "queued")
        .otherwise("running")
    )


def trap_family(single: Column, tags: Column) -> Column:
    """A non-empty family text other than "none"; else the sorted tags joined by commas; else null."""
    kept = F.array_sort(F.filter(tags, lambda t: (t != "") & (t != "none")))
    return F.when((single != "") & (single != "none"), single).when(
        F.size(kept) > 0, F.array_join(kept, ",")
    )


def applicant_type(packet_json: Column) -> Column:
    found = F.get_json_object(packet_json, "$.applicant_profile.type")
    return F.coalesce(F.when(found != "", found), F.lit("_unknown_"))


def is_numeric_gap(gap_id: Column, prefixes: Sequence[str] = V.NUMERIC_GAP_PREFIXES) -> Column:
    test = F.lit(False)
    for prefix in prefixes:
        test = test | gap_id.startswith(prefix)
    return test


def date_only(text: Column) -> Column:
    return F.substring(text, 1, 10)


def iso_midnight(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))


def round_number(folder: Column) -> Column:
    return F.coalesce(F.regexp_extract(folder, r"^round-([0-9]+)", 1).try_cast("bigint"), F.lit(0))


def round_folder(number: Column, suffix: str = "fleet") -> Column:
    text = number.cast("string")
    padded = F.when(F.length(text) >= 3, text).otherwise(F.lpad(text, 3, "0"))
    return F.concat(F.lit("round-"), padded, F.lit(f"-{suffix}"))


def minted_id(given: Column, domain: Column, position: Column, pad: int = 4) -> Column:
    text = position.cast("string")
    padded = F.when(F.length(text) >= pad, text).otherwise(F.lpad(text, pad, "0"))
    return F.when(F.trim(given) != "", given).otherwise(F.concat(domain, F.lit("-"), padded))


# --- hashes and fingerprints ---------------------------------------------------------------------------

def prefixed_sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def entity_fingerprint(applicant: Column, represented_by: Column, address: Column, area: Column, units: Column) -> Column:
    parts = [applicant, F.coalesce(represented_by, F.lit("null")), address, number_text(area), number_text(units)]
    return prefixed_sha256(F.concat_ws("|", *parts))


def scenario_fingerprint(facts: dict[str, Column]) -> Column:
    tokens = [F.concat(F.lit(f"{name}="), facts[name]) for name in V.FACTS]
    return F.concat(F.lit("vec:"), F.concat_ws("|", *tokens))


def fact_map(fingerprint: Column) -> Column:
    """Fingerprint text to a fact -> value map; tokens without a name are dropped."""
    tokens = F.split(F.regexp_replace(fingerprint, "^vec:", ""), r"\|")
    named = F.filter(tokens, lambda t: F.instr(t, "=") > 1)
    pairs = F.transform(
        named,
        lambda t: F.struct(
            F.substring_index(t, "=", 1).alias("key"),
            F.substr(t, F.instr(t, "=") + 1).alias("value"),
        ),
    )
    return F.map_from_entries(pairs)


def fact_distance(left: Column, right: Column) -> Column:
    """Changed facts over facts named in either fingerprint; 0 when neither names any."""
    a, b = fact_map(left), fact_map(right)
    flags = F.map_values(F.map_zip_with(a, b, lambda _k, x, y: (~x.eqNullSafe(y)).cast("int")))
    changed = F.aggregate(flags, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(flags) == 0, F.lit(0.0)).otherwise(changed / F.size(flags))


def jaccard_distance(left: Column, right: Column) -> Column:
    """One minus shared tokens over all tokens of two pipe-separated fingerprints."""
    a = F.array_distinct(F.split(F.regexp_replace(left, "^vec:", ""), r"\|"))
    b = F.array_distinct(F.split(F.regexp_replace(right, "^vec:", ""), r"\|"))
    return F.lit(1.0) - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


# --- arrays -------------------------------------------------------------------------------------------

def same_set(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))


def sorted_unique(items: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(items, lambda x: x != "")))
