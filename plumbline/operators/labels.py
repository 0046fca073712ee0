"""Rule evaluation, gold label derivation, fingerprints, provenance and case building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions import documents as D
from plumbline.functions import scalar as S
from plumbline.operators.joins import salted_join

# The comparators of the decision rules. A rule text is recognised by its marker; the first
# marker found decides. ``other`` compares with a second fact, ``missing``/``absent`` look at document sets.
# (marker, kind, fact, comparison, threshold if the text has none, second fact or document)
RULE_FORMS = [
    ("fsr_proposed >", "number", "fsr_proposed", ">", 1.0, None),
    ("rear_setback_m_proposed <", "number", "rear_setback_m_proposed", "<", 7.6, None),
    ("side_setback_m_proposed <", "number", "side_setback_m_proposed", "<", 1.2, None),
    ("front setback", "optional", "front_setback_m_proposed", "<", 6.1, None),
    ("front_setback", "optional", "front_setback_m_proposed", "<", 6.1, None),
    ("height_m_proposed >", "number", "height_m_proposed", ">", 11.5, None),
    ("units_proposed >", "number", "units_proposed", ">", 4.0, None),
    ("parking_spaces_proposed < units_proposed", "other", "parking_spaces_proposed", "<", None, "units_proposed"),
    ("energy_step_code_proposed <", "number", "energy_step_code_proposed", "<", 3.0, None),
    ("tree-assessment is in missing_documents", "missing_with", "tree_inventory_count", ">", 0.0, "tree-assessment"),
    ("neighbour-notification is in missing_documents", "missing", None, None, None, "neighbour-notification"),
    ("energy-compliance-report is not in submitted_documents", "absent", None, None, None, "energy-compliance-report"),
    ("architectural-set is not in submitted_documents", "absent", None, None, None, "architectural-set"),
]


def typed_rules(rules: DataFrame) -> DataFrame:
    """Rule texts (rule_id, condition, ...) to typed predicates; unknown texts get kind null and never match."""
    def value(item: str | float | None, kind: str) -> str:
        return f"cast({'null' if item is None else repr(item)} as {kind})"

    branches = " ".join(
        f"when contains(lower(condition), {marker!r}) then named_struct('number', {number}, 'kind', {value(kind, 'string')}, 'fact', {value(fact, 'string')}, "
        f"'comparison', {value(sign, 'string')}, 'fallback', {value(limit, 'double')}, 'operand', {value(other, 'string')})"
        for number, (marker, kind, fact, sign, limit, other) in enumerate(RULE_FORMS)
    )
    stated = S.rule_threshold(F.lower("condition"), F.col("form.fallback"))
    return rules.withColumn("form", F.expr(f"case {branches} end")).select(
        *rules.columns, F.col("form.number").alias("_form"), "form.kind", "form.fact", "form.comparison", "form.operand",
        F.when(F.col("form.kind").isin("number", "optional"), stated).otherwise(F.col("form.fallback")).alias("threshold"),
    )


def _case_side(kind: str, fact: str | None, other: str | None) -> tuple[Column, Column, Column]:
    """What a case brings to a form of condition: the value, the second value, and whether the form can hold at all."""
    given = F.try_element_at("facts", F.lit(fact)) if fact else F.lit(None).cast("double")
    second = F.try_element_at("facts", F.lit(other)) if kind == "other" else F.lit(None).cast("double")
    possible = {
        "optional": given.isNotNull(),
        "missing": F.array_contains("missing_documents", F.lit(other)),
        "missing_with": F.array_contains("missing_documents", F.lit(other)),
        "absent": ~F.array_contains("submitted_kinds", F.lit(other)),
    }.get(kind, F.lit(True))
    return F.coalesce(given, F.lit(0.0)), F.coalesce(second, F.lit(0.0)), possible


def matched_rules(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """(case columns, rule columns) for every rule that holds.

    ``cases``: facts map<string,double> (a missing fact reads as 0), missing_documents, submitted_kinds. A case gets one row for
    each form of condition that it can meet, with the values to compare, and meets only the rules of that form: an equi-join
    whose strategy is left to Spark, so the number of rules has no limit.
    """
    forms = []
    for number, (_, kind, fact, _, _, other) in enumerate(RULE_FORMS):
        value, second, possible = _case_side(kind, fact, other)
        forms.append(F.struct(F.lit(number).alias("_form"), value.alias("_value"), second.alias("_second"), possible.alias("_possible")))
    bound = F.when(F.col("kind") == "other", F.col("_second")).otherwise(F.col("threshold"))
    holds = (
        F.when(F.col("kind").isin("missing", "absent"), True)
        .when(F.col("comparison") == ">", F.col("_value") > bound).otherwise(F.col("_value") < bound)
    )
    met = cases.select("*", F.inline(F.array(*forms))).filter("_possible")
    return met.join(typed_rules(rules), "_form").filter(holds).drop("_form", "_value", "_second", "_possible")


#: What rules give to a case, and the column of the rules that it comes from.
RULE_GIFTS = {"rule_gaps": "emits_gap", "rule_evidence": "evidence_keys", "rule_ids": "rule_id", "rule_bylaws": "bylaw_ids", "bylaw_evidence": "required"}


def threshold_index(rules: DataFrame) -> DataFrame:
    """One row with one list: per form of condition and gift, its items in the order of the thresholds from which a case gets them.

    ``rules`` has rule_id, condition and the columns of RULE_GIFTS. Only the lowest threshold of an item counts (the highest for
    "less than", whose signs are turned), so a list is as long as the form has different items, however many rules name them.
    Conditions without a threshold give theirs from the start. The row is as large as the rule set, never as the cases.
    """
    typed = typed_rules(rules).filter(F.col("_form").isNotNull())
    plain = F.col("kind").isin("missing", "absent", "other")
    at = F.when(plain, F.lit(float("-inf"))).when(F.col("comparison") == ">", F.col("threshold")).otherwise(-F.col("threshold"))
    as_list = lambda c: F.col(c) if rules.schema[c].dataType.typeName() == "array" else F.array(c)
    gifts = [F.struct(F.lit(name).alias("gift"), as_list(column).alias("items")) for name, column in RULE_GIFTS.items()]
    each = typed.select("_form", at.alias("at"), F.inline(F.array(*gifts))).select("_form", "gift", "at", F.explode("items").alias("item"))
    first = each.filter("at is not null and item is not null").groupBy("_form", "gift", "item").agg(F.min("at").alias("at"))
    lists = first.groupBy("_form", "gift").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("items"))
    by_name = lists.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "_form", "gift"), "items"))).alias("named"))
    return by_name.select(F.array(*[F.try_element_at("named", F.lit(name)) for name in _index_names()]).alias("index"))


def _index_names() -> list[str]:
    return [f"{number}:{gift}" for number in range(len(RULE_FORMS)) for gift in RULE_GIFTS]


def _up_to(items: Column, reach: Column) -> Column:
    return F.filter(items, lambda x: x["at"] < reach)


def rule_gifts(cases: DataFrame, index: DataFrame) -> DataFrame:
    """``cases`` with the union of gaps, evidence, ids and citations of all rules that hold: one look per form at the index.

    The index is one value that every task gets; no rule is joined with a case, so nothing is shuffled. Of an item list a case takes
    those up to its value, which the order of thresholds makes a prefix.
    """
    held = cases.withColumn("_index", index.scalar())
    none = F.array().cast("array<string>")
    places = {name: i for i, name in enumerate(_index_names())}
    found: dict[str, list[Column]] = {name: [] for name in RULE_GIFTS}
    for number, (_, kind, fact, sign, _, other) in enumerate(RULE_FORMS):
        value, second, possible = _case_side(kind, fact, other)
        reach = value if sign == ">" else -value
        holds = possible & ((value > second) if sign == ">" else (value < second)) if kind == "other" else possible
        for name in RULE_GIFTS:
            items = F.get("_index", F.lit(places[f"{number}:{name}"]))
            taken = _up_to(items, reach) if kind in ("number", "optional", "missing_with") else items
            found[name].append(F.when(holds, F.transform(taken, lambda x: x["item"])))
    together = lambda columns: F.sort_array(F.array_distinct(F.flatten(F.array(*[F.coalesce(c, none) for c in columns]))))
    return held.select(*cases.columns, *[together(columns).alias(name) for name, columns in found.items()])


#: Columns of ``derive_labels``.
LABELS = ("bylaws_to_cite", "evidence_to_surface", "expected_gap_ids", "expected_redlines_min", "expected_redlines_max",
          "stage1_complete", "stage1_missing", "derivation_source")


def derive_labels(cases: DataFrame, rules: DataFrame, evidence_map: DataFrame) -> DataFrame:
    """Gold labels per case, see ``with_labels``."""
    return with_labels(cases, rules, evidence_map).select("case_id", *[F.col(f"_labels.{name}").alias(name) for name in LABELS])


def with_labels(cases: DataFrame, rules: DataFrame, evidence_map: DataFrame) -> DataFrame:
    """``cases`` with a struct ``_labels`` of gold labels: sorted unique gaps, citations, evidence, redline range, stage-1 flags, source.

    Labels given with the row (``given_*`` arrays, when present) win if they are not empty. Lists are
    bounded by the rule set, not by the data. The rules become an index of thresholds, at which a case looks once per form.
    """
    listed = rules.select("bylaw_ids").distinct().withColumn("bylaw_id", F.explode("bylaw_ids"))
    evidence = listed.join(evidence_map, "bylaw_id").groupBy("bylaw_ids").agg(F.collect_set("evidence_key").alias("required"))
    joined = rule_gifts(cases, threshold_index(rules.join(evidence, "bylaw_ids", "left")))
    for name in ("rule_gaps", "rule_bylaws"):
        joined = joined.withColumn(name, S.sorted_unique(F.col(name)))
    none = F.array().cast("array<string>")

    def prefer(given: str, derived: Column) -> Column:
        if given not in cases.columns:
            return derived
        own = F.array_sort(F.filter(F.coalesce(given, none), lambda x: x != ""))
        return F.when(F.size(own) > 0, own).otherwise(derived)

    missing = F.array_sort(F.filter("missing_documents", lambda x: x != ""))
    evidence_all = S.sorted_unique(F.array_union("bylaw_evidence", "rule_evidence"))
    gap_count = F.size("rule_gaps")
    given_number = lambda name: F.col(name) if name in cases.columns else F.lit(None).cast("int")
    low = F.coalesce(given_number("given_redlines_min"), gap_count)
    high = F.coalesce(given_number("given_redlines_max"), F.when(gap_count == 0, 0).otherwise(gap_count + 2))
    source = F.concat(
        F.lit("oracle-rule:"),
        F.when(F.size("rule_ids") > 0, F.array_join("rule_ids", "+")).otherwise("NO-GAP"),
    )
    labels = F.struct(
        prefer("given_bylaws", F.col("rule_bylaws")).alias("bylaws_to_cite"),
        prefer("given_evidence", evidence_all).alias("evidence_to_surface"),
        prefer("given_gap_ids", F.col("rule_gaps")).alias("expected_gap_ids"),
        low.alias("expected_redlines_min"),
        F.greatest(high, low).alias("expected_redlines_max"),
        (F.size(missing) == 0).alias("stage1_complete"),
        prefer("given_stage1_missing", missing).alias("stage1_missing"),
        source.alias("derivation_source"),
    )
    return joined.select(*cases.columns, labels.alias("_labels"))


def project_facts(grid: DataFrame, aliases: dict[str, Sequence[str]], defaults: dict[str, float]) -> DataFrame:
    """Fact columns from grid rows: first present alias read as a lenient number, else the default."""
    out = grid
    for fact, names in aliases.items():
        present = [S.lenient_number(F.col(n).cast("string")) for n in names if n in grid.columns]
        out = out.withColumn(fact, F.coalesce(*present, F.lit(defaults.get(fact)).cast("double")))
    return out


# Limits a scenario is measured against when the row names none.
SCENARIO_LIMITS = {"fsr_allowed": 1.0, "rear_setback_m_required": 7.6, "side_setback_m_required": 1.2, "height_m_max": 11.5}


def scenario_facts() -> dict[str, Column]:
    """The 14 bucketed facts of a case row."""
    limit = lambda name: F.coalesce(F.col(name), F.lit(SCENARIO_LIMITS[name]))
    number = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    missing = S.sorted_unique(F.col("missing_documents"))
    parking = F.coalesce(F.col("parking_spaces_required"), F.col("units_proposed"))
    return {
        "zone": F.col("zoning_district"),
        "units": S.number_text(F.col("units_proposed")),
        "lot": S.lot_bucket(F.col("lot_area_sqm")),
        "fsr": S.signed_steps(F.col("fsr_proposed") - limit("fsr_allowed"), 0.05, 2),
        "rear-setback": S.signed_steps(number("rear_setback_m_proposed") - limit("rear_setback_m_required"), 0.1, 1),
        "side-setback": S.signed_steps(number("side_setback_m_proposed") - limit("side_setback_m_required"), 0.1, 1),
        "parking": S.signed_number(number("parking_spaces_proposed") - parking),
        "height": S.signed_steps(number("height_m_proposed") - limit("height_m_max"), 0.5, 1),
        "energy-step": S.number_text(number("energy_step_code_proposed")),
        "stage1-missing": F.when(F.size(missing) > 0, F.array_join(missing, ",")).otherwise("none"),
        "trap-families": F.coalesce("edge_case_family", F.lit("none")),
        "outcome": F.col("outcome_class"),
        "gap-severity": F.col("gap_severity_bucket"),
        "applicant-type": F.col("applicant_type"),
    }


# Provenance defaults.
PROVENANCE_DEFAULTS = {"case_schema_version": "v1.0.0", "reviewer": "ve", "review_notes": ""}


def provenance(request_json: Column, response_json: Column, **given: Column) -> Column:
    """Provenance struct: request and response hashes plus the given fields, defaults filled in."""
    fields = {name: F.lit(value) for name, value in PROVENANCE_DEFAULTS.items()} | {"human_reviewed": F.lit(True)} | given
    fields["raw_request_hash"] = S.prefixed_sha256(request_json)
    fields["raw_response_hash"] = S.prefixed_sha256(response_json)
    return F.struct(*[value.alias(name) for name, value in sorted(fields.items())])


def with_fingerprints(cases: DataFrame) -> DataFrame:
    """Adds content, entity, document-stub and scenario fingerprints to case rows."""
    return cases.withColumns({
        "content_fingerprint": S.prefixed_sha256(D.canonical_json(F.col("application_packet"))),
        "entity_fingerprint": S.entity_fingerprint(
            F.col("applicant_type"), F.col("represented_by"), F.col("address_stub"), F.col("lot_area_sqm"), F.col("units_proposed")
        ),
        "document_stub_fingerprints": F.transform("submitted_documents", S.prefixed_sha256),
        "scenario_fingerprint": S.scenario_fingerprint(scenario_facts()),
    })


def build_cases(grid: DataFrame, rules: DataFrame, evidence_map: DataFrame, generated_at: str) -> DataFrame:
    """Full case rows out of grid rows: id, labels, fingerprints, provenance."""
    ids = S.minted_id(F.col("given_id"), F.col("domain"), F.col("row_index") + 1)
    facts = ["fsr_proposed", "rear_setback_m_proposed", "side_setback_m_proposed", "front_setback_m_proposed", "height_m_proposed",
             "units_proposed", "parking_spaces_proposed", "energy_step_code_proposed", "tree_inventory_count"]
    # a row is few bytes and much work, so rows are dealt evenly, whatever the splits of the input
    rows = grid.repartition(int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("case_id", ids)
    present = [F.struct(F.lit(f).alias("key"), F.col(f).cast("double").alias("value")) for f in facts if f in grid.columns]
    fact_map = F.map_from_entries(F.filter(F.array(*present), lambda e: e["value"].isNotNull()))
    packet = F.to_json(F.struct(
        F.struct("address_stub", "lot_area_sqm", "zoning_district", *[f for f in facts if f in grid.columns]).alias("project"),
        F.struct(F.col("applicant_type").alias("type"), "represented_by").alias("applicant_profile"),
        "submitted_documents", "missing_documents",
    ), {"ignoreNullFields": "false"})
    rows = with_fingerprints(rows.withColumn("facts", fact_map).withColumn("application_packet", packet))
    # the labels stay on their row: a join by case_id would shuffle all rows twice, and multiply rows whose ids repeat
    labelled = with_labels(rows, rules, evidence_map).select(*rows.columns, *[F.col(f"_labels.{name}").alias(name) for name in LABELS])
    labelled = labelled.select("case_id", *[c for c in labelled.columns if c != "case_id"])
    body = [c for c in labelled.columns if not D.is_generated_key(c)]
    return labelled.withColumn(
        "provenance",
        provenance(
            D.canonical_json(F.to_json(F.struct(*grid.columns))),
            D.canonical_json(F.to_json(F.struct(*body))),
            generated_at=F.lit(generated_at), generator_id=F.lit("deterministic-seed"),
        ),
    )


def build_few_shots(requests: DataFrame, cases: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Few-shot rows and refused requests.

    ``requests``: request_id, agent, inspired_by_train_case_ids, input, output, rationale_note. Parents must
    exist, be train cases and share one domain; the scenario comes from the first parent. Content already in
    ``existing`` (content_fingerprint) is not written again.
    """
    clean = requests.withColumn(
        "inspired_by_train_case_ids",
        F.filter(F.transform("inspired_by_train_case_ids", lambda x: F.trim(x)), lambda x: x != ""),
    )
    parents = clean.select("request_id", F.posexplode_outer("inspired_by_train_case_ids").alias("pos", "case_id"))
    known = cases.select("case_id", "domain", "split", "scenario_fingerprint")
    looked = salted_join(parents, known, ["case_id"], "left")
    verdict = looked.groupBy("request_id").agg(
        F.count("case_id").alias("parents"),
        F.count("split").alias("found"),
        F.count_if(F.col("split") != "train").alias("restricted"),
        (F.min("domain") != F.max("domain")).alias("mixed"),
        F.min("domain").alias("domain"),
        F.min_by("scenario_fingerprint", "pos").alias("scenario_fingerprint"),
    )
    reason = (
        F.when(F.col("parents") == 0, "no parent case")
        .when(F.col("found") < F.col("parents"), "parent not found")
        .when(F.col("restricted") > 0, "parent outside train")
        .when(F.col("mixed"), "parents of several domains")
    )
    judged = clean.join(verdict.withColumn("reason", reason), "request_id")
    content = F.to_json(F.struct(
        "agent", "inspired_by_train_case_ids",
        F.parse_json("input").alias("input"), F.parse_json("output").alias("output"), "rationale_note",
    ))
    built = (
        judged.filter(F.col("reason").isNull())
        .withColumn("content_fingerprint", S.prefixed_sha256(D.canonical_json(content)))
        .withColumn("few_shot_id", F.concat(F.lit("fs-"), "agent", F.lit("-"), F.substring("content_fingerprint", 8, 8)))
        .withColumn("entity_fingerprint", S.prefixed_sha256(F.concat_ws("|", F.lit("few-shot"), "agent", "content_fingerprint")))
        .drop("reason", "parents", "found", "restricted", "mixed", "request_id")
        .dropDuplicates(["agent", "content_fingerprint"])
    )
    if existing is not None:
        built = built.join(existing.select("agent", "content_fingerprint"), ["agent", "content_fingerprint"], "left_anti")
    return built, judged.filter(F.col("reason").isNotNull()).select("request_id", "reason")


# --- corpus hashes ------------------------------------------------------------------------------------

def corpus_hash(files: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    """Digest of all files per corpus and their number, for a corpus of any size.

    A tree of fixed depth over the files' own hashes. The first six hex digits of the sha256 of a path name its leaf; a leaf's
    digest is taken over the lines "hash path" of its files in path order, a node's (the first three digits) over the lines of
    its leaves, and the corpus's over those of its nodes. No text is collected. It is another digest than one over all contents
    as a single text, which ``corpus_file_hashes`` doesn't give either; compare it only with digests made here. A null path or
    content counts as an empty one.
    """
    path = F.coalesce("path", F.lit(""))
    own = S.prefixed_sha256(F.coalesce("content", F.lit("")))
    rows = files.select(*by, F.substring(F.sha2(path, 256), 1, 6).alias("place"), path.alias("name"), own.alias("digest"), F.lit(1).cast("bigint").alias("files"))
    for digits in (6, 3, 0):
        lines = F.transform(
            F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda f: F.concat(f["digest"], F.lit(" "), f["name"])
        )
        rows = rows.groupBy(*by, F.substring("place", 1, digits).alias("place")).agg(
            S.prefixed_sha256(F.array_join(lines, "\n")).alias("digest"), F.sum("files").alias("files")
        ).withColumn("name", F.col("place"))
    return rows.select(*by, F.col("digest").alias("corpus_hash"), "files")


def corpus_file_hashes(files: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    """(corpus, path, sha256) rows: the same content evidence without a size limit."""
    return files.select(*by, "path", S.prefixed_sha256(F.col("content")).alias("sha256"))


def refreshed_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries with new content hashes: status changed, same, no_entry (error) or no_file (kept)."""
    now = files.select("path", S.prefixed_sha256(F.col("content")).alias("new_hash"))
    joined = manifest.select("path", "content_hash", F.lit(True).alias("entry")).join(now, "path", "full_outer")
    status = (
        F.when(F.col("entry").isNull(), "no_entry").when(F.col("new_hash").isNull(), "no_file")
        .when(F.col("content_hash").eqNullSafe(F.col("new_hash")), "same").otherwise("changed")
    )
    return joined.select("path", F.coalesce("new_hash", "content_hash").alias("content_hash"), status.alias("status"))


def public_files(files: DataFrame, prefix: str, oracle_mark: str = "/oracle/") -> DataFrame:
    return files.filter(F.col("path").startswith(prefix) & ~F.col("path").contains(oracle_mark))


def seed_receipt(files: DataFrame, prefix: str) -> DataFrame:
    """(domain, path, hash) rows of the public files: the index receipt in long form."""
    return public_files(files, prefix).select("domain", "path", S.prefixed_sha256(F.col("content")).alias("sha256"))


# --- label agreement and sampling ----------------------------------------------------------------------------

def majority_labels(votes: DataFrame, key: str, label: str) -> DataFrame:
    """Label per key when all voters agree; otherwise the label most voted for and status needs-human."""
    counted = votes.groupBy(key, label).agg(F.count(F.lit(1)).alias("votes"))
    folded = counted.groupBy(key).agg(
        F.min_by(label, F.struct(-F.col("votes"), F.col(label))).alias("label"),
        F.count(F.lit(1)).alias("labels"), F.sum("votes").alias("voters"),
    )
    agreed = F.col("labels") == 1
    return folded.withColumn("review_status", F.when(agreed, "agreed").otherwise("needs-human")).withColumn("kept", agreed)


def hash_order(key: Column, seed: int) -> Column:
    """Seeded order value of a key, the same in every engine with md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_splits(
    df: DataFrame, key: str, strata: Sequence[str], shares: Sequence[tuple[str, float]], seed: int
) -> DataFrame:
    """Assigns each row a split by its hash rank inside its stratum; shares are cumulated in order.

    Ranks come from ``ranked_in_strata``, so a stratum with a large share of all rows is not one task.
    """
    ranked = ranked_in_strata(df, key, strata, seed)
    place = (F.col("rank") - 1) / F.col("stratum_size")
    cumulated, limits = 0.0, []
    for name, share in shares:
        cumulated += share
        limits.append((name, round(cumulated, 10)))
    split = F.lit(limits[-1][0])
    for name, limit in reversed(limits[:-1]):
        split = F.when(place < limit, name).otherwise(split)
    return ranked.withColumn("split", split).drop("rank", "stratum_size")


def stratified_sample(df: DataFrame, key: str, strata: Sequence[str], share: float, seed: int) -> DataFrame:
    """The ceil(share x size) lowest hash ranks of every stratum."""
    ranked = ranked_in_strata(df, key, strata, seed)
    return ranked.filter(F.col("rank") <= F.ceil(F.col("stratum_size") * share)).drop("rank", "stratum_size")


def ranked_in_strata(df: DataFrame, key: str, strata: Sequence[str], seed: int) -> DataFrame:
    """Rank by hash order inside each stratum, computed per hash bucket plus bucket offsets.

    The leading three hex digits of the order value cut a stratum in 4096 even buckets: the window runs inside
    a bucket and earlier buckets only contribute their counts.
    """
    from pyspark.sql import Window as W

    rows = df.withColumn("_order", hash_order(F.col(key), seed)).withColumn("_bucket", F.substring("_order", 1, 3))
    counts = rows.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*strata)
    offsets = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("stratum_size", F.sum("_n").over(whole)).drop("_n")
    local = F.row_number().over(W.partitionBy(*strata, "_bucket").orderBy("_order", key))
    return (
        rows.withColumn("_local", local).join(offsets, [*strata, "_bucket"])
        .withColumn("rank", F.col("_before") + F.col("_local"))
        .drop("_before", "_local", "_order", "_bucket")
    )
