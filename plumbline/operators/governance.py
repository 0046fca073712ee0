"""Dataset assertions A01-A24 and the tables of the diversity report.

Each assertion returns its violations as rows ``(assertion, subject, message)``; ``summarize`` folds them to a
status table. Pools are long or nested tables of cases and few-shots; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline import values as V
from plumbline.operators.joins import dim_join, salted_join, unknown_references


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _found(df: DataFrame, assertion: str, subject: Column, message: Column) -> DataFrame:
    return df.select(F.lit(assertion).alias("assertion"), subject.cast("string").alias("subject"), message.alias("message"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- A01, A02: schema ---------------------------------------------------------------------------------

def constraint_errors(df: DataFrame, assertion: str, subject: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken constraint. ``rules`` maps a message to a condition that must hold (null: broken)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for m, ok in rules.items()]))
    rows = df.select(F.col(subject).alias("_subject"), F.explode(broken).alias("_message"))
    return _found(rows, assertion, F.col("_subject"), F.col("_message"))


def case_rules() -> dict[str, Column]:
    c = F.col
    return {
        "case_id: required": F.length("case_id") > 0,
        "domain: required": F.length("domain") > 0,
        "split: unknown value": c("split").isin(V.SPLITS),
        "outcome_class: unknown value": c("outcome_class").isin(V.OUTCOMES),
        "pathway_class: unknown value": c("pathway_class").isin(V.PATHWAYS),
        "gap_severity_bucket: unknown value": c("gap_severity_bucket").isin(V.GAP_SEVERITIES),
        "expected_redlines_min: not a count": c("expected_redlines_min") >= 0,
        "expected_redlines_max: not a count": c("expected_redlines_max") >= 0,
        "label_confidence: outside 0..1": c("label_confidence").between(0, 1),
        "label_review_status: unknown value": c("label_review_status").isin(V.REVIEW_STATUSES),
    }


def _document_rules(required: Sequence[str], lists: Sequence[str], values: dict[str, Sequence[str]], numbers: dict[str, tuple[str, Callable]]) -> dict[str, Column]:
    """Rules of a nested document. Only ``required`` fields may not be null; the other rules hold where there is a value.

    Decoding options are asked for only where the document names any.
    """
    absent = lambda path: F.col("provenance.decoding").isNull() if path.startswith("provenance.decoding.") else F.lit(False)
    rules = {f"{p}: required": absent(p) | F.col(p).isNotNull() for p in required}
    rules |= {f"{p}: null item": F.coalesce(~F.exists(p, lambda x: x.isNull()), F.lit(True)) for p in lists}
    rules |= {f"{p}: unknown value": F.coalesce(F.col(p).isin(list(v)), F.lit(True)) for p, v in values.items()}
    return rules | {f"{p}: {word}": F.coalesce(test(F.col(p)), F.lit(True)) for p, (word, test) in numbers.items()}


def _provenance_fields() -> list[str]:
    return [f"provenance.{f}" for f in V.PROVENANCE_FIELDS] + [f"provenance.decoding.{f}" for f in V.DECODING_FIELDS]


MAX_TOKENS = {"provenance.decoding.max_tokens": ("not positive", lambda c: c > 0)}


def case_document_rules() -> dict[str, Column]:
    """A01 over whole case documents, with ``gold_labels`` and ``provenance`` as structs."""
    count = ("not a count", lambda c: c >= 0)
    return _document_rules(
        [*V.CASE_FIELDS, *[f"gold_labels.{f}" for f in V.GOLD_FIELDS], *_provenance_fields()],
        ["document_stub_fingerprints", *[f"gold_labels.{f}" for f in V.GOLD_LISTS]],
        {"split": V.SPLITS, "outcome_class": V.OUTCOMES, "pathway_class": V.PATHWAYS, "gap_severity_bucket": V.GAP_SEVERITIES,
         "gold_labels.label_review_status": V.REVIEW_STATUSES},
        {"gold_labels.expected_redlines_min": count, "gold_labels.expected_redlines_max": count,
         "gold_labels.label_confidence": ("outside 0..1", lambda c: c.between(0, 1)), **MAX_TOKENS},
    )


def few_shot_document_rules() -> dict[str, Column]:
    """A02 over whole few-shot documents."""
    return _document_rules([*V.FEW_SHOT_FIELDS, *_provenance_fields()], ["inspired_by_train_case_ids"], {}, MAX_TOKENS)


# --- A03: ids -------------------------------------------------------------------------------------------

def duplicate_ids(pool: DataFrame, id_column: str, assertion: str = "A03") -> DataFrame:
    """Every repeat of an id with the place it was first seen. Needs ``path`` and ``line``.

    The first place is an aggregate joined back, so a heavily repeated id is not sorted in one task.
    """
    place = F.struct("path", "line")
    first = pool.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter(F.col("n") > 1)
    repeats = salted_join(pool, first, [id_column], "inner").filter(place > F.col("first"))
    message = _say("duplicate at ", F.col("path"), ":", F.col("line"), " (first seen ", F.col("first.path"), ":", F.col("first.line"), ")")
    return _found(repeats, assertion, F.col(id_column), message)


# --- A04-A06: fingerprint collisions ----------------------------------------------------------------------

def collision_groups(references: DataFrame) -> DataFrame:
    """Fingerprints held by more than one reference, with the number of references.

    ``references``: fingerprint, ref. The owners stay in long form; join back with ``collision_members``.
    """
    return references.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("references")).filter(F.col("references") > 1)


def collision_members(references: DataFrame) -> DataFrame:
    """Every reference that shares its fingerprint, one row each."""
    return salted_join(references, collision_groups(references), ["fingerprint"], "inner")


def fingerprint_references(cases: DataFrame, few_shots: DataFrame | None, column: str) -> DataFrame:
    """(fingerprint, ref) over cases and few-shots; an array column gives one row per element."""
    def refs(df: DataFrame, id_column: str, word: str) -> DataFrame:
        value = F.col(column)
        if df.schema[column].dataType.typeName() == "array":
            value = F.explode(value)
        return df.select(value.alias("fingerprint"), _say(word, F.col(id_column)).alias("ref"))

    out = refs(cases, "case_id", "case ")
    if few_shots is not None and column in few_shots.columns:
        out = out.unionByName(refs(few_shots, "few_shot_id", "few-shot "))
    return out


def collision_violations(references: DataFrame, assertion: str) -> DataFrame:
    rows = collision_members(references)
    return _found(rows, assertion, F.col("fingerprint"), _say(F.col("ref"), " is one of ", F.col("references"), " owners"))


# --- A08-A11 ------------------------------------------------------------------------------------------------

def few_shot_leaks(few_shots: DataFrame, cases: DataFrame) -> DataFrame:
    """(few_shot_id, case_id, split) of parents outside the train split."""
    parents = few_shots.select("few_shot_id", F.explode("inspired_by_train_case_ids").alias("case_id"))
    restricted = cases.filter(F.col("split") != "train").select("case_id", "split")
    return salted_join(parents, restricted, ["case_id"], "inner").select("few_shot_id", "case_id", "split")


def unreviewed_labels(cases: DataFrame) -> DataFrame:
    rows = cases.filter((F.col("split") != "train") & (F.col("label_review_status") != "human-verified"))
    return _found(rows, "A09", F.col("case_id"), _say(F.col("split"), " label is ", F.col("label_review_status")))


def unknown_in_domain(
    cases: DataFrame, references: DataFrame, known: DataFrame, item: str, assertion: str, empty_domain: str = "every_case"
) -> DataFrame:
    """References (case_id, domain, item) that their domain does not know.

    A domain without any entry gives one row per case (``every_case``) or per case that has references
    (``referencing``), or no special row (``none``: each reference is then simply unknown).
    """
    domains = known.select("domain").distinct()
    unknown = unknown_references(references, known, ["domain", item])
    message = _say("unknown ", F.col(item))
    if empty_domain == "none":
        return _found(unknown, assertion, F.col("case_id"), message)
    listed = dim_join(unknown, domains, "domain", "left_semi")
    pool = cases if empty_domain == "every_case" else references
    bare = dim_join(pool.select("case_id", "domain").distinct(), domains, "domain", "left_anti")
    return _found(listed, assertion, F.col("case_id"), message).unionByName(
        _found(bare, assertion, F.col("case_id"), _say("domain ", F.col("domain"), " has no entries"))
    )


def indexed_oracle_paths(receipts: DataFrame) -> DataFrame:
    rows = receipts.select("domain", F.explode("indexed_paths").alias("path")).filter(F.col("path").contains("policy-corpus/oracle/"))
    return _found(rows, "A11", F.col("domain"), _say("indexed oracle path ", F.col("path")))


# --- distributions, A12, A24 ------------------------------------------------------------------------------------

def is_edge_case() -> Column:
    return F.coalesce(F.col("edge_case_family") != "_none_", F.lit(False))


def class_distribution(cases: DataFrame, column: str, listed: Sequence[str], by: Sequence[str] = ("domain", "split")) -> DataFrame:
    """Zero-filled count column per listed value plus n."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in listed]
    return cases.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("n"))


def class_shares(cases: DataFrame, column: str, by: Sequence[str] = ("domain", "split")) -> DataFrame:
    """Count and share of every value inside its group."""
    total = W.partitionBy(*by)
    return (
        cases.groupBy(*by, column).agg(F.count(F.lit(1)).alias("count"))
        .withColumn("share", F.col("count") / F.sum("count").over(total))
    )


def bounded_shares(cases: DataFrame, column: str, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of each bounded class per (domain, split); absent classes count as share 0."""
    n = F.count(F.lit(1))
    entries = F.array(*[
        F.struct(F.lit(v).alias("class"), (F.count_if(F.col(column) == v) / n).alias("share"),
                 F.lit(low).alias("low"), F.lit(high).alias("high"))
        for v, (low, high) in bounds.items()
    ])
    return cases.groupBy("domain", "split").agg(n.alias("n"), entries.alias("e")).select("domain", "split", "n", F.inline("e"))


def edge_ratio(cases: DataFrame) -> DataFrame:
    return cases.groupBy("domain", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_edge_case()).alias("edge_cases"),
        (F.count_if(is_edge_case()) / F.count(F.lit(1))).alias("ratio"),
    )


def diversity_violations(cases: DataFrame, bounds: dict = V.BOUNDS) -> DataFrame:
    """All A12 findings: (domain, split, check, value, share)."""
    pool = cases.filter(F.col("split") != "gold-holdout")
    row = lambda check, value, share: [F.lit(check).alias("check"), value.cast("string").alias("value"), share.cast("double").alias("share")]
    low, high = bounds["edge_ratio"]
    parts = [edge_ratio(pool).filter(~F.col("ratio").between(low, high)).select("domain", "split", *row("edge_ratio", F.lit(None), F.col("ratio")))]
    for check, column in (("outcome", "outcome_class"), ("applicant", "applicant_type")):
        shares = bounded_shares(pool, column, bounds[check])
        for side, test in (("below", F.col("share") < F.col("low")), ("above", F.col("share") > F.col("high"))):
            parts.append(shares.filter(test).select("domain", "split", *row(f"{check}_{side}", F.col("class"), F.col("share"))))
    generators = class_shares(pool, "generator_id").withColumn("expected", F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy("domain", "split")))
    off = F.abs(F.col("share") - F.col("expected")) > bounds["generator_tolerance"]
    parts.append(generators.filter(off).select("domain", "split", *row("generator", F.col("generator_id"), F.col("share"))))
    for check, column in (("gap_severity_degenerate", "gap_severity_bucket"), ("stage1_degenerate", "stage1_complete")):
        parts.append(degenerate_groups(pool, column).select("domain", "split", *row(check, F.col("only_value"), F.lit(None))))
    return union_all(parts)


def degenerate_groups(cases: DataFrame, column: str) -> DataFrame:
    """Groups of more than one case in which a column has a single value (min and max agree)."""
    value = F.col(column).cast("string")
    return (
        cases.groupBy("domain", "split")
        .agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("only_value"), F.max(value).alias("other"))
        .filter((F.col("n") > 1) & (F.col("only_value") == F.col("other")))
        .drop("other")
    )


def sealed_diversity_violations(cases: DataFrame, bounds: dict = V.BOUNDS, smallest: int = V.SMALL_SPLIT) -> DataFrame:
    """Edge ratio and outcome shares of every split with at least ``smallest`` cases."""
    low, high = bounds["edge_ratio"]
    edge = edge_ratio(cases).filter((F.col("n") >= smallest) & ~F.col("ratio").between(low, high))
    shares = bounded_shares(cases, "outcome_class", bounds["outcome"]).filter(F.col("n") >= smallest)
    pick = lambda df, check, value, share: df.select("domain", "split", F.lit(check).alias("check"), value.cast("string").alias("value"), share.alias("share"))
    return union_all([
        pick(edge, "edge_ratio", F.lit(None), F.col("ratio")),
        pick(shares.filter(F.col("share") < F.col("low")), "outcome_below", F.col("class"), F.col("share")),
        pick(shares.filter(F.col("share") > F.col("high")), "outcome_above", F.col("class"), F.col("share")),
    ])


def as_violations(findings: DataFrame, assertion: str) -> DataFrame:
    return _found(
        findings, assertion, F.concat_ws("|", "domain", "split"), F.concat_ws(" ", "check", "value", F.round("share", 4).cast("string"))
    )


# --- A13-A22 ----------------------------------------------------------------------------------------------------

def incomplete_corpus_files(files: DataFrame) -> DataFrame:
    """(domain, path, missing fields) of corpus files without license, vintage date or content hash."""
    wanted = ["license", "vintage_date", "content_hash"]
    gone = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in wanted]))
    return files.select("domain", "path", F.array_join(gone, ", ").alias("missing")).filter(F.col("missing") != "")


def unregistered_rules(oracle_rules: DataFrame, register: DataFrame) -> DataFrame:
    rows = unknown_references(oracle_rules.select("domain", "rule_id"), register, ["domain", "rule_id"])
    return _found(rows, "A14", F.col("domain"), _say("rule ", F.col("rule_id"), " is not in the register"))


def unknown_flags(flags: DataFrame, taxonomy: Sequence[str] = V.SUPPORT_FLAGS) -> DataFrame:
    rows = flags.filter(~F.col("flag").isin(list(taxonomy)))
    return _found(rows, "A19", F.col("case_id"), _say("unknown flag ", F.col("flag")))


def manifest_violations(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """A20 over (split, case_id) rows and declared (split, declared) counts."""
    actual = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("actual"))
    wrong = counts.join(actual, "split", "left").fillna(0, subset=["actual"]).filter(F.col("declared") != F.col("actual"))
    repeated = manifest.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return _found(wrong, "A20", F.col("split"), _say("declares ", F.col("declared"), " ids, lists ", F.col("actual"))).unionByName(
        _found(repeated, "A20", F.col("case_id"), _say("listed ", F.col("n"), " times"))
    )


def declared_vs_discovered(declared: DataFrame, discovered: DataFrame) -> DataFrame:
    """Ids on one side only, with the side."""
    a = declared.select("case_id").distinct().withColumn("in_declared", F.lit(True))
    b = discovered.select("case_id").distinct().withColumn("in_discovered", F.lit(True))
    side = F.when(F.col("in_declared").isNull(), "missing").when(F.col("in_discovered").isNull(), "extra")
    return a.join(b, "case_id", "full_outer").select("case_id", side.alias("side")).filter(F.col("side").isNotNull())


def sealed_hygiene(declared_sizes: DataFrame, files: DataFrame, allow_clear: bool = False) -> DataFrame:
    """A22 per sealed split with ids: sealed copy present, clear copy absent.

    ``declared_sizes``: domain, split, n; ``files``: path. A clear copy without a sealed one is the
    authoring phase and passes.
    """
    base = declared_sizes.filter(F.col("split").isin(V.SEALED_SPLITS) & (F.col("n") > 0)).withColumn(
        "clear", F.concat_ws(".", "domain", "split", F.lit("jsonl"))
    ).withColumn("sealed", F.concat("clear", F.lit(".age")))
    name = files.select(F.substring_index("path", "/", -1).alias("file")).distinct()
    flag = lambda column: name.select(F.col("file").alias(column), F.lit(True).alias(f"has_{column}"))
    seen = base.join(flag("clear"), "clear", "left").join(flag("sealed"), "sealed", "left")
    sealed, clear = F.col("has_sealed").isNotNull(), F.col("has_clear").isNotNull()
    checked = seen.filter(~(~sealed & clear))
    parts = [checked.filter(~sealed).select("domain", "split", F.lit("missing sealed file").alias("problem"))]
    if not allow_clear:
        parts.append(checked.filter(clear).select("domain", "split", F.lit("clear copy present").alias("problem")))
    return union_all(parts)


def receipt_mismatches(receipt: DataFrame, actual: DataFrame) -> DataFrame:
    """Receipt (path, sha256) against actual (path, sha256): missing or mismatch, at most one finding per row of the receipt.

    A path that is listed several times has to hold the recorded content each time; ``actual`` is a hash that differs, if any does.
    """
    have = actual.groupBy("path").agg(F.min("sha256").alias("_low"), F.max("sha256").alias("_high"))
    other = F.when(F.col("_low") != F.col("sha256"), F.col("_low")).otherwise(F.col("_high"))
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha256"), "mismatch")
    rows = receipt.join(have, "path", "left").withColumn("actual", other)
    return rows.withColumn("problem", problem).filter(F.col("problem").isNotNull()).drop("_low", "_high")


# --- roll-up ----------------------------------------------------------------------------------------------------

def summarize(checks: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(assertion, status, violations) for every assertion that ran.

    ``checks`` gives each assertion its own violations and the input it ran over, so none is reported that was not run.
    No input rows and no violations: skipped.
    """
    counts = [
        rows.agg(F.lit(name).alias("assertion"), F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        for name, pair in checks.items() for kind, rows in zip(("violations", "input_rows"), pair)
    ]
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")))
    both = union_all(counts).groupBy("assertion").agg(of("violations").alias("violations"), of("input_rows").alias("input_rows"))
    status = (
        F.when(F.col("violations") > 0, "failed").when(F.col("input_rows") == 0, "skipped").otherwise("passed")
    )
    return both.select("assertion", status.alias("status"), "violations")


def status_counts(summary: DataFrame) -> DataFrame:
    return summary.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped")])


# --- report tables ----------------------------------------------------------------------------------------------------

FAMILY_BLOCKS = 64


def coverage_matrix(cases: DataFrame) -> DataFrame:
    """Cases per (domain, family) and split; every domain appears with every family of the pool.

    Families are dealt to blocks by hash and every domain meets each block once, so the grid is built in many tasks.
    """
    family = F.coalesce("edge_case_family", F.lit("_none_"))
    rows = cases.select("domain", "split", family.alias("family"))
    counted = rows.groupBy("domain", "family").agg(*[F.count_if(F.col("split") == s).alias(s) for s in V.SPLITS])
    families = counted.select("family").distinct().withColumn("block", F.pmod(F.xxhash64("family"), F.lit(FAMILY_BLOCKS)).cast("int"))
    domains = counted.select("domain").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(FAMILY_BLOCKS - 1))))
    grid = domains.join(families, "block").drop("block")
    return grid.join(counted, ["domain", "family"], "left").fillna(0, subset=V.SPLITS)


def inventory(cases: DataFrame, files: DataFrame, rules: DataFrame, few_shots: DataFrame) -> DataFrame:
    """Per domain: cases of every split, corpus files, rules and few-shots; a domain that any of them names is listed.

    One pass over all four, folded map-side to one row a domain and kind. ``few_shots`` needs domain and few_shot_id, each once.
    """
    kinds = [(cases, F.col("split")), (files, F.lit("corpus_files")), (rules, F.lit("rules")), (few_shots, F.lit("few_shots"))]
    rows = union_all([df.select("domain", kind.alias("kind")) for df, kind in kinds])
    counts = {**{s: s for s in V.SPLITS}, **{k: k for k in ("corpus_files", "rules", "few_shots")}}
    return rows.groupBy("domain").agg(*[F.count_if(F.col("kind") == kind).alias(name) for kind, name in counts.items()])


def few_shot_domains(few_shots: DataFrame, cases: DataFrame) -> DataFrame:
    """(few_shot_id, domain) through the parents; without a known parent the only domain, else "unknown"."""
    parents = few_shots.select("few_shot_id", F.explode("inspired_by_train_case_ids").alias("case_id"))
    found = salted_join(parents, cases.select("case_id", "domain"), ["case_id"], "inner").select("few_shot_id", "domain").distinct()
    only = cases.agg(F.when(F.min("domain") == F.max("domain"), F.min("domain"))).scalar()
    return few_shots.select("few_shot_id").distinct().join(found, "few_shot_id", "left").withColumn(
        "domain", F.coalesce("domain", only, F.lit("unknown"))
    )


def all_domains(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [t.select("domain") for t in tables]).distinct()
