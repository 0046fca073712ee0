"""Per-case metrics M1-M13 and composites.

Every metric works on long tables (case, item, ...), in two aggregation steps:

1. items: all mentions of one item in one case (gold, ranked, evidence, redline, memo, ...) fold into one
   row of 0/1 marks, ``groupBy(case_id, item)``;
2. sums: the item rows of a case fold into a few counters, ``groupBy(case_id)``.

Both steps are sums and maxima, so Spark combines them map-side and a case or citation that holds a large
share of all rows never ends up in one task. ``score_cases`` runs all metrics over one shared set of
counters; a single metric builds only the counters it needs. Many cases with the counters of several
spaces are scored part by part, see ``parts``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions import scalar as S
from plumbline.operators.joins import dim_join, hashed_join, is_small
from plumbline.operators.parts import by_part, parts_of


@dataclass
class Package:
    """Long tables of cases, gold labels and predictions. Only the tables a metric reads must be given."""

    cases: DataFrame | None = None             # case_id, domain, split, pathway_class, gold_stage1_complete
    runtime: DataFrame | None = None           # case_id, predicted_pathway, stage1_complete, memo_markdown, letter_markdown
    gold_bylaws: DataFrame | None = None       # case_id, bylaw_id (repeats count in M5)
    cited: DataFrame | None = None             # case_id, seq (from 0), bylaw_id
    evidence: DataFrame | None = None          # case_id, bylaw_id, evidence_key (null: entry without keys)
    gold_gaps: DataFrame | None = None         # case_id, gap_id
    reported_gaps: DataFrame | None = None     # case_id, seq, gap_id, proposed_value, required_value, delta
    packet_numbers: DataFrame | None = None    # case_id, field, value
    redlines: DataFrame | None = None          # case_id, seq, addresses_gap, cited_bylaw_id, field_exists (or field, with packet_fields)
    packet_fields: DataFrame | None = None     # case_id, field: what the field of a redline is looked up in
    gold_missing: DataFrame | None = None      # case_id, document_id
    missing: DataFrame | None = None           # case_id, document_id
    gold_flags: DataFrame | None = None        # case_id, flag
    flags: DataFrame | None = None             # case_id, flag
    redline_scores: DataFrame | None = None    # case_id, seq, score (null: judge error)
    text_scores: DataFrame | None = None       # case_id, audience (staff/applicant), score (null: judge error)
    made: dict[str, DataFrame] = field(default_factory=dict)  # item tables made already, by space


@dataclass
class Dimensions:
    corpus: DataFrame | None = None            # bylaw_id
    evidence_map: DataFrame | None = None      # bylaw_id, evidence_key
    truth: DataFrame | None = None             # gap_id, proposed_field, required_field, tolerance (None: no truth map)
    flags: Sequence[str] = field(default_factory=lambda: V.SUPPORT_FLAGS)
    memo_sections: Sequence[str] = field(default_factory=lambda: V.MEMO_SECTIONS)
    letter_sections: Sequence[str] = field(default_factory=lambda: V.LETTER_SECTIONS)
    measured: dict[str, bool] = field(default_factory=dict)

    def small(self, name: str) -> bool:
        """Whether a dimension may be broadcast; measured once per set of dimensions."""
        if name not in self.measured:
            self.measured[name] = is_small(getattr(self, name))
        return self.measured[name]


REPORT = ("proposed_value", "required_value", "delta")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _marked(df: DataFrame, item: Column, name: str, **marks: Column | int) -> DataFrame:
    columns = [(m if isinstance(m, Column) else F.lit(m)).cast("int").alias(k) for k, m in marks.items()]
    return df.select("case_id", item.alias(name), *columns)


def _fold(parts: Sequence[DataFrame], keys: Sequence[str], marks: Sequence[str]) -> DataFrame:
    folded = _union(parts)
    return folded.groupBy(*keys).agg(
        *[F.coalesce(F.max(m), F.lit(0)).alias(m) if m in folded.columns else F.lit(0).alias(m) for m in marks]
    )


# --- step 1 + 2 per item space ---------------------------------------------------------------------

def bylaw_items(pkg: Package) -> DataFrame:
    """One row per (case, citation) with marks gold, top (in the first ten), used, memo, letter."""
    c = F.col
    parts = []
    if pkg.gold_bylaws is not None:
        parts.append(_marked(pkg.gold_bylaws, c("bylaw_id"), "bylaw_id", gold=1))
    if pkg.cited is not None:
        parts.append(_marked(pkg.cited, c("bylaw_id"), "bylaw_id", top=c("seq") < V.RECALL_DEPTH, used=1))
    if pkg.evidence is not None:
        parts.append(_marked(pkg.evidence, c("bylaw_id"), "bylaw_id", used=1))
    if pkg.redlines is not None:
        parts.append(_marked(pkg.redlines, c("cited_bylaw_id"), "bylaw_id", used=1))
    if pkg.runtime is not None and "memo_markdown" in pkg.runtime.columns:
        told = lambda text, in_memo: F.transform(S.citation_ids(c(text)), lambda i: F.struct(i.alias("id"), F.lit(in_memo).alias("in_memo")))
        found = [F.coalesce(told(*t), F.array().cast("array<struct<id:string,in_memo:boolean>>")) for t in (("memo_markdown", True), ("letter_markdown", False))]
        ids = pkg.runtime.select("case_id", F.inline(F.concat(*found)))
        memo, letter = F.when(c("in_memo"), 1), F.when(~c("in_memo"), 1)
        parts.append(_marked(ids, c("id"), "bylaw_id", used=memo, memo=memo, letter=letter))
    return _fold(parts, ["case_id", "bylaw_id"], ["gold", "top", "used", "memo", "letter"])


def checked_bylaws(pkg: Package, dims: Dimensions) -> DataFrame:
    """Citation items with ``unknown``: 1 where the corpus does not list the citation."""
    if "bylaw" in pkg.made:
        return pkg.made["bylaw"]
    items = bylaw_items(pkg)
    if dims.corpus is None:
        return items.withColumn("unknown", F.lit(1))
    known = dims.corpus.select("bylaw_id").distinct().withColumn("valid", F.lit(1))
    joined = dim_join(items, known, "bylaw_id", "left", dims.small("corpus"))
    return joined.withColumn("unknown", F.when(F.col("valid").isNull(), 1).otherwise(0)).drop("valid")


def bylaw_sums(pkg: Package, dims: Dimensions) -> DataFrame:
    return checked_bylaws(pkg, dims).groupBy("case_id").agg(
        F.sum("gold").alias("gold_bylaw_n"),
        F.sum(F.col("gold") * F.col("top")).alias("recovered_n"),
        F.sum("used").alias("used_n"),
        F.sum(F.col("used") * F.col("unknown")).alias("invalid_n"),
        F.sum(F.col("memo") * F.col("unknown")).alias("invalid_memo_n"),
        F.sum("letter").alias("letter_id_n"),
    )


def evidence_items(pkg: Package, dims: Dimensions) -> DataFrame:
    """One row per gold citation and required key: repeats ``m``, its ``share`` of the case's sum, ``have`` (null: not given).

    A citation without requirements has one row without a key, with all of its share.
    """
    if "evidence" in pkg.made:
        return pkg.made["evidence"]
    need = dims.evidence_map.groupBy("bylaw_id", "evidence_key").agg(F.count(F.lit(1)).alias("w"))
    total = dims.evidence_map.groupBy("bylaw_id").agg(F.count(F.lit(1)).alias("required_n"))
    gold = pkg.gold_bylaws.groupBy("case_id", "bylaw_id").agg(F.count(F.lit(1)).alias("m"))
    wanted = dim_join(gold, need.join(total, "bylaw_id"), "bylaw_id", "left", dims.small("evidence_map"))
    required = wanted.filter(F.col("w").isNotNull()).select(
        "case_id", "bylaw_id", "evidence_key", "m", (F.col("m") * F.col("w") / F.col("required_n")).alias("share")
    )
    given = pkg.evidence.filter(F.col("evidence_key").isNotNull()).select(
        "case_id", "bylaw_id", "evidence_key", F.lit(1).alias("have")
    )
    keyed = (
        _union([required, given])
        .groupBy("case_id", "bylaw_id", "evidence_key")
        .agg(F.max("m").alias("m"), F.sum("share").alias("share"), F.max("have").alias("have"))
        .filter(F.col("share").isNotNull())
    )
    free = wanted.filter(F.col("w").isNull()).select(
        "case_id", "bylaw_id", F.lit(None).cast("string").alias("evidence_key"), "m", F.col("m").cast("double").alias("share"), F.lit(1).alias("have")
    )
    return keyed.unionByName(free)


def evidence_sums(pkg: Package, dims: Dimensions) -> DataFrame:
    """Mean evidence share over gold citations, repeats counted; citations without requirements score 1."""
    met = evidence_items(pkg, dims).filter(F.col("have").isNotNull()).select("case_id", F.col("share").alias("evidence_sum"))
    count = pkg.gold_bylaws.groupBy("case_id").agg(F.count(F.lit(1)).alias("evidence_n"))
    return _union([met, count]).groupBy("case_id").agg(
        F.sum("evidence_sum").alias("evidence_sum"), F.sum("evidence_n").alias("evidence_n")
    )


def checked_redlines(pkg: Package) -> DataFrame:
    """Redlines with ``field_exists``, looked up in the fields of the packet where it is not told."""
    if pkg.packet_fields is None:
        return pkg.redlines
    found = pkg.packet_fields.select("case_id", "field", F.lit(True).alias("field_exists"))
    return hashed_join(pkg.redlines, found, ["case_id", "field"], "left").drop("field").fillna(False, subset=["field_exists"])


def gap_items(pkg: Package, dims: Dimensions) -> DataFrame:
    """One row per (case, gap): expected and reported counts, last report, truth values, redline marks."""
    c = F.col
    parts = []
    if pkg.gold_gaps is not None:
        parts.append(pkg.gold_gaps.select("case_id", "gap_id", F.lit(1).alias("expected")))
    if pkg.reported_gaps is not None:
        parts.append(pkg.reported_gaps.select("case_id", "gap_id", F.lit(1).alias("reported"), "seq", *REPORT))
    if pkg.packet_numbers is not None and dims.truth is not None:
        sides = [F.struct(c(f"{side}_field").alias("field"), F.lit(side).alias("side")) for side in ("proposed", "required")]
        hit = dim_join(pkg.packet_numbers, dims.truth.select("gap_id", F.inline(F.array(*sides))), "field", "inner", dims.small("truth"))
        truth = [F.when(c("side") == side, c("value")).alias(f"truth_{side}") for side in ("proposed", "required")]
        parts.append(hit.select("case_id", "gap_id", *truth))
    if pkg.redlines is not None:
        redlines = checked_redlines(pkg)
        known = dims.corpus.select(c("bylaw_id").alias("cited_bylaw_id")).distinct().withColumn("known", F.lit(1))
        redlines = dim_join(redlines, known, "cited_bylaw_id", "left", dims.small("corpus"))
        usable = c("field_exists") & c("known").isNotNull()
        marks = [
            F.lit(1).alias("redline"),
            usable.cast("int").alias("usable"),
            (~c("field_exists")).cast("int").alias("no_field"),
            c("known").isNull().cast("int").alias("no_bylaw"),
        ]
        if pkg.redline_scores is not None:
            redlines = hashed_join(redlines, pkg.redline_scores.select("case_id", "seq", "score"), ["case_id", "seq"], "left")
            marks += [
                F.when(usable, c("score")).alias("judged"),
                (usable & c("score").isNull()).cast("int").alias("judge_error"),
            ]
        parts.append(redlines.select("case_id", c("addresses_gap").alias("gap_id"), *marks))
    rows = _union(parts)
    have = set(rows.columns)

    def total(name: str) -> Column:
        return (F.coalesce(F.sum(name), F.lit(0)) if name in have else F.lit(0)).alias(name)

    def only(name: str) -> Column:
        return (F.max(name) if name in have else F.lit(None).cast("double")).alias(name)

    # plain numbers, so that the rows are folded by hash; a struct would have them sorted
    last = [(F.max_by(n, "seq") if "seq" in have else F.lit(None).cast("double")).alias(n) for n in REPORT]
    return rows.groupBy("case_id", "gap_id").agg(
        *[total(n) for n in ("expected", "reported", "redline", "usable", "no_field", "no_bylaw", "judged", "judge_error")],
        only("truth_proposed"),
        only("truth_required"),
        *last,
    ).withColumn("report", F.struct(*REPORT)).drop(*REPORT)


def gap_verdicts(pkg: Package, dims: Dimensions) -> DataFrame:
    """Gap items with ``oracle`` (counts for M6), ``match`` and the reason of the numeric check."""
    if "gap" in pkg.made:
        return pkg.made["gap"]
    c = F.col
    items = gap_items(pkg, dims)
    if dims.truth is None:
        seen = c("reported") > 0
        return items.withColumns({
            "numeric": F.lit(True),
            "oracle": (c("expected") > 0) & (seen | S.is_numeric_gap(c("gap_id"))),
            "reason": F.when(seen, "legacy_id_match").otherwise("not_reported"),
            "match": seen,
        })
    rows = dims.truth.groupBy("gap_id").agg(F.first("tolerance").alias("tolerance"))
    items = dim_join(items, rows, "gap_id", "left", dims.small("truth"))
    off = lambda told, truth: F.abs(told - truth) > c("tolerance")
    reason = (
        F.when(c("reported") == 0, "not_reported")
        .when(c("truth_proposed").isNull() | c("truth_required").isNull(), "application_packet_missing_truth_field")
        .when(off(c("report.proposed_value"), c("truth_proposed")), "provided_out_of_tolerance")
        .when(off(c("report.required_value"), c("truth_required")), "required_out_of_tolerance")
        .when(off(c("report.delta"), c("truth_required") - c("truth_proposed")), "delta_out_of_tolerance")
        .otherwise("ok")
    )
    return items.withColumns({
        "numeric": c("tolerance").isNotNull(),
        "oracle": (c("expected") > 0) & c("tolerance").isNotNull(),
        "reason": reason,
    }).withColumn("match", c("reason") == "ok")


def gap_sums(pkg: Package, dims: Dimensions) -> DataFrame:
    c = F.col
    rows = gap_verdicts(pkg, dims)
    expected = c("expected") > 0
    as_int = lambda test: test.cast("int")
    return rows.groupBy("case_id").agg(
        F.sum(as_int(c("oracle"))).alias("oracle_n"),
        F.sum(F.when(c("oracle") & c("match"), c("expected")).otherwise(0)).alias("gap_match_n"),
        F.sum(F.when(c("numeric") & ~c("oracle"), c("reported")).otherwise(0)).alias("gap_extra_n"),
        F.sum(F.when(c("numeric") | c("oracle"), c("reported")).otherwise(0)).alias("gap_predicted_n"),
        F.sum(as_int(expected)).alias("gold_gap_n"),
        F.sum("redline").alias("redline_n"),
        F.sum(as_int(expected & (c("usable") > 0))).alias("gap_hit_n"),
        F.sum(F.when(expected, c("usable")).otherwise(0)).alias("valid_redline_n"),
        F.sum(F.when(expected, 0).otherwise(c("redline"))).alias("gap_not_expected_n"),
        F.sum("no_field").alias("field_not_found_n"),
        F.sum("no_bylaw").alias("bylaw_not_found_n"),
        F.sum(F.when(expected, c("judged")).otherwise(0)).alias("judged_sum"),
        F.sum(F.when(expected, c("judge_error")).otherwise(0)).alias("judge_error_n"),
    )


def name_items(pkg: Package, dims: Dimensions) -> DataFrame:
    """One row per (case, kind, name) of support flags and missing documents, with marks gold, predicted and known."""
    if "name" in pkg.made:
        return pkg.made["name"]
    parts = []
    for kind, gold, predicted, column in (
        ("flag", pkg.gold_flags, pkg.flags, "flag"),
        ("document", pkg.gold_missing, pkg.missing, "document_id"),
    ):
        for table, mark in ((gold, "gold"), (predicted, "predicted")):
            if table is not None:
                parts.append(table.select(
                    "case_id", F.lit(kind).alias("kind"), F.col(column).alias("name"), F.lit(1).alias(mark)
                ))
    items = _fold(parts, ["case_id", "kind", "name"], ["gold", "predicted"])
    return items.withColumn("known", F.col("name").isin(list(dims.flags)).cast("int"))


def name_sums(pkg: Package, dims: Dimensions) -> DataFrame:
    """Support flags (against the closed taxonomy) and missing documents in one pass."""
    items, known = name_items(pkg, dims), F.col("known")
    flag, document = F.col("kind") == "flag", F.col("kind") == "document"
    count = lambda test, value: F.sum(F.when(test, value).otherwise(0))
    return items.groupBy("case_id").agg(
        count(flag, F.col("gold")).alias("gold_flag_n"),
        count(flag, F.col("predicted") * known).alias("flag_n"),
        count(flag, F.col("predicted") * (1 - known)).alias("dropped_flag_n"),
        count(flag, F.col("gold") * F.col("predicted") * known).alias("flag_hit_n"),
        count(document, F.abs(F.col("gold") - F.col("predicted"))).alias("document_diff_n"),
    )


TEXTS = ("memo_markdown", "letter_markdown")


def text_checks(runtime: DataFrame, dims: Dimensions) -> DataFrame:
    """The runtime table with section and cross-reference checks in place of both texts; a narrow projection."""
    kept = [name for name in runtime.columns if name not in TEXTS]
    memo, letter = F.col("memo_sections"), F.col("letter_sections")
    return (
        runtime.select(
            *kept, "memo_markdown",
            S.headings(F.col("memo_markdown")).alias("memo_sections"),
            S.headings(F.col("letter_markdown")).alias("letter_sections"),
        )
        .select(
            *kept,
            S.missing_sections(memo, dims.memo_sections).alias("memo_missing"),
            S.missing_sections(letter, dims.letter_sections).alias("letter_missing"),
            S.sections_in_order(memo, dims.memo_sections).alias("memo_order_ok"),
            S.sections_in_order(letter, dims.letter_sections).alias("letter_order_ok"),
            S.broken_cross_refs(F.col("memo_markdown"), memo, dims.memo_sections).alias("broken_refs"),
        )
        .withColumn(
            "text_ok",
            (F.size("memo_missing") == 0) & (F.size("letter_missing") == 0)
            & F.col("memo_order_ok") & F.col("letter_order_ok") & (F.size("broken_refs") == 0),
        )
    )


# --- formulas ------------------------------------------------------------------------------------

def _ratio(top: str, bottom: Column) -> Column:
    return F.col(top) / F.nullif(bottom, F.lit(0))


def _branches(*rules: tuple[Column, str, Column]) -> tuple[Column, Column]:
    """First rule that holds gives branch and raw; the last tuple is the default."""
    *cases, (_, branch, raw) = rules
    raw_column, branch_column = raw.cast("double"), F.lit(branch)
    for test, name, value in reversed(cases):
        raw_column = F.when(test, value.cast("double")).otherwise(raw_column)
        branch_column = F.when(test, F.lit(name)).otherwise(branch_column)
    return raw_column, branch_column


one, zero = (lambda: F.lit(1.0)), (lambda: F.lit(0.0))


def _m1() -> tuple[Column, Column]:
    return (F.col("predicted_pathway") == F.col("pathway_class")).cast("double"), F.lit("standard")


def _m2() -> tuple[Column, Column]:
    escalates = lambda name: F.col(name) == "specialist-required"
    return (escalates("predicted_pathway") == escalates("pathway_class")).cast("double"), F.lit("standard")


def _m3() -> tuple[Column, Column]:
    n = F.col("gold_bylaw_n")
    return _branches((n == 0, "vacuous_one_gold_empty", one()), (None, "standard", _ratio("recovered_n", n)))


def _m4() -> tuple[Column, Column]:
    return _branches(
        (F.col("used_n") == 0, "vacuous_one_empty_both", one()),
        (None, "standard", (F.col("invalid_n") == 0)),
    )


def _m5() -> tuple[Column, Column]:
    n = F.col("evidence_n")
    return _branches((n == 0, "vacuous_one_gold_empty", one()), (None, "standard", _ratio("evidence_sum", n)))


def _m6() -> tuple[Column, Column]:
    n = F.col("oracle_n")
    return _branches(
        ((n == 0) & (F.col("gap_predicted_n") == 0), "vacuous_one_empty_both", one()),
        (n == 0, "zero_predicted_nonempty_gold_empty", zero()),
        (None, "standard", _ratio("gap_match_n", n + F.col("gap_extra_n"))),
    )


def _m7() -> tuple[Column, Column]:
    same = (F.col("stage1_complete") == F.col("gold_stage1_complete")) & (F.col("document_diff_n") == 0)
    return same.cast("double"), F.lit("standard")


def _redline_branches() -> list[tuple[Column, str, Column]]:
    gold, emitted = F.col("gold_gap_n"), F.col("redline_n")
    return [
        ((gold > 0) & (emitted == 0), "zero_gold_nonempty_predicted_empty", zero()),
        ((gold == 0) & (emitted == 0), "vacuous_one_empty_both", one()),
        (gold == 0, "zero_predicted_nonempty_gold_empty", zero()),
    ]


def _m8() -> tuple[Column, Column]:
    worst = F.greatest("gold_gap_n", "redline_n")
    return _branches(*_redline_branches(), (None, "standard", _ratio("gap_hit_n", worst)))


def _m9() -> tuple[Column, Column]:
    ok = F.col("text_ok") & (F.col("invalid_memo_n") == 0) & (F.col("letter_id_n") == 0)
    return ok.cast("double"), F.lit("standard")


def _m10() -> tuple[Column, Column]:
    told, gold = F.col("flag_n"), F.col("gold_flag_n")
    return _branches(
        ((told == 0) & (gold == 0), "vacuous_one_empty_both", one()),
        (told == 0, "zero_gold_nonempty_predicted_empty", zero()),
        (None, "standard", _ratio("flag_hit_n", told)),
    )


def _m11() -> tuple[Column, Column]:
    told, gold = F.col("flag_n"), F.col("gold_flag_n")
    return _branches(
        ((told == 0) & (gold == 0), "vacuous_one_empty_both", one()),
        (gold == 0, "zero_predicted_nonempty_gold_empty", zero()),
        (None, "standard", _ratio("flag_hit_n", gold)),
    )


def _not_scored() -> tuple[Column, Column]:
    return F.lit(None).cast("double"), F.lit("not_applicable")


def _m12(judge: bool) -> tuple[Column, Column]:
    if not judge:
        return _not_scored()
    worst = F.greatest("gold_gap_n", "redline_n")
    return _branches(
        *_redline_branches(),
        (F.col("judge_error_n") > 0, "not_applicable", F.lit(None)),
        (None, "standard", _ratio("judged_sum", worst)),
    )


def _m13(judge: bool) -> tuple[Column, Column]:
    m4, m9 = _m4()[0], _m9()[0]
    gate = ((m4 != 1) | (m9 != 1), "gate_failed", zero())
    if not judge:
        return _branches(gate, (None, "not_applicable", F.lit(None)))
    score = V.STAFF_WEIGHT * F.col("staff_score") + V.APPLICANT_WEIGHT * F.col("applicant_score")
    return _branches(gate, (score.isNull(), "not_applicable", F.lit(None)), (None, "standard", score))


@dataclass(frozen=True)
class Metric:
    """Formula over the counters, the counter spaces it needs and the item tables it reads."""

    formula: Callable[..., tuple[Column, Column]]
    spaces: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()
    judged: bool = False


METRIC_TABLE: dict[str, Metric] = {
    "M1": Metric(_m1), "M2": Metric(_m2),
    "M3": Metric(_m3, ("bylaw",), ("gold_bylaws", "cited")),
    "M4": Metric(_m4, ("bylaw",), ("cited", "evidence", "redlines", "runtime")),
    "M5": Metric(_m5, ("evidence",), ("gold_bylaws", "evidence")),
    "M6": Metric(_m6, ("gap",), ("gold_gaps", "reported_gaps", "packet_numbers")),
    "M7": Metric(_m7, ("name",), ("gold_missing", "missing")),
    "M8": Metric(_m8, ("gap",), ("gold_gaps", "redlines", "packet_fields")),
    "M9": Metric(_m9, ("bylaw", "text"), ("runtime",)),
    "M10": Metric(_m10, ("name",), ("gold_flags", "flags")),
    "M11": Metric(_m11, ("name",), ("gold_flags", "flags")),
    "M12": Metric(_m12, ("gap",), ("gold_gaps", "redlines", "packet_fields", "redline_scores"), judged=True),
    "M13": Metric(_m13, ("bylaw", "text"), ("cited", "evidence", "redlines", "runtime"), judged=True),
}

_SPACES = {"bylaw": bylaw_sums, "evidence": evidence_sums, "gap": gap_sums, "name": name_sums}


def read_by(pkg: Package, metrics: Sequence[str], table: dict[str, Metric] = METRIC_TABLE) -> Package:
    """The package with only the item tables that the metrics read."""
    reads = {r for m in metrics for r in table[m].reads}
    return replace(pkg, **{f.name: None for f in fields(pkg) if f.name not in reads and f.name != "made"})


def needed_by(pkg: Package, metrics: Sequence[str], table: dict[str, Metric] = METRIC_TABLE) -> Package:
    """The package with all tables that counters of the metrics come from, the cases among them; texts only where they are read."""
    items, runtime = read_by(pkg, metrics, table), pkg.runtime
    if runtime is not None and items.runtime is None:
        runtime = runtime.drop(*TEXTS)
    return replace(items, cases=pkg.cases, runtime=runtime, text_scores=pkg.text_scores if "M13" in metrics else None)


def counters(pkg: Package, dims: Dimensions, metrics: Sequence[str], table: dict[str, Metric] = METRIC_TABLE) -> DataFrame:
    """One row per case with every counter the metrics need; counters of absent items are 0."""
    spaces = sorted({s for m in metrics for s in table[m].spaces})
    base = pkg.cases
    items = read_by(pkg, metrics, table)
    if pkg.runtime is not None:
        told = text_checks(pkg.runtime, dims) if "text" in spaces else pkg.runtime.drop(*TEXTS)
        base = base.join(told, "case_id", "inner")
    sums = [_SPACES[s](items, dims) for s in spaces if s in _SPACES]
    judged = []
    if "M13" in metrics and pkg.text_scores is not None:
        judged = ["staff_score", "applicant_score"]
        sums.append(pkg.text_scores.groupBy("case_id").agg(
            *[F.max(F.when(F.col("audience") == name.removesuffix("_score"), F.col("score"))).alias(name) for name in judged]
        ))
    if sums:
        stacked = _union(sums)
        names = [c for c in stacked.columns if c != "case_id"]
        merged = stacked.groupBy("case_id").agg(*[F.sum(c).alias(c) for c in names])
        base = base.join(merged, "case_id", "left").fillna(0, subset=[c for c in names if c not in judged])
    return base


def score_cases(
    pkg: Package,
    dims: Dimensions,
    metrics: Sequence[str] = V.METRICS,
    table: dict[str, Metric] = METRIC_TABLE,
    keep: Sequence[str] = ("case_id", "domain", "split"),
    parts: int | None = None,
) -> DataFrame:
    """Wide result: one row per case with ``M<n>`` and ``M<n>_branch`` columns.

    M12 and M13 are judged only when the response tables are part of the package. ``parts`` are the parts of the cases that are
    scored one after the other, by their number if not given; metrics of a space or two take all cases at once.
    """
    if parts is None:
        parts = parts_of(pkg.cases) if len({s for m in metrics for s in table[m].spaces}) > 2 else 1
    if parts > 1:
        return by_part(needed_by(pkg, metrics, table), parts, lambda p: score_cases(p, dims, metrics, table, keep, 1), "scores")
    judge = {"M12": pkg.redline_scores is not None, "M13": pkg.text_scores is not None}
    base = counters(pkg, dims, metrics, table)
    columns = [F.col(c) for c in keep if c in base.columns]
    for name in metrics:
        metric = table[name]
        raw, branch = metric.formula(judge[name]) if metric.judged else metric.formula()
        columns += [raw.alias(name), branch.alias(f"{name}_branch")]
    return base.select(*columns)


def to_long(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(case, metric, raw, branch) rows out of the wide result."""
    keys = [c for c in scores.columns if c not in {n for m in metrics for n in (m, f"{m}_branch")}]
    entry = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("raw"), F.col(f"{m}_branch").alias("branch")) for m in metrics
    ])
    return scores.select(*keys, F.inline(entry))


# --- composites ------------------------------------------------------------------------------------

def weighted(metrics: Sequence[str], scale: float = 1.0) -> Column:
    """Weighted sum of raw scores; null when any of them is null."""
    total = reduce(lambda a, b: a + b, [F.col(m) * V.WEIGHTS[m] for m in metrics])
    return total * scale if scale == 1.0 else total / F.lit(float(scale)) * 100


def with_composites(scores: DataFrame) -> DataFrame:
    """Adds the deterministic composite (0..100), the partial lower bound (0..85) and the full composite."""
    added = {
        "deterministic_prqs": weighted(V.DETERMINISTIC, V.DETERMINISTIC_MAX),
        "partial_full_prqs_lower_bound": weighted(V.NON_JUDGE),
    }
    if {"M12", "M13"} <= set(scores.columns):
        added["full_prqs"] = weighted(V.METRICS)
    return scores.withColumns(added)


def range_violations(long_scores: DataFrame) -> DataFrame:
    """Rows that may not enter a composite: null M1-M11 or any raw outside 0..1."""
    raw = F.col("raw")
    problem = F.when(raw.isNull() & F.col("metric").isin(V.NON_JUDGE), "raw_is_null").when(
        (raw < 0) | (raw > 1), "raw_out_of_range"
    )
    return long_scores.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def require_valid(scores: DataFrame, metrics: Sequence[str] = V.NON_JUDGE) -> DataFrame:
    """Strict form: the job fails on the first case with a null or out-of-range raw score."""
    for m in metrics:
        bad = F.col(m).isNull() if m in V.NON_JUDGE else F.lit(False)
        bad = bad | (F.col(m) < 0) | (F.col(m) > 1)
        message = F.concat(F.lit(f"metric {m} of case "), F.col("case_id"), F.lit(" is null or outside 0..1"))
        scores = scores.withColumn(m, F.when(bad, F.raise_error(message)).otherwise(F.col(m)))
    return scores
