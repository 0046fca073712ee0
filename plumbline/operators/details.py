"""What lies behind a score: counts, missed and wrong items of metrics M3-M13, in long form.

A detail is a row (case_id, metric, kind, item, part, value). Counts have no item; lists have one row per item, so a case with
very many items is many rows and never one array.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.operators import metrics as M
from plumbline.operators.joins import dim_join, salted_join
from plumbline.operators.parts import by_part, parts_of
from plumbline.session import stored

REDLINE_COUNTS = {"valid_redline_count": "valid_redline_n", "emitted_count": "redline_n", "gold_gap_count": "gold_gap_n"}
INVALID = {"field_not_found": "field_not_found_n", "gap_not_expected": "gap_not_expected_n", "bylaw_not_found": "bylaw_not_found_n"}
FLAG_COUNTS = {"predicted_count": "flag_n", "gold_count": "gold_flag_n", "intersection_count": "flag_hit_n"}
#: Counts per metric: kind and the counter, see ``metrics.counters``.
COUNTS: dict[str, dict[str, str]] = {
    "M3": {"gold_count": "gold_bylaw_n", "recovered_count": "recovered_n"},
    "M4": {"cited_total": "used_n"},
    "M5": {"gold_bylaw_count": "evidence_n"},
    "M6": {"oracle_numeric_count": "oracle_n", "predicted_numeric_count": "gap_predicted_n", "correct_count": "gap_match_n"},
    "M7": {"boolean_match": "boolean_match", "set_match": "set_match"},
    "M8": {**REDLINE_COUNTS, "distinct_gaps_addressed": "gap_hit_n"},
    "M9": {"memo_section_order_ok": "memo_order_ok", "letter_section_order_ok": "letter_order_ok"},
    "M10": FLAG_COUNTS, "M11": FLAG_COUNTS,
    "M12": REDLINE_COUNTS,
    "M13": {"m4_raw": "m4_raw", "m9_raw": "m9_raw", "staff_score": "staff_score", "applicant_score": "applicant_score"},
}


def _detail(metric: str, kind: str, item: Column | None = None, part: Column | None = None, value: Column | None = None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(
        F.lit(metric).alias("metric"), F.lit(kind).alias("kind"), text(item).alias("item"), text(part).alias("part"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
    )


def _rows(df: DataFrame, found: Sequence[Column]) -> DataFrame:
    """One row per detail that is not null."""
    return df.select("case_id", F.inline(F.array_compact(F.array(*found))))


def _counts(pkg: M.Package, dims: M.Dimensions, metrics: Sequence[str]) -> DataFrame:
    base = M.counters(pkg, dims, metrics)
    derived = {
        "M7": {"boolean_match": lambda: F.col("stage1_complete") == F.col("gold_stage1_complete"), "set_match": lambda: F.col("document_diff_n") == 0},
        "M13": {"m4_raw": lambda: M._m4()[0], "m9_raw": lambda: M._m9()[0]},
    }
    for metric in metrics:
        base = base.withColumns({name: make() for name, make in derived.get(metric, {}).items()})
    found = []
    for metric in metrics:
        found += [_detail(metric, kind, value=F.col(name)) for kind, name in COUNTS.get(metric, {}).items() if name in base.columns]
        if metric in ("M8", "M12"):
            found += [F.when(F.col(n) > 0, _detail(metric, "invalid_reasons", F.lit(reason), value=F.col(n))) for reason, n in INVALID.items()]
        if metric == "M9":
            lists = {"memo_sections_missing": "memo_missing", "letter_sections_missing": "letter_missing", "broken_cross_refs": "broken_refs"}
            sections = [*dict.fromkeys([*dims.memo_sections, *dims.letter_sections])]
            found += [F.when(F.array_contains(c, s), _detail("M9", kind, F.lit(s))) for kind, c in lists.items() for s in sections]
    return _rows(base, found)


def _bylaws(pkg: M.Package, dims: M.Dimensions, metrics: Sequence[str]) -> DataFrame:
    c, item = F.col, F.col("bylaw_id")
    found = {
        "M3": [F.when((c("gold") == 1) & (c("top") == 0), _detail("M3", "missing_bylaw_ids", item))],
        "M4": [F.when(c("used") * c("unknown") == 1, _detail("M4", "invalid_ids", item))],
        "M9": [F.when(c("memo") * c("unknown") == 1, _detail("M9", "invalid_memo_bylaw_ids", item)),
               F.when(c("letter") == 1, _detail("M9", "letter_contains_bylaw_ids", item))],
    }
    return _rows(M.checked_bylaws(pkg, dims), [d for m in metrics for d in found[m]])


def _evidence(pkg: M.Package, dims: M.Dimensions) -> DataFrame:
    items = M.evidence_items(pkg, dims)
    have = F.sum(F.when(F.col("have").isNotNull(), F.col("share")).otherwise(0.0))
    scores = items.groupBy("case_id", "bylaw_id").agg((have / F.max("m")).alias("score"))
    missing = items.filter(F.col("have").isNull())
    return _rows(scores, [_detail("M5", "per_bylaw_scores", F.col("bylaw_id"), value=F.col("score"))]).unionByName(
        _rows(missing, [_detail("M5", "missing_evidence", F.col("bylaw_id"), F.col("evidence_key"))])
    )


def _gaps(pkg: M.Package, dims: M.Dimensions) -> DataFrame:
    c, item = F.col, F.col("gap_id")
    extra = c("numeric") & ~c("oracle") & (c("reported") > 0)
    return _rows(M.gap_verdicts(pkg, dims), [
        F.when(c("oracle"), _detail("M6", "per_gap", item, c("reason"), c("match"))),
        F.when(c("oracle") & (c("reported") == 0), _detail("M6", "missing_gaps", item)),
        F.when(c("oracle") & (c("reported") > 0) & ~c("match"), _detail("M6", "wrong_value_gaps", item)),
        F.when(extra, _detail("M6", "extra_gaps", item, value=c("reported"))),
    ])


def _names(pkg: M.Package, dims: M.Dimensions, metrics: Sequence[str]) -> DataFrame:
    c, item = F.col, F.col("name")
    document, dropped = c("kind") == "document", (c("kind") == "flag") & (c("predicted") * (1 - c("known")) == 1)
    found = {
        "M7": [F.when(document & (c("predicted") > c("gold")), _detail("M7", "unexpected_missing", item)),
               F.when(document & (c("predicted") < c("gold")), _detail("M7", "omitted_missing", item))],
        "M10": [F.when(dropped, _detail("M10", "dropped_for_taxonomy", item))],
        "M11": [F.when(dropped, _detail("M11", "dropped_for_taxonomy", item))],
    }
    items = M.name_items(pkg, dims)
    return _rows(items, [d for m in metrics for d in found[m]])


def _judged(pkg: M.Package, dims: M.Dimensions) -> DataFrame:
    """Valid redlines with their judged score (null: judge error)."""
    known = dims.corpus.select(F.col("bylaw_id").alias("cited_bylaw_id")).distinct()
    usable = dim_join(M.checked_redlines(pkg).filter("field_exists"), known, "cited_bylaw_id", "left_semi", dims.small("corpus"))
    expected = pkg.gold_gaps.select("case_id", F.col("gap_id").alias("addresses_gap")).distinct()
    valid = salted_join(usable, expected, ["case_id", "addresses_gap"], "left_semi")
    scored = valid.join(pkg.redline_scores.select("case_id", "seq", "score"), ["case_id", "seq"], "left")
    return _rows(scored, [_detail("M12", "judged_redlines", F.col("seq"), F.col("addresses_gap"), F.col("score"))])


def metric_details(pkg: M.Package, dims: M.Dimensions, metrics: Sequence[str] = V.METRICS[2:], parts: int | None = None) -> DataFrame:
    """(case_id, metric, kind, item, part, value) rows for metrics M3-M13.

    Item tables are made and stored once per item space, however many of its metrics are asked for; counts and lists read them.
    M12 has judged redlines only where the package holds their scores. ``parts`` are the parts of the cases that are taken one after
    the other, by their number if not given.
    """
    parts = parts_of(pkg.cases) if parts is None else parts
    if parts > 1:
        return by_part(M.needed_by(pkg, metrics), parts, lambda p: metric_details(p, dims, metrics, 1), "details")
    space = lambda *names: [m for m in metrics if m in names]
    items = M.read_by(pkg, metrics)
    made = {}
    for name, listed, make in (
        ("bylaw", ("M3", "M4", "M9"), M.checked_bylaws), ("name", ("M7", "M10", "M11"), M.name_items),
        ("evidence", ("M5",), M.evidence_items), ("gap", ("M6",), M.gap_verdicts),
    ):
        if space(*listed):
            made[name] = stored(make(items, dims), f"{name}-items")
    pkg = replace(pkg, made=made)
    found = [_counts(pkg, dims, metrics)]
    for wanted, make in ((space("M3", "M4", "M9"), _bylaws), (space("M7", "M10", "M11"), _names)):
        if wanted:
            found.append(make(pkg, dims, wanted))
    for metric, make in (("M5", _evidence), ("M6", _gaps), ("M12", _judged)):
        if metric in metrics and (metric != "M12" or pkg.redline_scores is not None):
            found.append(make(pkg, dims))
    return M._union(found)
