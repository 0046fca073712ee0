"""Round reports, deltas, regression gates and triage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline import values as V
from plumbline.functions import scalar as S


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def _number(text: Column) -> Column:
    return F.when(F.lower(F.trim(text)) != "null", S.lenient_number(text))


def parse_round_reports(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(header rows, metric rows) of report markdown. ``reports``: round, text."""
    grab = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    header = reports.select(
        "round",
        grab("- Domain: `([^`]+)`").alias("domain"),
        grab("- Split: `([^`]+)`").alias("split"),
        grab("- Cases attempted: ([0-9]+)").cast("bigint").alias("cases_attempted"),
        grab("- Cases scored: ([0-9]+)").cast("bigint").alias("cases_scored"),
        grab("- Runtime errors: ([0-9]+)").cast("bigint").alias("runtime_errors"),
        F.when(F.col("text").contains("- Judge enabled: yes"), True)
        .when(F.col("text").contains("- Judge enabled: no"), False).alias("judge_enabled"),
    )
    lines = reports.select("round", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    trimmed = F.trim("line")
    rows = lines.filter(trimmed.startswith("|") & trimmed.endswith("|")).select("round", "line_no", _cells(F.col("line")).alias("cell"))
    cell = lambda i: F.get("cell", F.lit(i))
    composite = cell(0).isin("deterministic_prqs", "partial_full_prqs_lower_bound")
    metrics = rows.filter(composite | cell(0).rlike("^M[0-9]+$")).select(
        "round", cell(0).alias("metric"), _number(cell(1)).alias("mean"),
        F.when(composite, _number(cell(2))).alias("lower"), F.when(composite, _number(cell(3))).alias("upper"),
        F.when(~composite, _number(cell(3))).alias("null_count"), "line_no",
    )
    # a metric named twice keeps its last row
    last = metrics.groupBy("round", "metric").agg(
        F.max_by(F.struct("mean", "lower", "upper", "null_count"), "line_no").alias("m")
    )
    return header, last.select("round", "metric", "m.*")


def round_listing(folders: DataFrame) -> DataFrame:
    """One row per round folder: composite, interval, case count, status, delta to the round before.

    ``folders``: folder, summary_md (nullable), report_md (nullable).
    """
    metrics_source = F.coalesce("summary_md", "report_md", F.lit(""))
    report_source = F.coalesce("report_md", "summary_md", F.lit(""))
    composite = F.coalesce(_composite(metrics_source), _composite(report_source))
    scored = _grab_number(report_source, r"(?i)Cases scored:\s*([0-9]+)")
    ok_count = _grab_number(report_source, r"(?i)([0-9]+)/[0-9]+ ok count")
    line = lambda p: F.nullif(F.trim(F.regexp_extract("summary_md", p, 1)), F.lit(""))
    status = F.when(
        F.col("summary_md").isNull(), F.when(F.col("folder").contains("baseline"), "baseline").otherwise("report only")
    ).otherwise(F.coalesce(line(r"(?im)^- Outcome:\s*(.+)$"), line(r"(?im)^Recommendation:\s*(.+)$"), F.lit("summarized")))
    number = S.round_number(F.col("folder"))
    listed = folders.select(
        "folder", number.alias("round"), composite.alias("c"), F.coalesce(scored, ok_count).alias("ok_cases"), status.alias("status")
    ).select("folder", "round", "c.*", "ok_cases", "status")
    return with_delta(listed, "round", "prqs")


def _grab_number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def _composite(text: Column) -> Column:
    """(prqs, low, high) from the "This round" line, else from the composite's table row."""
    said = r"(?i)This round:\s*([0-9.]+)\s*CI95\s*\[([0-9.]+),\s*([0-9.]+)\]"
    row = F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("| deterministic_prqs |")), F.lit(0))
    cells = _cells(row)
    at = lambda i: F.get(cells, F.lit(i))
    span = r"\[([0-9.]+),\s*([0-9.]+)\]"
    interval = F.coalesce(at(4), F.lit(""))
    build = lambda a, b, c: F.struct(a.alias("prqs"), b.alias("ci_low"), c.alias("ci_high"))
    return F.when(text.rlike(said), build(*[_grab_number(text, said, i) for i in (1, 2, 3)])).when(
        row.isNotNull(),
        build(S.lenient_number(F.coalesce(at(2), at(1))), _grab_number(interval, span, 1), _grab_number(interval, span, 2)),
    )


def with_delta(rounds: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Delta to the round before, two decimals, null on the first round or when a side is null.

    Rounds are few; ``by`` partitions them when many series are listed at once.
    """
    if not by:
        rounds = rounds.withColumn("_all", F.lit(0))
        by = ["_all"]
    before = F.lag(value).over(W.partitionBy(*by).orderBy(order))
    return rounds.withColumn("delta", S.half_up(F.col(value) - before, 2)).drop("_all")


def normalize_report_docs(docs: DataFrame) -> DataFrame:
    """Report documents (json) with aliased fields to one shape; the first numeric alias wins."""
    number = lambda *paths: F.coalesce(*[S.lenient_number(F.get_json_object("json", p)) for p in paths])
    text = lambda *paths: F.coalesce(*[F.nullif(F.trim(F.get_json_object("json", p)), F.lit("")) for p in paths])
    folder = text("$.folder", "$.roundFolder", "$.runId", "$.id")
    rows = docs.withColumn("folder", folder).filter(F.col("folder").rlike("^round-[0-9]+"))
    round_no = F.coalesce(number("$.roundNumber", "$.round"), S.round_number(F.col("folder")).cast("double")).cast("bigint")
    return rows.select(
        "folder", round_no.alias("round"),
        number("$.prqs", "$.deterministicPrqs", "$.deterministic_prqs", "$.metrics.prqs", "$.metrics.deterministic_prqs").alias("prqs"),
        number("$.ci95Low", "$.ci95_low", "$.metrics.ci95Low", "$.metrics.ci95_low", "$.ci95[0]", "$.metrics.ci95[0]").alias("ci_low"),
        number("$.ci95High", "$.ci95_high", "$.metrics.ci95High", "$.metrics.ci95_high", "$.ci95[1]", "$.metrics.ci95[1]").alias("ci_high"),
        number("$.okCaseCount", "$.ok_case_count", "$.metrics.okCaseCount", "$.metrics.ok_case_count").alias("ok_cases"),
        F.coalesce(text("$.status"), F.lit("report only")).alias("status"),
    )


def regression_exit(rounds: DataFrame) -> DataFrame:
    """Exit code per round against the round before: 3 regressed, 0 fine, 2 numbers missing.

    ``rounds``: round, mean, lower.
    """
    prior = rounds.select((F.col("round") + 1).alias("round"), F.col("lower").alias("prior_lower"))
    code = (
        F.when(F.col("mean").isNull() | F.col("prior_lower").isNull(), 2)
        .when(F.col("mean") < F.col("prior_lower"), 3).otherwise(0)
    )
    return rounds.join(prior, "round").withColumn("exit_code", code)


def metric_deltas(rounds: DataFrame) -> DataFrame:
    """Metric-by-metric change to the round before; null when a side is missing.

    ``rounds``: round, metric, mean. Composites keep 2 decimals, metrics 3.
    """
    prior = rounds.select((F.col("round") + 1).alias("round"), "metric", F.col("mean").alias("prior"))
    delta = F.col("mean") - F.col("prior")
    digits = F.when(F.col("metric").startswith("M"), F.round(delta, 3)).otherwise(F.round(delta, 2))
    return rounds.join(prior, ["round", "metric"], "left").select(
        "round", "metric", "prior", F.col("mean").alias("current"), digits.alias("delta")
    )


def recommendation(metric_rows: DataFrame, composite_rows: DataFrame, most_regressed: int = 3) -> DataFrame:
    """accept / escalate / revert per round.

    A metric regresses when its mean falls. More than ``most_regressed`` falling metrics escalate; a
    composite below the prior lower bound reverts.
    """
    falls = metric_deltas(metric_rows).groupBy("round").agg(F.count_if(F.col("delta") < 0).alias("regressed_metrics"))
    codes = regression_exit(composite_rows).select("round", "exit_code")
    verdict = (
        F.when(F.col("exit_code") == 3, "revert")
        .when(F.col("regressed_metrics") > most_regressed, "escalate").otherwise("accept")
    )
    return codes.join(falls, "round", "left").withColumn("recommendation", verdict)


def triage_cases(errors: DataFrame) -> DataFrame:
    """All cases of every error class, in long form: agent, metric, error_class, case_id."""
    return errors.select("agent", "metric", "error_class", "case_id").distinct()


def triage(errors: DataFrame) -> DataFrame:
    """Error classes ranked by frequency inside an agent, with severity; ``triage_cases`` lists their cases.

    ``errors``: agent, metric, error_class, case_id, severity.
    """
    keys = ["agent", "metric", "error_class"]
    worst = errors.groupBy(*keys, "case_id").agg(F.max("severity").alias("severity"))
    counts = worst.groupBy(*keys).agg(F.count("case_id").alias("frequency"), F.max("severity").alias("severity"))
    return counts.withColumn("rank", F.rank().over(W.partitionBy("agent").orderBy(F.desc("frequency"))))


def judge_calibration(scores: DataFrame, gap_limit: float, tiers: Sequence[str] = ("bad", "ok", "good")) -> DataFrame:
    """Per metric: the worst good above the best bad, wide enough tier means, no parse failures.

    ``scores``: metric, tier, score (null: parse failure).
    """
    mean = lambda t: F.avg(F.when(F.col("tier") == t, F.col("score")))
    table = scores.groupBy("metric").agg(
        F.min(F.when(F.col("tier") == tiers[-1], F.col("score"))).alias("min_good"),
        F.max(F.when(F.col("tier") == tiers[0], F.col("score"))).alias("max_bad"),
        *[mean(t).alias(f"mean_{t}") for t in tiers],
        F.count_if(F.col("score").isNull()).alias("parse_failures"),
    )
    steps = [F.col(f"mean_{b}") - F.col(f"mean_{a}") for a, b in zip(tiers, tiers[1:])]
    wide = steps[0] >= gap_limit
    for step in steps[1:]:
        wide = wide & (step >= gap_limit)
    passed = (F.col("min_good") > F.col("max_bad")) & wide & (F.col("parse_failures") == 0)
    return table.withColumn("passed", F.coalesce(passed, F.lit(False)))


def top_rationales(rationales: DataFrame, n: int = 3) -> DataFrame:
    """First n non-blank rationales per round in agent order."""
    kept = rationales.withColumn("rationale", F.trim("rationale")).filter(F.col("rationale") != "")
    place = F.row_number().over(W.partitionBy("folder").orderBy("agent_id", "rationale"))
    return kept.withColumn("place", place).filter(F.col("place") <= n)


def error_rate(outcomes: DataFrame, limit: float = V.ERROR_RATE_LIMIT) -> DataFrame:
    """Share of failed cases and whether it stops the run. ``outcomes``: ok."""
    return outcomes.agg(
        F.count_if(~F.col("ok")).alias("errors"), F.count(F.lit(1)).alias("attempted"),
        F.try_divide(F.count_if(~F.col("ok")), F.count(F.lit(1))).alias("error_rate"),
    ).withColumn("stop", F.col("error_rate") > limit)


def context_verdicts(paths: DataFrame) -> DataFrame:
    """Leakage deny-list over context paths: reason or null, first reason wins."""
    clean = F.regexp_replace("path", r"^\./", "")
    reason = (
        F.when(F.array_contains(F.split(clean, "/"), ".."), "escapes the repo")
        .when(clean.endswith(".age"), "sealed")
        .when(clean.rlike(r"(^|/)datasets/cases/[^/]+\.dev\.jsonl$"), "dev split")
        .when(clean.rlike(r"(^|/)datasets/policy-corpus/oracle(/|$)"), "oracle data")
    )
    return paths.withColumn("normalized", clean).withColumn("reason", reason)
