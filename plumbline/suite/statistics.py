"""Aggregates, quantiles, bootstrap intervals and paired comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions.draws import poisson_limits
from plumbline.operators import metrics as M
from plumbline.operators import stats as A
from plumbline.suite.registry import load, query
from plumbline.suite.scoring import METRIC_SQL, dimensions, nested, package

SHOWN = V.NON_JUDGE
LONG_SQL = " union all ".join(f"select '{m}' as metric, case_id, raw, branch from {nested(METRIC_SQL[m])}" for m in SHOWN)


def long_scores(spark: SparkSession, root: str) -> DataFrame:
    return M.to_long(M.score_cases(package(spark, root), dimensions(spark, root), SHOWN), SHOWN)


@query("metric_summary", f"""
 with s as ({LONG_SQL})
 select domain, split, metric, round(avg(raw), 6) as mean, count(*) as count, count(*) - count(raw) as null_count
 from s join fx_case using (case_id) group by 1, 2, 3""")
def summary(spark: SparkSession, root: str) -> DataFrame:
    out = A.metric_summary(long_scores(spark, root), ["domain", "split", "metric"])
    return out.withColumn("mean", F.round("mean", 6))


@query("branch_missingness", f"""
 with s as ({LONG_SQL})
 select domain, split, metric, {", ".join(f"count_if(branch = '{b}') as {b}" for b in V.BRANCHES)}
 from s join fx_case using (case_id) group by 1, 2, 3""")
def branch_missingness(spark: SparkSession, root: str) -> DataFrame:
    return A.missingness(long_scores(spark, root), ["domain", "split", "metric"])


@query("price_quantiles", """
 select domain, round(quantile_cont(price, 0.025), 6) as low, round(quantile_cont(price, 0.5), 6) as median, round(quantile_cont(price, 0.975), 6) as high
 from fx_case group by domain""")
def price_quantiles(spark: SparkSession, root: str) -> DataFrame:
    out = A.quantiles(load(spark, root, "fx_case"), ["domain"], "price", {"low": 0.025, "median": 0.5, "high": 0.975})
    return out.select("domain", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


@query("score_spread", """
 select round, count(score) as n, round(avg(score), 6) as mean, round(stddev_samp(score), 6) as sd, round(min(score), 6) as minimum,
   round(max(score), 6) as maximum, round(max(score) - min(score), 6) as range, round(1.5 / nullif(stddev_samp(score), 0), 6) as threshold_over_sd
 from fx_round_score group by round""")
def score_spread(spark: SparkSession, root: str) -> DataFrame:
    out = A.spread(load(spark, root, "fx_round_score"), ["round"], "score")
    return out.select("round", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("round", "n")])


@query("label_confusion", """
 with c as (select source, count_if(quality = 1 and toxic = 0) as tp, count_if(quality <> 1 and toxic = 0) as fp,
   count_if(quality = 1 and toxic <> 0) as fn, count_if(quality <> 1 and toxic <> 0) as tn
   from labels join documents using (doc_id) group by source)
 select source, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 9) as precision, round(tp / nullif(tp + fn, 0), 9) as recall,
   round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) as f1 from c""")
def label_confusion(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "select source, quality, toxic from labels join documents using (doc_id)")
    out = A.confusion(rows, ["source"], F.col("quality") == 1, F.col("toxic") == 0)
    return out.select("source", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("score_breakdowns", """
 select pathway_class, outcome_class, gap_severity_bucket, generator_id, family, round(avg(score), 6) as mean, count(*) as n, grouping(pathway_class) * 16
   + grouping(outcome_class) * 8 + grouping(gap_severity_bucket) * 4 + grouping(generator_id) * 2 + grouping(family) as grouping_id
 from (select c.*, coalesce(c.edge_case_family, '_none_') as family, r.score from fx_case c join fx_round_score r on r.case_id = c.case_id)
 group by grouping sets ((pathway_class), (outcome_class), (gap_severity_bucket), (generator_id), (family), ())""")
def score_breakdowns(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, """
        select c.pathway_class, c.outcome_class, c.gap_severity_bucket, c.generator_id, coalesce(c.edge_case_family, '_none_') as family, r.score
        from fx_case c join fx_round_score r on r.case_id = c.case_id""")
    out = A.breakdowns(rows, ["pathway_class", "outcome_class", "gap_severity_bucket", "generator_id", "family"], "score")
    return out.withColumn("mean", F.round("mean", 6))


# --- bootstrap: the oracle walks the whole draw stream in SQL ---------------------------------------------------

def bootstrap_sql(source: str, by: str, value: str, resamples: int) -> str:
    """Draws as unsigned 32-bit arithmetic over a range of draw numbers; groups of equal size share their draws."""
    mul = lambda a, b: f"(({a})::hugeint * ({b})::hugeint) % 4294967296"
    keys = f"{by}," if by else ""
    same = " and ".join(f"v.{k.strip()} = s.{k.strip()}" for k in by.split(",")) if by else "true"
    group = f"group by {by}" if by else ""
    v_keys = f"v.{', v.'.join(k.strip() for k in by.split(','))}," if by else ""
    return f"""
 vec as (select {keys} {value} as x, row_number() over ({f"partition by {by}" if by else ""} order by case_id) - 1 as pos from {source}),
 sizes as (select {keys} count(*) as n, avg(x) as mean from vec {group}),
 r0 as (select n, unnest(range(0, n * {resamples})) as d from (select distinct n from sizes)),
 r1 as (select *, ((4242 + (d + 1)::hugeint * 1831565813) % 4294967296)::ubigint as s from r0),
 r2 as (select *, ({mul("xor(s, s >> 15)", "s | 1")})::ubigint as a from r1),
 r3 as (select *, xor(a, ((a + ({mul("xor(a, a >> 7)", "a | 61")})) % 4294967296)::ubigint) as b from r2),
 draws as (select n, d // n as r, floor(xor(b, b >> 14)::double / 4294967296.0 * n)::bigint as pos from r3),
 sized as (select v.*, s.n from vec v join sizes s on {same}),
 means as (select {v_keys} d.r, sum(v.x) / any_value(d.n) as m from draws d join sized v on v.n = d.n and v.pos = d.pos group by {v_keys} d.r),
 edges as (select {keys} quantile_cont(m, 0.025) as lower, quantile_cont(m, 0.975) as upper from means {group})"""


@query("bootstrap_composite_ci", f"""
 with {bootstrap_sql("fx_round_score", "domain", "score", 1000)}
 select domain, round(mean, 6) as mean, round(lower, 6) as lower, round(upper, 6) as upper, n from sizes join edges using (domain)""")
def bootstrap_composite(spark: SparkSession, root: str) -> DataFrame:
    out = A.bootstrap_ci(load(spark, root, "fx_round_score"), ["domain"], "score", ["case_id"])
    return out.select("domain", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")], "n")


METRIC_ROWS = """(select domain, case_id, metric, x from (
   select domain, case_id, 'm1' as metric, m1 as x from fx_round_score union all
   select domain, case_id, 'm3' as metric, case when k % 3 = 0 then null else m3 end as x from fx_round_score) where x is not null)"""


@query("bootstrap_metric_ci", f"""
 with rows_ as {METRIC_ROWS}, {bootstrap_sql("rows_", "domain, metric", "x", V.BOOTSTRAP_RESAMPLES)}
 select domain, metric, round(mean, 6) as mean, round(lower, 6) as lower, round(upper, 6) as upper, n from sizes join edges using (domain, metric)""")
def bootstrap_metrics(spark: SparkSession, root: str) -> DataFrame:
    """BS3: non-null values only, the draw stream restarts per group."""
    rows = load(spark, root, "select domain, case_id, k, m1, m3 from fx_round_score")
    long = rows.select("domain", "case_id", F.inline(F.array(
        F.struct(F.lit("m1").alias("metric"), F.col("m1").alias("x")),
        F.struct(F.lit("m3").alias("metric"), F.when(F.col("k") % 3 != 0, F.col("m3")).alias("x")),
    )))
    out = A.bootstrap_ci(long, ["domain", "metric"], "x", ["case_id"])
    return out.select("domain", "metric", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")], "n")


PAIR_SQL = "(select case_id, m3 * 100 - score as delta from fx_round_score)"


@query("paired_delta_gate", f"""
 with p as {PAIR_SQL}, {bootstrap_sql("p", "", "delta", V.BOOTSTRAP_RESAMPLES)}
 select round(mean, 6) as mean_delta, round(lower, 6) as lower, round(upper, 6) as upper, n, mean >= 1.5 and lower > 0 as accepted from sizes, edges""")
def paired_delta(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "fx_round_score")
    current = rows.select("case_id", (F.col("m3") * 100).alias("v"))
    ci = A.paired_delta_ci(rows.select("case_id", F.col("score").alias("v")), current, "v")
    out = A.patch_gate(ci)
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean_delta", "lower", "upper")], "n", "accepted")


def poisson_sql(source: str, by: str, value: str, resamples: int = V.BOOTSTRAP_RESAMPLES, seed: int = V.BOOTSTRAP_SEED) -> str:
    """Poisson(1) weights per row and resample, from the row's key alone."""
    mul = lambda a, b: f"(({a})::hugeint * ({b})::hugeint) % 4294967296"
    keys = f"{by}," if by else ""
    group = f"group by {by}" if by else ""
    weight = " + ".join(f"(u >= {x})::int" for x in poisson_limits())

    def mixed(source: str, start: str, end: str) -> str:
        return f"""
 {end}_1 as (select * exclude ({start}), {start} as s from {source}),
 {end}_2 as (select *, ({mul("xor(s, s >> 15)", "s | 1")})::ubigint as a from {end}_1),
 {end}_3 as (select *, xor(a, ((a + ({mul("xor(a, a >> 7)", "a | 61")})) % 4294967296)::ubigint) as b from {end}_2),
 {end}_0 as (select * exclude (s, a, b), xor(b, b >> 14) as {end} from {end}_3)"""

    return f"""
 keyed as (select {keys} {value} as x, sha256(concat('{seed}', chr(31), case_id)) as h from {source}),
 sizes as (select {keys} count(*) as n, avg(x) as mean from keyed {group}),
 drawn as (select {keys} x, r, ((('0x' || h[1:8])::ubigint + r::hugeint * 1831565813) % 4294967296)::ubigint as d, ('0x' || h[9:16])::ubigint as k2
   from keyed, range(1, {resamples + 1}) t(r)),
 {mixed("drawn", "d", "m")},
 again as (select * exclude (m), xor(m, k2) as d from m_0),
 {mixed("again", "d", "u")},
 weighed as (select {keys} r, x, {weight} as w from u_0),
 means as (select {keys} r, sum(w * x) / sum(w) as m from weighed group by {keys} r having sum(w) > 0),
 edges as (select {keys} quantile_cont(m, 0.025) as lower, quantile_cont(m, 0.975) as upper from means {group})"""


@query("bootstrap_poisson_ci", f"""
 with {poisson_sql("fx_round_score", "domain", "score")}
 select domain, round(mean, 6) as mean, round(lower, 6) as lower, round(upper, 6) as upper, n from sizes join edges using (domain)""")
def bootstrap_poisson(spark: SparkSession, root: str) -> DataFrame:
    """BS1 by resamples that merge: for groups of any size."""
    out = A.poisson_bootstrap_ci(load(spark, root, "fx_round_score"), ["domain"], "score", ["case_id"])
    return out.select("domain", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")], "n")


@query("paired_delta_poisson", f"""
 with p as {PAIR_SQL}, {poisson_sql("p", "", "delta")}
 select round(mean, 6) as mean_delta, round(lower, 6) as lower, round(upper, 6) as upper, n, mean >= 1.5 and lower > 0 as accepted from sizes, edges""")
def paired_delta_poisson(spark: SparkSession, root: str) -> DataFrame:
    """BS2 by resamples that merge."""
    rows = load(spark, root, "fx_round_score")
    current = rows.select("case_id", (F.col("m3") * 100).alias("v"))
    out = A.patch_gate(A.paired_delta_ci(rows.select("case_id", F.col("score").alias("v")), current, "v", interval=A.poisson_bootstrap_ci))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean_delta", "lower", "upper")], "n", "accepted")


@query("paired_completeness", """
 with p as (select case_id, score from fx_round_score where ck % 10 <> 0), c as (select case_id, m1 * 100 as score from fx_round_score where k % 10 <> 0)
 select coalesce(p.case_id, c.case_id) as case_id, p.score as prior, c.score as current, round(c.score - p.score, 9) as delta,
   p.score is not null and c.score is not null as pair_ok from p full outer join c on p.case_id = c.case_id""")
def paired_completeness(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "fx_round_score")
    prior = rows.filter("ck % 10 <> 0").select("case_id", F.col("score").alias("v"))
    current = rows.filter("k % 10 <> 0").select("case_id", (F.col("m1") * 100).alias("v"))
    return A.paired(prior, current, "v").withColumn("delta", F.round("delta", 9))


@query("split_aggregate", f"""
 with s as (select metric, c.domain, c.split, c.case_id, raw, branch from ({LONG_SQL}) x join fx_case c using (case_id)),
 rows_ as (select metric, domain, split, case_id, raw as x from s where raw is not null),
 {bootstrap_sql("rows_", "domain, split, metric", "x", V.BOOTSTRAP_RESAMPLES)}
 select s.domain, s.split, s.metric, round(avg(s.raw), 6) as mean, count(*) as count, count(*) - count(s.raw) as null_count,
   round(any_value(e.lower), 6) as lower, round(any_value(e.upper), 6) as upper, count_if(s.branch = 'standard') as standard_n
 from s join edges e on e.domain = s.domain and e.split = s.split and e.metric = s.metric group by 1, 2, 3""")
def split_aggregate(spark: SparkSession, root: str) -> DataFrame:
    scores = M.score_cases(package(spark, root), dimensions(spark, root), SHOWN)
    scores = scores.select(*[F.round(c, 9).alias(c) if c in SHOWN else F.col(c) for c in scores.columns])
    out = A.split_aggregate(scores, SHOWN)
    return out.select(
        "domain", "split", "metric", *[F.round(c, 6).alias(c) for c in ("mean", "lower", "upper")], "count", "null_count",
        F.col("missingness")["standard"].alias("standard_n"),
    )
