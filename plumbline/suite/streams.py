"""Agent events: batch twins with an oracle, and the streams themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.functions import scalar as S
from plumbline.session import read_table, work_dir
from plumbline.streaming import agent_events as A
from plumbline.streaming import run_state as R
from plumbline.suite.inputs import AGENTS, choose
from plumbline.suite.registry import load, query

LINES = """select run_id, seq, concat('e', cast(seq as string)) as eid, case seq % 10 when 0 then '' when 1 then ': keep alive' when 2 then concat('data: {"agent_id":"', agent_id, '","status":"', status, '","payload":', payload, '}')
   when 3 then concat('[{"agentId":"', agent_id, '"},{"x":1},{"agent_id":"extra","status":"ok"}]') when 4 then concat('data:{"events":[{"agent_id":"', agent_id, '","status":" done "}]}') when 5 then payload
   when 6 then 'data: [DONE]' when 7 then 'garbage' else concat('{"agent_id":"', agent_id, '"}') end as line from fx_agent_event"""


EVENT_LINES_SQL = f"""
 with ends as (select run_id, min(seq) as e from fx_agent_event where seq % 10 = 6 group by 1), k as (select a.* from fx_agent_event a left join ends using (run_id) where e is null or a.seq < e)
 select run_id, seq, 0 as part, agent_id, status from k where seq % 10 = 2 union all select run_id, seq, 0, agent_id, 'running' from k where seq % 10 = 3 union all
 select run_id, seq, 2, 'extra', 'ok' from k where seq % 10 = 3 union all select run_id, seq, 0, agent_id, 'done' from k where seq % 10 = 4 union all
 select run_id, seq, 0, 'orchestrator', 'done' from k where seq % 10 = 5 union all select run_id, seq, 0, agent_id, 'running' from k where seq % 10 in (8, 9)"""


@query("event_lines", EVENT_LINES_SQL)
def event_lines(spark: SparkSession, root: str) -> DataFrame:
    """SM1."""
    return A.event_lines(load(spark, root, LINES)).select("run_id", "seq", "part", "agent_id", "status")


@query("event_lines_stream", EVENT_LINES_SQL)
def event_lines_stream(spark: SparkSession, root: str) -> DataFrame:
    """SM1 as a stream: the lines as files, end marks kept across batches."""
    source, out = work_dir(spark, "lines"), work_dir(spark, "events")
    load(spark, root, LINES).write.parquet(source)
    lines = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    A.stream_event_lines(lines, A.RunStateTable(spark, work_dir(spark, "ends"), ("run_id",)), out, work_dir(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).select("run_id", "seq", "part", "agent_id", "status")


STATUS_SQL = "case when status in ('Completed', 'ok', 'success') then 'done' when status = 'ERRORED' then 'failed' when status = 'pending' then 'queued' else 'running' end"
FOLD_SQL = f"""
 s as (select run_id, agent_id, seq, {STATUS_SQL} as st, json_extract_string(payload, '$.label') as label, cast(json_extract_string(payload, '$.elapsedSeconds') as double) as elapsed,
   json_extract_string(payload, '$.summary') as summary from fx_agent_event),
 f as (select run_id, agent_id, max_by(st, seq) as status, max_by(label, seq) filter (where label is not null) as label, max_by(elapsed, seq) filter (where elapsed is not null) as elapsed_seconds,
   max_by(summary, seq) filter (where summary is not null) as summary, max(seq) as last_seq from s group by 1, 2)"""
FOLDED = ["run_id", "agent_id", "status", "label", "elapsed_seconds", "summary", "last_seq"]


@query("run_state_fold", f"with {FOLD_SQL} select {', '.join(FOLDED)} from f")
def run_state_fold(spark: SparkSession, root: str) -> DataFrame:
    """SM2, batch twin."""
    return A.fold_agents(load(spark, root, "fx_agent_event")).select(*FOLDED)


def event_stream(spark: SparkSession, root: str) -> DataFrame:
    """The events table as a file stream, with the same run, agent, status and payload columns as the batch input."""
    schema = read_table(spark, root, "events").schema
    raw = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    )
    return raw.selectExpr(
        "cast(user_id as string) as run_id", "event_id as seq", "event_id", f"{choose('event_id % 6', AGENTS)} as agent_id",
        "case event_type when 'purchase' then 'Completed' when 'error' then case when event_id % 5 = 0 then 'ERRORED' else 'pending' end "
        "when 'click' then 'ok' when 'view' then 'working' else 'success' end as status",
        """concat('{"k":', cast(event_id % 97 as string), case when event_id % 3 = 0 then concat(',"summary":"s', cast(event_id as string), '"') else '' end,
           case when event_id % 4 = 0 then concat(',"elapsedSeconds":', cast(event_id % 50 as string)) else '' end,
           case when event_id % 7 = 0 then concat(',"label":"L', cast(event_id % 11 as string), '"') else '' end, '}') as payload""",
        "cast(ts as timestamp) as ts", "event_type",
    )


@query("run_state_stream", f"with {FOLD_SQL} select {', '.join(FOLDED)} from f")
def run_state_stream(spark: SparkSession, root: str) -> DataFrame:
    """SM2, SM6, SNK4: file stream, fold in update mode, schema gate and keyed upsert."""
    table = A.RunStateTable(spark, work_dir(spark, "runs"))
    stream = A.stream_run_state(event_stream(spark, root), table, work_dir(spark, "quarantine"), work_dir(spark, "checkpoint"))
    stream.awaitTermination()
    return table.read().select(*FOLDED)


@query("run_state_after_restart", f"with {FOLD_SQL} select run_id, agent_id, status, last_seq from f")
def run_state_after_restart(spark: SparkSession, root: str) -> DataFrame:
    """SNK4: a second stream, with a new checkpoint and so with batch numbers from zero, goes on with the table of the first."""
    table, quarantine = A.RunStateTable(spark, work_dir(spark, "runs")), work_dir(spark, "quarantine")
    events = event_stream(spark, root)
    for part in (events.filter("seq % 3 <> 0"), events):
        A.stream_run_state(part, table, quarantine, work_dir(spark, "checkpoint")).awaitTermination()
    return table.read().select("run_id", "agent_id", "status", "last_seq")


@query("run_state_expiring", f"with {FOLD_SQL} select {', '.join(FOLDED)} from f")
def run_state_expiring(spark: SparkSession, root: str) -> DataFrame:
    """SM2 in Spark's state store, where ended runs expire."""
    out = work_dir(spark, "agents")
    R.stream_to(R.fold_runs(event_stream(spark, root), keep="60 days"), out, work_dir(spark, "checkpoint")).awaitTermination()
    return R.latest_agents(spark.read.parquet(out)).select(*FOLDED)


RUN_SQL = f"""
 with {FOLD_SQL}
 select run_id, case when bool_or(status = 'failed') then 'failed' when bool_and(status = 'done') and count(*) = 6 then 'done' when bool_or(status in ('running', 'done')) then 'running' else 'queued' end as run_status,
   count(*) as agents_seen from f group by run_id"""


@query("run_status", RUN_SQL)
def run_status(spark: SparkSession, root: str) -> DataFrame:
    """SM3, AG11."""
    return A.run_status(A.fold_agents(load(spark, root, "fx_agent_event"))).select("run_id", "run_status", "agents_seen")


SNAPSHOT_SQL = f"""
 with cut as (select run_id, agent_id, seq, {STATUS_SQL} as st from fx_agent_event), half as (select run_id, max(seq) as hi, min(seq) as lo from cut group by 1),
 snap as (select c.run_id, c.agent_id, max_by(st, seq) as status, max(seq) as last_seq from cut c join half h using (run_id) where seq <= (lo + hi) / 2 group by 1, 2),
 runs as (select run_id, case when bool_or(status = 'failed') then 'failed' when bool_and(status = 'done') and count(*) = 6 then 'done' else 'open' end as rs, max(last_seq) as upto from snap group by 1)
 select run_id, 'snapshot' as kind, last_seq as seq, agent_id, status from snap union all
 select c.run_id, 'increment', c.seq, c.agent_id, c.st from cut c join runs r using (run_id) where r.rs = 'open' and c.seq > r.upto"""


def run_snapshot(events: DataFrame) -> DataFrame:
    """Agent states and run status half way through each run."""
    half = events.groupBy("run_id").agg(((F.min("seq") + F.max("seq")) / 2).alias("middle"))
    agents = A.fold_agents(events.join(half, "run_id").filter("seq <= middle"))
    return agents.join(A.run_status(agents).select("run_id", "run_status"), "run_id")


@query("snapshot_and_increments", SNAPSHOT_SQL)
def snapshot_and_increments(spark: SparkSession, root: str) -> DataFrame:
    """SM4."""
    events = load(spark, root, "fx_agent_event")
    return A.snapshot_then_increments(run_snapshot(events), events)


@query("snapshot_and_increments_stream", SNAPSHOT_SQL)
def snapshot_and_increments_stream(spark: SparkSession, root: str) -> DataFrame:
    """SM4 as one stream: the snapshot is the first state of the operator that passes the increments on."""
    snapshot, out = run_snapshot(load(spark, root, "fx_agent_event")), work_dir(spark, "increments")
    R.stream_to(R.follow_runs(event_stream(spark, root), snapshot), out, work_dir(spark, "checkpoint")).awaitTermination()
    first = snapshot.select("run_id", F.lit("snapshot").alias("kind"), F.col("last_seq").alias("seq"), "agent_id", "status")
    later = spark.read.schema("run_id string, seq bigint, agent_id string, status string").parquet(out)
    return first.unionByName(later.select("run_id", F.lit("increment").alias("kind"), "seq", "agent_id", "status"))


@query("run_failure_marks", f"""
 with base as ({RUN_SQL}), x as (select run_id, max_by(concat('event ', cast(seq as string)), seq) as failure from fx_agent_event where event_type = 'error' and seq % 4 = 0 group by 1)
 select b.run_id, case when x.failure is not null then 'failed' else run_status end as run_status, case when x.failure is not null then concat('note', chr(10), x.failure) else 'note' end as notes
 from base b left join x on x.run_id = b.run_id""")
def run_failure_marks(spark: SparkSession, root: str) -> DataFrame:
    """SM5."""
    events = load(spark, root, "fx_agent_event")
    runs = A.run_status(A.fold_agents(events)).select("run_id", "run_status", F.lit("note").alias("notes"))
    failures = events.filter("event_type = 'error' and seq % 4 = 0").select("run_id", "seq", F.concat(F.lit("event "), F.col("seq").cast("string")).alias("summary"))
    return A.with_failures(runs, failures)


@query("normalized_runs", """
 with r as (select user_id, count(*) as n from events group by 1)
 select cast(user_id as string) as run_id, case when user_id % 3 = 0 then 6 else 1 end as agents, case when user_id % 3 = 0 then 'Scope pathway classifier' when user_id % 3 = 1 then 'Redline generator' else 'own' end as label,
   'queued' as status, case when user_id % 3 = 2 then n else 0 end as elapsed from r""")
def normalized_runs(spark: SparkSession, root: str) -> DataFrame:
    """XR2."""
    runs = load(spark, root, "select user_id, count(*) as n from events group by user_id")
    uid = F.col("user_id") % 3
    agent = F.struct(
        F.lit("redline-generator").alias("id"), F.when(uid == 2, "own").alias("label"), F.lit(None).cast("string").alias("status"),
        F.when(uid == 1, F.lit(float("nan"))).otherwise(F.col("n").cast("double")).alias("elapsed_seconds"), F.lit(None).cast("string").alias("artifact_href"),
        F.lit(None).cast("string").alias("summary"),
    )
    rows = runs.select(F.col("user_id").cast("string").alias("run_id"), F.when(uid != 0, F.array(agent)).alias("agents"))
    first = F.col("agents")[0]
    return A.normalized_runs(rows).select(
        "run_id", F.size("agents").alias("agents"), first["label"].alias("label"), first["status"].alias("status"), first["elapsed_seconds"].alias("elapsed")
    )


@query("schema_gate", f"""
 with {FOLD_SQL} select count(*) as rows_in, count_if(coalesce(elapsed_seconds, 0) < 40 and agent_id <> 'bylaw-retriever') as rows_ok from f""")
def schema_gate(spark: SparkSession, root: str) -> DataFrame:
    """SM6: rows that break a constraint do not pass."""
    rows = A.fold_agents(load(spark, root, "fx_agent_event")).withColumns({
        "elapsed_seconds": F.when(F.col("elapsed_seconds") >= 40, -1.0).otherwise(F.col("elapsed_seconds")),
        "agent_id": F.when(F.col("agent_id") != "bylaw-retriever", F.col("agent_id")),
    })
    return rows.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(A.valid_agent_row()).alias("rows_ok"))


@query("windowed_status_counts", f"""
 select time_bucket(interval '10 minutes', ts) as window_start, {STATUS_SQL} as status, count(*) as events from fx_agent_event group by 1, 2""")
def windowed_status_counts(spark: SparkSession, root: str) -> DataFrame:
    """Extension: tumbling counts with a watermark; windows still open at the end have their counts so far."""
    events = event_stream(spark, root).withColumn("status", S.agent_status(F.col("status")))
    out = work_dir(spark, "windows")
    A.stream_status_counts(events, out, work_dir(spark, "checkpoint")).awaitTermination()
    return A.latest_counts(spark.read.parquet(out)).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "status", "events")


@query("run_sessions", """
 with e as (select run_id, ts, case when ts - lag(ts) over (partition by run_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from fx_agent_event),
 s as (select run_id, ts, sum(fresh) over (partition by run_id order by ts) as n from e)
 select run_id, min(ts) as session_start, count(*) as events from s group by run_id, n""")
def run_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Extension, batch twin: activity sessions per run."""
    rows = load(spark, root, "fx_agent_event").groupBy("run_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("events"))
    return rows.select("run_id", F.col("session_window.start").alias("session_start"), "events")


@query("run_status_values", "select status, count(*) as n from (select " + STATUS_SQL + " as status from fx_agent_event) group by status")
def run_status_values(spark: SparkSession, root: str) -> DataFrame:
    rows = load(spark, root, "fx_agent_event").select(S.agent_status(F.col("status")).alias("status"))
    return rows.filter(F.col("status").isin(V.RUN_STATUSES)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
