"""Agent events folded into run state, in batch and as a stream."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline import values as V
from plumbline.functions import scalar as S
from plumbline.operators.joins import salted_join

EVENT = "struct<agent_id:string,agentId:string,status:string,payload:string>"


def event_lines(lines: DataFrame, by: tuple[str, ...] = ("run_id",), seq: str = "seq") -> DataFrame:
    """Response lines to events (run..., seq, part, agent_id, status, payload).

    Blank lines and comments are skipped, a ``data:`` lead is stripped, nothing after ``[DONE]`` counts.
    Accepts an array, an object with ``events``, one event, or any other object (then: orchestrator done).
    """
    text = F.trim("line")
    data = F.when(text.startswith("data:"), F.trim(F.substr(text, F.lit(6)))).otherwise(text)
    kept = lines.withColumn("data", data).filter((F.col("data") != "") & ~F.col("data").startswith(":"))
    if not lines.isStreaming:
        ends = kept.filter(F.col("data") == "[DONE]").groupBy(*by).agg(F.min(seq).alias("end_seq"))
        kept = salted_join(kept, ends, list(by), "left").filter(F.coalesce(F.col(seq) < F.col("end_seq"), F.lit(True)))
    kept = kept.filter(F.col("data") != "[DONE]")
    several = F.coalesce(
        F.from_json(F.when(F.col("data").startswith("["), F.col("data")), f"array<{EVENT}>"),
        F.from_json(F.get_json_object("data", "$.events"), f"array<{EVENT}>"),
    )
    one = F.from_json("data", EVENT)
    is_object = F.json_object_keys("data").isNotNull()
    name = lambda e: F.coalesce(_text(e["agent_id"]), _text(e["agentId"]))
    default = F.from_json(F.lit('{"agent_id":"orchestrator","status":"done"}'), EVENT)
    own = F.when(is_object, F.array(F.when(name(one).isNotNull(), one).otherwise(default.withField("payload", F.col("data")))))
    events = kept.select(*by, seq, "data", F.posexplode(F.coalesce(several, own)).alias("part", "e"))
    agent = name(F.col("e"))
    return events.filter(agent.isNotNull()).select(
        *by, seq, "part", agent.alias("agent_id"), F.coalesce(_text(F.col("e.status")), F.lit("running")).alias("status"),
        F.coalesce("e.payload", "data").alias("payload"),
    )


def _text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def _last(value: Column, order: Column) -> Column:
    """Last non-null value in event order (max_by skips null orders)."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def fold_agents(events: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Agent state per run: last status; label, elapsed, link and summary fall back to earlier events.

    Every field is a max-by aggregate, which Spark combines map-side, so a run with most of all events costs
    one row per task. Works on batch and streaming input (update mode).
    """
    order = F.struct(*[c for c in ("seq", "part") if c in events.columns])
    field = lambda *names: F.coalesce(*[_text(F.get_json_object("payload", f"$.{n}")) for n in names])
    number = F.coalesce(*[S.lenient_number(F.get_json_object("payload", f"$.{n}")) for n in ("elapsedSeconds", "elapsed_seconds")])
    return events.groupBy(*by, "agent_id").agg(
        F.max_by(S.agent_status(F.col("status")), order).alias("status"),
        _last(field("label"), order).alias("label"),
        _last(number, order).alias("elapsed_seconds"),
        _last(field("artifactHref", "artifact_href"), order).alias("artifact_href"),
        _last(field("summary"), order).alias("summary"),
        F.max("seq").alias("last_seq"),
    )


def run_status(agents: DataFrame, by: tuple[str, ...] = ("run_id",), seeded: int = len(V.AGENTS)) -> DataFrame:
    """Run status from agent states: any failed, all done, any running or done, else queued.

    All known agents start as queued, so a run is done only when every one of them is; an agent outside the
    known list joins the run.
    """
    is_ = lambda s: F.col("status") == s
    known = F.col("agent_id").isin(V.AGENTS)
    done_known = F.count_if(is_("done") & known)
    all_done = (done_known == seeded) & F.bool_and(is_("done"))
    status = (
        F.when(F.bool_or(is_("failed")), "failed").when(all_done, "done")
        .when(F.bool_or(F.col("status").isin("running", "done")), "running").otherwise("queued")
    )
    return agents.groupBy(*by).agg(status.alias("run_status"), F.count(F.lit(1)).alias("agents_seen"), F.max("last_seq").alias("last_seq"))


def with_failures(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Marks runs as failed and appends the note. ``runs``: run_id, run_status, notes; ``failures``: run_id, seq, summary."""
    last = failures.groupBy("run_id").agg(F.max_by("summary", "seq").alias("failure"))
    notes = F.concat_ws("\n", F.nullif(F.col("notes"), F.lit("")), F.nullif(F.col("failure"), F.lit("")))
    return runs.join(last.withColumn("hit", F.lit(True)), "run_id", "left").select(
        "run_id",
        F.when(F.col("hit"), "failed").otherwise(F.col("run_status")).alias("run_status"),
        F.when(F.col("hit"), notes).otherwise(F.col("notes")).alias("notes"),
    )


def normalized_runs(runs: DataFrame, link_root: str = "/api/eval-reports/round-001-fleet/per-agent/") -> DataFrame:
    """Agent rows with defaults; runs without agents get the full list as queued.

    ``runs``: run_id, status, agents array<struct<id,label,status,elapsed_seconds,artifact_href,summary>>.
    """
    labels = F.create_map(*[F.lit(x) for pair in V.AGENT_LABELS.items() for x in pair])
    link = lambda agent: F.concat(F.lit(link_root), agent, F.lit("/prompt-edits.json"))
    queued = F.array(*[
        F.struct(F.lit(a).alias("id"), F.lit(V.AGENT_LABELS[a]).alias("label"), F.lit("queued").alias("status"), F.lit(0.0).alias("elapsed_seconds"),
                 link(F.lit(a)).alias("artifact_href"), F.lit("Queued for orchestrator dispatch.").alias("summary"))
        for a in V.AGENTS
    ])
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    filled = F.transform("agents", lambda a: F.struct(
        a["id"].alias("id"), F.coalesce(a["label"], F.try_element_at(labels, a["id"]), a["id"]).alias("label"), F.coalesce(a["status"], F.lit("queued")).alias("status"),
        F.coalesce(finite(a["elapsed_seconds"]), F.lit(0.0)).alias("elapsed_seconds"),
        F.coalesce(a["artifact_href"], link(a["id"])).alias("artifact_href"), a["summary"].alias("summary"),
    ))
    return runs.withColumn("agents", F.when(F.coalesce(F.size("agents"), F.lit(0)) > 0, filled).otherwise(queued))


def snapshot_then_increments(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """What a follower of a run sees: its agent states first, then later events of runs that are not over.

    ``snapshot``: run_id, agent_id, status, last_seq, run_status; ``events``: run_id, seq, agent_id, status.
    """
    first = snapshot.select("run_id", F.lit("snapshot").alias("kind"), F.col("last_seq").alias("seq"), "agent_id", "status")
    open_runs = snapshot.filter(~F.col("run_status").isin("done", "failed")).groupBy("run_id").agg(F.max("last_seq").alias("upto"))
    later = salted_join(events, open_runs, ["run_id"], "inner").filter(F.col("seq") > F.col("upto"))
    return first.unionByName(later.select(
        "run_id", F.lit("increment").alias("kind"), "seq", "agent_id", S.agent_status(F.col("status")).alias("status")
    ))


def valid_agent_row() -> Column:
    """Schema gate before the sink: ids and status present and known, elapsed not negative."""
    return F.coalesce(
        (F.length("run_id") > 0) & (F.length("agent_id") > 0) & F.col("status").isin(V.RUN_STATUSES)
        & F.coalesce(F.col("elapsed_seconds") >= 0, F.lit(True)),
        F.lit(False),
    )


# --- keyed state table --------------------------------------------------------------------------------------

class RunStateTable:
    """Keyed agent state as versioned parquet in the shared folder.

    ``upsert`` folds rows into the newest version: the latest ``last_seq`` per key wins, so replaying a batch after a
    lost executor or driver changes nothing. Versions are counted by the table, whatever stream or restart the rows come
    from, and each goes to a fresh folder; it counts once its entries are in the index. Only rows of touched hash buckets
    are rewritten; the other buckets are carried by reference. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("run_id", "agent_id"), buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def _versions(self) -> tuple[dict[int, str], int]:
        """Bucket to the folder that holds it now, and the newest version."""
        path = f"{self.root}/index"
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path):
            return {}, 0
        index = self.spark.read.parquet(path).groupBy("bucket").agg(F.max_by("folder", "version").alias("folder"), F.max("version").alias("version"))
        rows = index.collect()
        return {row["bucket"]: row["folder"] for row in rows}, max(row["version"] for row in rows)

    def read(self) -> DataFrame | None:
        folders, _ = self._versions()
        if not folders:
            return None
        paths = [f"{folder}/bucket={bucket}" for bucket, folder in folders.items()]
        return self.spark.read.parquet(*paths)

    def upsert(self, rows: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = rows.withColumn("bucket", bucket)
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        if not touched:
            return
        folders, newest = self._versions()
        old = [f"{folders[b]}/bucket={b}" for b in touched if b in folders]
        merged = rows
        if old:
            merged = merged.unionByName(self.spark.read.parquet(*old).withColumn("bucket", bucket), allowMissingColumns=True)
        body = [c for c in rows.columns if c not in (*self.keys, "bucket")]
        latest = merged.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*body), "last_seq").alias("s")).select("bucket", *self.keys, "s.*")
        folder = f"{self.root}/version-{newest + 1}-{uuid.uuid4().hex}"
        latest.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        entries = self.spark.createDataFrame([(b, folder, newest + 1) for b in touched], "bucket int, folder string, version bigint")
        entries.coalesce(1).write.mode("append").parquet(f"{self.root}/index")


def stream_run_state(events: DataFrame, table: RunStateTable, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Streams events into the state table: fold, schema gate, keyed upsert; bad rows go to ``quarantine``.

    Quarantined rows are kept per stream and batch, so a replayed batch does not double them.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        ok = valid_agent_row()
        table.upsert(batch.filter(ok))
        batch.filter(~ok).write.mode("overwrite").parquet(f"{quarantine}/stream={stream}/batch={batch_id}")

    return (
        fold_agents(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )


def stream_event_lines(lines: DataFrame, ends: RunStateTable, out: str, checkpoint: str, by: tuple[str, ...] = ("run_id",), seq: str = "seq") -> StreamingQuery:
    """Streams response lines to events below ``out``; the end mark of a run holds for all later batches too.

    ``ends`` keeps the lowest position of ``[DONE]`` per run. Output is kept per batch, so a replayed batch overwrites its own.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        mark = F.regexp_replace(F.trim("line"), r"^data:\s*", "") == "[DONE]"
        ends.upsert(batch.filter(mark).groupBy(*by).agg((-F.min(seq)).alias("last_seq")))
        known = ends.read()
        if known is not None:
            over = known.select(*by, (-F.col("last_seq")).alias("over_at"))
            batch = batch.join(over, list(by), "left").filter(F.coalesce(F.col(seq) < F.col("over_at"), F.lit(True))).drop("over_at")
        event_lines(batch, by, seq).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


# --- extensions on event time --------------------------------------------------------------------------------

def status_counts(events: DataFrame, time: str = "ts", delay: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Events per status in tumbling windows; repeated event ids count once within the watermark delay."""
    return (
        events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window(time, width), "status").agg(F.count(F.lit(1)).alias("events"))
    )


def run_sessions(events: DataFrame, time: str = "ts", delay: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per run: a pause longer than the gap starts a new one."""
    return (
        events.withWatermark(time, delay).groupBy("run_id", F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("events"))
    )


def stream_status_counts(events: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Streams window counts to ``out`` as they change, open windows too; kept per batch, so a replayed batch overwrites its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(F.col("window.start").alias("window_start"), "status", "events").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        status_counts(events, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )


def latest_counts(updates: DataFrame) -> DataFrame:
    """The newest count per window and status out of the updates of one stream."""
    return updates.groupBy("window_start", "status").agg(F.max_by("events", "batch").alias("events"))
