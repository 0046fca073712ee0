"""Agent state per run in Spark's own state store: it expires after a run has ended, and may begin with a snapshot.

The stateful operators need the RocksDB state store, which streams started within ``rocksdb`` have.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline import values as V
from plumbline.functions import scalar as S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fields of an agent; each keeps the position of the event that it came from, so late events do not overwrite newer ones.
FIELDS = {"status": "string", "label": "string", "elapsed_seconds": "double", "artifact_href": "string", "summary": "string"}
STATE = ", ".join([*(f"{n} {kind}" for n, kind in FIELDS.items()), *(f"{n}_seq bigint" for n in FIELDS), "last_seq bigint"])
OUTPUT = "run_id string, agent_id string, status string, label string, elapsed_seconds double, artifact_href string, summary string, last_seq bigint, run_status string"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB; the session's setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stream_to(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what a stateful stream puts out to ``out``, a folder per batch: a replayed batch overwrites its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with rocksdb(rows.sparkSession):
        stream = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return stream.trigger(availableNow=True).foreachBatch(write).start()


def latest_agents(updates: DataFrame) -> DataFrame:
    """The newest row per run and agent out of the updates of one stream."""
    body = [c for c in updates.columns if c not in ("run_id", "agent_id", "batch")]
    return updates.groupBy("run_id", "agent_id").agg(F.max_by(F.struct(*body), "batch").alias("s")).select("run_id", "agent_id", "s.*")


def event_fields(events: DataFrame) -> DataFrame:
    """(run_id, seq, ts, agent_id, fields...) of agent events: payloads are read in the JVM, before the stateful operator."""
    text = lambda *names: F.coalesce(*[F.nullif(F.trim(F.get_json_object("payload", f"$.{n}")), F.lit("")) for n in names])
    number = F.coalesce(*[S.lenient_number(F.get_json_object("payload", f"$.{n}")) for n in ("elapsedSeconds", "elapsed_seconds")])
    return events.select(
        "run_id", F.col("seq").cast("long").alias("seq"), "ts", "agent_id", S.agent_status(F.col("status")).alias("status"), text("label").alias("label"),
        number.alias("elapsed_seconds"), text("artifactHref", "artifact_href").alias("artifact_href"), text("summary").alias("summary"),
    )


def status_of(agents: dict[str, str | None], known: frozenset[str]) -> str:
    """Run status from agent states, as ``agent_events.run_status``."""
    states = set(agents.values())
    if "failed" in states:
        return "failed"
    if known <= agents.keys() and states == {"done"}:
        return "done"
    return "running" if states & {"running", "done"} else "queued"


class RunFold(StatefulProcessor):
    """One state row per agent of a run; a touched run puts out its touched agents. ``keep_ms`` after the last event of an ended run
    (by event time) its state is dropped; an event that comes later yet begins a new state."""

    def __init__(self, keep_ms: int):
        self.keep_ms, self.known = keep_ms, frozenset(V.AGENTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.agents = handle.getMapState("agents", "agent_id string", STATE)
        self.latest = handle.getValueState("latest", "at bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.to_dict("records"):
            seq = int(row["last_seq"])
            values = [None if pd.isna(row[n]) else row[n] for n in FIELDS]
            self.agents.updateValue((row["agent_id"],), (*values, *[seq if v is not None else None for v in values], seq))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, touched = {k[0]: list(v) for k, v in self.agents.iterator()}, {}
        at = self.latest.get()[0] if self.latest.exists() else 0
        n = len(FIELDS)
        for frame in rows:
            at = max(at, int(frame["ts"].max().timestamp() * 1000))
            for agent, seq, *values in frame[["agent_id", "seq", *FIELDS]].itertuples(index=False):
                state = held.setdefault(agent, [None] * (2 * n) + [None])
                for i, value in enumerate(values):
                    if not pd.isna(value) and (state[n + i] is None or seq > state[n + i]):
                        state[i], state[n + i] = value, int(seq)
                state[2 * n] = int(seq) if state[2 * n] is None else max(state[2 * n], int(seq))
                touched[agent] = state
        for agent, state in touched.items():
            self.agents.updateValue((agent,), tuple(state))
        self.latest.update((at,))
        status = status_of({a: s[0] for a, s in held.items()}, self.known)
        if status in ("done", "failed"):
            self.handle.registerTimer(at + self.keep_ms)
        yield pd.DataFrame([(key[0], a, *s[:n], s[2 * n], status) for a, s in touched.items()], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists() and self.latest.get()[0] + self.keep_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.agents.clear()
            self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def fold_runs(events: DataFrame, keep: str = "1 day", delay: str = "1 hour", snapshot: DataFrame | None = None) -> DataFrame:
    """Agent states of a stream of events, as they change; ``agent_events.fold_agents`` in Spark's state store, with an end.

    A run's state goes ``keep`` after its last event once it is done or failed; the watermark, ``delay`` behind the newest event,
    says when. ``snapshot`` (run_id, agent_id, the fields, last_seq) gives the runs their first state. Rows of a run come to one
    task a batch at a time, as its state demands; only its agents are held.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    first = snapshot.select("run_id", "agent_id", *FIELDS, "last_seq").groupBy("run_id") if snapshot is not None else None
    return event_fields(events).withWatermark("ts", delay).groupBy("run_id").transformWithStateInPandas(
        RunFold(keep_ms), OUTPUT, "Update", "EventTime", initialState=first
    )


class Follower(StatefulProcessor):
    """Passes on events of open runs behind the position of their snapshot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.upto = handle.getValueState("upto", "seq bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if not initialState["run_status"].isin(["done", "failed"]).any():
            self.upto.update((int(initialState["last_seq"].max()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto = self.upto.get()[0] if self.upto.exists() else None
        for frame in rows:
            yield frame[["run_id", "seq", "agent_id", "status"]].iloc[:0] if upto is None else frame.loc[frame["seq"] > upto, ["run_id", "seq", "agent_id", "status"]]

    def close(self) -> None:
        pass


def follow_runs(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(run_id, seq, agent_id, status): the increments of ``agent_events.snapshot_then_increments`` as a stream.

    ``snapshot`` (run_id, agent_id, last_seq, run_status) is the operator's initial state: runs that were over in it, and runs it does
    not hold, send nothing.
    """
    rows = events.select("run_id", F.col("seq").cast("long").alias("seq"), "agent_id", S.agent_status(F.col("status")).alias("status"))
    first = snapshot.select("run_id", "last_seq", "run_status").groupBy("run_id")
    return rows.groupBy("run_id").transformWithStateInPandas(Follower(), "run_id string, seq bigint, agent_id string, status string", "Update", "None", initialState=first)
