"""State that expires, first states and late events of the stateful streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline import values as V
from plumbline.session import work_dir
from plumbline.streaming import agent_events as A
from plumbline.streaming import run_state as R

SCHEMA = "run_id string, seq bigint, agent_id string, status string, payload string, ts timestamp"


def at(hour: int) -> str:
    return f"2024-01-{1 + hour // 24:02d} {hour % 24:02d}:00:00"


def played(spark, tmp_path, batches, rows_of):
    """Feeds batches of events one after the other to one stream and returns its updates."""
    source, out, checkpoint = f"{tmp_path}/source", work_dir(spark, "out"), work_dir(spark, "checkpoint")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(SCHEMA).parquet(source)
        R.stream_to(rows_of(events), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


def event(run, seq, agent, status, hour, payload="{}"):
    return run, seq, agent, status, payload, at(hour)


def test_state_of_an_ended_run_expires(spark, tmp_path):
    agent = V.AGENTS[0]
    batches = [
        [event("a", 5, agent, "failed", 1, '{"label": "L", "summary": "first"}'), event("b", 5, agent, "working", 1, '{"label": "L"}')],
        [event("c", 1, agent, "ok", 100)],  # moves the watermark far beyond the end of run a
        [event("c", 2, agent, "ok", 101)],
        [event("a", 2, agent, "queued", 102), event("b", 2, agent, "queued", 102)],  # older positions: only state would know better
    ]
    got = {(r.run_id, r.agent_id): r for r in R.latest_agents(played(spark, tmp_path, batches, lambda e: R.fold_runs(e, keep="1 day"))).collect()}
    assert (got["a", agent].status, got["a", agent].label, got["a", agent].last_seq) == ("queued", None, 2)
    assert (got["b", agent].status, got["b", agent].label, got["b", agent].last_seq) == ("running", "L", 5)


def test_stream_equals_batch_whatever_the_order(spark, tmp_path):
    rows = [event(f"r{i % 3}", i, V.AGENTS[i % 6], ["ok", "working", "pending", "ERRORED"][(i * 7) % 4], 1, '{"label": "L%d"}' % i if i % 4 == 0 else '{"elapsedSeconds": %d}' % i) for i in range(60)]
    late = [rows[30:], rows[:30]]
    got = R.latest_agents(played(spark, tmp_path, late, lambda e: R.fold_runs(e, keep="9 days")))
    names = ["run_id", "agent_id", *R.FIELDS, "last_seq"]
    batch = A.fold_agents(spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string")))
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, batch.select(names).collect()))
    status = {r.run_id: r.run_status for r in A.run_status(batch).collect()}
    newest = got.groupBy("run_id").agg(F.max_by("run_status", "last_seq").alias("s"))
    assert {r.run_id: r.s for r in newest.collect()}.keys() == status.keys()


def test_first_states_come_from_a_snapshot(spark, tmp_path):
    snapshot = spark.createDataFrame([("a", V.AGENTS[0], "done", "old", 3.0, None, None, 10)], "run_id string, agent_id string, status string, label string, elapsed_seconds double, artifact_href string, summary string, last_seq bigint")
    got = played(spark, tmp_path, [[event("a", 8, V.AGENTS[0], "working", 1, '{"summary": "s"}'), event("a", 11, V.AGENTS[1], "ok", 1)]], lambda e: R.fold_runs(e, snapshot=snapshot))
    rows = {r.agent_id: r for r in got.collect()}
    assert (rows[V.AGENTS[0]].status, rows[V.AGENTS[0]].label, rows[V.AGENTS[0]].summary, rows[V.AGENTS[0]].last_seq) == ("done", "old", "s", 10)
    assert rows[V.AGENTS[1]].status == "done"


def test_followers_hear_nothing_of_runs_that_were_over(spark, tmp_path):
    snapshot = spark.createDataFrame([("a", "x", 5, "running"), ("a", "y", 7, "running"), ("b", "x", 5, "done")], "run_id string, agent_id string, last_seq bigint, run_status string")
    batches = [[event("a", 7, "x", "ok", 1), event("a", 8, "x", "ok", 1), event("b", 9, "x", "ok", 1)], [event("a", 9, "y", "failed", 2), event("n", 1, "x", "ok", 2)]]
    got = played(spark, tmp_path, batches, lambda e: R.follow_runs(e, snapshot))
    assert sorted((r.run_id, r.seq, r.agent_id, r.status) for r in got.collect()) == [("a", 8, "x", "done"), ("a", 9, "y", "failed")]


@pytest.mark.parametrize("states, status", [({"x": "failed"}, "failed"), ({a: "done" for a in V.AGENTS}, "done"), ({"x": "done"}, "running"), ({"x": None}, "queued"), ({}, "queued")])
def test_status_of_a_run(states, status):
    assert R.status_of(states, frozenset(V.AGENTS)) == status
