"""Streams that stop and start again: durable states, refused changes, timeouts, entries that expire."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from gleanery.storage import new_path
from gleanery.streaming import machine, runlog

T0 = dt.datetime(2024, 3, 1, 12)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r, default=str) for r in rows))


def event(run, seq, status=None, minute=0, line="x"):
    return {"run_id": run, "seq": seq, "line": line, "step_index": seq % 3, "stage": f"s{seq}", "status": status, "ts": str(T0 + dt.timedelta(minutes=minute))}


LOG = [
    [event("a", 1, "queued"), event("a", 2, "running"), event("b", 1, "queued")],
    [event("a", 3), event("a", 4, "completed"), event("b", 2, "completed")],
    [event("a", 5, "running"), event("b", 3, "running", line=None), event("c", 1, "queued")],
    [event("b", 4, "failed"), event("b", 5, "cancelled"), event("c", 2, "cancelled")],
]


def fill(folder, log, upto):
    for k, rows in enumerate(log[:upto]):
        if not (folder / f"{k}.json").exists():
            put(folder, k, rows)
            os.utime(folder / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # files are read in order of age


def test_table_survives_a_kill_between_batches(spark, tmp_path, monkeypatch):
    """The second batch's states are stored, then the stream dies before the batch is done; started again, the table equals the whole log's states."""
    folder, path, marks = tmp_path / "log", new_path(spark, "t"), new_path(spark, "m")
    fill(folder, LOG, 1)
    start = lambda: runlog.fold_stream(runlog.tail(spark, str(folder), 1), path, marks)
    start().awaitTermination()
    real, calls = runlog.partial_state, []

    def dying(batch):
        calls.append(1)
        if len(calls) == 1:
            real(batch).write.mode("overwrite").parquet(f"{path}/states/batch=1")
            raise RuntimeError("killed")
        return real(batch)

    fill(folder, LOG, 2)
    monkeypatch.setattr(runlog, "partial_state", dying)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    fill(folder, LOG, 4)
    start().awaitTermination()
    monkeypatch.undo()
    whole = runlog.run_state(spark.read.schema(runlog.EVENT).json(str(folder)))
    assert sorted(runlog.stored_state(spark, path).collect()) == sorted(whole.collect())
    assert sorted(tuple(r) for r in runlog.final_events(spark, path).collect()) == [("a", "completed", 4), ("b", "completed", 2), ("c", "cancelled", 2)]


def changes(rows):
    out, state = [], {}
    for r in rows:
        was, s = state.get(r["run_id"]), r["status"]
        if s is None or s == was:
            continue
        ok = was is None or s in runlog.NEXT.get(was, ())
        if was is not None:
            out.append((r["run_id"], r["seq"], "changed" if ok else "refused", was, s))
        state[r["run_id"]] = s if ok else was
    return sorted(out)


def test_machine_remembers_over_batches_and_restarts(spark, tmp_path):
    folder, path, marks = tmp_path / "log", new_path(spark, "t"), new_path(spark, "m")
    for upto in (2, 4):
        fill(folder, LOG, upto)
        runlog.append_stream(machine.run_changes(runlog.tail(spark, str(folder), 1)), path, marks).awaitTermination()
    got = sorted(tuple(r)[:5] for r in spark.read.parquet(path).select("run_id", "seq", "kind", "was", "status").collect())
    assert got == changes([r for rows in LOG for r in rows])
    assert ("a", 5, "refused", "completed", "running") in got and ("c", 2, "changed", "queued", "cancelled") in got


def test_silent_runs_time_out(spark, tmp_path):
    """Run a is silent for two hours while others go on; b ends in time, c is heard from again."""
    folder, path, marks = tmp_path / "log", new_path(spark, "t"), new_path(spark, "m")
    log = [
        [event("a", 1, "queued"), event("a", 2, "running", 1), event("b", 1, "queued"), event("c", 1, "queued")],
        [event("b", 2, "running", 20), event("b", 3, "completed", 30), event("c", 2, "running", 50)],
        [event("c", 3, None, 100)],
        [event("d", 1, "queued", 130), event("c", 4, "completed", 131)],
        [event("a", 3, "completed", 140)],
    ]
    fill(folder, log, 5)
    runlog.append_stream(machine.run_changes(runlog.tail(spark, str(folder), 1), 3600, "1 minute"), path, marks).awaitTermination()
    got = {(r.run_id, r.kind, r.was, r.status) for r in spark.read.parquet(path).where("kind <> 'changed'").collect()}
    assert got == {("a", "timed_out", "running", "failed"), ("a", "refused", "failed", "completed")}


def op(key, seq, what, second, value=None, ttl=10):
    at = T0 + dt.timedelta(seconds=second)
    return {"key": key, "seq": seq, "op": what, "value": value, "ttl_s": ttl, "ts": str(at)}


OPS = [
    [op("k", 1, "get", 0), op("k", 2, "set", 1, "one"), op("k", 3, "get", 10), op("j", 1, "set", 0, "other", 1000)],
    [op("k", 4, "refresh", 10), op("k", 5, "get", 19), op("k", 6, "get", 20), op("k", 7, "refresh", 21)],
    [op("k", 8, "set", 30, "two", 5), op("k", 9, "delete", 34), op("k", 10, "delete", 34), op("k", 11, "set", 40, "three", 0), op("k", 12, "get", 40)],
    [op("j", 2, "get", 900), op("j", 3, "refresh", 999, ttl=2000), op("j", 4, "get", 2900)],
]
WANT = {("k", 1): (False, None), ("k", 2): (True, "one"), ("k", 3): (True, "one"), ("k", 4): (True, "one"), ("k", 5): (True, "one"), ("k", 6): (False, None), ("k", 7): (False, None), ("k", 8): (True, "two"), ("k", 9): (True, "two"),
        ("k", 10): (False, None), ("k", 11): (True, "three"), ("k", 12): (False, None), ("j", 1): (True, "other"), ("j", 2): (True, "other"), ("j", 3): (True, "other"), ("j", 4): (True, "other")}


@pytest.mark.parametrize("late", ["0 seconds", "1 day"])
def test_entries_expire_and_are_refreshed(spark, tmp_path, late):
    """Whether expired state has been dropped by its timer or not, the answers are the same."""
    folder, path, marks = tmp_path / "ops", new_path(spark, "t"), new_path(spark, "m")
    for upto in (2, 4):
        fill(folder, OPS, upto)
        read = spark.readStream.schema("key string, seq long, op string, value string, ttl_s int, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
        runlog.append_stream(machine.entry_answers(read.withColumn("at_us", F.unix_micros("ts")), late), path, marks).awaitTermination()
    assert {(r.key, r.seq): (r.ok, r.value) for r in spark.read.parquet(path).collect()} == WANT
