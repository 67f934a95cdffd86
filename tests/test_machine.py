"""Changes of runs as a stream stores them, without a state of each run in a Python worker."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gleanery.plans import registry, relational
from gleanery.storage import new_path
from gleanery.streaming import machine, runlog

STATUSES = [None, "queued", "pending", "running", "completed", "failed", "cancelled", "unheard"]


def answers(batches):
    out, state = [], {}
    for rows in batches:
        for run, seq, s in sorted(rows, key=lambda r: r[1]):
            was = state.get(run)
            if run is None or s is None or s == was:
                continue
            ok = was is None or s in runlog.NEXT.get(was, ())
            if was is not None:
                out.append((run, seq, "changed" if ok else "refused", was, s))
            state[run] = s if ok else was
    return sorted(out)


def test_changes_over_batches_and_a_kill(spark, tmp_path, monkeypatch):
    """Runs of all statuses and of none over three starts; the second batch is stored and dies, and is run again. Later batches go on from earlier ones whatever their seq."""
    rng = random.Random(5)
    batches = [[(rng.choice([None, *"abcdefghij"]), k, rng.choice(STATUSES)) for k in rng.sample(range(1000), 60)] for _ in range(3)]
    path, marks, folder = new_path(spark, "t"), new_path(spark, "m"), str(tmp_path / "log")
    start = lambda: machine.change_stream(spark.readStream.schema("run_id string, seq bigint, status string").parquet(folder), path, marks)
    real = machine.steps
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "run_id string, seq bigint, status string").write.mode("append").parquet(folder)
        if k == 1:
            # what a writer that dies leaves: rows in the folder of a batch that is not done
            spark.createDataFrame([("a", 1, None, "failed")], "run_id string, seq bigint, was string, status string").write.parquet(f"{path}/batch=1/kind=first")
            monkeypatch.setattr(machine, "steps", lambda *_: 1 / 0)
            with pytest.raises(Exception, match="division"):
                start().awaitTermination()
            monkeypatch.setattr(machine, "steps", real)
        start().awaitTermination()
    assert sorted(tuple(r) for r in machine.stored_changes(spark, path).collect()) == answers(batches)


def test_run_changes_of_any_user(spark, small, monkeypatch):
    """As the SQL has it, events without a user make no run; and parts of the stream are written by more than one task."""
    n = F.col("user_id")
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("user_id", F.when(n == 3, None).when(n == 5, -5).otherwise(n)).repartition(4).cache()
    paths = []
    monkeypatch.setattr(relational, "table", lambda *_: events)
    monkeypatch.setattr(relational, "new_path", lambda *a: paths.append(new_path(*a)) or paths[-1])
    got = sorted(tuple(r) for r in registry.QUERIES["run_changes_stream"](spark, small).collect())
    with duckdb.connect() as db:
        db.register("events", events.drop("ts").toArrow())
        want = sorted(db.sql(registry.ORACLES["run_changes_stream"]).fetchall())
    events.unpersist()
    assert got == want and {r[0] for r in got} >= {"-5"}
    assert len(spark.read.parquet(paths[0]).inputFiles()) > 3


def told(batches):
    """What Entries answers, row by row."""
    out, entries = [], {}
    for rows in batches:
        for key, seq, op, value, ttl, at in sorted(rows, key=lambda r: r[1]):
            held, expires = entries.get(key, (None, None))
            live = expires is not None and at is not None and at < expires
            held, expires = (held, expires) if live else (None, None)
            read, then = held, None if ttl is None or at is None else at + ttl * 1_000_000
            if op == "set":
                held, expires, live, read = value, then, True, value
            elif op == "refresh" and live:
                expires = then
            elif op == "delete":
                held, expires = None, None
            out.append((key, seq, op, live, read))
            entries[key] = (held, expires)
    return out


def test_answers_over_batches(spark, tmp_path):
    """Times that go back and forth, values, times and spans that are null, operations of no name, keys that a batch leaves out; no entry goes through a Python worker."""
    rng = random.Random(7)
    ops = [None, "set", "set", "refresh", "refresh", "get", "get", "delete", "other"]
    row = lambda k: (rng.choice("abcdefgh"), k, rng.choice(ops), rng.choice([None, f"v{k}"]), rng.choice([None, 0, 1, 3, 9, 9, 9]), rng.choice([None, *[rng.randrange(6_000_000) for _ in range(20)]]))
    batches = [[row(k + 1000 * n) for k in rng.sample(range(1000), 150)] for n in range(3)] + [[("a", 5000, "get", None, None, 1), ("z", 5001, "get", None, None, 1)]]
    ddl, path, marks, folder = "key string, seq bigint, op string, value string, ttl_s int, at_us bigint", new_path(spark, "t"), new_path(spark, "m"), str(tmp_path / "ops")
    for rows in batches:
        spark.createDataFrame(rows, ddl).write.mode("append").parquet(folder)
        machine.answer_stream(spark.readStream.schema(ddl).parquet(folder), path, marks).awaitTermination()
    assert {r.seq: tuple(r) for r in machine.stored_answers(spark, path).collect()} == {r[1]: r for r in told(batches)}
