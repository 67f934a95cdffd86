"""State that a stream keeps for each key: runs that refuse forbidden changes and time out, and entries that expire and are refreshed.

Both hold one small value for each key in the state store, whatever a key's number of rows; rows of one batch are taken by seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanery.streaming.runlog import FINAL, NEXT

CHANGE = "run_id string, seq bigint, kind string, was string, status string"
ANSWER = "key string, seq bigint, op string, ok boolean, value string"
STORED = "run_id string, seq bigint, was string, status string, batch int, kind string"
TOLD = "key string, seq bigint, op string, ok boolean, value string, after struct<value: string, expires: bigint>, batch int, last boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What these streams need of the session, set once before they start unless the session has another provider than Spark's default."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(key, "HDFSBackedStateStoreProvider"):  # Spark's default, which keeps no timers
        spark.conf.set(key, ROCKS)


class RunMachine(StatefulProcessor):
    """Rows of kind `changed` and `refused` for each status that differs from the run's, and `timed_out` for runs that are silent too long.

    The first status of a run is taken as it is. A refused one leaves the run as it was. Runs that have ended stay in the state, so a change after the end is
    refused for good; a run that times out has failed.
    """

    def __init__(self, timeout_s: int | None = None):
        self.timeout_ms = None if timeout_s is None else timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        status, timer = self.run.get() if self.run.exists() else (None, None)
        latest = None
        for r in sorted(rows, key=lambda r: r.seq):
            latest = r.ts if latest is None or (r.ts is not None and r.ts > latest) else latest
            if r.status is None or r.status == status:
                continue
            ok = status is None or r.status in NEXT.get(status, ())
            if status is not None:
                yield Row(run_id=key[0], seq=r.seq, kind="changed" if ok else "refused", was=status, status=r.status)
            status = r.status if ok else status
        if self.timeout_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
                timer = None
            if status not in FINAL and latest is not None:
                timer = int(latest.timestamp() * 1000) + self.timeout_ms
                self.handle.registerTimer(timer)
        self.run.update((status, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status, _ = self.run.get()
        self.run.update(("failed", None))
        yield Row(run_id=key[0], seq=None, kind="timed_out", was=status, status="failed")

    def close(self) -> None:
        pass


def run_changes(events: DataFrame, timeout_s: int | None = None, late: str = "1 hour") -> DataFrame:
    """(run_id, seq, kind, was, status) of a stream of events (run_id, seq, status, ts): see RunMachine. With a timeout, time is that of the events: a run times
    out when the watermark, `late` behind the latest event of all runs, has passed its last event by so many seconds."""
    keep_state_in_rocksdb(events.sparkSession)
    if timeout_s is None:
        return events.groupBy("run_id").transformWithState(RunMachine(), CHANGE, "Append", "None")
    return events.withWatermark("ts", late).groupBy("run_id").transformWithState(RunMachine(timeout_s), CHANGE, "Append", "EventTime")


def moves(status: str) -> int:
    """How often a run of this status can change at most: no status comes back."""
    return max((1 + moves(s) for s in NEXT.get(status, ())), default=0)


def allowed(was: Column, status: Column) -> Column:
    out = F.lit(False)
    for a, bs in NEXT.items():
        out = out | ((was == a) & status.isin(*bs))
    return out


def steps(rows: DataFrame, order: list) -> DataFrame:
    """rows (run_id, status, ...) with kind (`first` for the first status of a run, `changed`, `refused`; null for one it has already) and was: RunMachine over whole runs.

    Each of the few changes that a run can make is the first that the one before allows, so running windows find them without rows of one run in one place.
    """
    by_order = Window.partitionBy("run_id").orderBy(*order)
    upto = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = [f"_s{k}" for k in range(1 + max(map(moves, NEXT)))]
    out = rows.withColumn(states[0], F.first("status").over(upto))
    for before, after in zip(states, states[1:], strict=False):
        out = out.withColumn(after, F.first(F.when(allowed(F.col(before), F.col("status")), F.col("status")), ignorenulls=True).over(upto))
    out = out.withColumn("was", F.lag(F.coalesce(*reversed(states))).over(by_order))
    kind = F.when(F.col("was").isNull(), "first").when(F.col("was") != F.col("status"), F.when(allowed(F.col("was"), F.col("status")), "changed").otherwise("refused"))
    return out.withColumn("kind", kind).drop(*states)


def change_stream(events: DataFrame, path: str, checkpoint: str):
    """Starts a stream over what there is that stores, by batch and kind, what RunMachine answers to events (run_id, seq, status) without a timeout; see stored_changes.

    The state of a run is its first status and its changes, of which there are few, in the folders of earlier batches: a batch goes on behind them, and one that is run
    again overwrites its own folder. An event without a run, or without a status, changes none.
    """

    def store(batch: DataFrame, n: int) -> None:
        rows = batch.where("run_id IS NOT NULL AND status IS NOT NULL").select("run_id", "seq", "status", F.lit(n).alias("batch"))
        if n:
            known = batch.sparkSession.read.schema(STORED).parquet(path).where((F.col("batch") < n) & F.col("kind").isin("first", "changed"))
            rows = rows.unionByName(known.select("run_id", "seq", "status", "batch"))
        told = steps(rows, ["batch", F.asc_nulls_last("seq"), "status"]).where((F.col("batch") == n) & F.col("kind").isNotNull())
        told.select("run_id", "seq", "was", "status", "kind").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={n}")

    return events.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_changes(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, seq, kind, was, status) of all changes, made or refused, in a table that change_stream keeps."""
    return spark.read.schema(STORED).parquet(path).where(F.col("kind").isin("changed", "refused")).select("run_id", "seq", "kind", "was", "status")


class Entries(StatefulProcessor):
    """One value for each key with its time of expiry; the answer to each operation in order of seq.

    `set` stores a value for ttl_s seconds; `refresh` gives a live entry that time anew; `get` reads and `delete` removes a live entry. Each is ok where the entry
    was live, which it is before its time of expiry and not at it; `set` always is. An expired entry's state is dropped when the watermark passes its expiry.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, expires bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        value, expires, timer = self.entry.get() if self.entry.exists() else (None, None, None)
        for r in sorted(rows, key=lambda r: r.seq):
            live = expires is not None and r.at_us < expires
            if not live:
                value, expires = None, None
            read = value
            if r.op == "set":
                value, expires, live, read = r.value, r.at_us + r.ttl_s * 1_000_000, True, r.value
            elif r.op == "refresh" and live:
                expires = r.at_us + r.ttl_s * 1_000_000
            elif r.op == "delete":
                value, expires = None, None
            yield Row(key=key[0], seq=r.seq, op=r.op, ok=live, value=read)
        if timer is not None:
            self.handle.deleteTimer(timer)
        if expires is None:
            self.entry.clear()
        else:
            timer = expires // 1000 + 1
            self.handle.registerTimer(timer)
            self.entry.update((value, expires, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def entry_answers(operations: DataFrame, late: str = "1 hour") -> DataFrame:
    """(key, seq, op, ok, value) of a stream of operations (key, seq, op, value, ttl_s int, ts timestamp, at_us bigint: ts in microseconds); see Entries."""
    keep_state_in_rocksdb(operations.sparkSession)
    return operations.withWatermark("ts", late).groupBy("key").transformWithState(Entries(), ANSWER, "Append", "EventTime")


def told(operations: DataFrame, order: list) -> DataFrame:
    """operations (key, seq, op, value, due, at_us, ...) with ok and read, as Entries answers them, and after: value and time of expiry of the entry that is left, or null;
    last marks the last row of each key. due is the time of expiry that a set or refresh asks for; an operation `held` is an entry that was there before.

    An entry lives from its last set on, until a row that comes at its time of expiry or later, or behind a delete; running windows find the last of each.
    """
    by_order = Window.partitionBy("key").orderBy(*order)
    upto = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_order.rowsBetween(Window.unboundedPreceding, -1)
    op = F.coalesce("op", F.lit("get"))
    made = op.isin("set", "held")
    place = lambda when, w: F.coalesce(F.max(F.when(when, F.col("_n"))).over(w), F.lit(0))
    out = operations.withColumn("_n", F.row_number().over(by_order)).withColumn("_due", F.last(F.when(made | (op == "refresh"), F.struct("due")), ignorenulls=True).over(before)["due"])
    out = out.withColumn("_over", ~made & ~F.coalesce(F.col("at_us") < F.col("_due"), F.lit(False)))
    out = out.withColumn("ok", place(made, upto) > F.greatest(place(F.col("_over"), upto), place(op == "delete", before)))
    out = out.withColumn("read", F.when(F.col("ok"), F.last(F.when(made, F.struct("value")), ignorenulls=True).over(upto)["value"]))
    expires = F.when(made | (op == "refresh"), F.col("due")).otherwise(F.col("_due"))
    out = out.withColumn("after", F.when(F.col("ok") & (op != "delete") & expires.isNotNull(), F.struct(F.col("read").alias("value"), expires.alias("expires"))))
    return out.withColumn("last", F.lead("_n").over(by_order).isNull()).drop("_n", "_due", "_over")


def answer_stream(operations: DataFrame, path: str, checkpoint: str):
    """Starts a stream over what there is that stores, by batch, what Entries answers to operations (key, seq, op, value, ttl_s, at_us); see stored_answers.

    A batch's last row of each key keeps the entry that is left, in a folder of such rows; a batch goes on from the latest of them, and one that is run again
    overwrites its own folder.
    """

    def store(batch: DataFrame, n: int) -> None:
        due = F.when(F.col("op").isin("set", "refresh"), F.col("at_us") + F.col("ttl_s").cast("long") * 1_000_000)
        rows = batch.select("key", "seq", "op", "value", due.alias("due"), "at_us", F.lit(n).alias("batch"))
        if n:
            known = batch.sparkSession.read.schema(TOLD).parquet(path).where(F.col("last") & (F.col("batch") < n))
            known = known.groupBy("key").agg(F.max_by("after", "batch").alias("after")).where("after IS NOT NULL")
            null = lambda kind: F.lit(None).cast(kind)
            held = known.select("key", null("long").alias("seq"), F.lit("held").alias("op"), "after.value", F.col("after.expires").alias("due"), null("long").alias("at_us"), F.lit(-1).alias("batch"))
            rows = rows.unionByName(held)
        out = told(rows, ["batch", F.asc_nulls_last("seq")]).where(F.col("batch") == n)
        out.select("key", "seq", "op", "ok", F.col("read").alias("value"), "after", "last").write.mode("overwrite").partitionBy("last").parquet(f"{path}/batch={n}")

    return operations.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, seq, op, ok, value) of all operations, in a table that answer_stream keeps."""
    return spark.read.schema(TOLD).parquet(path).select("key", "seq", "op", "ok", "value")
