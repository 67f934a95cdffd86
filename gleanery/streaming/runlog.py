"""Run logs as streams: tailing, the state of each run in a durable table, final events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "run_id string, seq int, line string, step_index int, stage string, status string, ts timestamp"
#: States that end a run, and which state may follow which.
FINAL = ("completed", "failed", "cancelled")
NEXT = {"queued": ("running", "cancelled"), "pending": ("running", "cancelled"), "running": FINAL}


def tail(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Events appended as JSON files to a folder; where a reader left off is in its checkpoint."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(path)


def partial_state(events: DataFrame) -> DataFrame:
    """What some of a log's events say of each run, in a form that adds up: first end, last status, step and stage by seq, and lines."""
    of = lambda c: F.struct("seq", F.col(c).alias("value"))
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), of(c)))
    return events.groupBy("run_id").agg(
        F.min(F.when(F.col("status").isin(*FINAL), of("status"))).alias("ended"), last("status").alias("last"), last("step_index").alias("step"), last("stage").alias("at"), F.count("line").alias("lines")
    )


def merged_state(partials: DataFrame) -> DataFrame:
    """(run_id, status, step_index, stage, lines, finished) from partial states of any number of batches."""
    whole = partials.groupBy("run_id").agg(F.min("ended").alias("ended"), F.max("last").alias("last"), F.max("step").alias("step"), F.max("at").alias("at"), F.sum("lines").alias("lines"))
    status = F.coalesce("ended.value", "last.value").alias("status")
    return whole.select("run_id", status, F.col("step.value").alias("step_index"), F.col("at.value").alias("stage"), "lines", F.col("ended").isNotNull().alias("finished"))


def run_state(events: DataFrame) -> DataFrame:
    """(run_id, status, step_index, stage, lines, finished): the latest of each by seq; a final state is never left."""
    return merged_state(partial_state(events))


def invalid_transitions(events: DataFrame) -> DataFrame:
    """(run_id, seq, was, status): changes of state that the machine does not allow. A batch over the log."""
    from pyspark.sql import Window

    was = F.lag("status").over(Window.partitionBy("run_id").orderBy("seq"))
    allowed = F.lit(False)
    for a, bs in NEXT.items():
        allowed = allowed | ((F.col("was") == a) & F.col("status").isin(*bs))
    moved = events.where("status is not null").withColumn("was", was).where("was is not null and was <> status")
    return moved.where(~allowed).select("run_id", "seq", "was", "status")


def fold_stream(events: DataFrame, path: str, checkpoint: str):
    """Starts a stream over what there is that keeps a durable table of run states: each batch's partial states in a folder of its own number, and the runs that
    ended in it (`final`), once for each run. A batch that is run again after a failure overwrites its own folders with the same rows."""

    def upsert(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        partial_state(batch).write.mode("overwrite").parquet(f"{path}/states/batch={n}")
        now = spark.read.parquet(f"{path}/states/batch={n}").where("ended IS NOT NULL").select("run_id", F.col("ended.value").alias("status"), F.col("ended.seq").alias("seq"))
        if n:
            before = spark.read.parquet(f"{path}/final").where(F.col("batch") < n)
            now = now.join(before.select("run_id"), "run_id", "left_anti")
        now.write.mode("overwrite").parquet(f"{path}/final/batch={n}")

    return events.writeStream.outputMode("append").foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of all runs in a table that fold_stream keeps."""
    return merged_state(spark.read.parquet(f"{path}/states"))


def final_events(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, status, seq): one event for each run that has ended, which ends its tail."""
    return spark.read.parquet(f"{path}/final").select("run_id", "status", "seq")


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """Starts a stream over what there is whose batches are stored by their number: a batch that is run again overwrites itself."""
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    return rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and tumbling window; rows later than the watermark are left out of a stream. An extra, beside the run logs."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
