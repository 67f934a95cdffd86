"""Counts for dashboards, and the quality of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("passed", "failed", "error", "skipped", "xfailed", "xpassed")


def outcome_counts(rows: DataFrame, outcome: str, duration: Column, outcomes: tuple[str, ...] = OUTCOMES, keys: list[str] | None = None) -> DataFrame:
    """A count for each outcome, total, duration, and whether the counts make up the total."""
    counts = [F.count_if(F.col(outcome) == o).alias(o) for o in outcomes]
    out = rows.groupBy(*(keys or [])).agg(*counts, F.count("*").alias("total"), F.round(F.sum(duration), 2).alias("duration"))
    return out.withColumn("consistent", sum((F.col(o) for o in outcomes), F.lit(0)) == F.col("total"))


def half_up(a: Column, b: Column) -> Column:
    """a / b of whole numbers, rounded half up to a whole number; null for b of 0."""
    return F.floor((2 * a + b).cast("decimal(38,0)") / F.nullif(2 * b, F.lit(0)).cast("decimal(20,0)")).cast("long")


def run_summary(runs: DataFrame, status: str, detected: Column, fixed: Column, patches: Column, started: Column, ended: Column, keys: list[str] | None = None) -> DataFrame:
    """Runs by status, sums, the mean of the rounded success rates of completed runs that found something, and the mean duration in seconds.

    Rates are rounded half up. Without such runs the rate is 0; without finished runs (or a mean of 0) the duration is null. queued runs, which are in no
    other count, have a column of their own.
    """
    s = F.col(status)
    rate = F.when((s == "completed") & (detected > 0), half_up(fixed.cast("long") * 10_000, detected.cast("long")))  # in hundredths: whole numbers have exact means
    took = F.when(s.isin("completed", "failed") & started.isNotNull() & ended.isNotNull(), F.unix_micros(ended.cast("timestamp")) - F.unix_micros(started.cast("timestamp")))
    mean = half_up(F.sum(took), F.count(took) * 10_000) / 100
    return runs.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"),
        *[F.count_if(s == x).alias(f"{x}_runs") for x in ("completed", "failed", "running", "pending", "cancelled", "queued")],
        F.coalesce(F.sum(detected), F.lit(0)).cast("long").alias("bugs_detected"),
        F.coalesce(F.sum(fixed), F.lit(0)).cast("long").alias("bugs_fixed"),
        F.coalesce(F.sum(patches), F.lit(0)).cast("long").alias("patches"),
        F.coalesce(half_up(F.sum(rate), F.count(rate)) / 100, F.lit(0.0)).alias("success_rate"),
        F.nullif(mean, F.lit(0.0)).alias("avg_duration"),
    )


def hit_label(rank: Column) -> Column:
    return F.when(rank.isNull(), "MISS").when(rank <= 1, "HIT@1").when(rank <= 3, "HIT@3").when(rank <= 10, "HIT@10").otherwise("MISS")


def hits_at(truth: DataFrame, hits: DataFrame, query_col: str, id_col: str, expected: str = "expected_id") -> DataFrame:
    """(query, expected, rank, label) of every expected answer."""
    h = hits.select(F.col(query_col).alias("_q"), F.col(id_col).alias("_i"), "rank")
    out = truth.join(h, (F.col(query_col) == F.col("_q")) & (F.col(expected) == F.col("_i")), "left")
    return out.select(query_col, expected, "rank", hit_label(F.col("rank")).alias("label"))


def hit_rates(labelled: DataFrame) -> DataFrame:
    """One row: queries, found at 1, 3, 5 and 10, and missed."""
    at = lambda k: F.count_if(F.col("rank") <= k).alias(f"top{k}")
    return labelled.agg(F.count("*").alias("queries"), at(1), at(3), at(5), at(10), F.count_if(F.col("label") == "MISS").alias("missed"))


def reachability(bugs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """bugs (file, symbol) with reachable and reason: file_not_indexed, symbol_not_found, test_only_symbol; the first that fits."""
    sid = F.concat_ws("::", "file", "symbol")
    f = files.select(F.col("path").alias("_f")).distinct().hint("merge")  # both grow with the input, whatever size Spark guesses
    s = symbols.select(F.col("id").alias("_s"), "is_test").hint("merge")
    j = bugs.withColumn("_id", sid).join(f, F.col("file") == F.col("_f"), "left").join(s, F.col("_id") == F.col("_s"), "left")
    reason = F.when(F.col("_f").isNull(), F.concat(F.lit("file_not_indexed:"), F.col("file"))).when(F.col("_s").isNull(), F.concat(F.lit("symbol_not_found:"), F.col("_id"))).when(F.col("is_test"), F.concat(F.lit("test_only_symbol:"), F.col("_id")))
    return j.select(*bugs.columns, reason.isNull().alias("reachable"), reason.alias("reason"))


def flaky(runs: DataFrame, test: str = "test", attempt: str = "attempt", outcome: str = "outcome") -> DataFrame:
    """(test, flaky): failed at first, and passed in some later attempt."""
    failed = F.max(F.when((F.col(attempt) == 0) & F.col(outcome).isin("failed", "error"), True).otherwise(False))
    passed = F.max(F.when((F.col(attempt) > 0) & (F.col(outcome) == "passed"), True).otherwise(False))
    return runs.groupBy(test).agg((failed & passed).alias("flaky"))


def baseline(results: DataFrame, node: str = "node_id", outcome: str = "outcome", order: str | None = None) -> DataFrame:
    """(node, outcome): the last outcome of every test, as pairs; a map would gather all of them in one row."""
    return results.groupBy(node).agg(F.max_by(outcome, order or node).alias(outcome))


def artefacts(files: DataFrame, path: str = "path") -> DataFrame:
    """One row for each run folder: reports and patches found below it."""
    run = F.regexp_extract(path, "(^|/)(r_[0-9]+_[0-9]+)/", 2)
    return files.where(run != "").groupBy(run.alias("run_id")).agg(F.count_if(F.col(path).endswith("bug_report.json")).alias("reports"), F.count_if(F.col(path).endswith(".patch")).alias("patches"))


def tab_counts(rows: DataFrame, status: str, tabs: tuple[str, ...]) -> DataFrame:
    """(tab, n): rows of each status that a tab shows, 0 where there are none, and of `all`."""
    counts = rows.agg(F.count("*").alias("all"), *[F.count_if(F.col(status) == t).alias(t) for t in tabs])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tab"), F.col(f"`{t}`").alias("n")) for t in ("all", *tabs)])).alias("x")).select("x.*")


def by_file(rows: DataFrame, file: str, passed: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, file, total, passed, percent): totals of each source file and the share that passed, rounded half up; rows without a file count for `unknown`."""
    name = F.coalesce(F.col(file), F.lit("unknown")).alias(file)
    out = rows.groupBy(*(keys or []), name).agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))
    return out.withColumn("percent", half_up(F.col("passed") * 100, F.col("total")))
