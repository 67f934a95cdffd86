"""Filling budgets in order, and the tiers of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import estimated_tokens
from gleanery.operators.running import running
from gleanery.storage import cut


def fill(rows: DataFrame, keys: list[str], order: list, size: str, budget: int) -> DataFrame:
    """Rows with fate and reason: in order, rows are taken while they fit; the first that does not is dropped, and with it all behind it.

    When the budget is exactly full, rows behind it are dropped as over_budget; behind an overflow they are not_considered.
    """
    run = cut(running(rows, keys, order, size), "running")
    ends = run.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min(F.when(F.col("used") > budget, F.col("position"))).alias("_over"), F.bool_or(F.col("used") == budget).alias("_full"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = run.join(ends, same)
    fate = F.when(F.col("used") <= budget, "taken").when((F.col("position") == F.col("_over")) | F.col("_full"), "over_budget").otherwise("not_considered")
    return out.withColumn("fate", fate).select(*rows.columns, "used", "fate", "position")


def tiers(required: Column, t4: Column, t5: Column, t6: Column, t7: Column, budget: int = 12_000) -> Column:
    """Which optional tiers of a prompt go in: struct(t4, t5, t6, total). Each is tried below a share of the budget, and must end below the next share."""
    b = float(budget)
    take4 = (required < b * 0.7) & (required + t4 < b * 0.8)
    after4 = required + F.when(take4, t4).otherwise(0)
    take5 = (after4 < b * 0.8) & (after4 + t5 < b * 0.85)
    after5 = after4 + F.when(take5, t5).otherwise(0)
    take6 = (after5 < b * 0.85) & (t6 > 0) & (after5 + t6 < b * 0.9)
    after6 = after5 + F.when(take6, t6).otherwise(0)
    return F.struct(take4.alias("t4"), take5.alias("t5"), take6.alias("t6"), (after6 + t7).cast("long").alias("total"))


def shares(required: Column, budget: int = 10_000, t4: float = 0.20, t5: float = 0.10, least: int = 100) -> Column:
    """Overflow, and what the neighbours and the map may use: struct(overflow, t4_budget, t5_budget). The map's share is taken after the neighbours'."""
    rest = F.lit(budget) - required
    four = F.least(F.lit(int(budget * t4)), rest)
    four = F.when((required <= budget) & (four > least), four).otherwise(0)
    five = F.least(F.lit(int(budget * t5)), rest - four)
    five = F.when((required <= budget) & (five > least), five).otherwise(0)
    return F.struct((required > budget).alias("overflow"), four.cast("long").alias("t4_budget"), five.cast("long").alias("t5_budget"))


def manifest(items: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and tokens of taken and dropped items."""
    taken = F.col("fate") == "taken"
    return items.groupBy(*keys).agg(F.count_if(taken).alias("included"), F.count_if(~taken).alias("dropped"), F.coalesce(F.sum(F.when(taken, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"))


def required_sections(reports: DataFrame, tests: DataFrame, source: DataFrame, suspects: DataFrame) -> DataFrame:
    """(group_id, section, ordinal, item_id, text, tokens): what a prompt must have, in order: evidence, test code, suspects' source.

    reports: (group_id, bug_id, test_name, error_type, error_message, called array<string>); tests: (test_name, text), sanitised; source: (id, text);
    suspects: (group_id, id). Each report is evidence; each test stands once for a group, by name; suspects come before the other symbols that reports call.
    An item without a text is left out.
    """
    evidence = reports.select("group_id", F.lit("evidence").alias("section"), F.lit(0).alias("_first"), F.col("bug_id").alias("item_id"), F.concat_ws("\n", "test_name", F.concat_ws(": ", "error_type", "error_message")).alias("text"))
    named = reports.select("group_id", "test_name").distinct().join(tests.dropDuplicates(["test_name"]), "test_name")
    code = named.select("group_id", F.lit("tests").alias("section"), F.lit(0).alias("_first"), F.col("test_name").alias("item_id"), "text")
    called = reports.select("group_id", F.explode("called").alias("id")).where("id is not null")
    wanted = suspects.select("group_id", "id", F.lit(0).alias("_first")).unionByName(called.withColumn("_first", F.lit(1))).groupBy("group_id", "id").agg(F.min("_first").alias("_first"))
    bodies = wanted.join(source, "id").select("group_id", F.lit("source").alias("section"), "_first", F.col("id").alias("item_id"), "text")
    every = evidence.unionByName(code).unionByName(bodies).where("text is not null")
    w = Window.partitionBy("group_id", "section").orderBy("_first", "item_id")
    return every.select("group_id", "section", F.row_number().over(w).cast("long").alias("ordinal"), "item_id", "text", estimated_tokens(F.col("text")).alias("tokens"))
