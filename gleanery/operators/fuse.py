"""Combining two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(a: DataFrame, b: DataFrame, keys: list[str], id_col: str, weight_a: float = 0.5) -> DataFrame:
    """(keys, id, score, rank): each score by its list's largest, weighted; a missing score is 0. Ties by id."""
    left = a.select(*keys, id_col, F.col("score").alias("_a"))
    right = b.select(*keys, id_col, F.col("score").alias("_b"))
    both = left.join(right, [*keys, id_col], "full")
    part = lambda c: F.coalesce(F.col(c) / F.max(c).over(Window.partitionBy(*keys)), F.lit(0.0))
    score = F.round(F.lit(weight_a) * part("_a") + F.lit(1 - weight_a) * part("_b"), 6)
    out = both.withColumn("score", score).drop("_a", "_b")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), id_col)).cast("long"))


def combine(a: DataFrame, b: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, id, rank): all of a by rank, then those of b that a has not."""
    both = a.select(*keys, id_col, "rank", F.lit(0).alias("_from")).unionByName(b.select(*keys, id_col, "rank", F.lit(1).alias("_from")))
    once = both.groupBy(*keys, id_col).agg(F.min(F.struct("_from", "rank")).alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_m._from", "_m.rank", id_col)
    return once.select(*keys, id_col, F.row_number().over(w).cast("long").alias("rank"))
