"""Connected components of an edge table, by alternating large-star and small-star steps: logarithmically many, each two aggregations by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut, forget


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of every node that an edge (a, b: long) names; the component is its smallest node.

    A node's neighbours are never gathered in one place: each step is a minimum by node and a join back, both of which Spark splits where one node has
    many. Raises an error if the graph has not settled after `rounds` steps. Loops (a = b) and repeated edges make no difference.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        star = large.join(small, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        after = cut(star.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        forget(now)
        now, before = after, state
        state = _state(now)
        if state == before:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components have not settled after {rounds} steps")
