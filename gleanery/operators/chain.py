"""Which rows a chain of links reaches: pointer doubling, so a chain of n steps takes about log2(n) joins and is never walked row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.storage import cut


def reached(links: DataFrame, starts: DataFrame, node: str = "node", to: str = "next", rounds: int = 64) -> DataFrame:
    """The nodes that follow from `starts` (node) along `links` (node, next: at most one link from a node; a null next ends the chain), starts included.

    After round k the marked nodes are those within 2^k - 1 steps, and a jump spans 2^k links. Raises an error if chains have not ended after `rounds` rounds.
    """
    jump = cut(links.where(F.col(to).isNotNull()).select(F.col(node).alias("_n"), F.col(to).alias("_t")), "jumps")
    marked = cut(starts.select(F.col(node).alias("_m")).distinct(), "reached")
    for _ in range(rounds):
        if jump.isEmpty():
            return marked.select(F.col("_m").alias(node))
        further = marked.join(jump, F.col("_m") == F.col("_n")).select(F.col("_t").alias("_m"))
        marked = cut(marked.union(further).distinct(), "reached")
        onward = jump.select(F.col("_n").alias("_n2"), F.col("_t").alias("_t2"))
        jump = cut(jump.join(onward, F.col("_t") == F.col("_n2")).select("_n", F.col("_t2").alias("_t")), "jumps")
    raise RuntimeError(f"chains have not ended after {rounds} rounds")
