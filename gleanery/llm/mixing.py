"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Every document of a source gets the same expected number of copies, target / source size. Whole copies are certain; the fractions are rounded in pairs:
mass moves from one document to the other, in the direction that a hash draws with the odds that keep each document's expectation, until one of the two
is integral; the other goes on to the next pair. Mass is counted in words, so a source's words never change but for the last fraction. Blocks of a few
dozen documents round by themselves and hand one fractional document each to the next level, up a tree, until a source has one left.
Large documents come first in a block, so that what stays fractional tends to be small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import WORD, cut
from gleanery.operators.running import running

BLOCK = 64
WEIGHTS = (5.0, 2.0, 1.0)
DONE = "array<struct<order:bigint,row:bigint,up:int>>"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, source_rank, docs, target) of a table (source, size).

    Sources in order of code points, null last, weigh `weights`, repeating. Together the targets make `share` of all sizes, none above `cap` times its
    source's size; the excess is reshared by weight until none is above: with sources by size per weight, those below a level are at their cap, and
    the rest share what remains. The windows run over one row for each source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("source_rank", F.row_number().over(order)).withColumn("w", w).withColumn("most", F.lit(cap) * F.col("source_size"))
    s = s.withColumn("level", F.col("most") / F.col("w"))
    by = Window.orderBy("level", "source_rank")
    every = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.least(F.lit(share), F.lit(cap)) * F.sum("source_size").over(every)
    s = s.withColumn("fair", (total - before) / rest)
    fair = F.coalesce(F.min(F.when(F.col("fair") <= F.col("level"), F.struct("level", "source_rank", "fair"))).over(every)["fair"], F.lit(math.inf))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("most"), fair * F.col("w")))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), F.col("source_rank").cast("long").alias("source_rank"), "docs", target.cast("double").alias("target"))


def unit(*cols) -> Column:
    """A number from 0 to 1, by hash: reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def fold(members: Column, level: int) -> Column:
    """Rounds an array of (order, draw, row, size, p) pair by pair: struct of done, array of (order, row, up), and carry, the member that may still be fractional.
    order: the size, negative."""
    one = lambda m, p: F.struct(m["order"].alias("order"), m["draw"].alias("draw"), m["row"].alias("row"), m["size"].alias("size"), p.cast("double").alias("p"))
    done = lambda m, up: F.array(F.struct(m["order"].alias("order"), m["row"].alias("row"), up.cast("int").alias("up")))
    near = 1e-9

    def step(s: Column, b: Column) -> Column:
        a = s["carry"]
        free = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])  # words that can move from b to a
        owed = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
        moved = F.when(unit(a["draw"], b["draw"], F.lit(level)) * (free + owed) < owed, free).otherwise(-owed)
        pa, pb = a["p"] + moved / a["size"], b["p"] - moved / b["size"]
        whole = lambda p: (p <= near) | (p >= 1 - near)
        a_done = F.struct(F.concat(s["done"], done(a, F.round(pa))).alias("done"), one(b, pb).alias("carry"))
        b_done = F.struct(F.concat(s["done"], done(b, F.round(pb))).alias("done"), one(a, pa).alias("carry"))
        return F.when(whole(pa), a_done).otherwise(b_done)

    none = F.array().cast(DONE)
    start = F.struct(none.alias("done"), one(F.get(members, F.lit(0)), F.get(members, F.lit(0))["p"]).alias("carry"))
    return F.aggregate(F.slice(members, F.lit(2), F.greatest(F.size(members) - 1, F.lit(0))), start, step)


def settle(f: Column) -> Column:
    """All of a source's last block decided: array of (order, row, up).

    The carry is rounded to the nearer side; the words that this adds or takes are made up by members that go the other way, largest first, each no larger
    than what is left. It concerns the words of one document at most.
    """
    c = f["carry"]
    up = c["p"] >= 0.5
    owed = F.when(up, (c["p"] - 1) * c["size"]).otherwise(c["p"] * c["size"])
    start = F.struct(owed.alias("owed"), F.array(F.struct(c["order"].alias("order"), c["row"].alias("row"), up.cast("int").alias("up"))).alias("done"))

    def step(s: Column, m: Column) -> Column:
        turns = (-m["order"] <= F.abs(s["owed"])) & F.when(s["owed"] > 0, m["up"] == 0).otherwise(m["up"] == 1)
        left = F.when(~turns, s["owed"]).when(s["owed"] > 0, s["owed"] + m["order"]).otherwise(s["owed"] - m["order"])
        now = F.struct(m["order"].alias("order"), m["row"].alias("row"), F.when(turns, 1 - m["up"]).otherwise(m["up"]).alias("up"))
        return F.struct(left.alias("owed"), F.concat(s["done"], F.array(now)).alias("done"))

    return F.aggregate(F.array_sort(f["done"]), start, step, lambda s: s["done"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, key_col: str | None = None) -> DataFrame:
    """How often the mix takes each document, so that each source's words come to its target.

    Returns id_col, source_col, size (words), source_size, target (both of the source), copies, taken (words the mix takes, repeats counted); one row for
    each row of docs; other columns are ignored, but key_col, if given, is returned too: a key of the row, which takes no part. A source's taken words come nearer to its target than half of one document.

    Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own, the last; rows of null or repeated ids
    are documents of their own; an empty table gives an empty result; the draws depend on ids and texts only, so reruns agree (of rows of one
    id and text, which one is taken more often is immaterial).
    """
    counted = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"), *([F.col(key_col).alias("key")] if key_col else []))
    sizes = cut(counted.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")  # rows keep their number from here on
    goal = cut(targets(sizes, weights, share, cap), "mix-targets").select(F.col("source").alias("_source"), "source_size", "source_rank", "docs", "target")
    rows = sizes.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-9)
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(F.lit(0)).cast("long")).withColumn("p", F.greatest(F.lit(0.0), ratio - whole))
    rows = rows.withColumn("p", F.when(F.col("p") < 1e-9, F.lit(0.0)).otherwise(F.col("p")))
    most = goal.agg(F.max("docs")).first()[0] or 0
    n_blocks = F.ceil(F.col("docs") / F.lit(BLOCK)).cast("long")
    alike = cut(sizes.groupBy("source", "draw").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("source").alias("_s"), F.col("draw").alias("_d")), "mix-alike")
    drawn = rows.where((F.col("size") > 0) & (F.col("p") > 0))
    if alike.isEmpty():
        drawn = drawn.withColumn("spread", F.lit(0).cast("long"))
    else:  # rows that are alike would all go to one block: these are numbered, and dealt by their number too; which of them gets which is immaterial
        same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("draw") == F.col("_d"))
        marked = cut(drawn.join(alike, same, "left"), "mix-marked")
        numbered = running(marked.where("_d is not null").drop("_s", "_d"), ["source_rank", "draw"], ["row"], position="spread")
        drawn = marked.where("_d is null").drop("_s", "_d").withColumn("spread", F.lit(0).cast("long")).unionByName(numbered)
    left = drawn.select("source_rank", F.pmod(F.xxhash64("draw", "spread"), n_blocks).alias("block"), F.struct((-F.col("size")).alias("order"), "draw", "row", F.col("size").cast("double").alias("size"), "p").alias("m"))
    done, blocks, level = [], -(-most // BLOCK), 0
    while True:
        folded = left.groupBy("source_rank", "block").agg(F.sort_array(F.collect_list("m")).alias("ms"))
        folded = cut(folded.select("source_rank", "block", fold(F.col("ms"), level).alias("f")), f"mix-level-{level}")
        last = blocks <= 1
        done.append(folded.select(F.explode(settle(F.col("f")) if last else F.col("f.done")).alias("d")).select("d.row", "d.up"))
        if last:
            break
        left = folded.select("source_rank", F.floor(F.col("block") / BLOCK).cast("long").alias("block"), F.col("f.carry").alias("m"))
        blocks, level = -(-blocks // BLOCK), level + 1
    ups = done[0]
    for d in done[1:]:
        ups = ups.unionByName(d)
    out = rows.join(ups.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    copies = F.col("whole") + F.coalesce("up", F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *([F.col("key").alias(key_col)] if key_col else []))
