"""Checks that report what is wrong as rows (kind, detail): an empty result is a valid table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.interval import overlaps


def freshness(indexed: DataFrame, current: DataFrame, path: str = "path", digest: str = "sha1") -> DataFrame:
    """(path, state) of indexed files: ok, changed, deleted."""
    now = current.select(F.col(path).alias("_p"), F.col(digest).alias("_d"))
    j = indexed.join(now, F.col(path) == F.col("_p"), "left")
    return j.select(path, F.when(F.col("_p").isNull(), "deleted").when(~F.col(digest).eqNullSafe(F.col("_d")), "changed").otherwise("ok").alias("state"))


def _errors(df: DataFrame, kind: str, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of edges that are no nodes."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return _errors(ends.distinct().join(nodes.select("id"), "id", "left_anti"), "dangling", F.col("id"))


def asymmetric(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Edges of either table whose mirror the other has not."""
    both = forward.select("src", "dst", F.lit(True).alias("_f")).unionByName(backward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(False).alias("_f")))
    once = both.groupBy("src", "dst").agg(F.bool_or("_f").alias("_f"), F.bool_or(~F.col("_f")).alias("_b"))  # one hashed pass for distinct edges and both ways
    open_ = F.col("src").isNull() | F.col("dst").isNull()  # an edge without an end mirrors none
    kinds = F.array(F.when(F.col("_f") & (~F.col("_b") | open_), "no mirror"), F.when(F.col("_b") & (~F.col("_f") | open_), "mirror only"))
    wrong = once.select("src", "dst", F.explode(F.array_compact(kinds)).alias("kind"))
    name = F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string"))
    return wrong.select("kind", name.alias("detail"))


def validate_index(symbols: DataFrame, files: DataFrame, calls: DataFrame, callers: DataFrame, tests: DataFrame) -> DataFrame:
    """All checks of a code index: dangling ends, mirrors, spans beyond their file or empty, overlapping spans (a class may hold methods), duplicate ids,
    unknown files, tests mapped to what they do not call or to tests."""
    id_ = F.col("id")
    in_file = symbols.join(files.select(F.col("path").alias("file"), "lines"), "file", "left")
    flat = symbols.where(~F.col("kind").isin("class", "module"))
    mapped = tests.join(calls.select(F.col("src").alias("test_id"), F.col("dst").alias("source_id")), ["test_id", "source_id"], "left_anti")
    to_tests = tests.join(symbols.where("is_test").select(id_.alias("source_id")), "source_id", "left_semi")
    pair = F.concat_ws("->", "test_id", "source_id")
    parts = [
        dangling(calls, symbols),
        asymmetric(calls, callers),
        _errors(in_file.where("lines is null"), "unknown file", F.col("file")),
        _errors(in_file.where("line_end > lines"), "span beyond file", id_),
        _errors(symbols.where("line_end < line_start"), "empty span", id_),
        _errors(symbols.groupBy("id").count().where("count > 1"), "duplicate id", id_),
        _errors(overlaps(flat, ["file"], "line_start", "line_end", "id"), "overlap", id_),
        _errors(mapped, "test does not call", pair),
        _errors(to_tests, "test mapped to test", pair),
    ]
    return reduce(DataFrame.unionByName, parts)
