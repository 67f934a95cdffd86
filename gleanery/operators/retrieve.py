"""Retrieval for failure reports: terms and seeds from a report, ranked text search and a graph walk, fused, tiered and filled into a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.stem import with_stems
from gleanery.functions.text import clean_message, estimated_tokens, query_terms, test_name_terms, tier, tokenize
from gleanery.operators import bm25, fuse, graph, pack, segments


def report_weights(reports: DataFrame, stemmer: str = "porter2") -> DataFrame:
    """(query_id, term, weight) of reports (bug_id, test_name, error_message, body, frames array<string>): a term of two sources counts twice."""
    words = lambda c: tokenize(F.coalesce(c, F.lit("")))
    terms = query_terms(test_name_terms(F.col("test_name")), words(clean_message(F.col("error_message"))), words(F.col("body")), words(F.array_join("frames", " ")))
    rows = reports.select(F.col("bug_id").alias("query_id"), F.explode(terms).alias("term"))
    if stemmer == "porter2":  # a whole identifier that has parts stays as it is
        rows = with_stems(rows, "term").select("query_id", F.when(F.col("term").rlike("[_0-9]"), F.col("term")).otherwise(F.col("stem")).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.least(F.count("*"), F.lit(bm25.CAP)).cast("long").alias("weight"))


def retrieve(weights: DataFrame, index_path: str, edges: DataFrame, nodes: DataFrame, seeds: DataFrame, source: DataFrame, k: int = 50, budget: int = 10_000) -> DataFrame:
    """(query_id, id, score, rank, tier, tokens, used, fate) for every query: hits of the segmented index and of the walk from the query's seeds, fused half and
    half, tiered by kind and score, and filled into a budget of tokens by rank.

    weights: (query_id, term, weight); edges: (src, dst, edge_type, weight); nodes: (id, kind, is_test); seeds: (query_id, id, score); source: (id, text).
    Tests and what the tiers drop are left out.
    """
    spark = weights.sparkSession
    hits = segments.search(spark, index_path, weights, "id", k=k).select("query_id", "id", "score", "rank")
    walked = graph.walk_by_query(edges, seeds).select("query_id", "id", "score")
    walked = bm25.top_k(walked, "query_id", "id", k).select("query_id", "id", "score", "rank")
    fused = fuse.fuse(hits, walked, ["query_id"], "id").join(nodes.where("not is_test").select("id", "kind"), "id")
    tiers = fused.withColumn("tier", tier(F.col("kind"), F.col("score"))).where("tier <> 'DROP'")
    sized = tiers.join(source.select("id", estimated_tokens(F.col("text")).alias("_full")), "id").withColumn("tokens", F.when(F.col("tier") == "FULL", F.col("_full")).otherwise(F.least("_full", F.lit(40))))
    return pack.fill(sized.select("query_id", "id", "score", "rank", "tier", "tokens"), ["query_id"], ["rank"], "tokens", budget).drop("position")
