"""The registered queries of this subpackage: each applies one operator to its whole table. ORACLES has the SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import collisions, divergence, fingerprints, jaccard, lines, mixing, packing, quality, rules, sessions, suffixes, token_counts, toxicity
from gleanery.llm.common import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.drop_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("cleaned")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_wide_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("segments").cast("long").alias("n_segments"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document before and after three edits: a word put in at a third, 40 characters out at a half, the last 20 replaced.

    Two steps: all trees are made and stored beside their texts; the edits start from the stored trees.
    """
    how = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    made = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), *how, keep=True)
    docs = cut(made.select("doc_id", F.col("edited_text").alias("text"), "tree"), "trees", compression="zstd")
    n = F.coalesce(F.length("text"), F.lit(0))
    at = lambda start, end, new: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("new"))
    edits = F.array(at(F.floor(n / 3), F.floor(n / 3), "inserted "), at(F.floor(n / 2), F.floor(n / 2) + 40, ""), at(F.greatest(n - 20, F.lit(0)), n + 9, " and a new end."))
    return token_counts.count_tokens(docs.withColumn("edits", edits), *how, "edits", tree_col="tree")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.link_vectors(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op13_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all clicks; the path as a digest."""
    out = sessions.sessionise(table(spark, sf_dir, "clicks"))
    ids = F.array_join(F.transform("path", lambda x: x.cast("string")), ",")
    return out.withColumn("path_sha256", F.sha2(ids.cast("binary"), 256)).drop("path")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_suffix_array_dedup, op3_fingerprints, op4_quality_rules, op5_mixing, op6_quality_classifier, op7_line_dedup, op8_toxicity, op9_token_counts, op10_ngram_jaccard_join, op11_embedding_links, op12_source_divergence, op13_gap_sessions)}
ORACLES = {"op4_quality_rules": rules.ORACLE, "op7_line_dedup": lines.ORACLE, "op10_ngram_jaccard_join": jaccard.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_gap_sessions": sessions.ORACLE}
