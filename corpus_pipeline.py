"""From raw documents to packed training sequences: five stages, each written as Parquet and read back as the next one's documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import jaccard, lines, mixing, packing, quality
from gleanery.llm.common import cut, unused

#: From this score on a document stays.
MIN_QUALITY = 0.7


def with_rows(docs: DataFrame, what: str) -> tuple[DataFrame, str]:
    """docs with a key of each row, which stays as it is since it is written, and the key's name, which docs has no column of: ids may be null or repeated."""
    row = unused(docs, "_row")
    return cut(docs.withColumn(row, F.monotonically_increasing_id()), what), row


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = unused(docs, "_quality")
    scored = quality.with_quality(docs, labels, score)
    return scored.where(F.col(score) >= MIN_QUALITY).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites have; n_chars follows the text."""
    own = {c: unused(docs, f"_kept_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_removed")}  # columns of the input that only share a name with the counts
    out = lines.drop_wide_lines(docs.withColumnsRenamed(own))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by id (null last), of each group that shingles of five words link at a similarity of 0.8; each row is judged by its own text, whatever its id."""
    keyed, row = with_rows(docs, "near-rows")
    found = jaccard.jaccard_components(keyed, id_col=row, words=5, num=80, den=100).select(F.col(row).alias("_r"), "component_id")
    ids = keyed.select(F.col(row).alias("_key"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(row).alias("key")).alias("place"))
    first = found.join(ids, F.col("_r") == F.col("_key")).groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.key").alias(row))
    return keyed.join(first, row, "left_semi").select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole copies, up to two."""
    keyed, row = with_rows(docs, "mix-rows")
    copies = mixing.mix(keyed, key_col=row).where("copies > 0").select(row, F.col("copies").cast("int").alias("_times"))
    times = unused(docs, "_times")
    taken = keyed.join(copies.withColumnRenamed("_times", times), row)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times))).alias(unused(docs, "_copy"))).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k + 1}")
    return docs


#: A nearest-neighbour vote, sketches and hashed draws: SQL can't express them; tests hold the rows against a brute-force version.
ORACLE_SQL = None
