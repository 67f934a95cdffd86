"""The pipeline, stage by stage, against what each stage's operator decides and brute force where that is short."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm_operators import brute_components

from gleanery.llm import mixing, quality
from gleanery.llm.common import cut


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], d), "test-stage"))
    assert all(x.columns == names for x in seen[:-1])
    scores = {r.doc_id: r.predicted for r in quality.score_quality(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert {r.doc_id for r in seen[1].collect()} == {i for i, p in scores.items() if p}
    assert seen[2].count() == seen[1].count()
    linked = brute_components([(r.doc_id, r.text) for r in seen[2].collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in seen[3].collect()) == sorted(i for i, _, c in linked if i == c)
    copies = {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    assert {r.doc_id: r["count"] for r in seen[4].groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}
    packed = seen[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 2048 for r in packed)
    assert seen[5].where("piece = 0").count() == seen[4].count()
