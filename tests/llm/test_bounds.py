"""Bounds that hold whatever repeats, columns that keep their values on every path, and equal rows that spread."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import common, jaccard, labelled, lines, packing, quality, toxicity


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))


@pytest.mark.parametrize("texts", [1, 3000])
def test_training_rows_are_bounded(spark, texts):
    """One labelled id with 3,000 rows, of one text or of as many texts."""
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % texts).alias("text"))
    docs = docs.union(spark.createDataFrame([(2, "other")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = labelled.training_rows(docs, labels, "quality", "doc_id", "text", 1, 1, 100).collect()
    assert len(got) == min(100, texts + 1)
    assert len({(r.id, r.text) for r in got}) == len(got)


@pytest.mark.parametrize("most_sent", [lines.MOST_SENT, 0])
def test_line_dedup_keeps_columns_of_any_name(spark, most_sent):
    rows = [(k, f"wide\nown {k}", f"s{k}", 100 + k, f"mine {k}", k) for k in range(9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _row long, _wide string, __row long")
    got = lines.drop_wide_lines(d, most_sent=most_sent).collect()
    assert {(r.doc_id, r.text, r._row, r._wide, r["__row"]) for r in got} == {(k, f"own {k}", 100 + k, f"mine {k}", k) for k in range(9)}


def clashing(spark, rows):
    names = "doc_id long, text string, lang string, source string, n_chars long, _row long, _quality double, _copy int, _times int, n_lines int, n_removed string"
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, 0.5, 3, 4, 5, "six") for i, t, s in rows], names)


def corpus(rng):
    texts = [prose(rng, 60) for _ in range(12)]
    return [(k, t, f"s{k % 3}") for k, t in enumerate(texts)] + [(None, texts[0], None), (3, texts[3], "s1"), (20, None, "s1"), (21, "", "s2"), (22, "x " * 3000, "s1")]


@pytest.mark.parametrize("rows", [True, False])
def test_every_stage_keeps_the_columns(spark, tmp_path, rows):
    """All five stages over a table with nulls, repeats and names that stages use inside, and over an empty one."""
    spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    d = clashing(spark, corpus(random.Random(1)) if rows else [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, d, str(tmp_path)), "stage-test")
        assert out.columns == d.columns
        assert all((r._row, r._quality, r._copy, r._times, r.n_lines, r.n_removed) == (7, 0.5, 3, 4, 5, "six") for r in out.collect())
        assert rows or out.isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, d, "").collect()
    assert len(packed) >= d.count() and (rows or not packed)


def test_equal_rows_of_one_id_meet_once(spark):
    """3,000 equal rows and a near copy: one text of each class goes to the join."""
    rng = random.Random(2)
    ws = prose(rng, 100).split()
    near = " ".join([*ws[:50], "new", *ws[51:]])
    rows = [(1, " ".join(ws))] * 3000 + [(2, near), (1, prose(rng, 80)), (5, prose(rng, 80))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.jaccard_components(d).groupBy("doc_id", "component_id", "n_shingles").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 77, 1), (1, 1, 97, 3000), (2, 1, 97, 1), (5, 5, 77, 1)]
    bare = d.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    sets = jaccard.scan(bare, 4).where("kind = 0").select("id", "n", "class")
    texts = jaccard._class_texts(bare, sets, sets.select("class").distinct(), 4)
    assert texts.count() == texts.select("class").distinct().count() == 4


def test_equal_rows_spread_over_salts(spark):
    """5,000 equal rows are ranked by many windows, and packed gaplessly."""
    d = spark.createDataFrame([(1, "one two three")] * 5000, "doc_id long, text string").repartition(4)
    kept = packing.pack_documents(d, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    got = kept.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert sum(r.n for r in got) == kept.agg(F.sum("length")).first()[0] and all(r.n == r.end for r in got)
    rows = spark.range(5000).select(F.col("id").alias("row"))
    assert rows.select(F.pmod(F.xxhash64("row"), F.lit(80)).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0] < 120


def test_a_worker_holds_one_operators_tables():
    dropped = []
    common.held("one", lambda: dropped.append("one"))
    common.held("one", lambda: dropped.append("one"))
    assert not dropped
    common.held("two")
    assert dropped == ["one"]


def test_rare_tokens_are_a_parameter(spark):
    counts = spark.createDataFrame([(b"bad", 2, 0), (b"worse", 9, 0), (b"fine", 0, 900), (b"rest", 500, 5000)], "token binary, toxic long, clean long")
    found = lambda **k: {bytes(r.token) for r in toxicity.log_odds(counts, significance=0.5, **k)[0].collect()}
    assert b"bad" not in found() and b"bad" in found(least_docs=1)


def test_equal_cosines_go_by_the_rows_order():
    """Ties at the k-th place: the vote takes k neighbours, equal ones by their order, so equal inputs give equal scores."""
    shares = np.tile(np.eye(1, quality.TERMS, 3, dtype=np.float32), (9, 1))
    space = quality.Space(shares, np.array([1, 0, 1, 0, 1, 0, 1, 0, 1]), 4)
    assert len(set(space.vote(np.repeat(shares[:1], 50, 0), 3, 8.0).round(12))) == 1
