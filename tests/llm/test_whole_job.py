"""Cases where an operator once did less than its whole job."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb
import pytest
from test_llm_operators import brute_components

from gleanery.llm import jaccard, lines, mixing, queries
from gleanery.llm.common import cut


def test_blocks_of_wide_lines_go(spark):
    """Headers, footers and inner blocks of many sites go whole, a copied document too; a line on too few sites stays."""
    head, inner, foot = ["Site menu", "Search here"], ["Share this", "Print this", "Mail this", "Rate this"], ["Terms of use", "All rights reserved"]
    own = [[f"own {k} {i}" for i in range(6)] for k in range(9)]
    rows = [(k, "\n".join([*head, *own[k][:3], *inner, *own[k][3:], *foot]), f"s{k}") for k in range(9)]
    rows += [(20 + k, "copied one\ncopied two", f"s{k}") for k in range(8)] + [(40 + k, "rare one\nrare two", f"s{k}") for k in range(7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {k: ("\n".join(own[k]), 8) for k in range(9)} | {20 + k: ("", 2) for k in range(8)} | {40 + k: ("rare one\nrare two", 0) for k in range(7)}
    for most_sent in (lines.MOST_SENT, 0):
        assert {r.doc_id: (r.text, r.n_removed) for r in lines.drop_wide_lines(d, most_sent=most_sent).collect()} == want


@pytest.mark.parametrize("name", ["op7_line_dedup"])
def test_line_queries_match_their_sql(spark, name):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    cols = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(tuple(r[c] for c in cols) for r in queries.QUERIES[name](spark, d).collect()) == sorted(want)


@pytest.mark.parametrize("num", [85, 80])
def test_null_ids_link(spark, num):
    """Null-id texts of their own are near copies: of a document, between two documents that only they link, and of each other."""
    rng = random.Random(3)
    vary = lambda ws, at: [f"new{k}" if k in at else w for k, w in enumerate(ws)]
    a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(3))
    texts = [(1, a), (None, vary(a, {60})), (5, b), (None, vary(b, {20, 21})), (9, vary(b, {20, 21, 90, 91})), (None, c), (None, vary(c, {50})), (None, c), (12, [f"u{k}" for k in range(50)])]
    rows = [(i, " ".join(ws)) for i, ws in texts]
    rows += [(30, " ".join(b)), (31, " ".join(vary(a, {2, 118})))]
    want = brute_components(rows, 4, num, 100)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert (None, 117, 1) in want and (9, 117, 5) in want
    assert sorted((tuple(r) for r in jaccard.jaccard_components(d, num=num).collect()), key=str) == want


def test_null_ids_alone_link_two(spark):
    """The chain 1 - null - 2: the ends do not link, the null-id text between them links with both."""
    ws = [f"v{k}" for k in range(100)]
    ends, mid = [" ".join(ws[:96]), " ".join(ws[12:])], " ".join(ws[5:])
    rows = [(1, ends[0]), (2, ends[1]), (None, mid)]
    want = brute_components(rows, 4, 85, 100)
    assert {x[2] for x in want} == {1} and {x[2] for x in brute_components(rows[:2], 4, 85, 100)} == {1, 2}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.jaccard_components(d).collect()), key=str) == want


def test_pipeline_judges_rows_by_text(spark):
    """Rows with null or repeated ids: one row of each component stays, none is lost to its id, and each is mixed by its own copies."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    dup, only = text(90), [text(60 + k) for k in range(5)]
    rows = [(1, dup), (2, dup), (2, only[0]), (None, only[1]), (None, only[2]), (None, dup + " end"), (None, only[3]), (7, only[4]), (7, only[4])]
    d = spark.createDataFrame([(i, t, "en", "ab"[k % 2], len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = cut(corpus_pipeline.near_duplicates(spark, d, ""), "kept-rows")
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, dup), (2, only[0]), *((None, only[k]) for k in (1, 2, 3)), (7, only[4])], key=str)
    mixed = corpus_pipeline.source_mix(spark, kept, "").groupBy("text").count().collect()
    sizes = {r["size"]: r.copies for r in mixing.mix(kept).collect()}
    assert {len(r.text.split()): r["count"] for r in mixed} == {n: c for n, c in sizes.items() if c}


def test_lines_round_the_threshold(spark):
    """Estimates of a thousand sites are not exact; the lines whose estimates are near the threshold are counted."""
    sites = {f"line {n}": n for n in (700, 985, 998, 999, 1000, 1001, 1010, 1400)}
    rows = [(k, "\n".join(x for x, n in sites.items() if k < n), f"s{k}") for k in range(1400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for most_sent in (lines.MOST_SENT, 0):
        left = {x for r in lines.drop_wide_lines(d, min_sites=1000, most_sent=most_sent).collect() for x in r.text.split("\n") if x}
        assert left == {x for x, n in sites.items() if n < 1000}
