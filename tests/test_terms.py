"""Tokens counted where texts are read: the same as by the expressions, for odd words too; what follows deals documents, not words or pairs of queries and documents."""

from __future__ import annotations

import re

import pytest

from gleanery.functions import terms
from gleanery.functions import text as X
from gleanery.operators import bm25, relational

ODD = [
    "getHTTPResponse2xx of _x __init__ a_b A aB Ab AB ABc ABcD 9a a9 99 _ __", "the TheEnd ThE running Flies agreed hopping's skies y yY Yay", None, "", "naïve İstanbul Kelvin ﬁne", "HTTPServer_v2Beta XMLHttpRequest snake_case_name camelCaseName lots2Of3Digits4", "def return self x x x",
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


@pytest.mark.parametrize("stemmer", ["none", "light", "porter2"])
def test_counts_are_those_of_tokens(spark, stemmer):
    docs = odd(spark)
    stop = X.STOPWORDS if stemmer != "porter2" else X.english_stopwords()
    counts = terms.counted(docs, "text", stemmer, stop)
    want = {(r.id, r.term): r.tf for r in bm25.term_counts_of(bm25.term_rows(docs, "id", "text", stemmer, stop), "id").collect()}
    got = {(r.id, r.term): r.tf for r in terms.exploded(counts, "id").collect()}
    assert got == want and len(want) > 30
    lengths = {r.id: r.length for r in counts.collect()}
    assert lengths == {k: sum(n for (i, _), n in want.items() if i == k) for k in range(len(ODD))}


def test_a_batch_of_long_texts_goes_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(terms, "CHARS", 10)
    assert [(r.id, r.length, r.terms[0].tf) for r in terms.counted(odd(spark, ["aa " * n for n in range(1, 9)]).coalesce(1), "text").collect()] == [(k, k + 1, k + 1) for k in range(8)]


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "aa cc cc"), (2, "aa")], "id long, text string")
    weights = spark.createDataFrame([("q", "aa", 1), ("q", "cc", 1)], "query_id string, term string, weight long")
    got = bm25.search(docs, weights, "id", "text").collect()
    assert [(r.id, r["rank"], [(b.term, b.tf) for b in r.breakdown]) for r in got] == [(1, 1, [("aa", 2), ("cc", 2)]), (2, 2, [("aa", 1)])]


def test_documents_are_scored_where_they_lie(spark):
    """Between the scan and the k best of each task documents are dealt by id alone: no exchange has a row for each query and document."""
    weights = spark.createDataFrame([(q, t, 1) for q in range(5) for t in ("aa", "bb")], "query_id long, term string, weight long")
    docs = odd(spark, ["aa bb", "bb", "aa aa cc"])
    found = bm25.search(docs, weights, "id", "text")
    plan = found.drop("breakdown")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and not [x for x in dealt if "query_id" in x and "," in x]
    assert "collect_list" not in plan  # breakdowns are made only where they are asked for
    assert found.count() == 15


def test_held_words_are_looked_up_in_the_scan(spark):
    """A text goes on once for each held word, not for each of its words."""
    docs = odd(spark, ["one two three four five", "two three", "six"])
    items = spark.createDataFrame([(1, "two three four"), (2, "zz"), (3, "six")], "item_id long, item string")
    found = relational.holders(docs, items.where("item_id = 1"), "text", "item")
    assert "array_intersect" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.item_id) for r in found.collect()] == [(0, 1)]
    assert sorted((r.id, r.item_id) for r in relational.holders(docs, items, "text", "item").collect()) == [(0, 1), (2, 3)]


def test_segments_count_where_texts_are_read(spark, tmp_path, monkeypatch):
    """A segment's counts are made without dealing a row for each token."""
    from gleanery.operators import segments

    monkeypatch.setattr(bm25, "term_rows", None)
    name = segments._new_segment(odd(spark, ["aa bb aa", None, "the of"]), str(tmp_path), segments.Texts())
    rows = spark.read.parquet(f"{tmp_path}/{name[1]}/forward").collect()
    assert name[2:] == (1, 3) and [(r.id, sorted((t.term, t.tf) for t in r.terms)) for r in rows] == [(0, [("aa", 2), ("bb", 1)])]
