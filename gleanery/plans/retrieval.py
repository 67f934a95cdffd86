"""Retrieval from stored indexes, over documents and over code, and what a prompt is made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.operators import bm25, graph, group, metrics, pack, resolve, retrieve, segments
from gleanery.plans import code
from gleanery.plans.ranking import MULTI, SCORED, TOKENS, benchmark_weights, docs
from gleanery.plans.registry import query, table
from gleanery.sources import pyindex
from gleanery.storage import cut, new_path


@query("stored_search", f"WITH {TOKENS}, {MULTI}, {SCORED} SELECT query_id, doc_id, score, rank FROM hits WHERE rank <= 10")
def stored_search(spark, d):
    """The queries of bm25_multi_query over an index that is built and stored first."""
    path = new_path(spark, "index")
    bm25.build_index(docs(spark, d), "doc_id", "text", path, "none", X.STOPWORDS)
    return bm25.search_index(spark, path, benchmark_weights(spark, d), "doc_id").drop("breakdown")


PLAIN = segments.Texts("none", tuple(X.STOPWORDS))


@query("pruned_search", f"WITH {TOKENS}, {MULTI}, {SCORED} SELECT query_id, doc_id, score, rank FROM hits WHERE rank <= 10")
def pruned_search(spark, d):
    """stored_search from a segmented index, of whose blocks only those are read that can hold one of the ten best."""
    path = new_path(spark, "segmented")
    segments.update(docs(spark, d), path, "doc_id", "text", PLAIN)
    return segments.search(spark, path, benchmark_weights(spark, d), "doc_id", heavy=200).drop("breakdown")


@query("updated_search", f"WITH {TOKENS}, {MULTI}, {SCORED} SELECT query_id, doc_id, score, rank FROM hits WHERE rank <= 10")
def updated_search(spark, d):
    """stored_search after an update: the index was made of other versions of the documents, without some and with one that is gone since."""
    now = docs(spark, d)
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" more of the same"))).otherwise(F.col("text"))
    gone = now.limit(1).select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    path = new_path(spark, "updated")
    segments.update(now.where("doc_id % 7 <> 3").withColumn("text", text).unionByName(gone), path, "doc_id", "text", PLAIN)
    segments.update(now, path, "doc_id", "text", PLAIN)
    return segments.search(spark, path, benchmark_weights(spark, d), "doc_id", heavy=200).drop("breakdown")


STALE = """now AS (SELECT doc_id, sha1(coalesce(text, '')) AS h FROM documents),
was AS (SELECT doc_id, sha1(coalesce(text, '') || CASE WHEN doc_id % 11 = 0 AND text IS NOT NULL THEN ' more of the same' ELSE '' END) AS h FROM documents WHERE doc_id % 7 <> 3
    UNION ALL SELECT -1 - doc_id, sha1('gone') FROM documents WHERE doc_id % 5 = 0)"""


@query("stale_documents", f"WITH {STALE} SELECT coalesce(now.doc_id, was.doc_id) AS id, CASE WHEN was.h IS NULL THEN 'new' WHEN now.h IS NULL THEN 'deleted' ELSE 'changed' END AS state FROM now FULL JOIN was ON now.doc_id = was.doc_id WHERE now.h IS DISTINCT FROM was.h")
def stale_documents(spark, d):
    """What an index of earlier versions lacks, by digests."""
    now = docs(spark, d)
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" more of the same"))).otherwise(F.col("text"))
    gone = now.where("doc_id % 5 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("gone").alias("text"))
    path = new_path(spark, "stale")
    segments.update(now.where("doc_id % 7 <> 3").withColumn("text", text).unionByName(gone), path, "doc_id", "text", PLAIN)
    return segments.stale(now, path, "doc_id", "text")


@query("porter_search")
def porter_search(spark, d):
    """The benchmark's items as queries, stemmed by Porter's second algorithm, without English stopwords; held against plain Python in the tests."""
    path = new_path(spark, "porter-index")
    bm25.build_index(docs(spark, d), "doc_id", "text", path)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    rows = bm25.term_rows(items, "query_id", "text")
    weights = rows.groupBy("query_id", "term").agg(F.least(F.count("*"), F.lit(bm25.CAP)).cast("long").alias("weight"))
    return bm25.search_index(spark, path, weights, "doc_id").drop("breakdown")


def indexed_code(spark, d):
    """Symbols, typed edges, chunks and the stored index of the made sources."""
    parsed = code.parsed(spark, d)
    found, symbols, names = code.resolved(parsed, code.files(spark, d))
    calls = cut(found.where("callee is not null").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct(), "calls")
    refs = pyindex.constant_references(parsed, symbols, names)
    nodes = symbols.select("id", "kind", F.coalesce("is_test", F.lit(False)).alias("is_test"), "parent")
    edges = cut(graph.typed_edges(nodes, calls, refs, calls.limit(0)), "typed")
    chunks = cut(bm25.code_chunks(symbols, code.files(spark, d), with_token=False), "chunks")
    path = new_path(spark, "code-index")
    segments.update(chunks, path, "id", "text")
    return symbols, nodes, edges, chunks, path


@query("code_chunks", f"SELECT {code.ID} AS id, kind FROM part, {code.NAMES} WHERE n <> 'same'")
def code_chunks(spark, d):
    """All symbols but `same`: each of its words is a stopword or a single character."""
    return bm25.code_chunks(pyindex.symbols(code.parsed(spark, d)), code.files(spark, d)).select("id", "kind")


def code_reports(spark, d):
    """A report for every twentieth part, the queries of this search: its module's make fails."""
    k = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("tests/test_m"), k, F.lit(".py::test_weigh_box"), k)
    file = F.concat(F.lit("src/m"), k, F.lit(".py"))
    return table(spark, d, "part").where("p_partkey % 20 = 0").select(F.concat(F.lit("b"), k).alias("bug_id"), name.alias("test_name"), F.concat(F.lit("E   TypeError: box"), k, F.lit(" can't weigh")).alias("error_message"), F.concat(F.lit("make(Box"), k, F.lit(")")).alias("body"), F.array(F.lit("make"), F.lit("weigh")).alias("frames"), file.alias("file"), F.lit(11).alias("line"))


@query("retrieve_context")
def retrieve_context(spark, d):
    """Every report: terms and seeds, stored index and walk, fused, tiered and filled; held in the tests against the symbols that the report is about."""
    symbols, nodes, edges, chunks, path = indexed_code(spark, d)
    reports = code_reports(spark, d)
    seeds = resolve.evidence_seeds(reports.select(F.col("bug_id").alias("group_id"), F.lit(1).alias("frame_no"), "file", "line"), spark.createDataFrame([], "group_id string, id string"), symbols)
    return retrieve.retrieve(retrieve.report_weights(reports), path, edges, nodes, seeds.withColumnRenamed("group_id", "query_id"), chunks.select("id", "text"))


@query("evidence_seeds", f"WITH {code.FRAMES}, {code.SPAN} SELECT DISTINCT bug AS group_id, id, 1.0::DOUBLE AS score FROM (SELECT bug, (SELECT arg_min(id, (e - s) * 1000) FROM sp WHERE sp.m = f.m AND line BETWEEN s AND e) AS id FROM f UNION ALL SELECT event_id, 'tests/t' || user_id || '.py::test_x' FROM events WHERE event_type = 'error') WHERE id IS NOT NULL")
def evidence_seeds(spark, d):
    f = code.frames(spark, d).withColumnRenamed("bug_id", "group_id").withColumn("frame_no", F.lit(1))
    failing = table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("group_id"), F.concat(F.lit("tests/t"), "user_id", F.lit(".py::test_x")).alias("id"))
    return resolve.evidence_seeds(f, failing, pyindex.symbols(code.parsed(spark, d)))


@query("flaky_split", "SELECT event_id, coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 3 = 0 END, false) AS excluded FROM events")
def flaky_split(spark, d):
    marked = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 3 == 0).alias("flaky"))
    out, rest = group.split_flaky(marked)
    return out.select("event_id", F.lit(True).alias("excluded")).unionByName(rest.select("event_id", F.lit(False).alias("excluded")))


@query("artefact_rollup", "SELECT 'r_' || user_id || '_' || (event_id % 3) AS run_id, count(*) FILTER (event_type = 'error') AS reports, count(*) FILTER (event_type = 'view') AS patches FROM events GROUP BY ALL")
def artefact_rollup(spark, d):
    name = F.when(F.col("event_type") == "error", "bug_report.json").when(F.col("event_type") == "view", "fix.patch").otherwise("log.txt")
    paths = table(spark, d, "events").select(F.concat(F.lit("out/r_"), "user_id", F.lit("_"), (F.col("event_id") % 3).cast("string"), F.lit("/x/"), name).alias("path"))
    return metrics.artefacts(paths)


@query("test_name_terms", "SELECT event_id, event_type || ',test_' || event_type || ',' || CASE WHEN user_id >= 10 THEN user_id || ',' ELSE '' END || 'u' || user_id AS terms FROM events")
def test_name_terms(spark, d):
    """Names like tests/a.py::TestX::test_<type> u<user>: pieces of two characters or more but for test, then the whole words."""
    terms = X.test_name_terms(F.concat(F.lit("tests/a.py::TestX::test_"), "event_type", F.lit(" u"), "user_id"))
    return table(spark, d, "events").select("event_id", F.array_join(terms, ",").alias("terms"))


REPORTS = "r AS (SELECT user_id AS g, event_id AS b, 'tests/t' || (event_id % 5) || '.py::test_x' AS t, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 's' || (event_id % 6) END AS c FROM events)"


@query(
    "prompt_sections",
    f"""WITH {REPORTS}, i AS (SELECT g AS group_id, 'evidence' AS section, 0 AS f, b::VARCHAR AS item_id, t || chr(10) || 'E: m' || b AS text FROM r
    UNION ALL SELECT DISTINCT g, 'tests', 0, t, 'def test_x(): ' || t FROM r WHERE t NOT LIKE 'tests/t4%'
    UNION ALL SELECT g, 'source', min(f), id, 'body of ' || id FROM (SELECT g, c AS id, 1 AS f FROM r WHERE c IS NOT NULL UNION ALL SELECT DISTINCT g, 's' || (g % 6), 0 FROM r) GROUP BY g, id)
    SELECT group_id, section, row_number() OVER (PARTITION BY group_id, section ORDER BY f, item_id) AS ordinal, item_id, ceil(length(text) / 3.5::DOUBLE * 1.15::DOUBLE)::BIGINT AS tokens FROM i""",
)
def prompt_sections(spark, d):
    e = table(spark, d, "events")
    test = F.concat(F.lit("tests/t"), F.col("event_id") % 5, F.lit(".py::test_x"))
    called = F.array(F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("s"), F.col("event_id") % 6)))
    reports = e.select(F.col("user_id").alias("group_id"), F.col("event_id").cast("string").alias("bug_id"), test.alias("test_name"), F.lit("E").alias("error_type"), F.concat(F.lit("m"), "event_id").alias("error_message"), called.alias("called"))
    tests = spark.range(4).select(F.concat(F.lit("tests/t"), "id", F.lit(".py::test_x")).alias("test_name")).withColumn("text", F.concat(F.lit("def test_x(): "), "test_name"))
    source = spark.range(6).select(F.concat(F.lit("s"), "id").alias("id")).withColumn("text", F.concat(F.lit("body of "), "id"))
    suspects = e.select(F.col("user_id").alias("group_id"), F.concat(F.lit("s"), F.col("user_id") % 6).alias("id")).distinct()
    return pack.required_sections(reports, tests, source, suspects).drop("text")
