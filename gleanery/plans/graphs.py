"""Graphs: edges, walks, reach and name resolution over tables that stand for code."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import graph
from gleanery.plans.registry import query, table

#: Parts call parts: a sparse graph with cycles, hubs, tests and classes.
NODES = "nodes AS (SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'constant' ELSE 'function' END AS kind, p_partkey % 10 = 0 AS is_test, CASE WHEN p_partkey % 6 = 1 THEN p_partkey - 1 END AS parent FROM part)"
CALLS = "calls AS (SELECT DISTINCT p_partkey AS src, (p_partkey * k + 1) % (SELECT count(*) FROM part) AS dst FROM part, (SELECT unnest([2, 3, 5]) AS k) WHERE p_partkey % k = 0)"


def nodes(spark, d):
    k = F.col("p_size") % 5
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, "class").when(k == 1, "constant").otherwise("function").alias("kind"), (F.col("p_partkey") % 10 == 0).alias("is_test"), F.when(F.col("p_partkey") % 6 == 1, F.col("p_partkey") - 1).alias("parent"))


def calls(spark, d):
    p = table(spark, d, "part")
    n = p.agg(F.count("*").alias("n"))
    k = F.explode(F.array(*[F.lit(x) for x in (2, 3, 5)])).alias("k")
    return p.select(F.col("p_partkey").alias("src"), k).where("src % k = 0").crossJoin(F.broadcast(n)).select("src", ((F.col("src") * F.col("k") + 1) % F.col("n")).alias("dst")).distinct()  # n is one row


TYPED = f"""{NODES}, {CALLS},
full_ AS (SELECT c.*, count(*) OVER (PARTITION BY c.src) AS n, s.is_test AS st, t.is_test AS dt, t.kind AS dk FROM calls c JOIN nodes s ON c.src = s.id JOIN nodes t ON c.dst = t.id),
cnt AS (SELECT src, count(*) AS n FROM calls GROUP BY src),
fwd AS (SELECT f.src, f.dst, CASE WHEN dk = 'class' AND st AND cnt.n = 1 THEN 'tests' WHEN dk = 'class' THEN 'instantiates' WHEN st THEN 'tests' ELSE 'calls' END AS edge_type FROM full_ f JOIN cnt ON f.src = cnt.src),
back AS (SELECT src, dst, count(*) OVER (PARTITION BY dst) AS fans FROM full_ WHERE NOT st AND NOT dt),
refs AS (SELECT DISTINCT id AS src, (id * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM nodes WHERE id % 4 = 1),
deco AS (SELECT DISTINCT id AS src, (id * 11 + 5) % (SELECT count(*) FROM part) AS dst FROM nodes WHERE id % 9 = 0),
typed AS (SELECT * FROM fwd UNION ALL SELECT dst, src, 'called_by' FROM back WHERE fans <= 8 UNION ALL SELECT parent, id, 'contains' FROM nodes WHERE parent IS NOT NULL
    UNION ALL SELECT src, dst, 'references' FROM refs UNION ALL SELECT src, dst, 'decorated_by' FROM deco
    UNION ALL SELECT dst, src, 'referenced_by' FROM refs JOIN nodes s ON src = s.id JOIN nodes t ON dst = t.id WHERE NOT s.is_test AND NOT t.is_test)"""


def typed(spark, d):
    n = nodes(spark, d)
    count = F.broadcast(n.agg(F.count("*").alias("n")))  # one row
    to = lambda test, by, plus: n.where(test).crossJoin(count).select(F.col("id").alias("src"), ((F.col("id") * by + plus) % F.col("n")).alias("dst"))
    return graph.typed_edges(n, calls(spark, d), to("id % 4 = 1", 7, 3), to("id % 9 = 0", 11, 5))


@query("typed_edges", f"WITH {TYPED} SELECT src, dst, edge_type, CASE edge_type WHEN 'tests' THEN 1.0 WHEN 'calls' THEN 0.8 WHEN 'references' THEN 0.8 WHEN 'called_by' THEN 0.5 WHEN 'decorated_by' THEN 0.5 WHEN 'contains' THEN 0.8 ELSE 0.3 END::DOUBLE AS weight FROM typed")
def typed_edges(spark, d):
    return typed(spark, d)


@query("graph_walk")
def graph_walk(spark, d):
    """A walk from every twentieth part, each a query of its own, which leaves 300 nodes at most; held against a priority queue over the whole graph in the tests."""
    seeds = nodes(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "id", F.lit(1.0).alias("score"))
    reached = graph.walk_by_query(typed(spark, d), seeds)
    return graph.walk_hits(reached, nodes(spark, d), seeds).select("query_id", "id", F.round("score", 6).alias("score"), "hop", "rank")


@query("reach_depth", f"WITH RECURSIVE {CALLS}, r AS (SELECT src AS start, dst AS node, 1 AS k FROM calls UNION ALL SELECT start, dst, k + 1 FROM r JOIN calls ON node = src WHERE k < 4) SELECT DISTINCT start, node FROM r")
def reach_depth(spark, d):
    c = calls(spark, d)
    return graph.reach(c, c.select(F.col("src").alias("id")), 4)


@query("neighbourhood", f"WITH {CALLS} SELECT node FROM (SELECT dst AS node FROM calls WHERE src % 20 = 0 UNION SELECT src FROM calls WHERE dst % 20 = 0) WHERE node % 20 <> 0")
def neighbourhood(spark, d):
    c = calls(spark, d)
    every = c.select(F.col("src").alias("id")).union(c.select("dst")).where("id % 20 = 0")
    return graph.neighbourhood(c, every)


@query("first_neighbours", f"WITH {CALLS}, o AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS ordinal FROM calls) SELECT * FROM o WHERE ordinal <= 5")
def first_neighbours(spark, d):
    return graph.first_neighbours(calls(spark, d), "dst", "src", "src", 5)


@query("unique_names", "WITH n AS (SELECT p_name, count(*) AS c, min(p_partkey) AS id FROM part GROUP BY p_name), w AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || '?' ELSE p_name END AS wanted FROM part) SELECT p_partkey, wanted, CASE WHEN c = 1 THEN id END AS resolved_id, CASE WHEN c IS NULL THEN 'no match' WHEN c > 1 THEN 'multiple matches' END AS reason FROM w LEFT JOIN n ON wanted = p_name")
def unique_names(spark, d):
    p = table(spark, d, "part")
    wanted = p.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("wanted"))
    return graph.resolve_names(wanted, p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")), "wanted")


REFS = "refs AS (SELECT l_suppkey AS src, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_partkey END AS dst, 'call' AS edge_type, l_linenumber AS line FROM lineitem), n AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 7 <> 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0), j AS (SELECT refs.*, CASE WHEN dst IS NULL THEN 'no match' WHEN src NOT IN (SELECT id FROM n) THEN 'caller not found' WHEN dst NOT IN (SELECT id FROM n) THEN 'external' END AS reason FROM refs)"


def built(spark, d):
    dst = F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey"))
    refs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), dst.alias("dst"), F.lit("call").alias("edge_type"), F.col("l_linenumber").alias("line"))
    s = table(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("id"))
    return graph.build_edges(refs, s.union(table(spark, d, "part").where("p_partkey % 3 <> 0").select("p_partkey")))


@query("build_edges", f"WITH {REFS} SELECT src, dst, edge_type, max(line) AS line FROM j WHERE reason IS NULL GROUP BY ALL")
def build_edges(spark, d):
    return built(spark, d)[0]


@query("unresolved_edges", f"WITH {REFS} SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason")
def unresolved_edges(spark, d):
    return built(spark, d)[1].groupBy("reason").agg(F.count("*").alias("n"))


@query("tests_to_sources", f"WITH {NODES}, {CALLS} SELECT DISTINCT src AS test_id, dst AS source_id FROM calls JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.is_test AND NOT b.is_test")
def tests_to_sources(spark, d):
    return graph.tests_to_sources(calls(spark, d), nodes(spark, d))


@query("parent_children", f"WITH {NODES} SELECT parent AS id, string_agg(id::VARCHAR, ',' ORDER BY id) AS children FROM nodes WHERE parent IS NOT NULL GROUP BY parent")
def parent_children(spark, d):
    from gleanery.operators.resolve import children

    return children(nodes(spark, d)).select("id", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))
