"""What queries send and store follows the input, not the square of a group or the depth of a chain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.operators import graph, names, resolve
from gleanery.plans import registry
from gleanery.sources import pyindex
from gleanery.storage import cut


def test_inherited_stores_no_closure(spark, monkeypatch):
    """Thirty classes in a chain that all have `run`: one row for each class and name is stored, not one for each class and base above."""
    bases = spark.createDataFrame([(f"c{k:02}", f"c{k + 1:02}", 0) for k in range(30)], "cls string, base string, ordinal int")
    members = spark.createDataFrame([(f"c{k:02}", "run", f"c{k:02}.run") for k in range(31)] + [("c03", "top", "c03.top")], "cls string, name string, member string")
    stored = []

    def counted(df, what, *more, **options):
        out = cut(df, what, *more, **options)
        stored.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    got = {(r.cls, r.name): r.member for r in graph.inherited(bases, members).collect()}
    assert got == {(f"c{k:02}", "run"): f"c{k:02}.run" for k in range(31)} | {(f"c{k:02}", "top"): "c03.top" for k in range(4)}
    assert sum(stored) < 150


def test_inherited_above_cycles(spark, monkeypatch):
    """Classes above a cycle go another way, with the same answer: the first way that is none round a cycle; classes beside it are not touched."""
    monkeypatch.setattr(graph, "ROUNDS", 3)
    bases = [("a", "b", 0), ("a", "c", 1), ("b", "a", 0), ("z", "a", 0), ("a", "a", 2)] + [(f"d{k}", f"d{k + 1}", 0) for k in range(6)]
    members = [("c", "m", "c.m"), ("b", "own", "b.own"), ("d6", "m", "d6.m")]
    got = graph.inherited(spark.createDataFrame(bases, "cls string, base string, ordinal int"), spark.createDataFrame(members, "cls string, name string, member string"))
    want = {(x, "m"): "c.m" for x in "abcz"} | {(x, "own"): "b.own" for x in "abz"} | {(f"d{k}", "m"): "d6.m" for k in range(7)}
    assert {(r.cls, r.name): r.member for r in got.collect()} == want


def test_calls_are_dealt_by_form(spark):
    """A call meets only the tables that its form of receiver is looked up in."""
    p = pyindex.parse(spark.createDataFrame([("a.py", "def f(x):\n    x.go()\n    f(x)\n", "source")], "path string, text string, kind string"))
    s = pyindex.symbols(p)
    none = lambda ddl: spark.createDataFrame([], ddl)
    found = resolve.resolve_calls(pyindex.calls(p), s, none("file string, alias string, target string, resolved_file string"), none("cls string, base string, ordinal int"), none("owner string, attr string, cls string"), [], none("caller string, name string"))
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.receiver, r.name, r.callee) for r in found.collect()} == {("x", "go", None), (None, "f", "a.py::f")}


@pytest.mark.parametrize("name", ["linked_imports", "linked_bases", "inherited_members"])
def test_no_calls_for_names(spark, small, monkeypatch, name):
    """Imports, bases and members are found without resolving calls."""
    monkeypatch.setattr(resolve, "resolve_calls", None)
    assert registry.QUERIES[name](spark, small).head(1)


def test_symbols_settled_in_parsing(spark):
    """Of a name that a file, or two files of one path, define twice, the last definition holds; selecting symbols deals nothing."""
    rows = [("a.py", "def f():\n    pass\n\n\ndef f(x):\n    return x\n", "source"), ("b.py", "Z = 1\n", "source"), ("b.py", "\n\nZ = 1\n", "source")]
    parsed = cut(pyindex.parse(spark.createDataFrame(rows, "path string, text string, kind string").repartition(3)), "facts")
    s = pyindex.symbols(parsed)
    assert "Exchange" not in s._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.line_start) for r in s.where("kind <> 'module'").collect()) == [("a.py::f", 5), ("b.py::Z", 3)]
    assert s.where("kind = 'module'").count() == 2


def test_equal_patterns_are_ranked_once(spark, tmp_path):
    """Many patterns of one text and hint: each gets every hit with its rank, and names are compared once for all of them."""
    symbols = spark.createDataFrame([(k, f"red{k}", None, "f", k) for k in range(40)], "id long, name string, qualified_name string, file string, line_start int")
    names.build_names(symbols, str(tmp_path))
    asked = spark.range(50).select(F.col("id").alias("pattern_id"), F.lit("red").alias("pattern"), F.lit(None).cast("string").alias("hint_file"))
    found = names.find_all(spark, str(tmp_path), asked)
    rows = found.collect()
    assert len(rows) == 2000 and {(r.pattern_id, r.id, r.rank) for r in rows} == {(p, k, k + 1) for p in range(50) for k in range(40)}
    assert set(found.columns) == {"pattern_id", "id", "name", "qualified_name", "file", "line_start", "match", "rank"}
    last = found._jdf.queryExecution().optimizedPlan().toString()
    assert last.index("Join") < last.index("Window")  # ids of patterns come to hits that are ranked


def test_hits_of_one_pattern_are_spread(spark, tmp_path):
    """One pattern that many ask for and many symbols of two names have: its hits are ranked and paired by several tasks, and only the two names are indexed."""
    symbols = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, "red").otherwise("reds").alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.lit("f").alias("file"), F.lit(1).alias("line_start"))
    names.build_names(symbols, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 27  # 12 of red and 15 of reds, each behind itself
    asked = spark.range(1300).select(F.col("id").alias("pattern_id"), F.lit("red").alias("pattern"), F.lit(None).cast("string").alias("hint_file"))
    found = names.find_all(spark, str(tmp_path), asked)
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 6000 * 1300 and max(r["count"] for r in tasks) < 6000 * 1300 * 0.8
    ranks = found.groupBy("id").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("pattern_id").alias("n"), F.count("*").alias("rows"))
    want = {k: k // 2 + 1 + 3000 * (k % 2) for k in range(6000)}
    assert {(r.id, r.low, r.high, r.n, r["rows"]) for r in ranks.collect()} == {(k, x, x, 1300, 1300) for k, x in want.items()}


def joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["test_only", "code_context", "linked_imports"])
def test_sources_are_not_broadcast(spark, small, name):
    """Made sources are many times the table that they are made from, so its size is no reason to send them whole to each executor."""
    plan = joins(registry.QUERIES[name](spark, small))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_texts_of_chunks_are_not_broadcast(spark, small):
    from gleanery.operators import bm25
    from gleanery.plans import code

    assert "BroadcastHashJoin" not in joins(bm25.code_chunks(pyindex.symbols(code.parsed(spark, small)), code.files(spark, small), with_token=False))


def test_index_checks_parse_once(spark, small, monkeypatch):
    seen = []
    parse = pyindex.parse
    monkeypatch.setattr(pyindex, "parse", lambda files: seen.append(1) or parse(files))
    assert registry.QUERIES["index_checks"](spark, small).head(1) and len(seen) == 1


def test_sanitizing_is_spread(spark):
    """A table of sources that is read as one part is cleaned by as many tasks as there are shuffle partitions; what is cut is as before."""
    text = 'if x:\n    def f():\n        "doc"\n        return lambda: 1  # this Should fail\n\n\nclass A:\n    """a\n    b"""\n\n    try:\n        pass\n    finally:\n        def g(): "only"\n'
    files = spark.createDataFrame([(f"{k}.py", text) for k in range(40)], "path string, text string").coalesce(1)
    out = pyindex.sanitized(files)
    assert {(r.docstrings_removed, r.comments_removed) for r in out.collect()} == {(3, 1)} and out.select("path").count() == 40
    used = out.select("path", "docstrings_removed", F.spark_partition_id().alias("task")).select("task").distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_spans_beyond_all_points_are_not_dealt(spark):
    """Only the spans that lie where points are come to the join; points at the ends of spans, and none at all, have their answers."""
    from gleanery.operators.interval import enclosing

    spans = spark.createDataFrame([("k", 10 * n, 10 * n + 4, n) for n in range(1, 200)], "k string, s long, e long, id long")
    points = spark.createDataFrame([(1, "k", 24), (2, "k", 25), (3, "k", 30), (4, "x", 30)], "p long, k string, at long")
    found = enclosing(points, spans, "k", "at", "s", "e", "id", ["p"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 24" in plan and "<= 30" in plan
    assert {(r.p, r.id) for r in found.collect()} == {(1, 2), (2, None), (3, 3), (4, None)}
    assert enclosing(points.limit(0), spans, "k", "at", "s", "e", "id", ["p"]).count() == 0


def test_mirrors_are_compared_in_one_pass(spark):
    """No join: distinct edges and both ways come out of one grouping. An edge without an end mirrors none."""
    from gleanery.operators.validate import asymmetric

    edges = lambda *rows: spark.createDataFrame(list(rows), "src long, dst long")
    found = asymmetric(edges((1, 2), (1, 2), (3, 4), (5, None)), edges((2, 1), (7, 6), (None, 5)))
    assert "Join" not in joins(found)
    assert sorted((r.kind, r.detail) for r in found.collect()) == [("mirror only", "5"), ("mirror only", "6->7"), ("no mirror", "3->4"), ("no mirror", "5")]


@pytest.mark.parametrize("name", ["code_heuristics", "identical_branches", "code_symbols", "review_targets"])
def test_symbols_alone_are_not_stored(spark, small, name):
    """Queries that read symbols once look for nothing else and store no facts between."""
    plan = joins(registry.QUERIES[name](spark, small))
    assert plan.count("MapInArrow") == 1 and "facts-" not in plan


def test_symbols_alone_are_the_same():
    text = "import a\nZ = 1\n\n\nclass B(a.C):\n    def f(self, x: int):\n        if x:\n            return g(x)\n        return 1\n\n\ndef f(x):\n    return x\n"
    every = list(pyindex.facts("m.py", text, False))
    assert [v for k, v in every if k == "symbol"] == [v for _, v in pyindex.facts("m.py", text, False, symbols_alone=True)] and len(every) > 5
