"""Scans, spans and splits on one single key: what is carried over the edges of stretches, and that no window or task has the whole key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import group, interval
from gleanery.operators.chain import reached
from gleanery.operators.scan import deal, scan


@pytest.fixture(params=["1", "16"])
def stretches(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_states_are_carried(spark, stretches):
    rng = random.Random(1)
    data = [(rng.choice(("a", "b", None)), i, rng.choice((None, 1, 2, 5, -3))) for i in range(300)]
    rows = deal(spark.createDataFrame(data, "k string, i int, v int"), ["k"], ["i"])
    v = F.col("v")
    states = {"s": ("sum", v), "hi": ("max", v), "lo": ("min", v), "l": ("last", v)}
    got = {(r.k, r.i): (r.s, r.hi, r.lo, r.l) for r in scan(rows, ["k"], ["i"], **states).collect()}
    before = {(r.k, r.i): (r.s, r.hi, r.lo, r.l) for r in scan(rows, ["k"], ["i"], inclusive=False, **states).collect()}
    for key in ("a", "b", None):
        seen, last = [], (None,) * 4
        for k, i, x in data:
            if k == key:
                assert before[k, i] == last
                seen += [x] if x is not None else []
                last = (sum(seen), max(seen), min(seen), seen[-1]) if seen else last
                assert got[k, i] == last
    if stretches > 1:
        assert rows.where("k = 'a'").select("_stretch").distinct().count() > 2
        assert rows.groupBy("k", "_stretch").count().agg(F.max("count")).first()[0] < 60


def test_chains(spark):
    links = spark.createDataFrame([(i, i + 3) for i in range(100)] + [(200, 201), (201, None), (300, 300 + 1)], "node int, next int")
    starts = spark.createDataFrame([(1,), (200,), (999,)], "node int")
    assert sorted(r.node for r in reached(links, starts).collect()) == [*range(1, 103, 3), 200, 201, 999]


def merged(spans, gap=3):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] += 1
        else:
            out.append([s, e, 1])
    return sorted(tuple(x) for x in out)


def test_one_key_is_merged_over_stretches(spark, stretches):
    rng = random.Random(2)
    spans = [(s := rng.randrange(2000) * 4, s + rng.choice((0, 1, 2, 9, 400))) for _ in range(900)] + [(0, 0), (0, 0), (5000, 5000), (5000, 9000)]
    got = interval.merge_near(spark.createDataFrame([("k", *x) for x in spans], "k string, s int, e int"), ["k"], "s", "e")
    assert sorted((r.span_start, r.span_end, r.members) for r in got.collect()) == merged(spans)
    assert sorted(r.group_no for r in got.collect()) == list(range(1, len(merged(spans)) + 1))


def test_one_key_overlaps_over_stretches(spark, stretches):
    rng = random.Random(3)
    spans = sorted((s := rng.randrange(3000), s + rng.choice((0, 1, 8)), i) for i in range(700))
    want = sorted((a[2], b[2]) for a, b in zip(spans, spans[1:]) if b[0] <= a[1])
    got = interval.overlaps(spark.createDataFrame([("k", *x) for x in spans], "k string, s int, e int, id int"), ["k"], "s", "e", "id")
    assert sorted((r.id, r.next_id) for r in got.collect()) == want


def test_one_key_as_of_over_stretches(spark, stretches):
    rng = random.Random(4)
    marks = sorted((rng.randrange(1000), v) for v in range(60))
    rows = [(i, rng.randrange(-50, 1100)) for i in range(500)]
    m = spark.createDataFrame([("k", *x) for x in marks], "k string, line int, v int")
    r = spark.createDataFrame([("k", *x) for x in rows] + [("none", 9999, 5)], "k string, id int, at int")
    upto = {i: [v for line, v in marks if line <= at] for i, at in rows}
    got = {x.id: x.last_v for x in interval.last_before(r, m, "k", "at", "line", "v").collect()}
    assert got == {i: (vs[-1] if vs else None) for i, vs in upto.items()} | {9999: None}
    got = {x.id: (x.v, x.ordinal, x.total, x.not_evaluated) for x in interval.reached_marks(r, m, "k", "at", "line", "v").collect()}
    assert got == {i: (vs[-1], len(vs), 60, 60 - len(vs)) if vs else (marks[0][1], 1, 60, 59) for i, vs in upto.items()}


def test_spans_of_any_length(spark):
    """Spans over the whole range go to two cells at most, and points find the innermost."""
    rng = random.Random(5)
    spans = [(0, 2**40, 0), (5, 5, 1), (2**39, 2**39 + 2, 2)] + [(s := rng.randrange(2**30), s + rng.randrange(2 ** rng.randrange(1, 31)), 10 + i) for i in range(200)]
    points = [5, 0, 2**40, 2**40 + 1, 2**39 + 1, *(rng.randrange(2**30) for _ in range(300))]
    want = {p: min(((e - s, i) for s, e, i in spans if s <= p <= e), default=(0, None))[1] for p in points}
    p = spark.createDataFrame([("k", x) for x in points] + [("other", 5)], "k string, at long")
    s = spark.createDataFrame([("k", *x) for x in spans] + [("k", 9, 2, -1)], "k string, s long, e long, id int")
    got = {(r.k, r.at): r.id for r in interval.enclosing(p, s, "k", "at", "s", "e", "id", ["k", "at"]).collect()}
    assert got == {("k", x): i for x, i in want.items()} | {("other", 5): None}
    none = interval.enclosing(p, s.limit(0), "k", "at", "s", "e", "id", ["k", "at"]).collect()
    assert len(none) == len(got) and all(r.id is None for r in none)


def split(sizes, limit, most):
    out, total, n, part = [], 0, 0, 0
    for x in sizes:
        if n == 0 or total + x > limit or n >= most:
            part, total, n = part + 1, 0, 0
        total, n = total + x, n + 1
        out.append(part)
    return out


@pytest.mark.parametrize("most", [None, 4])
def test_one_key_is_split_alike_folded_and_doubled(spark, stretches, most):
    rng = random.Random(6)
    sizes = [rng.choice((0, 1, 2, 5, 9, 30, None)) for _ in range(500)]
    want = split([x or 0 for x in sizes], 12, most or 10**9)
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate(sizes)] + [("small", i, 7) for i in range(3)] + [(None, 0, 1)], "k string, i int, size int")
    for most_rows in (10_000, 50):
        plan = group.split_in_order(rows, ["k"], ["i"], "size", 12, most, most_rows)
        assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
        got = {(r.k, r.i): r.part for r in plan.collect()}
        assert got == {("k", i): p for i, p in enumerate(want)} | {("small", i): i + 1 for i in range(3)} | {(None, 0): 1}


def test_digest_of_any_number_of_files(spark):
    """The same for any partitioning; other for any change of a file, a path or the version; the leaves are small."""
    from gleanery.functions import text as X

    rows = [(f"src/{k}.py", f"{k * k:040x}") for k in range(500)]
    make = lambda rows, n=3: spark.createDataFrame(rows, "path string, sha1 string").repartition(n)
    first = X.tree_digest(make(rows), "1").first()
    assert first.files == 500 and X.tree_digest(make(rows[::-1], 7), "1").first() == first
    others = [(make(rows), "2"), (make([("src/x.py", rows[0][1]), *rows[1:]]), "1"), (make([(rows[0][0], "f" * 40), *rows[1:]]), "1"), (make(rows[1:]), "1"), (make(rows + rows[:1]), "1")]
    assert len({first.tree_digest, *(X.tree_digest(d, v).first().tree_digest for d, v in others)}) == 6
    assert X.tree_digest(make(rows).limit(0), "1").first().files == 0


def test_facts_are_typed_columns(spark):
    """No fact is parsed again from text, and a kind's rows read that kind's column alone."""
    from gleanery.sources import pyindex
    from gleanery.storage import cut

    sources = spark.createDataFrame([("a.py", "import os\n\n\ndef f(x):\n    return os.getcwd()\n", "source"), ("b.py", "def (:\n", "source"), ("c.py", None, "test")], "path string, text string, kind string")
    parsed = cut(pyindex.parse(sources), "facts")
    plan = pyindex.calls(parsed)._jdf.queryExecution().toString()
    assert "from_json" not in plan and "struct<caller" in plan and "struct<id" not in plan.split("ReadSchema")[-1]
    assert [tuple(r) for r in pyindex.calls(parsed).collect()] == [("a.py::f", "a.py", None, "os", "getcwd", 5)]
    assert {r.id for r in pyindex.symbols(parsed).collect()} == {"a.py::<module>", "a.py::f", "c.py::<module>"}
    assert [r.file for r in pyindex.failures(parsed).collect()] == ["b.py"]


def test_patterns_of_any_length_find_names(spark):
    from gleanery.operators import names
    from gleanery.storage import new_path

    rng = random.Random(8)
    symbols = [(f"s{k}", n := "".join(rng.choice("abcé.") for _ in range(rng.randrange(1, 9))), f"{rng.choice('abc')}.{n}", f"f{k % 3}", k % 7) for k in range(300)] + [("only", "x", None, "f0", 1)]
    patterns = [(k, "".join(rng.choice("abcé.") for _ in range(rng.randrange(1, 6))), rng.choice((None, "f1"))) for k in range(60)] + [(100, "", None), (101, "zzz", None), (102, "x", None), (103, None, None)]
    path = new_path(spark, "names")
    names.build_names(spark.createDataFrame(symbols, "id string, name string, qualified_name string, file string, line_start int"), path)
    plan = names.find_all(spark, path, spark.createDataFrame(patterns, "pattern_id int, pattern string, hint_file string"))
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()
    got = [(r.pattern_id, r["rank"], r.id, r.match) for r in plan.collect()]
    want = []
    for i, p, hint in patterns:
        hits = [(-(2 if n == p or (q or n) == p or (q or n).endswith("." + p) else 1), hint is None or f != hint, f, line, s) for s, n, q, f, line in symbols if p and p in (q or n)]
        want += [(i, k, h[4], -h[0]) for k, h in enumerate(sorted(hits), 1)]
    assert sorted(got) == sorted(want)


def test_folders_are_read_by_tasks(spark, tmp_path):
    """Files of any name, the hidden ones too, and outcome files with and without results; read in as many tasks as asked."""
    import json

    from gleanery.sources import files, folders

    (tmp_path / "a").mkdir()
    for name, text in (("a/_x.py", "x = 1\n"), ("a/__init__.py", ""), ("b.py", "y\n"), (".hidden.py", "z"), ("a/note.txt", "n")):
        (tmp_path / name).write_text(text)
    found = folders.folder_files(spark, str(tmp_path), "*.py", files_per_task=1)
    assert found.rdd.getNumPartitions() == 4
    assert {r.path.removeprefix(str(tmp_path) + "/"): bytes(r.content).decode() for r in found.collect()} == {"a/_x.py": "x = 1\n", "a/__init__.py": "", "b.py": "y\n", ".hidden.py": "z"}
    assert found.where("size = 0").count() == 1 and folders.folder_files(spark, f"file://{tmp_path}", "*.none").count() == 0
    assert {r.path for r in files.source_files(spark, str(tmp_path)).collect()} >= {"a/_x.py", "a/__init__.py", "b.py"}
    results = [{"node_id": "t.py::a", "outcome": "failed", "duration": 0.5, "error_type": "ValueError", "frames": [{"file": "m.py", "line": 3, "function": "f", "code_line": "f()"}]}, {"node_id": "t.py::b", "outcome": "passed", "duration": 0.25}]
    for name, text in (("one.json", json.dumps({"exit_code": 1, "duration": 0.8, "total_tests": 2, "results": results})), ("_two.json", json.dumps({"exit_code": 5, "results": []})), ("bad.json", "not json")):
        (tmp_path / name).write_text(text)
    got = folders.outcomes(spark, str(tmp_path))
    assert sorted((r.file.rsplit("/", 1)[-1], r.exit_code, r.node_id, r.outcome, r.frames[0].line if r.frames else None) for r in got.where("node_id IS NOT NULL").collect()) == [("one.json", 1, "t.py::a", "failed", 3), ("one.json", 1, "t.py::b", "passed", None)]
    assert sorted((r.file.rsplit("/", 1)[-1], r.exit_code) for r in got.where("node_id IS NULL").collect()) == [("_two.json", 5), ("bad.json", None)]


def test_json_folders_are_replaced_whole(spark, tmp_path):
    from gleanery.sources import files

    at = str(tmp_path / "rows")
    files.write_json(spark.range(300).repartition(5), at, ["id"], partitions=3)
    assert [r.id for r in spark.read.json(at).orderBy("id").collect()] == list(range(300)) and len(list((tmp_path / "rows").glob("part-*"))) == 3
    bad = spark.range(3).select(F.raise_error(F.lit("stop")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stop"):
        files.write_json(bad, at, ["id"])
    assert spark.read.json(at).count() == 300
    files.write_json(spark.range(2), at, ["id"])
    assert spark.read.json(at).count() == 2
