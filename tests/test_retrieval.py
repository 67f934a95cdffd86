"""Search over stored indexes, retrieval for reports, and sources and streams, against small sequential models."""

from __future__ import annotations

import json
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import types as T

from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.functions.stem import stem
from gleanery.operators import bm25, pack
from gleanery.plans import registry
from gleanery.plans.retrieval import new_path
from gleanery.sources import files
from gleanery.streaming import runlog


def parted(word):
    """The rule of identifiers, character by character."""
    kind = lambda c: "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.isalpha() else ""
    out, free = "", 0
    for i, c in enumerate(word):
        a, b, d = (kind(word[j]) if j < len(word) else "" for j in (i, i + 1, i + 2))
        turn = a and b and a != b and (a, b) != ("upper", "lower")
        capitals = (a, b, d) == ("upper", "upper", "lower")
        out += c
        if i >= free and (turn or capitals):
            out, free = out + " ", i + (2 if turn else 3)
    return out


PARTED = {"x1y2Z": "x 1y 2Z", "HTTPServer": "HTTP Server", "getHTTPResponseCode": "get HTTP Response Code", "ABc1": "A Bc1", "aBCd": "a BCd", "snake_case2x": "snake case 2x", "plain": "plain", "A": "A", "": ""}


def test_identifiers_are_parted(spark):
    rng = random.Random(7)
    words = list(PARTED) + ["".join(rng.choice("abAB01_") for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.pieces_of(F.col("w")).alias("p")).collect()
    assert {r.w: " ".join(r.p) for r in got} == {w: " ".join(parted(re.sub("[^a-zA-Z0-9]+", " ", w)).split()) for w in words}
    assert all(" ".join(parted(w.replace("_", " ")).split()) == p for w, p in PARTED.items())


#: Word pairs of the algorithm's published sample vocabulary.
STEMS = """
consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist,
consistently consist, consisting consist, consists consist, consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol,
consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol, consolingly consol, consols consol, consonant conson,
consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir,
conspirators conspir, conspire conspir, conspired conspir, conspiring conspir, constable constabl, constables constabl, constance constanc,
constancy constanc, constant constant, knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead,
kneading knead, knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell, knelt knelt, knew knew, knick knick, knif knif,
knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit, knives knive, knob knob, knobs knob,
knock knock, knocked knock, knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot
"""


def test_stems_of_the_published_sample():
    for pair in STEMS.replace("\n", " ").split(","):
        word, want = pair.split()
        assert stem(word) == want, word


def tokens(text, stop):
    """Words split at signs and at case and digit boundaries; pieces are stemmed, whole words of several pieces are not."""
    out = []
    for w in re.findall("[a-zA-Z0-9_]+", text or ""):
        p = [x for x in parted(re.sub("[^a-zA-Z0-9]+", " ", w)).split(" ") if x]
        ok = lambda t: len(t) >= 2 and t not in stop
        out += [s for x in p if ok(x.lower()) and ok(s := stem(x.lower()))]
        if len(p) > 1 and ok(w.lower()):
            out.append(w.lower())
    return out


def test_porter_search(spark, small):
    stop = set(X.english_stopwords())
    docs = {r.doc_id: Counter(tokens(r.text, stop)) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = {r.item_id: Counter(tokens(r.text, stop)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    docs = {i: c for i, c in docs.items() if c}
    df, n = Counter(t for c in docs.values() for t in c), len(docs)
    mean = sum(sum(c.values()) for c in docs.values()) / n
    want = {}
    for q, terms in items.items():
        scores = []
        for i, c in docs.items():
            length = sum(c.values())
            s = sum(min(w, 2) * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * length / mean)) for t, w in terms.items() if t in c)
            if s > 0:
                scores.append((-round(s, 6), i))
        want[q] = [(i, -s) for s, i in sorted(scores)[:10]]
    got = {}
    for r in registry.QUERIES["porter_search"](spark, small).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert {q: [i for i, _ in w] for q, w in want.items() if w} == {q: [i for i, _ in w] for q, w in got.items()}
    assert all(s == pytest.approx(t, abs=2e-6) for q, w in got.items() for (_, s), (_, t) in zip(w, want[q], strict=True))


def test_stored_index_reads_buckets(spark):
    """A search reads the buckets of its terms alone, whatever it finds; many terms are joined."""
    docs = spark.createDataFrame([(k, f"common word{k} other{k % 7}") for k in range(60)] + [(99, None)], "id long, text string")
    path = new_path(spark, "test-index")
    bm25.build_index(docs, "id", "text", path, "none", X.STOPWORDS, buckets=16)
    counts, lengths, stats = bm25.load_index(spark, path, ["common"], 16)
    assert {r.term for r in counts.collect()} == {"common"} and lengths.count() == stats.first().n == 60
    assert "PartitionFilters: [isnotnull" in (plan := counts._jdf.queryExecution().executedPlan().toString()) or "bucket" in plan
    q = bm25.query_weights(spark.createDataFrame([("a", ["other3", "common"]), ("b", ["nothing"])], "query_id string, terms array<string>"), "query_id", "terms")
    few, many = (bm25.search_index(spark, path, q, "id", buckets=16, most_terms=n).drop("breakdown").collect() for n in (10, 1))
    assert sorted(few) == sorted(many) and [r.id for r in sorted(few, key=lambda r: r.rank)][:3] == [3, 10, 17]


def test_retrieve_context(spark, small):
    """The best symbol of every report is of its own module; budgets hold; no test and nothing dropped is left."""
    rows = registry.QUERIES["retrieve_context"](spark, small).collect()
    best = {r.query_id: r.id for r in rows if r["rank"] == min(x["rank"] for x in rows if x.query_id == r.query_id)}
    parts = spark.read.parquet(f"{small}/part.parquet").where("p_partkey % 20 = 0").count()
    own = sum(i.startswith(f"src/m{q[1:]}.py::") for q, i in best.items())
    assert len(best) == parts and own == parts
    assert all(r.used <= 10_000 for r in rows if r.fate == "taken") and {r.tier for r in rows} <= {"FULL", "SIGNATURE", "SKELETON"}


def test_holders(spark):
    from gleanery.operators.relational import holders

    texts = ["one two three four", "x one two three fourth", "two\nthree", "", None, "zero  one two three  four", "three"]
    items = ["one two three four", "two three", "three", "e two thr", "two\nthree", "one  two"]
    r, i = spark.createDataFrame(list(enumerate(texts)), "k long, text string"), spark.createDataFrame(list(enumerate(items)), "q long, item string")
    assert sorted((x.k, x.q) for x in holders(r, i, "text", "item").collect()) == sorted((k, q) for k, t in enumerate(texts) for q, x in enumerate(items) if t is not None and x in t)


def test_required_sections(spark):
    reports = spark.createDataFrame([("g", "b2", "t::y", "E", "bad", ["s1", None, "s3"]), ("g", "b1", "t::y", None, None, None), ("h", "b3", "gone", "E", "x", [])], "group_id string, bug_id string, test_name string, error_type string, error_message string, called array<string>")
    tests = spark.createDataFrame([("t::y", "code"), ("t::y", "code"), ("t::z", "other")], "test_name string, text string")
    source = spark.createDataFrame([("s1", "one"), ("s2", "two"), ("s3", None)], "id string, text string")
    suspects = spark.createDataFrame([("g", "s2"), ("g", "s1")], "group_id string, id string")
    got = [(r.group_id, r.section, r.ordinal, r.item_id, r.text) for r in pack.required_sections(reports, tests, source, suspects).collect()]
    assert sorted(got) == [("g", "evidence", 1, "b1", "t::y\n"), ("g", "evidence", 2, "b2", "t::y\nE: bad"), ("g", "source", 1, "s1", "one"), ("g", "source", 2, "s2", "two"), ("g", "tests", 1, "t::y", "code"), ("h", "evidence", 1, "b3", "gone\nE: x")]


def test_files(spark, tmp_path):
    for k, name in enumerate(("old", "new")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(json.dumps({"n": k, "x": [k]}, indent=1))
        (tmp_path / name / "b.md").write_text(f"line {k}\nsecond")
        time.sleep(1.1)
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("x", T.ArrayType(T.IntegerType()))])
    assert sorted((r.n, r.x) for r in files.json_documents(spark, f"{tmp_path}/*/a.json", schema).collect()) == [(0, [0]), (1, [1])]
    assert sorted(r.value for r in files.texts(spark, f"{tmp_path}/*/b.md").collect()) == ["line 0\nsecond", "line 1\nsecond"]
    assert files.newest_folder(spark, str(tmp_path)).first().folder.endswith("/new")


def test_tail(spark, tmp_path):
    """Events appended to a folder are read once each, and a reader that starts again goes on where it left off."""
    log, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    (tmp_path / "log").mkdir()

    def append(name, *seqs):
        (tmp_path / "log" / name).write_text("".join(json.dumps({"run_id": "r", "seq": s, "line": f"l{s}", "status": "running"}) + "\n" for s in seqs))

    def read():
        runlog.tail(spark, log).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(out).collect())

    append("1.json", 1, 2)
    assert read() == [1, 2]
    append("2.json", 3)
    assert read() == [1, 2, 3] == read()
    assert runlog.run_state(spark.read.schema(runlog.EVENT).json(log)).first().lines == 3
