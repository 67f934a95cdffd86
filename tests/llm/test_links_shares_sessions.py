"""Vector links, source divergences and sessions: edge cases, brute force, and the SQL."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import collisions, divergence, queries, sessions

DATA = "/root/testdata/sf0.01"


# vectors


def brute_links(rows, cosine=0.9):
    """{position: (n_links, component)} by all pairs; component: the smallest id that links reach."""
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            unit[k] = x / np.linalg.norm(x)
    n, root = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations(unit, 2):
        if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
            n[a], n[b] = n[a] + 1, n[b] + 1
            root[find(a)] = find(b)
    groups: dict = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(i, n[k], least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)]


def near(rng, base, spread):
    return (np.array(base) + rng.normal(0, spread, len(base))).astype(np.float32).tolist()


def vectors(rng, n=120, dims=16):
    base = [rng.normal(0, 1, dims).tolist() for _ in range(n)]
    rows = [(k, np.float32(v).tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, near(rng, base[k % 7], 0.05)) for k in range(40)]
    rows += [(2000 + k, np.float32(base[3]).tolist()) for k in range(30)]  # copies
    rows += [(5, np.float32(base[9]).tolist()), (None, np.float32(base[10]).tolist()), (None, [1.0, 2.0]), (3000, [1.0, 2.0]), (3001, [2.0, 4.0])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * dims), (4003, [None] + [1.0] * (dims - 1)), (4004, [float("nan")] * dims), (4005, [float("inf")] + [1.0] * (dims - 1))]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_links_against_all_pairs(spark, block):
    rows = vectors(np.random.default_rng(3))
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, w int, component string").repartition(3)
    got = [tuple(r) for r in collisions.link_vectors(d, recall=0.999, block=block).collect()]
    want = brute_links(rows)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_links_of_no_vectors(spark):
    for rows in ([], [(1, None), (2, [0.0])]):
        got = collisions.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert sorted(tuple(r) for r in got.collect()) == [(i, 0, i, True) for i, _ in rows]
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just above 0.9 and just below it: nine tenths of the former are found, none of the latter."""
    rng, rows = np.random.default_rng(8), []
    for k in range(400):
        a, b = rng.normal(0, 1, (2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9005 if k % 2 else 0.8995
        rows += [(2 * k, (3 * a).tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = {r.vec_id: r.n_links for r in collisions.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).collect()}
    assert sum(got[2 * k] for k in range(1, 400, 2)) >= 180
    assert not any(got[2 * k] for k in range(0, 400, 2))


def test_a_family_in_one_block_is_cut_into_tiles(spark):
    """A family beyond a block: every link counts once, though its pairs meet in tiles."""
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, 32)
    rows = [(k, near(rng, base, 0.05)) for k in range(300)]
    got = sorted(tuple(r) for r in collisions.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=50).collect())
    assert got == [(k, 299, 0, k == 0) for k in range(300)]


def test_calibration():
    for n in (100, 10**5, 10**9):
        window, least, halves, dealings = collisions.calibrated(n, 0.9, 0.95, 1024)
        assert n / 2**halves <= 1024 and 1 <= least <= collisions.PROJECTIONS and dealings >= 1 and window < 1
    assert collisions.calibrated(10**6, 0.9, 0.99, 1024)[3] > collisions.calibrated(10**6, 0.9, 0.9, 1024)[3]


# divergences


def by_sql(rows, least_docs=10):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    sql = divergence.ORACLE.replace(">= 10)", f">= {least_docs})")
    return sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({sql})").fetchall())


def texts(rng):
    words = "alpha Beta GAMMA straße été 日本 x y1z don't über naïve A a ß".split()
    rows = [(k, " ".join(rng.choice(words[: 3 + k % 12]) for _ in range(rng.randrange(40))), "ab"[k % 2], f"s{k % 5}") for k in range(80)]
    rows += [(100, None, "a", "s1"), (101, "", None, None), (102, "alpha " * 50_000, "a", "s0"), (103, "only once", "c", "s1"), (104, "", "c", "s2"), (105, "lone", "d", "s1")]
    return rows + rows[:6] + [(None, "Beta beta", "a", "s9")]


@pytest.mark.parametrize("least_docs", [10, 1])
def test_divergences_against_sql(spark, least_docs):
    rows = texts(random.Random(2))
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, term int, n int").repartition(3)
    got = sorted(tuple(r) for r in divergence.divergences(d, least=least_docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == by_sql(rows, least_docs)
    assert any(r[2] == "term" for r in got) and any(r[2] == "pair" and r[4] == 0 for r in got)


def test_shards_do_not_change_divergences(spark, monkeypatch):
    rows = texts(random.Random(4))
    monkeypatch.setattr(divergence, "SHARD_ROWS", 7)
    monkeypatch.setattr(divergence, "SHARD_SHARES", 7)
    monkeypatch.setattr(divergence, "HELD", 3)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    assert sorted(tuple(r) for r in divergence.divergences(d).select("lang", "source", "part", "item", "value", "rank").collect()) == by_sql(rows)


def test_divergences_of_nothing(spark):
    assert divergence.divergences(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


# sessions

T0 = dt.datetime(2024, 1, 31, 23, 50)


def clicks(rng, n=400, clients=4):
    """(click_id, ts, arrived_at, client_id, kind, value), with ties, repeats, late and broken rows."""
    rows = []
    for k in range(n):
        at = T0 + dt.timedelta(minutes=rng.choice((0, 1, 5, 14, 15, 16)) * rng.random() + k * 1.7, microseconds=rng.randrange(10**6))
        at = T0 + dt.timedelta(minutes=15 * (k // 3)) if k % 11 == 0 else at
        late = dt.timedelta(minutes=rng.choice((0, 0, 0, 15, 16)))
        rows.append((k * 7 % n, at, None if k % 13 == 0 else at + late, None if k % 41 == 0 else rng.randrange(clients), rng.choice(("view", "purchase", "signup", None)), rng.choice((None, -1.005, 59.994, 60.0, 61.5, 7.125))))
    rows += [(n + 1, None, T0, 1, "view", 1.0), (n + 2, T0, T0, 99, "purchase", 60.0), (n + 3, T0, T0 + dt.timedelta(hours=1), 98, "view", 1.0), (n + 4, T0, T0, None, "view", 1.0)]
    return rows + rows[:30]


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double"
SESSION = "client_id session_id start_us end_us n_clicks n_late value_cents closed_by path_sha256".split()


def digested(df):
    return sorted(tuple(r) for r in df.withColumn("path_sha256", F.sha2(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").cast("binary"), 256)).select(SESSION).collect())


def brute_sessions(rows):
    """The definition, click by click."""
    us = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
    single = {r[0]: r for r in rows if r[1] is not None and r[3] is not None}
    out = []
    for client in {r[3] for r in single.values()}:
        own = [r for r in single.values() if r[3] == client]
        late = [us(r[1]) for r in own if r[2] is not None and us(r[2]) - us(r[1]) > 15 * sessions.MINUTE]
        timely = sorted((us(r[1]), r[0], r[5] is not None and r[5] >= 60 and r[4] in ("purchase", "signup"), 0 if r[5] is None else int(np.floor(100 * r[5] + 0.5))) for r in own if not (r[2] is not None and us(r[2]) - us(r[1]) > 15 * sessions.MINUTE))
        found: list = []
        for c in timely:
            last = found[-1][0][-1] if found else None
            why = None
            if last:
                why = "end" if last[2] else "gap" if c[0] - last[0] >= 15 * sessions.MINUTE else "length" if c[0] - found[-1][0][0][0] > 60 * sessions.MINUTE else None
                if why:
                    found[-1][1] = why
            if not last or why:
                found.append([[c], None])
            else:
                found[-1][0].append(c)
        for k, (cs, why) in enumerate(found):
            upto = found[k + 1][0][0][0] if k + 1 < len(found) else None
            n_late = sum(u >= cs[0][0] and (upto is None or u < upto) for u in late)
            path = ",".join(str(c[1]) for c in cs)
            out.append((client, cs[0][1], cs[0][0], cs[-1][0], len(cs), n_late, sum(c[3] for c in cs), why or ("end" if cs[-1][2] else "none"), hashlib.sha256(path.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 3])
def test_sessions_against_the_definition(spark, most):
    rows = clicks(random.Random(6))
    d = spark.createDataFrame([(*r, "{}", 1) for r in rows], CLICKS + ", props string, island int").repartition(5)
    want = brute_sessions(rows)
    assert digested(sessions.sessionise(d, most=most)) == want
    assert {"end", "gap", "length", "none"} <= {r[7] for r in want} and any(r[5] for r in want)


def test_one_client_over_many_stretches(spark):
    """One client with pauses far apart: islands that cross stretches, a long island without any break, and equal times."""
    rows = [(k, T0 + dt.timedelta(minutes=k // 2), T0 + dt.timedelta(minutes=k // 2 + (16 if k % 9 == 0 else 0)), 1, "view", 1.0) for k in range(600)]
    rows += [(1000 + k, T0 + dt.timedelta(days=2, minutes=20 * k), None, 1, "purchase", 99.0) for k in range(5)]
    want = brute_sessions(rows)
    for parts in ("1", "7", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [digested(sessions.sessionise(spark.createDataFrame(rows, CLICKS), most=m)) for m in (100_000, 50)]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == [want, want]


def test_sessions_of_nothing(spark):
    assert sessions.sessionise(spark.createDataFrame([], CLICKS)).collect() == []


def test_session_zone_has_no_say(spark):
    rows = clicks(random.Random(9), 60)
    d = spark.createDataFrame(rows, CLICKS)
    want = brute_sessions(rows)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert digested(sessions.sessionise(d)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_gap_sessions"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    cols = ", ".join(got.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(f"SELECT {cols} FROM ({queries.ORACLES[name]})").fetchall())
