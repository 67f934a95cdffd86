"""Every registered query with SQL against DuckDB, on the smallest tables; every other one must run."""

from __future__ import annotations

import duckdb
import pytest

from gleanery.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, db, name):
    got = registry.QUERIES[name](spark, small)
    rows = [tuple(cell(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    found = db.execute(registry.ORACLES[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(got.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = [tuple(cell(r[i]) for i in order) for r in found.fetchall()]
    assert sorted(rows, key=str) == sorted(want, key=str)


ODD = {
    "no place": "CASE WHEN n % 7 = 0 THEN NULL ELSE l_partkey END AS l_partkey, l_quantity",
    "no length": "l_partkey, CASE WHEN n % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "parts": "l_partkey, l_quantity + (n % 4) / 4.0::DOUBLE AS l_quantity",
    "backwards": "l_partkey, CASE WHEN n % 7 = 0 THEN -l_quantity ELSE l_quantity END AS l_quantity",
}


@pytest.mark.parametrize("what", ODD)
def test_odd_spans_are_merged_as_in_sql(spark, small, tmp_path, what):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS SELECT l_orderkey, l_linenumber, {ODD[what]} FROM (SELECT *, l_orderkey * 7 + l_linenumber + l_partkey * 13 AS n FROM '{small}/lineitem.parquet')")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    want = con.execute(f"SELECT k, group_no, span_start, span_end, members FROM ({registry.ORACLES['proximity_merge']})").fetchall()
    got = registry.QUERIES["proximity_merge"](spark, str(tmp_path)).select("k", "group_no", "span_start", "span_end", "members").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
