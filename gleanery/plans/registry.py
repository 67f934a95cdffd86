"""All registered queries and their SQL, by name. A plan module adds to them with @query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.functions.text import CAPITALS, CLASSES, LETTERS, TURNS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), and the SQL that DuckDB answers alike."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def sql_classes(x: str) -> str:
    """SQL for the classes of a word's letters and digits, as in functions.text."""
    return f"translate({x}, '{LETTERS}', '{CLASSES}')"


def sql_parted(x: str, k: str) -> str:
    """SQL for a word x with blanks at its inner boundaries, from its classes k: a reduction from left to right."""
    turn, capitals = f"{k}[c.i:c.i + 1] IN {TURNS}", f"{k}[c.i:c.i + 2] = '{CAPITALS}'"
    steps = f"list_prepend({{'o': '', 'f': 1, 'i': 0}}, list_transform(range(1, length({x}) + 1), lambda i: {{'o': '', 'f': 0, 'i': i}}))"
    text = f"s.o || {x}[c.i] || CASE WHEN c.i >= s.f AND ({turn} OR {capitals}) THEN ' ' ELSE '' END"
    free = f"CASE WHEN c.i < s.f THEN s.f WHEN {turn} THEN c.i + 2 WHEN {capitals} THEN c.i + 3 ELSE s.f END"
    return f"CASE WHEN regexp_matches({k}, '{'|'.join([*TURNS, CAPITALS])}') THEN list_reduce({steps}, lambda s, c: {{'o': {text}, 'f': {free}, 'i': c.i}}).o ELSE {x} END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from gleanery.plans import code, graphs, groups, ranking, relational, retrieval, texts  # noqa: E402, F401
