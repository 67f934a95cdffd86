"""Folders that tasks write: a file for each row, whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.plans import registry, relational
from gleanery.sources import folders


def test_rows_become_files(spark, tmp_path):
    """Files in folders that are made as needed, an empty one of a null, nothing left aside; a second write adds, and replaces a file of one name."""
    root = tmp_path / "out"
    rows = [("a/1.txt", "one"), ("a/2.txt", "zwei é\n"), ("b.txt", None), (".c/d/e.txt", "")]
    folders.write_files(spark.createDataFrame(rows, "n string, t string").repartition(3), f"file://{root}", "n", "t")
    folders.write_files(spark.createDataFrame([("a/1.txt", "new"), ("f.txt", "f")], "n string, t string"), str(root), "n", "t")
    got = {r.path.removeprefix(f"{root}/"): bytes(r.content).decode() for r in folders.folder_files(spark, str(root)).collect()}
    assert got == {"a/1.txt": "new", "a/2.txt": "zwei é\n", "b.txt": "", ".c/d/e.txt": "", "f.txt": "f"}
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    folders.write_files(spark.createDataFrame([], "n string, t string"), str(tmp_path / "none"), "n", "t")
    assert folders.folder_files(spark, str(tmp_path / "none")).count() == 0


def test_failed_write_leaves_nothing_aside(spark, tmp_path):
    bad = spark.range(20).select(F.concat("id", F.lit(".txt")).alias("n"), F.when(F.col("id") == 15, F.raise_error(F.lit("stop"))).otherwise(F.lit("x" * 9)).alias("t"))
    with pytest.raises(Exception, match="stop"):
        folders.write_files(bad, str(tmp_path / "out"), "n", "t")
    assert [p.name for p in tmp_path.iterdir() if p.name != "out"] == [] and all(p.read_text() == "x" * 9 for p in tmp_path.rglob("*.txt"))


def test_outcome_files_of_any_user(spark, small, tmp_path, monkeypatch):
    """A file for each run and no folder of its own; runs of a negative and of no number are counted too."""
    n = F.col("user_id")
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("user_id", F.when(n == 3, None).when(n == 5, -5).otherwise(n))
    at = str(tmp_path / "outcomes")
    monkeypatch.setattr(relational, "table", lambda *_: events)
    monkeypatch.setattr(relational, "new_path", lambda *_: at)
    got = {r.user_id: r for r in registry.QUERIES["outcome_files"](spark, small).collect()}
    assert {k: r.total for k, r in got.items()} == {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    assert None in got and -5 in got and all(r.consistent for r in got.values())
    found = [p for p in (tmp_path / "outcomes").rglob("*") if p.is_file()]
    assert len(found) == len(got) and not [p for p in (tmp_path / "outcomes").rglob("user_id=*") if p.is_dir()]
