"""Test results from console logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(log: Column) -> Column:
    """struct(total, failed) of the closing line; without one, of the marks of single tests."""
    n = lambda word: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(log, rf"(?m)^=+ .*?([0-9]+) {word}.* in [0-9.]+s.*=+[ \t]*$", 1), F.lit("")), F.lit("9999999999")).cast("long"), F.lit(0).cast("long"))
    failed, passed, skipped = n("failed"), n("passed"), n("skipped")
    marks = lambda w: F.regexp_count(log, F.lit(rf"[ \t]{w}([ \t\n]|$)")).cast("long")
    closed = (failed + passed + skipped) > 0
    return F.struct(F.when(closed, failed + passed + skipped).otherwise(marks("PASSED") + marks("FAILED")).alias("total"), F.when(closed, failed).otherwise(marks("FAILED")).alias("failed"))


def failures(logs: DataFrame, log_col: str, keys: list[str]) -> DataFrame:
    """(keys, test_name, error_type, error_message, file_path, line_number) of every failed test in the FAILURES part; the file is the first in the
    traceback that is no test. Without that part, the failed tests by name, of unknown error."""
    log = F.col(log_col)
    part = F.regexp_extract(log, r"(?s)=+ FAILURES =+\n(.*?)(\n=+ |$)", 1)
    head = r"(?m)^_{3,} ([^ \n]+) _{3,}$"
    names = F.regexp_extract_all(part, F.lit(head), F.lit(1))
    bodies = F.slice(F.split(part, head), F.lit(2), F.size(names))
    found = logs.where(part != "").select(*keys, F.explode(F.arrays_zip(names.alias("name"), bodies.alias("body"))).alias("f")).select(*keys, F.col("f.name").alias("name"), F.col("f.body").alias("body"))
    places = F.transform(F.regexp_extract_all("body", F.lit(r"[^ \n]+\.py:[0-9]+:"), F.lit(0)), lambda x: F.struct(F.translate(F.regexp_extract(x, r"^(.*\.py):", 1), "\\", "/").alias("path"), F.regexp_extract(x, r":([0-9]+):$", 1).cast("int").alias("line")))
    tests = F.filter(places, lambda p: F.contains(p["path"], F.lit("test_")) | F.contains(F.lower(p["path"]), F.lit("tests")))
    own = F.filter(places, lambda p: ~(F.contains(p["path"], F.lit("test_")) | F.contains(F.lower(p["path"]), F.lit("tests"))))
    place = F.coalesce(F.get(own, F.lit(0)), F.get(places, F.lit(0)))
    error = F.regexp_extract("body", r"([A-Z]\w+(Error|Exception|Warning)): ", 1)
    message = F.trim(F.regexp_extract("body", r"[A-Z]\w+(?:Error|Exception|Warning): ([^\n]*)", 1))
    asserted = F.trim(F.regexp_extract("body", r"(?m)^E[ \t]+(assert [^\n]*)", 1))
    detailed = found.select(
        *keys,
        F.concat_ws("::", F.get(tests, F.lit(0))["path"], F.col("name")).alias("test_name"),
        F.when(error != "", error).when(asserted != "", "AssertionError").otherwise("Unknown").alias("error_type"),
        F.when(error != "", message).when(asserted != "", asserted).otherwise("Test failed").alias("error_message"),
        F.coalesce(place["path"], F.lit("")).alias("file_path"),
        F.coalesce(place["line"], F.lit(0)).alias("line_number"),
    )
    bare = logs.where(part == "").select(*keys, F.explode(F.regexp_extract_all(log, F.lit(r"(?m)^([^ \n]+::[^ \n]+)[ \t]+FAILED"), F.lit(1))).alias("test_name"))
    return detailed.unionByName(bare.select(*keys, "test_name", F.lit("Unknown").alias("error_type"), F.lit("Test failed (no details available)").alias("error_message"), F.lit("").alias("file_path"), F.lit(0).alias("line_number")))
