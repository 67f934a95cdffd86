"""Files as tables, and tables as files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import excluded, is_test_path, posix_path
from gleanery.operators.running import running
from gleanery.sources.folders import folder_files


def source_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), glob: str = "*.py") -> DataFrame:
    """(path relative to root, text, sha1, lines, size, modified, kind) of all files below root that match, but for excluded paths.

    Spark's scan passes over files whose names begin with _, such as __init__.py; these are read by tasks too, through a source of our own.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    raw = raw.select("path", "modificationTime", "length", "content")
    hidden = folder_files(spark, root, glob).where(F.element_at(F.split("path", "/"), -1).startswith("_"))
    raw = raw.unionByName(hidden.select("path", F.col("modified").alias("modificationTime"), F.col("size").alias("length"), "content"))
    full = F.regexp_replace("path", "^file:/*", "/")
    base = "/" + root.removeprefix("file:").lstrip("/") if "://" not in root or root.startswith("file:") else root
    out = raw.select(posix_path(full, base).alias("path"), F.decode("content", "UTF-8").alias("text"), F.sha1("content").alias("sha1"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    out = out.withColumn("lines", F.size(F.split(F.regexp_replace("text", r"\n$", ""), "\n"))).withColumn("kind", F.when(is_test_path(F.col("path")), "test").otherwise("source"))
    return out.where(~excluded(F.col("path"), exclude)) if exclude else out


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row for each JSON file; the schema is declared, never guessed."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file."""
    return spark.read.text(path, wholetext=True)


def newest_folder(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """One row (folder): the folder below root with the latest file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "modificationTime")
    return raw.agg(F.max_by(F.regexp_replace("path", "/[^/]*$", ""), F.struct("modificationTime", "path")).alias("folder"))


def folder_size(spark: SparkSession, root: str) -> DataFrame:
    """One row (files, megabytes)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("length")
    return raw.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / F.lit(float(1024 * 1024)), 2).alias("megabytes"))


def write_json(df: DataFrame, path: str, order: list, partitions: int | None = None) -> None:
    """Rows as JSON lines with sorted fields, in order over all files of the folder, which are as many as Spark finds right unless `partitions` says.

    The folder is written beside its place and then renamed into it: a reader finds the old rows or the new ones, and a writer that fails leaves the old.
    """
    named = df.select(*sorted(df.columns))
    dealt = named.repartitionByRange(partitions, *order) if partitions else named.repartitionByRange(*order)
    spark, aside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    dealt.sortWithinPartitions(*order).write.json(aside)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    new, old, gone = jpath(aside), jpath(path), jpath(aside + ".old")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(old):
        fs.rename(old, gone)
    if not fs.rename(new, old):
        raise OSError(f"{aside} could not be renamed to {path}")
    fs.delete(gone, True)


def split_sinks(df: DataFrame, test: Column, path_true: str, path_false: str, order: list) -> None:
    """Two files of one table, by a test; a null counts as false."""
    kept = df.withColumn("_t", F.coalesce(test, F.lit(False))).persist()
    try:
        write_json(kept.where("_t").drop("_t"), path_true, order)
        write_json(kept.where("not _t").drop("_t"), path_false, order)
    finally:
        kept.unpersist()


def markdown_sections(bugs: DataFrame, title: str = "Bug report") -> DataFrame:
    """(ordinal, markdown): a report as rows in order, the heading first and then a section for each bug, however many there are.

    bugs: bug_id, test_name, error_type, error_message, severity; of the columns file, line, traceback and confidence, those that are there make lines too.
    """
    nl = "\n"
    fields = [("Test", "test_name"), ("Error", "error_type"), ("Severity", "severity"), ("Confidence", "confidence"), ("File", "file"), ("Line", "line")]
    lines = [F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for label, c in fields if c in bugs.columns]
    blocks = [F.concat(F.lit(f"```{nl}"), F.coalesce(F.col(c), F.lit("")), F.lit(f"{nl}```")) for c in ("error_message", "traceback") if c in bugs.columns]
    body = F.concat(F.lit("## "), F.col("bug_id"), F.lit(nl * 2), F.concat_ws(nl, *lines), F.lit(nl * 2), F.concat_ws(nl * 2, *blocks), F.lit(nl))
    placed = running(bugs.select("bug_id", body.alias("markdown")), [], ["bug_id", "markdown"], position="ordinal")
    head = bugs.agg(F.lit(0).cast("long").alias("ordinal"), F.concat(F.lit(f"# {title}{nl * 2}"), F.count("*").cast("string"), F.lit(f" bugs{nl}")).alias("markdown"))
    return head.unionByName(placed.select("ordinal", "markdown"))


def write_markdown(bugs: DataFrame, path: str, title: str = "Bug report") -> None:
    """The report as text files that make it up in the order of their names."""
    markdown_sections(bugs, title).repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("markdown").write.mode("overwrite").text(path)


def cached(spark: SparkSession, root: str, key: str, build) -> DataFrame:
    """The table stored under a content hash, built and stored if there is none."""
    path = f"{root.rstrip('/')}/index_{key[:16]}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
