"""Folders as a data source of its own: files are listed once, read and written by tasks, whatever their names, and test outcomes in them become rows."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FILES = "path string, modified timestamp, size bigint, content binary"
#: A run's file: its totals and one result for each test.
OUTCOMES = (
    "exit_code int, duration double, total_tests int, results array<struct<node_id: string, outcome: string, duration: double, error_type: string, error_message: string, "
    "frames: array<struct<file: string, line: int, function: string, code_line: string>>, stdout: string, stderr: string>>"
)


def opened(root: str) -> tuple:
    """(store, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*")
        self.each = int(options.get("filespertask", 64))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = opened(self.root)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob))
        return [Files(found[a : a + self.each]) for a in range(0, len(found), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = opened(self.root)
        for path in partition.paths:
            info = store.get_file_info(path)
            with store.open_input_file(path) as f:
                yield path, info.mtime, info.size, f.read()


class FolderWriter(DataSourceArrowWriter):
    """A file is written aside and moved to its place: a task that fails or runs twice leaves the file whole, and what it left aside goes at the end."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.aside = f"{self.root}.{uuid.uuid4().hex}"

    def write(self, batches: Iterator) -> WriterCommitMessage:
        store, root = opened(self.root)
        _, aside = opened(self.aside)
        store.create_dir(aside, recursive=True)
        made = set()
        for batch in batches:
            names, contents = (batch.column(batch.schema.get_field_index(c)) for c in ("path", "content"))
            for name, content in zip(names, contents, strict=True):
                to, new = f"{root}/{name.as_py()}", f"{aside}/{uuid.uuid4().hex}"
                if (parent := posixpath.dirname(to)) not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(new, compression=None) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                store.move(new, to)
        return WriterCommitMessage()

    def _clear(self) -> None:
        from pyarrow import fs

        store, aside = opened(self.aside)
        if store.get_file_info(aside).type != fs.FileType.NotFound:
            store.delete_dir(aside)

    def commit(self, messages: list) -> None:
        store, root = opened(self.root)
        store.create_dir(root, recursive=True)  # of no rows, a folder without files
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


class Folder(DataSource):
    """Format `folder`: (path, modified, size, content) of all files below a path; options glob and filesPerTask. Rows (path below it, content) are added as files.
    Stores are those that pyarrow opens by uri."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("files are only added to a folder")
        return FolderWriter(self.options)


def folder_files(spark: SparkSession, root: str, glob: str = "*", files_per_task: int = 64) -> DataFrame:
    """All files below root that match, those with a leading _ or . too, `files_per_task` to a task."""
    spark.dataSource.register(Folder)
    return spark.read.format("folder").option("glob", glob).option("filesPerTask", files_per_task).load(root)


def write_files(rows: DataFrame, root: str, name: str, text: str) -> None:
    """A file for each row, at `name` below root, written by the tasks that have the rows; of rows with one name any one is kept."""
    rows.sparkSession.dataSource.register(Folder)
    files = rows.select(F.col(name).alias("path"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("long").alias("size"), F.encode(text, "UTF-8").alias("content"))
    files.write.format("folder").mode("append").save(root)


def outcomes(spark: SparkSession, root: str, glob: str = "*.json", files_per_task: int = 512) -> DataFrame:
    """(file, exit_code, run_duration, total_tests, node_id, outcome, duration, error_type, error_message, frames, stdout, stderr): a row for each
    result of each file; a run without results has one row without a test, and a file that is no such document one with nulls alone."""
    text = F.decode("content", "UTF-8")
    read = folder_files(spark, root, glob, files_per_task).select(F.col("path").alias("file"), F.from_json(text, OUTCOMES, {"mode": "PERMISSIVE"}).alias("run"))
    rows = read.select("file", "run.exit_code", F.col("run.duration").alias("run_duration"), "run.total_tests", F.explode_outer("run.results").alias("r"))
    return rows.select("file", "exit_code", "run_duration", "total_tests", "r.*")
