"""What the operators of this subpackage share: the words of a text, cutting lineage, sizes of a shuffle, packed binary blocks."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gleanery.storage import cut, forget, shared_dir, unused  # noqa: F401

#: Fixed value: a word, as a pattern that Java, DuckDB and Python read alike.
WORD = r"[^\x20\x09-\x0D]+"


_held: dict[str, Callable[[], None]] = {}


def held(owner: str, drop: Callable[[], None] | None = None) -> None:
    """Called by a task that uses `owner`'s tables of this Python worker: the tables of every other owner are dropped, so what one stage keeps from batch to
    batch is not held through the stages that follow. `drop` says how to drop the owner's own."""
    for other in [o for o in _held if o != owner]:
        _held.pop(other)()
    if drop:
        _held[owner] = drop


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions: how finely the cluster's owner wants this input dealt."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_bytes(spark: SparkSession, n: int = 16 << 20) -> None:
    """Bound the bytes of an Arrow batch, unless the session's owner has: long texts else make batches of any size."""
    ship(spark)
    key, ours = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.gleanery.arrowBytes"
    now = spark.conf.getAll
    if key not in now or now[key] == now.get(ours):
        spark.conf.set(key, n)
        spark.conf.set(ours, str(n))


def release() -> None:
    """Give a Python worker's free memory back to the machine: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """A function of batches or tables that gives memory back after each batch (where it yields) or when it is done."""
    if inspect.isgeneratorfunction(f):

        def each(batches):
            for out in f(batches):
                yield out
                del out
                release()

        return each

    def once(left):
        try:
            return f(left)
        finally:
            release()

    def pair(left, right):
        try:
            return f(left, right)
        finally:
            release()

    return pair if len(inspect.signature(f).parameters) == 2 else once


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application: they need not have it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[2]
        at = Path(tempfile.mkdtemp(prefix="gleanery-")) / "gleanery.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted((top / "gleanery").rglob("*.py")):
                z.write(f, f.relative_to(top))
        spark.sparkContext.addPyFile(str(at))
        _shipped.add(app)


def text_bytes(col: str) -> Column:
    """The text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known types as one compressed block: lengths first."""
    head = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(block: bytes, *types: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    out, at = [], 8 * len(types)
    for kind, n in zip(types, np.frombuffer(data, "<i8", len(types)), strict=True):
        out.append(np.frombuffer(data[at : at + int(n)], kind))
        at += int(n)
    return out
