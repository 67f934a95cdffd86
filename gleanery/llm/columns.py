"""Column expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.llm.common import WORD


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: SQL has no local names but those of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0))


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1 as an array; empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
