"""Rows to learn from, and the held-out rows that no model sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import cut


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's decimal text falls in the fold; a null id never does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, folds: int, fold: int, most: int) -> DataFrame:
    """(id, text, label) of labelled rows outside the fold, once for each id and text: all, or where there are more, at most `most` of them, picked by hashes.

    Where there are more labelled ids than `most`, about as many ids are taken first; of the rows that these have, however many, `most` stay.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut(named.join(F.broadcast(known), "id").dropDuplicates(["id", "text"]), "labelled-rows")  # about `most` pairs of numbers are sent
    if rows.count() > most:
        key = F.xxhash64("id", "text")
        last = rows.select(key.alias("key")).orderBy("key").limit(most).agg(F.max("key")).first()[0]  # of at most `most` numbers
        rows = rows.where(key <= last)
    return rows
