"""Row numbers and running sums over a whole table or over keys of any size: no window holds more than one stretch of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.storage import cut


def running(rows: DataFrame, keys: list[str], order: list, size: str | None = None, position: str = "position", used: str = "used") -> DataFrame:
    """rows with their number in the order, from 1 for each key (one numbering without keys), and with the running sum of `size`, if given.

    Rows are dealt by range of (keys, order) and stored with their stretch; counts and sums of a stretch come first (one row for each key and stretch),
    and give each stretch what lies before it. Rows that are equal in the order are numbered in any order, but once for all.
    """
    stretch = cut(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_stretch", F.spark_partition_id()), "stretches")
    amount = F.col(size) if size else F.lit(0)
    sums = stretch.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n"), F.sum(amount).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_stretch").alias("_at"), zero("_n").alias("_n0"), zero("_s").alias("_s0"))
    same = F.col("_stretch") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    inner = stretch.withColumn("_i", F.row_number().over(w))
    if size:
        inner = inner.withColumn("_u", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = inner.join(offsets, same)
    out = out.withColumn(position, (F.col("_n0") + F.col("_i")).cast("long"))
    if size:
        out = out.withColumn(used, F.coalesce("_u", F.lit(0)) + F.col("_s0"))
    return out.select(*rows.columns, *([used] if size else []), position)
