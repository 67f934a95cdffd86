"""Prefix scans over keys of any size: an associative state is carried across stretches of the order, so no window holds more than one stretch of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.storage import cut

#: A state's total over rows, and its running value over a window.
KINDS = {
    "sum": (lambda c, place: F.sum(c), lambda c: F.sum(c)),
    "max": (lambda c, place: F.max(c), lambda c: F.max(c)),
    "min": (lambda c, place: F.min(c), lambda c: F.min(c)),
    "last": (lambda c, place: F.max_by(c, F.when(c.isNotNull(), place)), lambda c: F.last(c, ignorenulls=True)),
}


def deal(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """rows stored by range of (keys, order), with the number of the stretch as _stretch: as many stretches as there are shuffle partitions, of like size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *keys, *order).withColumn("_stretch", F.spark_partition_id()), "stretches")


def scan(dealt: DataFrame, keys: list[str], order: list[Column | str], inclusive: bool = True, **states: tuple[str, Column]) -> DataFrame:
    """dealt with the running state of each name: ("sum" | "max" | "min" | "last", expression), null where no row counts yet.

    "last" is the last value that is not null. The order must tell the rows of a key apart where equal rows would give different states. A key's rows of one
    stretch meet in one window; of each stretch one row goes on, and the rows of a key that go on are at most as many as there are stretches.
    """
    inner = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    totals = dealt.groupBy(*keys, "_stretch").agg(*[KINDS[kind][0](c, place).alias(f"_scan_t_{name}") for name, (kind, c) in states.items()])
    start = totals.select(
        *[F.col(k).alias(f"_scan_k{i}") for i, k in enumerate(keys)],
        F.col("_stretch").alias("_scan_at"),
        *[KINDS[kind][1](F.col(f"_scan_t_{name}")).over(before).alias(f"_scan_b_{name}") for name, (kind, _) in states.items()],
    )
    same = F.col("_stretch") == F.col("_scan_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_scan_k{i}"))
    seen = dealt.select("*", *[KINDS[kind][1](c).over(inner).alias(f"_scan_i_{name}") for name, (kind, c) in states.items()])
    both = {
        "sum": lambda b, i: F.when(b.isNull(), i).when(i.isNull(), b).otherwise(b + i),
        "max": lambda b, i: F.greatest(b, i),
        "min": lambda b, i: F.least(b, i),
        "last": lambda b, i: F.coalesce(i, b),
    }
    values = [both[kind](F.col(f"_scan_b_{name}"), F.col(f"_scan_i_{name}")).alias(name) for name, (kind, _) in states.items()]
    return seen.join(start, same).select(*dealt.columns, *values)
