"""Grouping of candidates and reports: confidence, categories, clusters, budgeted splits, coverage, report order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.chain import reached
from gleanery.operators.running import running
from gleanery.operators.scan import deal, scan
from gleanery.storage import cut

#: Which source's findings come first in a report.
SOURCE_RANK = {"pytest": 0, "llm": 1, "heuristic": 2, "ruff": 3}


def confidence(sources: Column, verified: Column) -> Column:
    """Of an array of sources and whether any member is confirmed."""
    return F.when(verified, "confirmed").when(F.size(F.array_distinct(sources)) >= 2, "multi-source").otherwise("single-source")


def report_order(groups: DataFrame, sources: str = "sources", extra: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """Numbers groups B001, B002, ... : confirmed first, then the best source's rank, confidence, and `extra`."""
    table = F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])
    rank = F.array_min(F.transform(sources, lambda s: F.coalesce(F.try_element_at(table, s), F.lit(99))))
    level = F.when(F.col("confidence") == "confirmed", 0).when(F.col("confidence") == "multi-source", 1).otherwise(2)
    placed = groups.withColumn("_sure", F.when(F.col("confidence") == "confirmed", 0).otherwise(1)).withColumn("_rank", rank).withColumn("_level", level)
    n = F.col("position").cast("string")
    out = running(placed, [], ["_sure", "_rank", "_level", *extra]).drop("_sure", "_rank", "_level")
    return out.withColumn("group_id", F.concat(F.lit("B"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0"))))


def categorize(reports: DataFrame) -> DataFrame:
    """Adds category and group_by: collection problems by test module, reports without a resolved symbol by test file, all others by source.

    reports: failure_kind, test_name, called_symbols array<struct<name, symbol_id, file, resolution>>.
    """
    module = F.element_at(F.split("test_name", "::"), 1)
    unresolved = F.forall("called_symbols", lambda s: s["symbol_id"].isNull())
    category = F.when(F.col("failure_kind").isin("collection_error", "import_error"), "collection").when(F.coalesce(unresolved, F.lit(True)), "unresolved").otherwise("source")
    return reports.withColumn("category", category).withColumn("group_by", module)


def clusters(reports: DataFrame, id_col: str = "bug_id") -> DataFrame:
    """(file, symbol, bug_ids sorted, bugs): reports by their first resolved symbol."""
    first = F.get(F.filter("called_symbols", lambda s: s["symbol_id"].isNotNull()), F.lit(0))
    named = reports.withColumn("_s", first).where("_s is not null")
    return named.groupBy(F.col("_s.file").alias("file"), F.col("_s.symbol_id").alias("symbol")).agg(F.sort_array(F.collect_set(id_col)).alias("bug_ids"), F.countDistinct(id_col).alias("bugs"))


def group_tokens(reports: DataFrame, keys: list[str], text_cols: list[str], symbols: Column, per_symbol: int = 100) -> DataFrame:
    """Estimated tokens of each group: those of its texts, and a flat number for each symbol."""
    from gleanery.functions.text import estimated_tokens

    texts = sum((estimated_tokens(F.col(c)) for c in text_cols), F.lit(0))
    return reports.groupBy(*keys).agg((F.sum(texts) + F.lit(per_symbol) * F.sum(symbols)).cast("long").alias("estimated_tokens"))


def split_in_order(rows: DataFrame, keys: list[str], order: list[str], size: str, limit: float, most: int | None = None, most_rows: int = 10_000) -> DataFrame:
    """Numbers rows of each key by the part they go to: in order, a new part begins when the size would pass the limit or `most` rows are in it.

    A part is never empty, so a row beyond the limit stands alone; a null size is 0 and a negative one an error. Where a row goes depends on all rows of its
    key before it: keys of at most `most_rows` rows are folded as arrays, larger ones by `split_large`, which has no key in one place. Sums are exact for
    sizes that are whole numbers.
    """
    names = [*keys, *order, size]
    read = rows.select(*names, F.when(F.col(size) < 0, F.raise_error(F.lit("a size is negative"))).otherwise(F.coalesce(F.col(size).cast("double"), F.lit(0.0))).alias("_size"))
    large = read.groupBy(*keys).count().where(F.col("count") > most_rows).drop("count")
    if large.isEmpty():
        return _folded(read, keys, order, limit, most).select(*names, "part")
    large = cut(large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), "large-keys")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    small = _folded(read.join(large, same, "left_anti"), keys, order, limit, most)
    return small.unionByName(split_large(read.join(large, same, "left_semi"), keys, order, limit, most)).select(*names, "part")


def _folded(rows: DataFrame, keys: list[str], order: list[str], limit: float, most: int | None) -> DataFrame:
    """rows (with _size) with their part: each key's rows as one sorted array, folded from first to last."""
    kept = [c for c in rows.columns if c not in keys]
    item = F.struct(*order, *[c for c in kept if c not in order])
    start = F.struct(F.lit(0).cast("long").alias("part"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        new = (s["n"] == 0) | (s["total"] + x["_size"] > limit) | (s["n"] >= F.lit(most or 2**62))
        part = s["part"] + new.cast("long")
        total, n = F.when(new, x["_size"]).otherwise(s["total"] + x["_size"]), F.when(new, F.lit(1).cast("long")).otherwise(s["n"] + 1)
        return F.struct(part.alias("part"), total.alias("total"), n.alias("n"), F.concat(s["parts"], F.array(part)).alias("parts"))

    whole = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    placed = whole.withColumn("_parts", F.aggregate("_rows", start, step)["parts"])
    each = placed.select(*keys, F.explode(F.arrays_zip("_rows", "_parts")).alias("_z"))
    return each.select(*keys, "_z._rows.*", F.col("_z._parts").alias("part"))


def split_large(rows: DataFrame, keys: list[str], order: list[str], limit: float, most: int | None) -> DataFrame:
    """rows (with _size) with their part: from running sums follows where the part that would begin at a row would end, and so the begin of the next; pointer
    doubling tells which of these begins are reached from the first row."""
    placed = cut(running(rows, keys, order, "_size", "_no", "_upto"), "placed")
    lean = placed.select(*keys, "_no", "_upto", (F.col("_upto") - F.col("_size")).alias("_from"))
    ends = lean.select(*keys, F.col("_upto").alias("_at"), F.lit(0).alias("_side"), "_no")
    asks = lean.select(*keys, (F.col("_from") + F.lit(float(limit))).alias("_at"), F.lit(1).alias("_side"), "_no")
    sort = ["_at", "_side", "_no"]
    fits = scan(deal(ends.unionByName(asks), keys, sort), keys, sort, _last=("max", F.when(F.col("_side") == 0, F.col("_no")))).where("_side = 1")
    after = F.greatest(F.coalesce("_last", F.lit(0)), F.col("_no")) + 1
    after = F.least(after, F.col("_no") + most) if most else after
    totals = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("_no").alias("_n"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    node = lambda no: F.struct(*keys, no.cast("long").alias("no"))
    links = fits.join(totals, same).select(node(F.col("_no")).alias("node"), F.when(after <= F.col("_n"), node(after)).alias("next"))
    begins = reached(links, placed.where("_no = 1").select(node(F.col("_no")).alias("node"))).select(F.col("node").alias("_b"), F.lit(1).alias("_begin"))
    flagged = placed.withColumn("_node", node(F.col("_no"))).join(begins, F.col("_node") == F.col("_b"), "left").drop("_b", "_node")
    numbered = scan(deal(flagged, keys, ["_no"]), keys, ["_no"], part=("sum", F.coalesce("_begin", F.lit(0)).cast("long")))
    return numbered.select(*rows.columns, "part")


def coverage(every: DataFrame, grouped: DataFrame, excluded: DataFrame, id_col: str = "id") -> DataFrame:
    """(kind, id) of ids that are not exactly once in groups or exclusions: duplicate, overlap, missing, extra. Empty if the invariant holds."""
    one = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"))
    twice = grouped.groupBy(id_col).count().where("count > 1")
    both = grouped.select(id_col).intersect(excluded.select(id_col))
    placed = grouped.select(id_col).union(excluded.select(id_col)).distinct()
    missing = every.select(id_col).distinct().join(placed, id_col, "left_anti")
    extra = placed.join(every.select(id_col), id_col, "left_anti")
    return one(twice, "duplicate").union(one(both, "overlap")).union(one(missing, "missing")).union(one(extra, "extra"))


def numbered(groups: DataFrame, order: list, prefix: str = "G") -> DataFrame:
    out = running(groups, [], order)
    return out.withColumn("group_id", F.concat(F.lit(prefix), F.col("position").cast("string"))).drop("position")


def collected(*parts: DataFrame) -> DataFrame:
    """Candidates of all collectors in their order (column collector, from 0); what a collector lacks is null."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("collector", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def split_flaky(reports: DataFrame, flaky: str = "flaky") -> tuple[DataFrame, DataFrame]:
    """(excluded, remaining); a null is not flaky."""
    test = F.coalesce(F.col(flaky), F.lit(False))
    return reports.where(test), reports.where(~test)
