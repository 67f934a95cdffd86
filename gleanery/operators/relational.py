"""Queries over relational tables: filters, pages, existence, latest rows, fuzzy names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scoped(rows: DataFrame, **equal) -> DataFrame:
    """Rows where each named column equals its value; a value of None is no condition."""
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == F.lit(v))
    return rows


def page(rows: DataFrame, order: list, skip: int = 0, limit: int = 100) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)


def having(rows: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows with a partner (EXISTS)."""
    return rows.join(others.select(F.col(other_key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def lacking(rows: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    """Rows without a partner (NOT EXISTS); a null key has none."""
    return rows.join(others.select(F.col(other_key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """existing with those rows whose key it lacks, once each: an insert that ignores conflicts."""
    fresh = rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(existing.columns))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def update_rows(table: DataFrame, log: DataFrame, key: str, seq: str, cols: list[str]) -> DataFrame:
    """table with the last logged value of each column, where the log has one: updates as an append-only log."""
    last = log.groupBy(F.col(key).alias("_k")).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_{c}") for c in cols])
    out = table.join(last, table[key] == F.col("_k"), "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in table.columns])


def find_named(symbols: DataFrame, name: str, hint_file: str | None = None) -> DataFrame:
    """Symbols of a name: equal or the last part of a qualified name (2), else containing it (1); best first, the hinted file first."""
    q = F.col("qualified_name")
    exact = (F.col("name") == name) | (q == name) | q.endswith("." + name)
    score = F.when(exact, 2).when(F.contains(q, F.lit(name)), 1).otherwise(0)
    hint = F.when(F.col("file") == F.lit(hint_file), 0).otherwise(1)
    return symbols.withColumn("match", score).where("match > 0").orderBy(F.desc("match"), hint, "file", "line_start", "id")


def search_history(rows: DataFrame, status: str | None, text: str, status_col: str, cols: list[str]) -> DataFrame:
    """Rows of a status in which some column has the text, whatever the case; blanks round the text don't count."""
    q = text.strip().lower()
    out = scoped(rows, **{status_col: status})
    test = F.lit(False)
    for c in cols:
        test = test | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
    return out.where(test) if q else out


def live(entries: DataFrame, now, pattern: str = "%") -> DataFrame:
    """Entries (key, value, expires_at) of a key pattern that have not expired; without expiry they stay."""
    return entries.where(F.col("key").like(pattern) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def tests_of_sources(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(test_path, source_path): a test's source by its rewritten path, or by the source's stem anywhere in the test's path.

    tests: test_path; sources: source_path. A stem meets the paths that have its rarest run of three characters (a shorter stem: the stem itself), which
    every path that contains it has; both rules are checked on the pairs. The rewritten path contains the stem, so the rule asks for no pairs of its own.
    """
    runs = lambda c, n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1))), lambda i: i + (n - 1) <= F.length(c)), lambda i: F.substring(c, i, F.lit(n)))
    stem = F.regexp_replace(F.regexp_replace("source_path", "^src/", ""), r"\.py$", "")
    s = sources.select("source_path").distinct().withColumn("_stem", stem).where("_stem <> ''")
    of = s.withColumn("_run", F.explode(F.when(F.length("_stem") < 3, F.array("_stem")).otherwise(F.array_distinct(runs(F.col("_stem"), 3)))))
    often = of.groupBy("_run").agg(F.count("*").alias("_often"))
    key = of.join(often, "_run").groupBy("source_path", "_stem").agg(F.min_by("_run", F.struct("_often", "_run")).alias("_run"))
    t = tests.select("test_path").distinct()
    t = t.withColumn("_run", F.explode(F.array_distinct(F.concat(*[runs(F.col("test_path"), n) for n in (1, 2, 3)]))))
    rewritten = F.element_at(F.split(F.replace("test_path", F.lit("tests/test_"), F.lit("src/")), "::"), 1)
    return t.join(key, "_run").where((rewritten == F.col("source_path")) | F.contains("test_path", F.col("_stem"))).select("test_path", "source_path").distinct()


#: Up to so many distinct words of items are literals of the scan of texts.
HELD = 5_000


def holders(rows: DataFrame, items: DataFrame, text: str, item: str) -> DataFrame:
    """Pairs of rows and items whose text the row's text holds.

    What stands between the first and the last blank of an item are whole words of any text that holds it. Texts and items meet by the longest of these
    words; only items without such a word, of two words or less, are looked for in every text.
    """
    words = lambda c: F.filter(F.split(c, "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    inner = F.filter(F.split(F.col(item), "[ \\t\\n\\x0B\\f\\r]+"), lambda x, i: (i > 0) & (i < F.size(F.split(F.col(item), "[ \\t\\n\\x0B\\f\\r]+")) - 1))
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    keyed = items.withColumn("_word", longest)
    some = [r[0] for r in keyed.where("_word is not null").select("_word").distinct().limit(HELD + 1).collect()]  # bounded
    own = F.array_intersect(F.split(F.col(text), "[ \\t\\n\\x0B\\f\\r]+"), F.lit(some) if some else F.array().cast("array<string>")) if len(some) <= HELD else F.array_distinct(words(F.col(text)))
    met = rows.withColumn("_word", F.explode(own)).join(keyed.where("_word is not null"), "_word").drop("_word").where(F.contains(text, F.col(item)))
    short = keyed.where("_word is null").drop("_word")
    return met if short.isEmpty() else met.unionByName(rows.join(short, F.contains(text, F.col(item))))
