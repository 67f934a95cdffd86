"""How far the sources of a language differ in their words: term counts in DuckDB by shards of (lang, term), partial sums of pairs of sources, merged by Spark.

A first pass counts the terms of each batch of texts, so that a frequent word or a large source sends one row for each task and not one for each occurrence.
Shards are dealt by lang and term; each is counted, and later compared, by one vectorised SQL statement. Their number follows the rows counted.
"""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_bytes, cut, forget, lean, width

#: Fixed value: a term, in UTF-8 bytes: letters of ASCII and everything beyond it.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Counted rows that a shard has on average at most, and terms times sources that a shard compares: each shard sends a row for each pair of sources, so
#: the second follows the work alone and not the number of tasks.
SHARD_ROWS = 1_000_000
SHARD_SHARES = 100_000
#: Entries of a task's counts before they are sent on.
HELD = 300_000

COUNTED = "lang string, source string, term string, n bigint, df bigint"
COMPARED = "part string, lang string, a string, b string, value bigint"

COUNT_SQL = """
WITH c AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(df)::BIGINT AS df FROM counted WHERE term IS NOT NULL GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(df) >= {least})
SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source))::INTEGER AS nth FROM c SEMI JOIN k USING (lang, term)
"""
COMPARE_SQL = """
WITH share AS (
  SELECT t.lang, t.term, g.source, coalesce(k.n, 0) AS n, 1 + ((1000000000::HUGEINT * (coalesce(k.n, 0) + 2)) // (g.n_source + 2 * g.terms))::BIGINT AS p,
         1 + ((1000000000::HUGEINT * (t.n + 2)) // (g.n_lang + 2 * g.terms))::BIGINT AS q
  FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM kept GROUP BY ALL) t JOIN groups g USING (lang)
  LEFT JOIN kept k ON k.lang = t.lang AND k.term = t.term AND k.source = g.source),
pairs AS (
  SELECT x.lang, x.source AS a, y.source AS b, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p))::BIGINT AS value
  FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term AND x.source < y.source GROUP BY ALL),
terms AS (
  SELECT lang, source AS a, term AS b, ((p - q) * (p - q)) // (p + q) AS value FROM share WHERE n > 0 AND p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, b) <= {top})
SELECT 'pair' AS part, lang, a, b, value FROM pairs UNION ALL SELECT 'term', lang, a, b, value FROM terms
"""


def answered(sql: str, schema: pa.Schema, **tables: pa.Table) -> pa.Table:
    """The rows of one statement over Arrow tables, by one thread of an in-memory database."""
    con = duckdb.connect(config={"threads": 1})
    try:
        for name, t in tables.items():
            con.register(name, t)
        return con.sql(sql).to_arrow_table().cast(schema)
    finally:
        con.close()


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def counted_batches(batches):
    """(lang, source, term, n, df) of texts, a few rows for each term and task; each group once more with a null term."""
    schema = arrow_schema(COUNTED)
    held: dict = {}

    def sent():
        rows = [(lang, source, None, 0, 0) for lang, source in held]
        rows += [(lang, source, t.decode(), n, df) for (lang, source), (ns, dfs) in held.items() for (t, n), df in zip(ns.items(), dfs.values(), strict=True)]
        held.clear()
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 50_000], strict=True), schema, strict=True)], schema=schema)

    for b in batches:
        texts = b.column(0).cast(pa.binary())
        for text, lang, source in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            ns, dfs = held.setdefault((lang, source), ({}, {}))
            for t, n in Counter(TERM.findall(text.as_py().translate(LOWER))).items():
                ns[t] = ns.get(t, 0) + n
                dfs[t] = dfs.get(t, 0) + 1
        if sum(len(ns) for ns, _ in held.values()) > HELD:
            yield from sent()
    yield from sent()


def term_counts(docs: DataFrame, least: int, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, source, term, n > 0, nth: place of the source among the term's), and groups (lang, source, n_source, n_lang, terms).

    A term is kept where `least` documents (rows) of the language have it.
    """
    spark = docs.sparkSession
    arrow_bytes(spark)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{k}") for k, c in enumerate((text, lang, source))])
    counted = cut(read.mapInArrow(lean(counted_batches), COUNTED), "term-counts")
    shards = max(width(spark), counted.count() // SHARD_ROWS + 1)
    sql, schema = COUNT_SQL.format(least=least), "lang string, source string, term string, n bigint, nth int"

    def each(batches):
        if shard := list(batches):
            yield from answered(sql, arrow_schema(schema), counted=pa.Table.from_batches(shard)).to_batches(50_000)

    kept = cut(counted.where("term IS NOT NULL").repartition(shards, "lang", "term").mapInArrow(lean(each), schema), "kept-terms")
    groups = counted.select("lang", "source").distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count(F.when(F.col("nth") == 1, 1)).alias("terms"))
    whole = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    whole = cut(whole.select("lang", "source", "n_source", "n_lang", "terms"), "term-groups")
    forget(counted)
    return kept, whole


def divergences(docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from each other source of its language, and the `top` terms it has too much of.

    A group's share of a term, in billionths and smoothed by two occurrences, is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with V kept terms and N their
    occurrences. Two shares are floor((p - q)^2 / (p + q)) apart. Part `pair` has the sum over all kept terms for each other source, part `term` the kept
    terms that the source has and whose share is above the language's. Whole numbers throughout, so results do not depend on the order of sums.

    Defined results: null texts, languages and sources are empty strings; repeated rows are documents of their own; a language without kept terms has pairs of
    value 0 and no terms; a language of one source has no pairs; an empty table gives no rows. Ties go by item, in the order of UTF-8.
    """
    kept, groups = term_counts(docs, least, text, lang, source)
    work = groups.groupBy("lang").agg(F.max("terms").alias("v"), F.count("*").alias("s")).agg(F.sum(F.col("v") * F.col("s"))).first()[0] or 0
    shards = work // SHARD_SHARES + 1
    sql = COMPARE_SQL.format(top=top)
    kept_schema = arrow_schema("lang string, source string, term string, n bigint")
    group_schema = arrow_schema("lang string, source string, n_source bigint, n_lang bigint, terms bigint")

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        out = arrow_schema(COMPARED)
        if not left.num_rows:
            return out.empty_table()
        return answered(sql, out, kept=left.select(kept_schema.names).cast(kept_schema), groups=right.select(group_schema.names).cast(group_schema))

    dealt = kept.select("lang", "source", "term", "n", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"))
    everywhere = groups.where("terms > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = cut(dealt.groupBy("shard").cogroup(everywhere.groupBy("shard")).applyInArrow(lean(each), COMPARED), "divergences")
    sums = found.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both.alias("e"), "value").select("lang", "e.*", "value")
    bare = groups.where("terms = 0").select("lang", "source")
    other = bare.select(F.col("lang").alias("_l"), F.col("source").alias("item"))
    zero = bare.join(other, (F.col("lang") == F.col("_l")) & (F.col("source") != F.col("item"))).select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = found.where("part = 'term'").select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    return ranked(pairs.unionByName(zero), "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


#: The same by SQL over all documents at once.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(df) >= 10),
v AS (SELECT lang, count(*) AS terms, sum(n) AS n_lang FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT c.lang, c.source, sum(c.n) AS n_source FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
share AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.n_source, 0) + 2 * v.terms) AS BIGINT) AS p,
         CAST(1 + (1000000000 * (k.n + 2)) // (v.n_lang + 2 * v.terms) AS BIGINT) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM share WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""
