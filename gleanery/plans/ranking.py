"""Ranked retrieval over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.functions.stem import with_stems
from gleanery.operators import bm25, fuse, metrics, relational
from gleanery.plans.registry import query, sql_classes, sql_parted, table

STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
TERMS = ("the", "erthion", "ingth", "edand", "tion", "tion", "tion", "wherever")

#: Tokens of documents as DuckDB sees them: words split at case and digit boundaries and underscores, the whole word behind its pieces.
TOKENS = rf"""
words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9_]+')) AS w FROM documents),
plain AS (SELECT doc_id, w, regexp_replace(w, '[^a-zA-Z0-9]+', ' ', 'g') AS x FROM words),
split AS (SELECT doc_id, w, list_filter(string_split_regex(trim({sql_parted("x", "k")}), ' +'), lambda y: y <> '') AS p FROM (SELECT *, {sql_classes("x")} AS k FROM plain)),
tok AS (SELECT doc_id, term FROM (SELECT doc_id, lower(unnest(CASE WHEN len(p) > 1 THEN list_append(p, w) ELSE p END)) AS term FROM split)
    WHERE length(term) >= 2 AND term NOT IN ({STOP})),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY ALL),
st AS (SELECT count(*) AS n, sum(length)::DOUBLE / count(*) AS avgdl FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL)"""
SCORED = """
parts AS (SELECT query_id, tf.doc_id, term, weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl)) AS c
    FROM tf JOIN df USING (term) JOIN q USING (term) JOIN len ON tf.doc_id = len.doc_id, st),
scored AS (SELECT query_id, doc_id, round(sum(c), 6) AS score FROM parts GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""
ONE = f"q AS (SELECT 'q' AS query_id, term, least(count(*), 2) AS weight FROM (SELECT unnest([{', '.join(repr(t) for t in TERMS)}]) AS term) GROUP BY ALL)"


def one_query(spark):
    return bm25.query_weights(spark.createDataFrame([("q", list(TERMS))], "query_id string, terms array<string>"), "query_id", "terms")


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("bm25_topk", f"WITH {TOKENS}, {ONE}, {SCORED} SELECT query_id, doc_id, score, rank FROM hits WHERE rank <= 10")
def bm25_topk(spark, d):
    return bm25.search(docs(spark, d), one_query(spark), "doc_id", "text").drop("breakdown")


@query("bm25_breakdown", f"WITH {TOKENS}, {ONE}, {SCORED} SELECT hits.doc_id, rank, parts.term, round(c, 6) AS contribution FROM hits JOIN parts ON hits.doc_id = parts.doc_id WHERE rank <= 10")
def bm25_breakdown(spark, d):
    hits = bm25.search(docs(spark, d), one_query(spark), "doc_id", "text")
    return hits.select("doc_id", "rank", F.explode("breakdown").alias("b")).select("doc_id", "rank", "b.term", "b.contribution")


@query("top_contributions", f"WITH {TOKENS}, {ONE}, {SCORED}, o AS (SELECT hits.doc_id, parts.term, row_number() OVER (PARTITION BY hits.doc_id ORDER BY round(c, 6) DESC, parts.term) AS r FROM hits JOIN parts ON hits.doc_id = parts.doc_id WHERE rank <= 10) SELECT doc_id, string_agg(term, ',' ORDER BY r) AS terms FROM o WHERE r <= 3 GROUP BY ALL")
def top_contributions(spark, d):
    hits = bm25.search(docs(spark, d), one_query(spark), "doc_id", "text")
    return hits.select("doc_id", F.array_join(bm25.top_contributions(F.col("breakdown")), ",").alias("terms"))


MULTI = rf"""q AS (SELECT query_id, term, least(count(*), 2) AS weight FROM (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z0-9_]+'))) AS term FROM benchmark)
    WHERE length(term) >= 5 GROUP BY ALL)"""


def benchmark_weights(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.filter(F.transform(F.regexp_extract_all("text", F.lit("[a-zA-Z0-9_]+"), F.lit(0)), lambda x: F.lower(x)), lambda x: F.length(x) >= 5).alias("terms"))
    return bm25.query_weights(q, "query_id", "terms")


@query("bm25_multi_query", f"WITH {TOKENS}, {MULTI}, {SCORED} SELECT query_id, doc_id, score, rank FROM hits WHERE rank <= 10")
def bm25_multi_query(spark, d):
    return bm25.search(docs(spark, d), benchmark_weights(spark, d), "doc_id", "text").drop("breakdown")


HOLDS = "truth AS (SELECT item_id AS query_id, min(doc_id) AS expected_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL)"


def truth(spark, d):
    """The first document that holds each benchmark item."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    return relational.holders(docs(spark, d), b, "text", "item").groupBy("query_id").agg(F.min("doc_id").alias("expected_id"))


@query("hit_at_k", f"WITH {TOKENS}, {MULTI}, {SCORED}, {HOLDS} SELECT t.query_id, expected_id, rank, CASE WHEN rank IS NULL THEN 'MISS' WHEN rank <= 1 THEN 'HIT@1' WHEN rank <= 3 THEN 'HIT@3' WHEN rank <= 10 THEN 'HIT@10' ELSE 'MISS' END AS label FROM truth t LEFT JOIN (SELECT * FROM hits WHERE rank <= 10) h ON t.query_id = h.query_id AND expected_id = doc_id")
def hit_at_k(spark, d):
    hits = bm25.search(docs(spark, d), benchmark_weights(spark, d), "doc_id", "text")
    return metrics.hits_at(truth(spark, d), hits, "query_id", "doc_id")


@query("hit_rates", f"WITH {TOKENS}, {MULTI}, {SCORED}, {HOLDS}, l AS (SELECT rank FROM truth t LEFT JOIN (SELECT * FROM hits WHERE rank <= 10) h ON t.query_id = h.query_id AND expected_id = doc_id) SELECT count(*) AS queries, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 3) AS top3, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank <= 10) AS top10, count(*) FILTER (rank IS NULL) AS missed FROM l")
def hit_rates(spark, d):
    return metrics.hit_rates(hit_at_k(spark, d))


@query("term_stats", f"WITH {TOKENS} SELECT doc_id, term, tf FROM tf")
def term_stats(spark, d):
    return bm25.term_counts(docs(spark, d), "doc_id", X.tokenize(F.col("text")))


@query("postings_df", f"WITH {TOKENS} SELECT term, count(*) AS df, string_agg(doc_id || ':' || tf, ',' ORDER BY doc_id) AS postings FROM tf GROUP BY ALL")
def postings_df(spark, d):
    p = bm25.postings(term_stats(spark, d), "doc_id")
    return p.select("term", "df", F.array_join(F.transform("postings", lambda x: F.concat_ws(":", x["doc_id"], x["tf"])), ",").alias("postings"))


@query("corpus_stats", f"WITH {TOKENS} SELECT count(*) AS n, sum(length)::BIGINT AS tokens, round(sum(length)::DOUBLE / count(*), 6) AS avgdl FROM len")
def corpus_stats(spark, d):
    return bm25.corpus_stats(docs(spark, d).select(F.size(X.tokenize(F.col("text"))).cast("long").alias("length"))).withColumn("avgdl", F.round("avgdl", 6))


@query("query_weights", f"WITH {MULTI} SELECT query_id, term, weight FROM q")
def query_weights(spark, d):
    return benchmark_weights(spark, d)


SECOND = """, other AS (SELECT l.doc_id, (quality * 2 + toxic)::DOUBLE AS score FROM labels l WHERE quality * 2 + toxic > 0),
orank AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM other)"""


def two_rankings(spark, d):
    a = bm25.search(docs(spark, d), one_query(spark), "doc_id", "text", k=50).select("query_id", "doc_id", "score", "rank")
    b = table(spark, d, "labels").select(F.lit("q").alias("query_id"), "doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("double").alias("score")).where("score > 0")
    return a, bm25.top_k(b, "query_id", "doc_id", 50)


@query("fused_rank", f"WITH {TOKENS}, {ONE}, {SCORED}{SECOND}, a AS (SELECT * FROM hits WHERE rank <= 50), b AS (SELECT * FROM orank WHERE rank <= 50), f AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(0.5 * coalesce(a.score / (SELECT max(score) FROM a), 0) + 0.5 * coalesce(b.score / (SELECT max(score) FROM b), 0), 6) AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id) SELECT 'q' AS query_id, doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f")
def fused_rank(spark, d):
    a, b = two_rankings(spark, d)
    return fuse.fuse(a, b, ["query_id"], "doc_id")


@query("combine_rank", f"WITH {TOKENS}, {ONE}, {SCORED}{SECOND}, u AS (SELECT doc_id, 0 AS o, rank FROM hits WHERE rank <= 50 UNION ALL SELECT doc_id, 1, rank FROM orank WHERE rank <= 50), m AS (SELECT doc_id, min(o * 1000000 + rank) AS m FROM u GROUP BY ALL) SELECT 'q' AS query_id, doc_id, row_number() OVER (ORDER BY m, doc_id) AS rank FROM m")
def combine_rank(spark, d):
    a, b = two_rankings(spark, d)
    return fuse.combine(a, b, ["query_id"], "doc_id")


@query("post_filter", f"WITH {TOKENS}, {ONE}, {SCORED} SELECT doc_id, rank FROM hits WHERE rank <= 10 AND doc_id % 3 <> 0")
def post_filter(spark, d):
    """Test-like documents leave after the top k, so fewer than k may stay."""
    return bm25_topk(spark, d).where("doc_id % 3 <> 0").select("doc_id", "rank")


@query("light_stem_terms", f"WITH {TOKENS} SELECT term, CASE WHEN term LIKE '%ies' AND length(term) > 4 THEN left(term, length(term) - 3) || 'y' WHEN term LIKE '%ed' AND length(term) > 5 THEN left(term, length(term) - 2) WHEN term LIKE '%ing' AND length(term) > 6 THEN left(term, length(term) - 3) WHEN term LIKE '%ates' AND length(term) > 5 THEN left(term, length(term) - 1) WHEN term LIKE '%es' AND length(term) > 5 THEN left(term, length(term) - 2) WHEN term LIKE '%s' AND length(term) > 3 AND term NOT LIKE '%ss' THEN left(term, length(term) - 1) ELSE term END AS stem FROM df")
def light_stem_terms(spark, d):
    return term_stats(spark, d).select("term").distinct().withColumn("stem", X.light_stem(F.col("term")))


@query("porter2_stems")
def porter2_stems(spark, d):
    return with_stems(term_stats(spark, d).select("term").distinct())


@query("searchable_chunks", f"WITH {TOKENS} SELECT d.doc_id, coalesce(length, 0) AS token_count FROM documents d JOIN len USING (doc_id) WHERE d.doc_id % 7 <> 0")
def searchable_chunks(spark, d):
    c = docs(spark, d).select("doc_id", F.size(X.tokenize(F.col("text"))).cast("long").alias("token_count"), (F.col("doc_id") % 7 == 0).alias("is_test"))
    return bm25.searchable(c).select("doc_id", "token_count")
