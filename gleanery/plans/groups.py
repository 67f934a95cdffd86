"""Spans, groups, packing and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.operators import group, interval, pack, validate
from gleanery.plans.registry import query, table

SPANS = "spans AS (SELECT l_orderkey % 97 AS k, l_orderkey AS o, l_linenumber AS ln, (l_partkey * 3)::BIGINT AS s, (l_partkey * 3 + l_quantity)::BIGINT AS e FROM lineitem)"


def spans(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") % 97).alias("k"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"), (F.col("l_partkey") * 3).alias("s"), F.rint(F.col("l_partkey") * 3 + F.col("l_quantity")).cast("long").alias("e"))


@query("proximity_merge", f"WITH {SPANS}, f AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spans), g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS group_no FROM f) SELECT k, group_no::BIGINT AS group_no, min(s) AS span_start, max(e) AS span_end, count(*) AS members FROM g GROUP BY k, group_no")
def proximity_merge(spark, d):
    return interval.merge_near(spans(spark, d), ["k"], "s", "e", 3)


@query("bucket_candidates", f"WITH {SPANS} SELECT k, ln, count(*) AS n, min(s) AS first FROM spans GROUP BY k, ln")
def bucket_candidates(spark, d):
    return spans(spark, d).groupBy("k", "ln").agg(F.count("*").alias("n"), F.min("s").alias("first"))


@query("enclosing_interval", f"WITH {SPANS}, p AS (SELECT event_id, user_id % 97 AS k, (event_id * 7) % 6000 AS pt FROM events), sp AS (SELECT k, o * 10 + ln AS id, s, e FROM spans) SELECT event_id, arg_min(id, (e - s) * 1000000000000 + id) AS id FROM p LEFT JOIN sp ON p.k = sp.k AND pt BETWEEN s AND e GROUP BY event_id")
def enclosing_interval(spark, d):
    return enclosing_spans(spark, d, spans(spark, d))


def enclosing_spans(spark, d, some):
    p = table(spark, d, "events").select("event_id", (F.col("user_id") % 97).alias("k"), ((F.col("event_id") * 7) % 6000).alias("at"))
    s = some.select("k", "s", "e", (F.col("o") * 10 + F.col("ln")).alias("id"))
    return interval.enclosing(p, s, "k", "at", "s", "e", "id", ["event_id"])


@query("overlap_check", f"WITH {SPANS}, sp AS (SELECT k, s, e, o * 10 + ln AS id FROM spans), n AS (SELECT k, id, e, lead(id) OVER w AS next_id, lead(s) OVER w AS ns FROM sp WINDOW w AS (PARTITION BY k ORDER BY s, e, id)) SELECT k, id, next_id FROM n WHERE ns <= e")
def overlap_check(spark, d):
    s = spans(spark, d).select("k", "s", "e", (F.col("o") * 10 + F.col("ln")).alias("id"))
    return interval.overlaps(s, ["k"], "s", "e", "id")


@query("as_of_last", "WITH m AS (SELECT user_id, event_id AS mark, value AS v FROM events WHERE event_type = 'purchase') SELECT event_id, (SELECT arg_max(v, mark) FROM m WHERE m.user_id = e.user_id AND mark <= e.event_id) AS last_v FROM events e WHERE event_type = 'view'")
def as_of_last(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    marks = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("mark"), F.col("value").alias("v"))
    return interval.last_before(e.where("event_type = 'view'").select("user_id", "event_id"), marks, "user_id", "event_id", "mark", "v").select("event_id", "last_v")


@query("confidence_groups", "WITH g AS (SELECT user_id, count(DISTINCT event_type) AS n, bool_or(event_type = 'error') AS v FROM events GROUP BY user_id) SELECT user_id, CASE WHEN v THEN 'confirmed' WHEN n >= 2 THEN 'multi-source' ELSE 'single-source' END AS confidence FROM g")
def confidence_groups(spark, d):
    return confidences(table(spark, d, "events"))


def confidences(events):
    g = events.groupBy("user_id").agg(F.collect_set("event_type").alias("s"), F.bool_or(F.col("event_type") == "error").alias("v"))
    return g.select("user_id", group.confidence(F.col("s"), F.col("v")).alias("confidence"))


SOURCE = "CASE event_type WHEN 'error' THEN 'pytest' WHEN 'click' THEN 'llm' WHEN 'signup' THEN 'heuristic' ELSE 'ruff' END"


@query("report_order", f"WITH g AS (SELECT user_id, list(DISTINCT {SOURCE}) AS s, bool_or(event_type = 'purchase' AND event_id % 3 = 0) AS v, min(event_id) AS line FROM events GROUP BY user_id), c AS (SELECT *, CASE WHEN v THEN 0 WHEN len(s) >= 2 THEN 1 ELSE 2 END AS level, list_min(list_transform(s, lambda x: CASE x WHEN 'pytest' THEN 0 WHEN 'llm' THEN 1 WHEN 'heuristic' THEN 2 ELSE 3 END)) AS r FROM g), o AS (SELECT user_id, row_number() OVER (ORDER BY CASE WHEN level = 0 THEN 0 ELSE 1 END, r, level, user_id, line) AS position FROM c) SELECT user_id, position, 'B' || lpad(position::VARCHAR, greatest(3, length(position::VARCHAR))::INTEGER, '0') AS group_id FROM o")
def report_order(spark, d):
    n = F.col("position").cast("string")
    return reports_in_order(table(spark, d, "events")).withColumn("group_id", F.concat(F.lit("B"), F.lpad(n, F.greatest(F.lit(3), F.length(n)), F.lit("0"))))


def reports_in_order(events):
    src = F.when(F.col("event_type") == "error", "pytest").when(F.col("event_type") == "click", "llm").when(F.col("event_type") == "signup", "heuristic").otherwise("ruff")
    g = events.groupBy("user_id").agg(F.collect_set(src).alias("sources"), F.bool_or((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)).alias("v"), F.min("event_id").alias("line"))
    g = g.withColumn("confidence", group.confidence(F.col("sources"), F.col("v")))
    return group.report_order(g, "sources", ("user_id", "line")).select("user_id", "position", "group_id")


@query("coverage_invariant", "WITH g AS (SELECT doc_id AS id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 50 = 0 UNION ALL SELECT -1), x AS (SELECT doc_id AS id FROM documents WHERE doc_id % 100 < 40), e AS (SELECT doc_id AS id FROM documents) SELECT 'duplicate' AS kind, id::VARCHAR AS id FROM g GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'overlap', id::VARCHAR FROM (SELECT id FROM g INTERSECT SELECT id FROM x) UNION ALL SELECT 'missing', id::VARCHAR FROM (SELECT id FROM e EXCEPT (SELECT id FROM g UNION SELECT id FROM x)) UNION ALL SELECT 'extra', id::VARCHAR FROM ((SELECT id FROM g UNION SELECT id FROM x) EXCEPT SELECT id FROM e)")
def coverage_invariant(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    g = lab.union(lab.where("id % 50 = 0")).union(spark.range(1).select(F.lit(-1).cast("long").alias("id")))
    return group.coverage(docs, g, docs.where("id % 100 < 40"))


@query("budget_fill", "WITH r AS (SELECT doc_id, lang, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position FROM documents), o AS (SELECT *, min(position) FILTER (used > 50000) OVER (PARTITION BY lang) AS over, max(CASE WHEN used = 50000 THEN 1 ELSE 0 END) OVER (PARTITION BY lang) AS full_ FROM r) SELECT doc_id, used::BIGINT AS used, position, CASE WHEN used <= 50000 THEN 'taken' WHEN position = over OR full_ = 1 THEN 'over_budget' ELSE 'not_considered' END AS fate FROM o")
def budget_fill(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return pack.fill(docs, ["lang"], ["doc_id"], "n_chars", 50_000).select("doc_id", "used", "position", "fate")


@query("pack_manifest", "WITH r AS (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) SELECT lang, count(*) FILTER (used <= 50000) AS included, count(*) FILTER (used > 50000) AS dropped, coalesce(sum(n_chars) FILTER (used <= 50000), 0)::BIGINT AS tokens FROM r GROUP BY lang")
def pack_manifest(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("tokens"))
    return pack.manifest(pack.fill(docs, ["lang"], ["doc_id"], "tokens", 50_000), ["lang"])


TIERS = "t AS (SELECT doc_id, n_chars AS r, doc_id * 7 % 2500 AS a, doc_id * 11 % 1500 AS b, doc_id * 13 % 900 AS c FROM documents)"


@query("tier_budget", f"WITH {TIERS}, x AS (SELECT *, r < 8400.0 AND r + a < 9600.0 AS t4 FROM t), y AS (SELECT *, r + CASE WHEN t4 THEN a ELSE 0 END AS r4 FROM x), z AS (SELECT *, r4 < 9600.0 AND r4 + b < 10200.0 AS t5 FROM y), w AS (SELECT *, r4 + CASE WHEN t5 THEN b ELSE 0 END AS r5 FROM z) SELECT doc_id, t4, t5, (r5 < 10200.0 AND c > 0 AND r5 + c < 10800.0) AS t6, (r5 + CASE WHEN r5 < 10200.0 AND c > 0 AND r5 + c < 10800.0 THEN c ELSE 0 END + 50)::BIGINT AS total FROM w")
def tier_budget(spark, d):
    k = F.col("doc_id")
    t = pack.tiers(F.col("n_chars"), k * 7 % 2500, k * 11 % 1500, k * 13 % 900, F.lit(50))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", "t.t4", "t.t5", "t.t6", "t.total")


@query("tier_shares", "WITH x AS (SELECT doc_id, n_chars AS r, CASE WHEN n_chars <= 10000 AND least(2000, 10000 - n_chars) > 100 THEN least(2000, 10000 - n_chars) ELSE 0 END AS f FROM documents) SELECT doc_id, r > 10000 AS overflow, f::BIGINT AS t4_budget, (CASE WHEN r <= 10000 AND least(1000, 10000 - r - f) > 100 THEN least(1000, 10000 - r - f) ELSE 0 END)::BIGINT AS t5_budget FROM x")
def tier_shares(spark, d):
    return table(spark, d, "documents").select("doc_id", pack.shares(F.col("n_chars")).alias("s")).select("doc_id", "s.overflow", "s.t4_budget", "s.t5_budget")


@query("split_in_order", "WITH RECURSIVE o AS (SELECT o_custkey AS k, o_orderkey AS id, (o_orderkey % 9 + 1)::DOUBLE AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders), r AS (SELECT k, id, n, size AS s, 1 AS c, 1::BIGINT AS part FROM o WHERE n = 1 UNION ALL SELECT o.k, o.id, o.n, CASE WHEN r.s + o.size > 12 OR r.c >= 3 THEN o.size ELSE r.s + o.size END, CASE WHEN r.s + o.size > 12 OR r.c >= 3 THEN 1 ELSE r.c + 1 END, CASE WHEN r.s + o.size > 12 OR r.c >= 3 THEN part + 1 ELSE part END FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1) SELECT k AS o_custkey, id AS o_orderkey, part FROM r")
def split_in_order(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 9 + 1).cast("double").alias("size"))
    return group.split_in_order(o, ["o_custkey"], ["o_orderkey"], "size", 12.0, 3).select("o_custkey", "o_orderkey", "part")


@query("assertion_places", """WITH m AS (SELECT l_orderkey % 50 AS k, l_partkey AS pos, l_linenumber AS v, l_orderkey AS o FROM lineitem WHERE l_linenumber > 1),
    n AS (SELECT k, pos, v, o, row_number() OVER (PARTITION BY k ORDER BY pos, o * 10 + v) AS ordinal, count(*) OVER (PARTITION BY k) AS total FROM m),
    r AS (SELECT o_orderkey AS id, o_orderkey % 50 AS k, o_custkey * 2 - 40 AS pos FROM orders),
    w AS (SELECT r.id, r.k, greatest(1, count(m.k)) AS ordinal FROM r LEFT JOIN m ON m.k = r.k AND m.pos <= r.pos GROUP BY r.id, r.k)
    SELECT w.id, n.o * 10 + n.v AS mark, n.ordinal, n.total, n.total - n.ordinal AS not_evaluated FROM w JOIN n ON n.k = w.k AND n.ordinal = w.ordinal""")
def assertion_places(spark, d):
    """The last mark at or before each place, or the first of all, with its ordinal, their total and how many were not evaluated."""
    m = table(spark, d, "lineitem").where("l_linenumber > 1")
    marks = m.select((F.col("l_orderkey") % 50).alias("k"), F.col("l_partkey").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mark"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).alias("k"), (F.col("o_custkey") * 2 - 40).alias("at"))
    return interval.reached_marks(rows, marks, "k", "at", "line", "mark").select("id", "mark", "ordinal", "total", "not_evaluated")


@query("freshness_diff", "SELECT path, state FROM (SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 13 = 0 THEN 'deleted' WHEN doc_id % 10 = 0 THEN 'changed' ELSE 'ok' END AS state FROM documents)")
def freshness_diff(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    now = docs.where("doc_id % 13 <> 0").select("path", F.sha1(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary")).alias("sha1"))
    return validate.freshness(docs.select("path", F.sha1(F.col("text").cast("binary")).alias("sha1")), now)


EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


@query("mirror_check", f"WITH {EDGES}, b AS (SELECT dst AS src, src AS dst FROM e WHERE (src + dst) % 29 <> 0) SELECT 'no mirror' AS kind, src || '->' || dst AS detail FROM e WHERE (src + dst) % 29 = 0")
def mirror_check(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return validate.asymmetric(e, e.where("(src + dst) % 29 <> 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("dangling_check", "SELECT 'dangling' AS kind, id::VARCHAR AS detail FROM (SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT DISTINCT o_orderkey FROM orders) WHERE id NOT IN (SELECT c_custkey FROM customer)")
def dangling_check(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return validate.dangling(e, table(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("first_seen", "SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL)")
def first_seen(spark, d):
    once = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return once.withColumn("ordinal", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))


REPORTS = "r AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'f' || (event_id % 17) END AS f, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 's' || (event_id % 53) END AS s FROM events)"


def reports(spark, d):
    kind = F.when(F.col("event_type") == "error", "import_error").otherwise("assertion")
    known = F.col("event_id") % 3 != 0
    sym = F.struct(F.lit("n").alias("name"), F.when(known, F.concat(F.lit("s"), F.col("event_id") % 53)).alias("symbol_id"), F.when(known, F.concat(F.lit("f"), F.col("event_id") % 17)).alias("file"), F.lit("x").alias("resolution"))
    return table(spark, d, "events").select(F.col("event_id").alias("bug_id"), kind.alias("failure_kind"), F.concat(F.lit("tests/t"), F.col("user_id") % 20, F.lit(".py::test_x")).alias("test_name"), F.array(sym).alias("called_symbols"), F.col("props").alias("code"), F.col("event_type").alias("error_message"), "user_id")


@query("categorize", "SELECT CASE WHEN event_type = 'error' THEN 'collection' WHEN event_id % 3 = 0 THEN 'unresolved' ELSE 'source' END AS category, 'tests/t' || (user_id % 20) || '.py' AS group_by, count(*) AS n FROM events GROUP BY ALL")
def categorize(spark, d):
    return group.categorize(reports(spark, d)).groupBy("category", "group_by").agg(F.count("*").alias("n"))


@query("suspect_clusters", f"WITH {REPORTS} SELECT f AS file, s AS symbol, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS bug_ids, count(*) AS bugs FROM r WHERE s IS NOT NULL GROUP BY f, s")
def suspect_clusters(spark, d):
    c = group.clusters(reports(spark, d))
    return c.select("file", "symbol", F.array_join(F.transform("bug_ids", lambda x: x.cast("string")), ",").alias("bug_ids"), "bugs")


@query("group_tokens", "SELECT user_id, (sum(ceil(length(props) / 3.5::DOUBLE * 1.15::DOUBLE)::BIGINT + ceil(length(event_type) / 3.5::DOUBLE * 1.15::DOUBLE)::BIGINT) + 100 * count(*))::BIGINT AS estimated_tokens FROM events GROUP BY user_id")
def group_tokens(spark, d):
    return group.group_tokens(reports(spark, d), ["user_id"], ["code", "error_message"], F.size("called_symbols"))


@query("group_order", "SELECT c_custkey, 'G' || row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS group_id FROM customer")
def group_order(spark, d):
    return group.numbered(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment", F.desc("c_acctbal"), "c_custkey"]).select("c_custkey", "group_id")
