"""Scalar functions over texts, messages, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import answers
from gleanery.functions import text as X
from gleanery.plans.registry import query, sql_classes, sql_parted, table

IDENT = "'get' || replace(p_name, ' ', '_') || 'HTTPResponse' || p_partkey || 'xY'"


@query("split_ident", f"WITH i AS (SELECT p_partkey, {IDENT} AS x, regexp_replace({IDENT}, '[^a-zA-Z0-9]+', ' ', 'g') AS q FROM part), p AS (SELECT p_partkey, x, list_filter(string_split_regex(trim({sql_parted('q', 'k')}), ' +'), lambda y: y <> '') AS p FROM (SELECT *, {sql_classes('q')} AS k FROM i)) SELECT p_partkey, lower(array_to_string(CASE WHEN len(p) > 1 THEN list_append(p, x) ELSE p END, ' ')) AS pieces FROM p")
def split_ident(spark, d):
    x = F.concat(F.lit("get"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("HTTPResponse"), "p_partkey", F.lit("xY"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.split_identifier(x), " ").alias("pieces"))


@query("token_estimate", "SELECT doc_id, ceil(length(text)::DOUBLE / 3.5::DOUBLE * 1.15::DOUBLE)::BIGINT AS estimated, greatest(1, length(text) // 4)::BIGINT AS approximate FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("estimated"), X.approximate_tokens(F.col("text")).alias("approximate"))


@query("hash_key", "SELECT o_custkey, substr(sha1(string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR)), 1, 16) AS group_key FROM orders GROUP BY o_custkey")
def hash_key(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("ids"))
    return g.select("o_custkey", X.group_key(F.col("ids")).alias("group_key"))


MESSAGE = "'E   at line ' || event_id || '  0x' || lower(to_hex(event_id)) || chr(10) || 'use -v to see ' || props || chr(10) || event_type || '   assert ' || user_id || ' == ' || (event_id % 9) || ' zero'"


def message():
    nl = F.lit("\n")
    return F.concat(F.lit("E   at line "), "event_id", F.lit("  0x"), F.lower(F.hex("event_id")), nl, F.lit("use -v to see "), "props", nl, "event_type", F.lit("   assert "), "user_id", F.lit(" == "), F.col("event_id") % 9, F.lit(" zero"))


@query("normalise_msg", rf"SELECT event_id, regexp_replace(regexp_replace(regexp_replace({MESSAGE}, '[ \t\n\r]+', ' ', 'g'), '0x[0-9a-fA-F]+', '0x...', 'g'), 'at line [0-9]+', 'at line N', 'g') AS message FROM events")
def normalise_msg(spark, d):
    return table(spark, d, "events").select("event_id", X.normal_message(message()).alias("message"))


@query("clean_message", rf"SELECT event_id, trim(regexp_replace(array_to_string(list_filter(string_split(regexp_replace({MESSAGE}, '(?m)^E[ \t]+', '', 'g'), chr(10)), lambda x: NOT contains(lower(x), 'use -v')), chr(10)), '[ \t\n\r]+', ' ', 'g')) AS message FROM events")
def clean_message(spark, d):
    return table(spark, d, "events").select("event_id", X.clean_message(message()).alias("message"))


@query("bug_ids", rf"SELECT event_id, 'b_' || substr(sha1('t' || user_id || '|' || event_type || '|' || regexp_replace(regexp_replace(regexp_replace({MESSAGE}, '[ \t\n\r]+', ' ', 'g'), '0x[0-9a-fA-F]+', '0x...', 'g'), 'at line [0-9]+', 'at line N', 'g')), 1, 12) AS bug_id FROM events")
def bug_ids(spark, d):
    return table(spark, d, "events").select("event_id", X.bug_id(F.concat(F.lit("t"), "user_id"), F.col("event_type"), message()).alias("bug_id"))


OPERATORS = ("==", "!=", "<", ">", "<=", ">=", "is", "is not", "in", "not in")


@query("assertion_parts", f"SELECT event_id, [{', '.join(f"'{x}'" for x in OPERATORS)}][event_id % 10 + 1] AS operator, user_id::VARCHAR AS actual, (event_id % 9)::VARCHAR AS expected FROM events")
def assertion_parts(spark, d):
    """Every operator, in place of the message's own."""
    op = F.element_at(F.array(*[F.lit(x) for x in OPERATORS]), (F.col("event_id") % 10 + 1).cast("int"))
    m = F.replace(message(), F.lit(" == "), F.concat(F.lit(" "), op, F.lit(" ")))
    return table(spark, d, "events").select("event_id", X.assertion_parts(m).alias("a")).select("event_id", "a.operator", "a.actual", "a.expected")


@query("severity", "SELECT event_id, CASE event_type WHEN 'error' THEN 'High' WHEN 'view' THEN 'Medium' ELSE 'Low' END AS severity FROM events")
def severity(spark, d):
    return severities(table(spark, d, "events"))


def severities(events):
    m = F.when(F.col("event_type") == "error", "ZeroDivision: by zero").when(F.col("event_type") == "view", "AssertionError")
    return events.select("event_id", X.severity(m, F.lit("src/a.py")).alias("severity"))


SECRET = "CASE WHEN doc_id % 4 = 0 THEN text || ' AKIA' || upper(substr(md5(doc_id::VARCHAR), 1, 16)) || ' sk-' || md5(doc_id::VARCHAR) ELSE text END"
REDACTED = f"regexp_replace(regexp_replace({SECRET}, 'AKIA[0-9A-Z]{{16}}', '[REDACTED]', 'g'), 'sk-[A-Za-z0-9]{{20,}}', '[REDACTED]', 'g')"


@query("redact", f"SELECT doc_id, md5(regexp_replace({REDACTED}, '-----BEGIN [A-Z]+ PRIVATE KEY-----', '[REDACTED]', 'g')) AS digest, (len(regexp_extract_all({SECRET}, 'AKIA[0-9A-Z]{{16}}')) + len(regexp_extract_all({SECRET}, 'sk-[A-Za-z0-9]{{20,}}')) + len(regexp_extract_all({REDACTED}, '-----BEGIN [A-Z]+ PRIVATE KEY-----')))::BIGINT AS found FROM documents")
def redact(spark, d):
    md5 = F.md5(F.col("doc_id").cast("string").cast("binary"))
    t = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" AKIA"), F.upper(F.substring(md5, 1, 16)), F.lit(" sk-"), md5)).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.redact(t).cast("binary")).alias("digest"), X.secrets_found(t).alias("found"))


@query("numbered_lines", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, array_to_string(list_transform(l[2:4], lambda x, i: lpad((i + 1)::VARCHAR, 4, ' ') || ' | ' || x), chr(10)) AS lines FROM l")
def numbered_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", X.numbered_lines(F.col("text"), 2, 4).alias("lines"))


@query("preview", "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 77) || '...' ELSE text END AS preview FROM documents")
def preview(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("path_rules", "WITH p AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'tests/test_' || event_type || '.py' WHEN 1 THEN 'src/' || event_type || '.py' WHEN 2 THEN 'build/lib/' || event_type || '.py' WHEN 3 THEN 'src/' || event_type || '_test.py' WHEN 4 THEN 'conftest.py' ELSE 'secrets/' || event_type || '.env' END AS path FROM events) SELECT event_id, event_id % 6 IN (0, 3, 4) AS is_test, event_id % 6 = 2 AS excluded, event_id % 6 = 5 AS denied FROM p")
def path_rules(spark, d):
    k = F.col("event_id") % 6
    c = lambda a, b: F.concat(F.lit(a), F.col("event_type"), F.lit(b))
    path = F.when(k == 0, c("tests/test_", ".py")).when(k == 1, c("src/", ".py")).when(k == 2, c("build/lib/", ".py")).when(k == 3, c("src/", "_test.py")).when(k == 4, "conftest.py").otherwise(c("secrets/", ".env"))
    return table(spark, d, "events").select("event_id", X.is_test_path(path).alias("is_test"), X.excluded(path, ("build",)).alias("excluded"), X.denied(path, ("*.env", "id_rsa")).alias("denied"))


@query("posix_paths", "SELECT event_id, 'src/' || event_type || '/x.py' AS path, event_id % 3 = 0 AS external FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, '/usr/lib/' || event_type || '.py', true FROM events WHERE event_id % 3 = 0")
def posix_paths(spark, d):
    k = F.col("event_id") % 3
    p = F.when(k == 0, F.concat(F.lit("/usr/lib/"), "event_type", F.lit(".py"))).when(k == 1, F.concat(F.lit("C:\\work\\src\\"), "event_type", F.lit("\\x.py"))).otherwise(F.concat(F.lit("./src/"), "event_type", F.lit("/x.py")))
    return table(spark, d, "events").select("event_id", X.posix_path(p, "C:\\work").alias("path"), X.is_external(p, "C:\\work").alias("external"))


@query("node_parts", "SELECT event_id, 'tests/a.py' AS file, CASE WHEN event_id % 2 = 0 THEN 'TestX' END AS class, 'test_' || event_type AS test FROM events")
def node_parts(spark, d):
    n = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("tests/a.py::TestX::test_"), "event_type")).otherwise(F.concat(F.lit("tests/a.py::test_"), "event_type"))
    return table(spark, d, "events").select("event_id", X.node_parts(n).alias("n")).select("event_id", "n.file", "n.class", "n.test")


@query("failure_kinds", "SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'collection_error' WHEN event_type = 'error' THEN 'import_error' WHEN event_type = 'view' THEN 'assertion' WHEN event_type = 'click' THEN 'timeout' ELSE 'exception' END AS kind, CASE event_type WHEN 'error' THEN 'confirmed' WHEN 'view' THEN 'not_applicable' ELSE 'unconfirmed' END AS verified FROM events")
def failure_kinds(spark, d):
    t = F.col("event_type")
    m = F.when(t == "error", "cannot IMPORT x").when(t == "view", "assert 1 == 2").when(t == "click", "Timeout after 3s").otherwise("boom")
    path = F.when(F.col("event_id") % 2 == 0, "conftest.py").otherwise("a.py")
    src = F.when(t == "error", "pytest").when(t == "view", "ruff").otherwise("llm")
    return table(spark, d, "events").select("event_id", X.failure_kind(F.lit(None).cast("string"), m, path).alias("kind"), X.verification(src).alias("verified"))


@query("log_kinds", "SELECT event_id, CASE event_type WHEN 'error' THEN 'err' WHEN 'view' THEN 'ok' WHEN 'click' THEN 'rem' WHEN 'signup' THEN 'meta' ELSE 'default' END AS kind FROM events")
def log_kinds(spark, d):
    t = F.col("event_type")
    line = F.when(t == "error", "E   assert").when(t == "view", "3 passed").when(t == "click", "-old").when(t == "signup", "--- a/file").otherwise("plain")
    return table(spark, d, "events").select("event_id", X.log_kind(line).alias("kind"))


@query("progress", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 100 WHEN event_type = 'error' THEN 65 ELSE least(floor((event_id % 6) * 100.0::DOUBLE / 6 + 50.0::DOUBLE / 6 + 0.5), 98) END::BIGINT AS progress FROM events")
def progress(spark, d):
    s = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return table(spark, d, "events").select("event_id", X.progress((F.col("event_id") % 6).cast("double"), F.lit(6), s).alias("progress"))


@query("tier_label", "WITH t AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'constant' ELSE 'function' END AS kind, (p_partkey % 100) / 100.0::DOUBLE AS score FROM part) SELECT p_partkey, CASE WHEN kind = 'class' AND score >= 0.25 THEN 'SKELETON' WHEN kind = 'constant' AND score >= 0.25 THEN 'FULL' WHEN kind = 'function' AND score >= 0.6 THEN 'FULL' WHEN kind = 'function' AND score >= 0.25 THEN 'SIGNATURE' ELSE 'DROP' END AS tier FROM t")
def tier_label(spark, d):
    k = F.col("p_size") % 3
    kind = F.when(k == 0, "class").when(k == 1, "constant").otherwise("function")
    return table(spark, d, "part").select("p_partkey", X.tier(kind, (F.col("p_partkey") % 100) / F.lit(100.0)).alias("tier"))


@query("explain_path", "SELECT p_partkey, 'p' || p_partkey || ' -calls-> ' || p_brand || ' -contains-> ' || p_type AS path FROM part")
def explain_path(spark, d):
    step = lambda a, b: F.struct(a.alias("src"), b.cast("string").alias("edge_type"))
    path = F.array(step(F.concat(F.lit("p"), F.col("p_partkey")), F.lit("calls")), step(F.col("p_brand"), F.lit("contains")), step(F.col("p_type"), F.lit(None)))
    return table(spark, d, "part").select("p_partkey", X.explain_path(path).alias("path"))


@query("json_extract", "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, false AS rejected FROM events")
def json_extract(spark, d):
    answer = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    v = F.from_json(X.json_object(answer), "k long")
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", "v.k", F.col("v").isNull().alias("rejected"))


@query("url_parse", r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)', 1) AS owner, regexp_extract(url, '^https?://[^/?#]+/[^/?#]+/([^/?#]+)', 1) AS repo FROM pages")
def url_parse(spark, d):
    part = lambda n: F.regexp_extract("url", "^https?://[^/?#]+" + "/[^/?#]+" * (n - 1) + "/([^/?#]+)", 1)
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), part(1).alias("owner"), part(2).alias("repo"))


@query("date_labels", "SELECT o_orderkey, 'r_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN o_orderkey % 5000 >= 3600 THEN (o_orderkey % 5000) // 3600 || 'h ' || (o_orderkey % 5000) % 3600 // 60 || 'm ' || (o_orderkey % 5000) % 60 || 's' WHEN o_orderkey % 5000 >= 60 THEN (o_orderkey % 5000) // 60 || 'm ' || (o_orderkey % 5000) % 60 || 's' ELSE (o_orderkey % 5000) || 's' END AS took FROM orders")
def date_labels(spark, d):
    at = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(at, "'r_'yyyyMMdd'_'HHmmss").alias("run_id"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), X.duration_label(F.col("o_orderkey") % 5000).alias("took"))


@query("query_terms", "WITH w AS (SELECT item_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda x: lower(x)), lambda x: length(x) >= 8)) AS a FROM benchmark) SELECT item_id, (2 * len(a))::BIGINT AS n FROM w")
def query_terms(spark, d):
    words = F.filter(F.transform(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)), lambda x: F.lower(x)), lambda x: F.length(x) >= 8)
    return table(spark, d, "benchmark").select("item_id", F.size(X.query_terms(words, words)).cast("long").alias("n"))


@query("content_hash", "SELECT count(*) AS files, sha256('v1' || chr(10) || string_agg(p_partkey || ':' || sha1(p_name), chr(10) ORDER BY p_partkey::VARCHAR)) AS content_hash FROM part")
def content_hash(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.sha1(F.col("p_name").cast("binary")).alias("sha1"))
    return X.content_hash(f, "v1")


@query("tree_digest", """WITH f AS (SELECT sha256(p_partkey::VARCHAR) AS at_, p_partkey || ':' || sha1(p_name) AS line FROM part),
    a AS (SELECT at_[1:4] AS k, sha256(string_agg(line, chr(10) ORDER BY line)) AS d, count(*) AS n FROM f GROUP BY ALL),
    b AS (SELECT k[1:2] AS k2, sha256(string_agg(k || ':' || d, chr(10) ORDER BY k || ':' || d)) AS d, sum(n) AS n FROM a GROUP BY ALL)
    SELECT sum(n)::BIGINT AS files, sha256('v1' || chr(10) || string_agg(k2 || ':' || d, chr(10) ORDER BY k2 || ':' || d)) AS tree_digest FROM b""")
def tree_digest(spark, d):
    """The digest of all files by a tree: no task has more than a leaf's files."""
    f = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.sha1(F.col("p_name").cast("binary")).alias("sha1"))
    return X.tree_digest(f, "v1")


#: Answers as they come, what is said of them, by the number of an event modulo their count; {n} is the number, the lines asked about are 10 to 40.
ANSWERS = (
    ('{"category": "logic", "line_start": 12, "line_end": 14, "reason": "off by {n}"}', "ok"),
    ('Sure:\n```json\n{"category": "type", "line_start": 10, "line_end": 40, "reason": "case {n}", "more": [1, {"a": 2}]}\n```\nDone.', "ok"),
    ('{"no_bugs": true}', "no_bugs"),
    ('no object here, {n}', "not_an_object"),
    ('[1, 2]', "not_an_object"),
    ('{"category": "  ", "line_start": 12, "line_end": 14, "reason": "x"}', "category"),
    ('{"category": "logic", "line_start": "12", "line_end": 14, "reason": "x"}', "lines"),
    ('{"category": "logic", "line_start": 12.5, "line_end": 14, "reason": "x"}', "lines"),
    ('{"category": "logic", "line_start": 12, "line_end": 14, "reason": 7}', "reason"),
    ('{"category": "logic", "line_start": 20, "line_end": 14, "reason": "x"}', "order"),
    ('{"category": "logic", "line_start": 9, "line_end": 14, "reason": "x"}', "bounds"),
    ('{"no_bugs": "yes", "line_start": 12, "line_end": 14, "reason": "x"}', "category"),
    ('{"category": "logic", "line_start": 12, "line_end": 41, "reason": "x"} {', "bounds"),
)
SAID = ", ".join(f"({k}, '{v}')" for k, (_, v) in enumerate(ANSWERS))


@query("judged_answers", f"SELECT event_id, verdict, CASE k WHEN 0 THEN 'logic' WHEN 1 THEN 'type' END AS category, CASE k WHEN 0 THEN 12 WHEN 1 THEN 10 END::BIGINT AS line_start, CASE k WHEN 0 THEN 14 WHEN 1 THEN 40 END::BIGINT AS line_end, CASE k WHEN 0 THEN 'off by ' || event_id WHEN 1 THEN 'case ' || event_id END AS reason FROM events JOIN (VALUES {SAID}) AS t(k, verdict) ON k = event_id % {len(ANSWERS)}")
def judged_answers(spark, d):
    """Reviewers' answers with every reason to reject one."""
    texts = F.array(*[F.lit(t) for t, _ in ANSWERS])
    e = table(spark, d, "events").select("event_id", F.replace(F.get(texts, (F.col("event_id") % len(ANSWERS)).cast("int")), F.lit("{n}"), F.col("event_id").cast("string")).alias("answer"))
    return e.select("event_id", answers.parsed(F.col("answer")).alias("v")).select("event_id", answers.judged(F.col("v"), F.lit(10), F.lit(40)).alias("j")).select("event_id", "j.*")


ADDRESSES = (
    ("https://github.com/own{n}/re-po", "own{n}/re-po", None),
    ("http://www.GitHub.com/own{n}/repo.git/", "own{n}/repo", None),
    ("github.com/own{n}/repo?tab=readme#x", "own{n}/repo", None),
    ("  own{n}/repo_1.x  ", "own{n}/repo_1.x", None),
    ("https://me@github.com/own{n}/repo", "own{n}/repo", None),
    ("https://gitlab.com/own{n}/repo", None, "host"),
    ("repo{n}", None, "no_owner"),
    ("github.com/own{n}", None, "identifier"),
    ("own{n}/re po", None, "identifier"),
    ("own{n}/..", None, "identifier"),
    ("https://github.com/own{n}/repo/tree", None, "identifier"),
    ("   ", None, "empty"),
)
NAMED = ", ".join(f"({k}, {'NULL' if r is None else repr(r)}, {'NULL' if e is None else repr(e)})" for k, (_, r, e) in enumerate(ADDRESSES))


@query("repositories", f"SELECT page_id, replace(repo, '{{n}}', page_id::VARCHAR) AS repo, error FROM pages JOIN (VALUES {NAMED}) AS t(k, repo, error) ON k = page_id % {len(ADDRESSES)}")
def repositories(spark, d):
    """Addresses of repositories in all forms, and those that are none."""
    forms = F.array(*[F.lit(a) for a, _, _ in ADDRESSES])
    p = table(spark, d, "pages").select("page_id", F.replace(F.get(forms, (F.col("page_id") % len(ADDRESSES)).cast("int")), F.lit("{n}"), F.col("page_id").cast("string")).alias("url"))
    return p.select("page_id", answers.repository(F.col("url")).alias("r")).select("page_id", "r.*")
