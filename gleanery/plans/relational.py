"""Dashboards, filters and pages over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as X
from gleanery.operators import metrics, names, relational
from gleanery.plans.registry import query, table
from gleanery.sources import folders
from gleanery.storage import new_path
from gleanery.streaming import machine, runlog

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END"
RUNS = f"runs AS (SELECT *, {STATUS} AS status, (o_orderkey % 5)::BIGINT AS detected, (o_orderkey % 3)::BIGINT AS fixed, (o_orderkey % 2)::BIGINT AS patches, o_orderdate + to_seconds(o_orderkey % 1000) AS ended FROM orders)"


def runs(spark, d):
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    o = table(spark, d, "orders").withColumn("status", s)
    return o.withColumn("detected", F.col("o_orderkey") % 5).withColumn("fixed", F.col("o_orderkey") % 3).withColumn("patches", F.col("o_orderkey") % 2).withColumn("ended", F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 1000))


SUMMARY = """count(*) AS total, count(*) FILTER (status = 'completed') AS completed_runs, count(*) FILTER (status = 'failed') AS failed_runs, count(*) FILTER (status = 'running') AS running_runs,
    count(*) FILTER (status = 'pending') AS pending_runs, count(*) FILTER (status = 'cancelled') AS cancelled_runs, count(*) FILTER (status = 'queued') AS queued_runs,
    coalesce(sum(detected), 0)::BIGINT AS bugs_detected, coalesce(sum(fixed), 0)::BIGINT AS bugs_fixed, coalesce(sum(patches), 0)::BIGINT AS patches,
    coalesce((2 * sum((20000 * fixed + detected) // nullif(2 * detected, 0)) FILTER (status = 'completed' AND detected > 0) + count(*) FILTER (status = 'completed' AND detected > 0)) // nullif(2 * count(*) FILTER (status = 'completed' AND detected > 0), 0) / 100::DOUBLE, 0) AS success_rate,
    nullif((2 * sum(epoch_us(ended) - epoch_us(o_orderdate)) FILTER (status IN ('completed', 'failed')) + 10000 * count(*) FILTER (status IN ('completed', 'failed'))) // nullif(20000 * count(*) FILTER (status IN ('completed', 'failed')), 0) / 100::DOUBLE, 0) AS avg_duration"""


@query("run_summary", f"WITH {RUNS} SELECT {SUMMARY} FROM runs")
def run_summary(spark, d):
    return metrics.run_summary(runs(spark, d), "status", F.col("detected"), F.col("fixed"), F.col("patches"), F.col("o_orderdate"), F.col("ended"))


@query("run_summary_by_owner", f"WITH {RUNS} SELECT o_custkey, {SUMMARY} FROM runs GROUP BY o_custkey")
def run_summary_by_owner(spark, d):
    return metrics.run_summary(runs(spark, d), "status", F.col("detected"), F.col("fixed"), F.col("patches"), F.col("o_orderdate"), F.col("ended"), ["o_custkey"])


KINDS = ("click", "view", "purchase", "signup", "error", "logout")


@query("outcome_counts", "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + ", count(*) AS total, round(sum(round(value, 2)), 2) AS duration, count(*) FILTER (event_type IN (" + ", ".join(f"'{k}'" for k in KINDS) + ")) = count(*) AS consistent FROM events GROUP BY user_id")
def outcome_counts(spark, d):
    return metrics.outcome_counts(table(spark, d, "events"), "event_type", F.round("value", 2), KINDS, ["user_id"])


@query("failures_only", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')")
def failures_only(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("error", "purchase")).select("event_id", "event_type")


@query("owner_runs_page", "SELECT o_orderkey, c_name, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 20")
def owner_runs_page(spark, d):
    o = relational.scoped(table(spark, d, "orders"), o_orderstatus="F", o_orderpriority=None)
    c = relational.scoped(table(spark, d, "customer"), c_mktsegment="BUILDING")
    j = o.join(c, o.o_custkey == c.c_custkey).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return relational.page(j, [F.desc("o_orderdate"), "o_orderkey"], 20, 100).select("o_orderkey", "c_name", "n_name", "o_totalprice")


@query("active_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('O', 'P'))")
def active_semi(spark, d):
    active = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return relational.having(table(spark, d, "customer"), active, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("orphan_anti", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_anti(spark, d):
    return relational.lacking(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_acctbal")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, d):
    return relational.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("row_updates", "WITH l AS (SELECT user_id % 1500 + 1 AS k, arg_max(event_type, event_id) AS t, arg_max(round(value, 2), event_id) AS v FROM events GROUP BY ALL) SELECT c_custkey, coalesce(t, c_mktsegment) AS c_mktsegment, coalesce(v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN l ON c_custkey = k")
def row_updates(spark, d):
    log = table(spark, d, "events").select((F.col("user_id") % 1500 + 1).alias("c_custkey"), "event_id", F.col("event_type").alias("c_mktsegment"), F.round("value", 2).alias("c_acctbal"))
    return relational.update_rows(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), log, "c_custkey", "event_id", ["c_mktsegment", "c_acctbal"])


@query("insert_ignore", "SELECT c_custkey, c_nationkey FROM customer UNION ALL SELECT DISTINCT o_custkey + 1000000, 0 FROM orders WHERE o_custkey + 1000000 NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(spark, d):
    new = table(spark, d, "orders").select((F.col("o_custkey") + 1000000).alias("c_custkey"), F.lit(0).alias("c_nationkey"))
    return relational.insert_new(table(spark, d, "customer").select("c_custkey", "c_nationkey"), new, ["c_custkey"])


@query("history_search", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND (contains(lower(text), 'the') OR contains(lower(role), 'the'))")
def history_search(spark, d):
    return relational.search_history(table(spark, d, "conversations"), "user", " The ", "role", ["text", "role"]).select("conv_id", "turn")


@query("fuzzy_name", "SELECT p_partkey, CASE WHEN p_name = 'red' OR p_name LIKE '%.red' THEN 2 ELSE 1 END AS match FROM part WHERE contains(p_name, 'red')")
def fuzzy_name(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"), F.col("p_brand").alias("file"), F.col("p_size").alias("line_start"))
    return relational.find_named(s, "red", "Brand#11").select(F.col("id").alias("p_partkey"), "match")


ASKED = "p AS (SELECT n_nationkey AS pattern_id, CASE WHEN n_nationkey % 5 = 0 THEN lower(n_name[1:2]) WHEN n_nationkey % 5 = 1 THEN lower(n_name[1:1]) WHEN n_nationkey % 5 = 2 THEN 'no such name' ELSE lower(n_name[1:3]) END AS pattern, 'Brand#' || (11 + n_nationkey) AS hint FROM nation UNION ALL SELECT 1000 + p_partkey, string_split(p_name, ' ')[1], NULL FROM part WHERE p_partkey % 50 = 0)"


@query("many_names", f"""WITH {ASKED}, s AS (SELECT p_partkey AS id, string_split(p_name, ' ')[-1] AS name, replace(p_name, ' ', '.') AS q, p_brand AS file, p_size AS line FROM part),
    h AS (SELECT pattern_id, id, hint, file, line, CASE WHEN name = pattern OR q = pattern OR ends_with(q, '.' || pattern) THEN 2 WHEN contains(q, pattern) OR contains(name, pattern) THEN 1 END AS match FROM p JOIN s ON contains(q, pattern))
    SELECT pattern_id, id, match, row_number() OVER (PARTITION BY pattern_id ORDER BY match DESC, CASE WHEN file = hint THEN 0 ELSE 1 END, file, line, id)::INTEGER AS rank FROM h""")
def many_names(spark, d):
    """A table of patterns against all names, from a stored index of their runs."""
    p = table(spark, d, "part")
    symbols = p.select(F.col("p_partkey").alias("id"), F.element_at(F.split("p_name", " "), -1).alias("name"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("qualified_name"), F.col("p_brand").alias("file"), F.col("p_size").alias("line_start"))
    n = table(spark, d, "nation")
    k = F.col("n_nationkey") % 5
    text = F.when(k == 0, F.substring("n_name", 1, 2)).when(k == 1, F.substring("n_name", 1, 1)).when(k == 2, "no such name").otherwise(F.substring("n_name", 1, 3))
    asked = n.select(F.col("n_nationkey").cast("long").alias("pattern_id"), F.lower(text).alias("pattern"), F.concat(F.lit("Brand#"), F.lit(11) + F.col("n_nationkey")).alias("hint_file"))
    more = p.where("p_partkey % 50 = 0").select((F.lit(1000) + F.col("p_partkey")).cast("long").alias("pattern_id"), F.element_at(F.split("p_name", " "), 1).alias("pattern"), F.lit(None).cast("string").alias("hint_file"))
    path = new_path(spark, "names")
    names.build_names(symbols, path)
    return names.find_all(spark, path, asked.unionByName(more)).select("pattern_id", "id", "match", "rank")


@query("live_entries", "SELECT event_id FROM events WHERE ('clone:' || user_id || ':' || event_id) LIKE 'clone:1%' AND ts + INTERVAL 30 DAY > (SELECT max(ts) FROM events)")
def live_entries(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    kv = e.select("event_id", F.concat_ws(":", F.lit("clone"), "user_id", "event_id").alias("key"), (F.col("ts") + F.expr("INTERVAL 30 DAY")).alias("expires_at"))
    return relational.live(kv, F.lit(now), "clone:1%").select("event_id")


@query("hit_rate_cache", "SELECT user_id, CASE WHEN count(*) = 0 THEN 0.0 ELSE round((count(*) FILTER (event_type = 'view'))::DOUBLE * 100 / count(*), 2) END AS hit_rate FROM events GROUP BY user_id")
def hit_rate_cache(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("h"), F.count("*").alias("n")).select("user_id", X.rate(F.col("h"), F.col("n")).alias("hit_rate"))


@query("counts_by_kind", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY o_orderpriority")
def counts_by_kind(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy("o_orderpriority")


@query("by_day_label", "WITH x AS (SELECT date_diff('day', ts::DATE, (SELECT max(ts) FROM events)::DATE) AS d, ts FROM events) SELECT CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN d || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END AS label, count(*) AS n FROM x GROUP BY 1")
def by_day_label(spark, d):
    e = table(spark, d, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return e.groupBy(X.age_label(F.col("ts"), now).alias("label")).agg(F.count("*").alias("n"))


@query("stage_counters", "SELECT 'customer' AS what, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'verified', count(*) FROM orders WHERE o_orderstatus = 'F'")
def stage_counters(spark, d):
    o = table(spark, d, "orders")
    one = lambda name, df: df.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
    return one("customer", table(spark, d, "customer")).union(one("orders", o)).union(one("verified", o.where("o_orderstatus = 'F'")))


EVENTS = "e AS (SELECT (user_id)::VARCHAR AS run_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status, (event_id % 6)::INTEGER AS step_index, event_type AS stage FROM events)"


def as_log(events):
    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
    return events.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("line"), (F.col("event_id") % 6).cast("int").alias("step_index"), F.col("event_type").alias("stage"), status.alias("status"))


STATE = f"WITH {EVENTS} SELECT run_id, coalesce(arg_min(status, seq) FILTER (status IN ('completed', 'failed', 'cancelled')), arg_max(status, seq) FILTER (status IS NOT NULL)) AS status, arg_max(step_index, seq) AS step_index, arg_max(stage, seq) AS stage, count(stage) AS lines, coalesce(bool_or(status IN ('completed', 'failed', 'cancelled')), false) AS finished FROM e GROUP BY run_id"


@query("run_state", STATE)
def run_state(spark, d):
    return runlog.run_state(as_log(table(spark, d, "events")))


def in_parts(events, what, start, n=3):
    """Runs a stream over events that come in one stretch of ids after the other: each is written by as many tasks as have its rows, and `start(stream, path)` goes on
    from its marks with it. Returns the path."""
    spark = events.sparkSession
    path = new_path(spark, what)
    edges = events.approxQuantile("event_id", [k / n for k in range(1, n)], 0.05)
    bounds = [float("-inf"), *sorted(set(edges)), float("inf")]
    for low, high in zip(bounds, bounds[1:], strict=False):
        events.where((F.col("event_id") > low) & (F.col("event_id") <= high)).write.mode("append").parquet(path)
        start(spark.readStream.schema(events.schema).parquet(path), path).awaitTermination()
    return path


def log_parts(spark, d, what, start):
    """in_parts with what as_log reads of the events."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return in_parts(events, what, lambda stream, path: start(as_log(stream), f"{path}-table", f"{path}-marks"))


@query("run_state_stream", STATE)
def run_state_stream(spark, d):
    """The same state, from a durable table that a stream of several batches keeps."""
    path = log_parts(spark, d, "run-events", runlog.fold_stream)
    return runlog.stored_state(spark, f"{path}-table")


@query("final_events", f"WITH {EVENTS} SELECT run_id, arg_min(status, seq) AS status, min(seq) AS seq FROM e WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY run_id")
def final_events(spark, d):
    """One event for each run that ends, whatever comes after it in later batches."""
    path = log_parts(spark, d, "final-events", runlog.fold_stream)
    return runlog.final_events(spark, f"{path}-table")


ALLOWED = "((r.state = 'queued' AND s.status IN ('running', 'cancelled')) OR (r.state = 'running' AND s.status IN ('completed', 'failed', 'cancelled')))"


@query("run_changes_stream", f"""WITH RECURSIVE {EVENTS}, s AS (SELECT run_id, seq, status, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM e WHERE status IS NOT NULL),
    r AS (SELECT run_id, n, seq, NULL::VARCHAR AS was, status, status AS state, '' AS kind FROM s WHERE n = 1
    UNION ALL SELECT s.run_id, s.n, s.seq, r.state, s.status, CASE WHEN {ALLOWED} THEN s.status ELSE r.state END, CASE WHEN s.status = r.state THEN '' WHEN {ALLOWED} THEN 'changed' ELSE 'refused' END
        FROM r JOIN s ON s.run_id = r.run_id AND s.n = r.n + 1)
    SELECT run_id, seq, kind, was, status FROM r WHERE kind <> ''""")
def run_changes_stream(spark, d):
    """Changes that the state machine of runs makes and refuses, from a stream of several batches with a state for each run."""
    path = log_parts(spark, d, "machine-events", machine.change_stream)
    return machine.stored_changes(spark, f"{path}-table")


@query("entry_stream", """WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS key, event_id AS seq, CASE event_type WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'set' WHEN 'view' THEN 'refresh' WHEN 'error' THEN 'delete' ELSE 'get' END AS op,
        'v' || event_id AS value, 3600 * (1 + event_id % 40) AS ttl, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT key, n, seq, op, op = 'set' AS ok, CASE WHEN op = 'set' THEN value END AS read, CASE WHEN op = 'set' THEN value END AS value, CASE WHEN op = 'set' THEN us + ttl * 1000000 END AS expires FROM o WHERE n = 1
    UNION ALL SELECT o.key, o.n, o.seq, o.op, o.op = 'set' OR coalesce(o.us < r.expires, false), CASE WHEN o.op = 'set' THEN o.value WHEN o.us < r.expires THEN r.value END,
        CASE WHEN o.op = 'set' THEN o.value WHEN o.op <> 'delete' AND o.us < r.expires THEN r.value END,
        CASE WHEN o.op = 'set' OR (o.op = 'refresh' AND o.us < r.expires) THEN o.us + o.ttl * 1000000 WHEN o.op <> 'delete' AND o.us < r.expires THEN r.expires END
        FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1)
    SELECT key, seq, op, ok, read AS value FROM r""")
def entry_stream(spark, d):
    """Entries that are set, refreshed, read and deleted by a stream, and expire."""
    op = F.when(F.col("event_type").isin("signup", "purchase"), "set").when(F.col("event_type") == "view", "refresh").when(F.col("event_type") == "error", "delete").otherwise("get")
    ts = F.col("ts").cast("timestamp")
    columns = (F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("v"), "event_id").alias("value"), (3600 * (1 + F.col("event_id") % 40)).cast("int").alias("ttl_s"), F.unix_micros(ts).alias("at_us"))
    answer = lambda stream, path: machine.answer_stream(stream.select(*columns), f"{path}-table", f"{path}-marks")
    path = in_parts(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), "entry-events", answer)
    return machine.stored_answers(spark, f"{path}-table")


@query("invalid_transitions", f"WITH {EVENTS}, m AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY seq) AS was FROM e WHERE status IS NOT NULL) SELECT run_id, seq, was, status FROM m WHERE was IS NOT NULL AND was <> status AND NOT ((was IN ('queued', 'pending') AND status IN ('running', 'cancelled')) OR (was = 'running' AND status IN ('completed', 'failed', 'cancelled')))")
def invalid_transitions(spark, d):
    return runlog.invalid_transitions(as_log(table(spark, d, "events")))


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return runlog.windowed_counts(table(spark, d, "events"), "ts", "event_type")


@query("flaky_rule", "WITH a AS (SELECT user_id AS test, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS outcome FROM events) SELECT test, bool_or(attempt = 0 AND outcome = 'failed') AND bool_or(attempt > 0 AND outcome = 'passed') AS flaky FROM a GROUP BY test")
def flaky_rule(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    r = e.select(F.col("user_id").alias("test"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("attempt"), F.when(F.col("event_type") == "error", "failed").otherwise("passed").alias("outcome"))
    return metrics.flaky(r)


RESULT = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' WHEN 'click' THEN 'error' ELSE 'passed' END"


@query("outcome_files", f"SELECT user_id, count(*) FILTER ({RESULT} = 'passed') AS passed, count(*) FILTER ({RESULT} = 'failed') AS failed, count(*) FILTER ({RESULT} = 'error') AS error, count(*) FILTER ({RESULT} = 'skipped') AS skipped, 0 AS xfailed, 0 AS xpassed, count(*) AS total, round(sum(event_id % 7 / 2.0::DOUBLE), 2) AS duration, true AS consistent FROM events GROUP BY user_id")
def outcome_files(spark, d):
    """Outcomes of runs, each run a file of its own that tasks read and parse."""
    e = table(spark, d, "events")
    result = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "click", "error").otherwise("passed")
    row = F.struct(F.concat(F.lit("tests/t.py::test_"), "event_id").alias("node_id"), result.alias("outcome"), (F.col("event_id") % 7 / 2.0).alias("duration"))
    run = F.struct(F.lit(0).alias("exit_code"), F.count("*").alias("total_tests"), F.collect_list(row).alias("results"))
    path = new_path(spark, "outcomes")
    name = F.format_string("%03x/user_id=%s.json", F.pmod(F.xxhash64("user_id"), F.lit(1024)), F.coalesce(F.col("user_id").cast("string"), F.lit("none")))  # in 1,024 folders
    folders.write_files(e.groupBy("user_id").agg(F.to_json(run).alias("value")).withColumn("name", name), path, "name", "value")
    read = folders.outcomes(spark, path).withColumn("user_id", F.expr(r"try_cast(regexp_extract(file, 'user_id=(-?[0-9]+)', 1) AS BIGINT)"))
    return metrics.outcome_counts(read, "outcome", F.col("duration"), keys=["user_id"])


@query("idle_customers", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def idle_customers(spark, d):
    """Customers without an order of one state: an anti join that has rows."""
    return relational.lacking(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey").select("c_custkey")


@query("status_tabs", "SELECT 'all' AS tab, count(*) AS n FROM events UNION ALL SELECT t, count(*) FILTER (event_type = t) FROM events, (SELECT unnest(['view', 'click', 'error', 'never']) AS t) GROUP BY t")
def status_tabs(spark, d):
    return metrics.tab_counts(table(spark, d, "events"), "event_type", ("view", "click", "error", "never"))


@query("files_passed", "SELECT l_returnflag, coalesce(CASE WHEN l_suppkey % 7 <> 0 THEN 'src/s' || (l_suppkey % 40) || '.py' END, 'unknown') AS file, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS passed, floor((2 * 100 * count(*) FILTER (l_linestatus = 'F') + count(*)) / (2.0 * count(*)))::BIGINT AS percent FROM lineitem GROUP BY ALL")
def files_passed(spark, d):
    """Totals by source file and the share that passed."""
    file = F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("src/s"), F.col("l_suppkey") % 40, F.lit(".py")))
    return metrics.by_file(table(spark, d, "lineitem").withColumn("file", file), "file", F.col("l_linestatus") == "F", ["l_returnflag"])
