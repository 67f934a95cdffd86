"""Gap sessionisation: lag windows mark hard breaks, their running sum numbers islands, and a fold over each island's sorted clicks cuts sessions that last too long.

Clicks are dealt by range of (client, time), so a client of any size is spread: each stretch is read by a window of its own, and one row of each client and
stretch (its first and last click, its number of breaks) tells the next stretch what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import cut, forget
from gleanery.operators.chain import reached
from gleanery.operators.scan import deal, scan

MINUTE = 60_000_000


def micros(ts: str) -> Column:
    """Microseconds from 1970 to a time without a zone, read from its fields: the session's zone has no say."""
    days = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.expr(f"extract(SECOND FROM `{ts}`)").cast("decimal(18,6)") * F.lit(1_000_000).cast("decimal(10,0)")
    return (days * 1440 + F.hour(ts) * 60 + F.minute(ts)) * MINUTE + seconds.cast("long")


def single_clicks(clicks: DataFrame, late: int, final_value: float, final_kinds: tuple[str, ...]) -> DataFrame:
    """(_click, _client, _us, _late, _final, _cents), once for each click id; clicks without client or time are left out.

    Where rows of one click id differ, the smallest by (client, time, flags, cents) counts. A null arrival is timely; a null, non-finite or very large value is
    worth 0 cents, and a null or not-a-number value or a null kind is never final. Rows without a click id are clicks of their own only if they differ.
    """
    value = F.nanvl("value", F.lit(None).cast("double"))
    cents = F.when(F.abs(value) < 9e16, F.floor(value * 100 + 0.5))
    flags = F.struct(
        F.col("client_id").cast("long").alias("_client"),
        micros("ts").alias("_us"),
        F.coalesce(micros("arrived_at") - micros("ts") > late, F.lit(False)).alias("_late"),
        F.coalesce((value >= final_value) & F.col("kind").isin(*final_kinds), F.lit(False)).alias("_final"),
        F.coalesce(cents.cast("long"), F.lit(0)).alias("_cents"),
    )
    known = clicks.where("client_id IS NOT NULL AND ts IS NOT NULL").select(F.col("click_id").cast("long").alias("_click"), flags.alias("_f"))
    return known.groupBy("_click").agg(F.min("_f").alias("_f")).select("_click", "_f.*")


def islands(dealt: DataFrame, gap: int) -> DataFrame:
    """dealt with _island, counted from 1 for each client (0: late clicks before all others), and _islands, the client's number of them."""
    w = Window.partitionBy("_client", "_stretch").orderBy("_us", "_late", "_click")
    timely = ~F.col("_late")
    last = F.last(F.when(timely, F.struct("_us", "_final")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    breaks = lambda before: before["_final"] | (F.col("_us") - before["_us"] >= gap)
    marked = dealt.withColumn("_before", last).withColumn("_break", F.when(timely & F.col("_before").isNotNull() & breaks(F.col("_before")), 1).otherwise(0))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marked.withColumn("_inner", F.sum("_break").over(upto)).withColumn("_seen", F.max(timely).over(upto)).drop("_before", "_break")

    place = F.when(timely, F.struct("_us", "_click"))
    ends = marked.groupBy("_client", "_stretch").agg(
        F.min(F.when(timely, F.col("_us"))).alias("_first"), F.max_by(F.struct("_us", "_final"), place).alias("_last"), F.sum("_break").alias("_inner")
    )
    earlier = Window.partitionBy("_client").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("_last", ignorenulls=True).over(earlier)
    opens = F.when(F.col("_first").isNull(), 0).when(F.col("_carried").isNull() | F.col("_carried._final") | (F.col("_first") - F.col("_carried._us") >= gap), 1).otherwise(0)
    ends = ends.withColumn("_carried", carried).withColumn("_opens", opens)
    number = F.col("_inner") + F.col("_opens")
    offsets = ends.select(
        F.col("_client").alias("_c"),
        F.col("_stretch").alias("_s"),
        "_opens",
        F.coalesce(F.sum(number).over(earlier), F.lit(0)).alias("_offset"),
        F.sum(number).over(Window.partitionBy("_client")).alias("_islands"),
    )
    both = rows.join(offsets, (F.col("_client") == F.col("_c")) & (F.col("_stretch") == F.col("_s")))
    island = F.col("_offset") + F.col("_inner") + F.when(F.col("_seen"), F.col("_opens")).otherwise(0)
    return both.select("_client", "_us", "_late", "_click", "_final", "_cents", island.cast("long").alias("_island"), F.col("_islands").cast("long").alias("_islands"))


def fold(rows: DataFrame, length: int) -> DataFrame:
    """Sessions of whole islands: the sorted clicks of each are folded once, and a click more than `length` after its session's first opens the next session."""
    click = F.struct("_us", F.col("_click").alias("id"), F.col("_final").alias("final"), F.col("_cents").alias("cents"))
    per = rows.groupBy("_client", "_island").agg(
        F.sort_array(F.collect_list(F.when(~F.col("_late"), click))).alias("clicks"),
        F.collect_list(F.when(F.col("_late"), F.col("_us"))).alias("late"),
        F.max("_islands").alias("_islands"),
    )
    zero = F.struct(F.lit(1).alias("i"), F.lit(None).cast("long").alias("start"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, c: Column) -> Column:
        new = s["start"].isNull() | (c["_us"] - s["start"] > length)
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(new, c["_us"]).otherwise(s["start"]).alias("start"), F.when(new, F.concat(s["cuts"], F.array(s["i"]))).otherwise(s["cuts"]).alias("cuts")
        )

    n = F.size("clicks")
    whole = F.element_at("clicks", -1)["_us"] - F.element_at("clicks", 1)["_us"] <= length
    cuts = F.when(whole, F.array(F.lit(1))).otherwise(F.aggregate("clicks", zero, step)["cuts"])
    at = per.where(n > 0).withColumn("_cuts", cuts)
    end = lambda k: F.coalesce(F.get("_cuts", k + 1), n + 1)
    part = lambda c, k: F.struct(F.slice("clicks", c, end(k) - c).alias("clicks"), F.get("clicks", end(k) - 1)["_us"].alias("next_us"))
    each = at.select("_client", "_island", "_islands", "late", F.explode(F.transform("_cuts", part)).alias("_p")).select("*", "_p.*").drop("_p")
    first, last = F.element_at("clicks", 1), F.element_at("clicks", -1)
    in_late = F.filter("late", lambda u: (u >= first["_us"]) & (F.col("next_us").isNull() | (u < F.col("next_us"))))
    why = F.when(F.col("next_us").isNotNull(), "length").when(last["final"], "end").when(F.col("_island") < F.col("_islands"), "gap").otherwise("none")
    return each.select(
        F.col("_client").alias("client_id"),
        first["id"].alias("session_id"),
        first["_us"].alias("start_us"),
        last["_us"].alias("end_us"),
        F.size("clicks").cast("long").alias("n_clicks"),
        F.size(in_late).cast("long").alias("n_late"),
        F.aggregate("clicks", F.lit(0).cast("long"), lambda s, c: s + c["cents"]).alias("value_cents"),
        why.alias("closed_by"),
        F.transform("clicks", lambda c: c["id"]).alias("path"),
    )


def unroll(rows: DataFrame, length: int) -> DataFrame:
    """Rows of islands of any size with each session as an island of its own: every click's next session start is found by a scan in reverse, and pointer
    doubling tells which starts are reached. Adds _cut, whether the session was closed by its length."""
    clicks = rows.where("NOT _late").select("_client", "_island", "_us", "_click")
    both = clicks.select("*", F.lit(1).alias("_side"), (-F.col("_us")).alias("_back"), (-F.col("_click")).alias("_tie"))
    probes = clicks.select("*", F.lit(0).alias("_side"), (-(F.col("_us") + length)).alias("_back"), (-F.col("_click")).alias("_tie"))
    keys, order = ["_client", "_island"], ["_back", "_side", "_tie"]
    found = scan(deal(both.unionByName(probes), keys, order), keys, order, _to=("last", F.when(F.col("_side") == 1, F.col("_click"))))
    links = cut(found.where("_side = 0").select(F.col("_click").alias("node"), F.col("_to").alias("next")), "session-links")
    heads = clicks.groupBy("_client", "_island").agg(F.min_by("_click", F.struct("_us", "_click")).alias("node"))
    begins = reached(links, heads.select("node")).select(F.col("node").alias("_b"), F.lit(1).alias("_begin"))
    flagged = rows.join(begins, (F.col("_click") == F.col("_b")) & ~F.col("_late"), "left").drop("_b")
    order = ["_us", "_late", "_click"]
    numbered = scan(deal(flagged, keys, order), keys, order, _part=("sum", F.coalesce("_begin", F.lit(0))))
    return numbered.drop("_begin", "_stretch")


def sessionise(
    clicks: DataFrame,
    gap: int = 15 * MINUTE,
    length: int = 60 * MINUTE,
    late: int = 15 * MINUTE,
    final_value: float = 60.0,
    final_kinds: tuple[str, ...] = ("purchase", "signup"),
    most: int = 100_000,
) -> DataFrame:
    """Sessions of clicks (click_id, client_id, ts, arrived_at, kind, value), with their path, an array of click ids in order.

    Times are in microseconds. A session closes after a final click (`end`), before a pause of `gap` or more (`gap`), or before the first click that comes more
    than `length` after the session's first (`length`); `none` is a session still open at the end of the data. Late clicks join no session but are counted with
    the session that was the client's last to begin by then; those before a client's first session, and those of clients without timely clicks, are not counted.

    Islands of at most `most` clicks and late clicks are folded whole. Longer ones are cut by `unroll`, which needs no island in one place: what a session that
    is longer than `most` clicks holds is its path alone.

    Defined results: rows without client or time are left out, repeated click ids count once (see `single_clicks`), equal times go by click id, an empty table
    gives no session, further columns are not read.
    """
    keys, order = ["_client"], ["_us", "_late", "_click"]
    dealt = deal(single_clicks(clicks, late, final_value, final_kinds), keys, order)
    placed = cut(islands(dealt, gap).where("_island > 0"), "islands")
    large = placed.groupBy("_client", "_island").count().where(F.col("count") > most).select("_client", "_island")
    if large.isEmpty():
        return fold(placed, length)
    large = cut(large, "large-islands")
    small = fold(placed.join(large, ["_client", "_island"], "left_anti"), length)
    parts = cut(unroll(placed.join(large, ["_client", "_island"], "left_semi"), length), "session-parts")
    spans = Window.partitionBy("_client", "_island")
    closed = F.when(F.col("_part") < F.col("_parts"), "length").when(F.col("_ends"), "end").when(F.col("_island") < F.col("_islands"), "gap").otherwise("none")
    timely, place = ~F.col("_late"), F.struct("_us", "_click")
    sessions = parts.groupBy("_client", "_island", "_part").agg(
        F.min_by("_click", F.when(timely, place)).alias("session_id"),
        F.min(F.when(timely, F.col("_us"))).alias("start_us"),
        F.max(F.when(timely, F.col("_us"))).alias("end_us"),
        F.count(F.when(timely, 1)).alias("n_clicks"),
        F.count(F.when(~timely, 1)).alias("n_late"),
        F.sum(F.when(timely, F.col("_cents"))).alias("value_cents"),
        F.max_by("_final", F.when(timely, place)).alias("_ends"),
        F.max("_islands").alias("_islands"),
        F.sort_array(F.collect_list(F.when(timely, place))).alias("_path"),
    )
    sessions = sessions.withColumn("_parts", F.max("_part").over(spans)).withColumn("closed_by", closed).withColumn("client_id", F.col("_client"))
    sessions = sessions.withColumn("path", F.transform("_path", lambda c: c["_click"]))
    return small.unionByName(sessions.select(small.columns))


#: The same by SQL, with the length cuts as a recursion over the clicks of an island.
ORACLE = """
WITH RECURSIVE single AS (
  SELECT click_id, any_value(client_id) AS client_id, epoch_us(any_value(ts)) AS us, epoch_us(any_value(arrived_at)) AS arrived,
         any_value(kind) AS kind, any_value(value) AS value
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY click_id),
flagged AS (
  SELECT *, coalesce(arrived - us > 900000000, false) AS late, coalesce(value >= 60 AND kind IN ('purchase', 'signup'), false) AS final,
         coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents FROM single),
timely AS (
  SELECT *, row_number() OVER w AS k, lag(us) OVER w AS before_us, lag(final) OVER w AS before_final
  FROM flagged WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)),
cuts AS (
  SELECT client_id, k, us AS start_us, 'none' AS why FROM timely WHERE k = 1
  UNION ALL
  SELECT t.client_id, t.k, CASE WHEN t.before_final OR t.us - t.before_us >= 900000000 OR t.us - c.start_us > 3600000000 THEN t.us ELSE c.start_us END,
         CASE WHEN t.before_final THEN 'end' WHEN t.us - t.before_us >= 900000000 THEN 'gap' WHEN t.us - c.start_us > 3600000000 THEN 'length' ELSE '' END
  FROM cuts c JOIN timely t ON t.client_id = c.client_id AND t.k = c.k + 1),
numbered AS (
  SELECT t.*, c.why, sum(CASE WHEN c.why <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY t.client_id ORDER BY t.k) AS no
  FROM timely t JOIN cuts c ON t.client_id = c.client_id AND t.k = c.k),
sessions AS (
  SELECT client_id, no, arg_min(click_id, k) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, sum(cents) AS value_cents,
         arg_min(why, k) AS opened_by, arg_max(final, k) AS final, string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY k) AS path
  FROM numbered GROUP BY client_id, no),
spans AS (
  SELECT *, lead(start_us) OVER w AS next_us, lead(opened_by) OVER w AS next_by FROM sessions WINDOW w AS (PARTITION BY client_id ORDER BY no)),
lates AS (
  SELECT s.client_id, s.no, count(*) AS n FROM spans s JOIN flagged f
  ON f.client_id = s.client_id AND f.late AND f.us >= s.start_us AND (s.next_us IS NULL OR f.us < s.next_us) GROUP BY s.client_id, s.no)
SELECT s.client_id, s.session_id, s.start_us, s.end_us, s.n_clicks, coalesce(l.n, 0) AS n_late, CAST(s.value_cents AS BIGINT) AS value_cents,
       coalesce(s.next_by, CASE WHEN s.final THEN 'end' ELSE 'none' END) AS closed_by, sha256(s.path) AS path_sha256
FROM spans s LEFT JOIN lates l ON l.client_id = s.client_id AND l.no = s.no
"""
