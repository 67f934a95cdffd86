"""Typed graphs as (nodes, edges): edge derivation, decaying best-first walks, bounded reach, neighbourhoods, name resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.storage import cut

#: What an edge of each type lets through.
WEIGHTS = {"tests": 1.0, "calls": 0.8, "references": 0.8, "called_by": 0.5, "decorated_by": 0.5, "referenced_by": 0.3, "instantiates": 0.3, "contains": 0.8}


def typed_edges(nodes: DataFrame, calls: DataFrame, references: DataFrame, decorated: DataFrame, hub: int = 8, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(src, dst, edge_type, weight) that a walk follows.

    nodes: (id, kind, is_test, parent); calls, references, decorated: (src, dst). A call is `tests` from a test (to a class only if it is the test's one
    call), `instantiates` to a class, else `calls`. Backward edges lead to non-tests, from non-tests; called_by is left out where more than `hub`
    non-tests call. A class contains its methods.
    """
    c = calls.select("src", "dst").distinct()
    s = nodes.select(F.col("id").alias("src"), F.col("is_test").alias("src_test"))
    d = nodes.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"), F.col("is_test").alias("dst_test"))
    full = c.join(c.groupBy("src").agg(F.count("*").alias("n")), "src").join(s, "src").join(d, "dst")
    is_class = F.col("dst_kind") == "class"
    kind = F.when(is_class & F.col("src_test") & (F.col("n") == 1), "tests").when(is_class, "instantiates").when(F.col("src_test"), "tests").otherwise("calls")
    forward = full.select("src", "dst", kind.alias("edge_type"))
    back = full.where("not src_test and not dst_test")
    few = back.groupBy("dst").agg(F.count("*").alias("fans")).where(F.col("fans") <= hub).select("dst")
    called = back.join(few, "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("called_by").alias("edge_type"))
    r = references.select("src", "dst").distinct()
    back_refs = r.join(s, "src").join(d, "dst").where("not src_test and not dst_test")
    parts = (
        forward,
        called,
        r.withColumn("edge_type", F.lit("references")),
        back_refs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("referenced_by").alias("edge_type")),
        decorated.select("src", "dst").distinct().withColumn("edge_type", F.lit("decorated_by")),
        nodes.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("edge_type")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return out.withColumn("weight", F.element_at(table, F.col("edge_type")))


def walk(edges: DataFrame, seeds: DataFrame, decay: float = 0.9, max_hops: int = 3, min_score: float = 0.15, max_visited: int = 300, rounds: int = 20) -> DataFrame:
    """walk_by_query() of one query, whose seeds are (id, score): (id, score, hop, path)."""
    return walk_by_query(edges, seeds.withColumn("query_id", F.lit("")), decay, max_hops, min_score, max_visited, rounds).drop("query_id")


def walk_by_query(edges: DataFrame, seeds: DataFrame, decay: float = 0.9, max_hops: int = 3, min_score: float = 0.15, max_visited: int = 300, rounds: int = 20) -> DataFrame:
    """(query_id, id, score, hop, path) of every node that a walk from a query's seeds (query_id, id, score) reaches; all walks go on together.

    A node keeps its best product of weights and decay, with the hops of that very path; a node whose best path has max_hops hops is not left, even if a
    weaker path is shorter. So labels are recomputed from the seeds until they stand still; a label can only be wrong because of a better one, and every
    factor is below 1. Equal scores: fewer hops, then the smaller path. path: array of (src, edge_type) to the node. edges with weights such that
    weight * decay < 1; an error is raised if labels still move after `rounds`.

    A query leaves its best max_visited nodes only, by (score, hop, id); what these reach belongs to the result, however many nodes that are. The best path
    to one of them runs over better ones alone, so the labels of the walk without the bound say which they are.
    """
    empty = F.array().cast("array<struct<src:string,edge_type:string>>")
    base = seeds.groupBy("query_id", F.col("id").cast("string").alias("id")).agg(F.max(F.col("score").cast("double")).alias("score")).select("query_id", "id", "score", F.lit(0).alias("hop"), empty.alias("path"))
    e = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "edge_type", (F.col("weight") * decay).alias("w"))
    best = F.min(F.struct((-F.col("score")).alias("loss"), "hop", "path")).alias("b")

    def after(now: DataFrame) -> DataFrame:
        step = now.where(F.col("hop") < max_hops).join(e, F.col("id") == F.col("src"))
        new = step.select("query_id", F.col("dst").alias("id"), (F.col("score") * F.col("w")).alias("score"), (F.col("hop") + 1).alias("hop"), F.concat("path", F.array(F.struct("src", "edge_type"))).alias("path"))
        every = base.unionByName(new.where(F.col("score") >= min_score))
        return cut(every.groupBy("query_id", "id").agg(best).select("query_id", "id", (-F.col("b.loss")).alias("score"), "b.hop", "b.path"), "walk")

    def state(now: DataFrame) -> tuple:
        return tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("query_id", "id", "score", "hop"))).first())

    now = cut(base, "walk")
    seen = state(now)
    for _ in range(rounds):
        now, before = after(now), seen
        seen = state(now)
        if seen == before:
            order = Window.partitionBy("query_id").orderBy(F.desc("score"), "hop", "id")
            left = now.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_visited).drop("_n")
            return after(left) if now.groupBy("query_id").count().where(F.col("count") > max_visited).head(1) else now
    raise RuntimeError(f"the walk has not settled after {rounds} rounds")


def walk_hits(reached: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes that queries reach (query_id, id, score, hop, ...) with kind and rank within the query, best first; tests stay only if they are the query's seeds."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "hop", "id")
    n = nodes.select(F.col("id").cast("string").alias("id"), "kind", "is_test")
    s = seeds.select("query_id", F.col("id").cast("string").alias("id"), F.lit(True).alias("is_seed")).distinct()
    out = reached.join(n, "id").join(s, ["query_id", "id"], "left").where(~F.col("is_test") | F.col("is_seed"))
    return out.drop("is_seed").withColumn("rank", F.row_number().over(order).cast("long"))


def reach(edges: DataFrame, starts: DataFrame, max_edges: int = 4) -> DataFrame:
    """(start, node) pairs with a path of 1 to max_edges edges; a start reaches itself only round a cycle."""
    e = edges.select("src", "dst").distinct()
    front = starts.select(F.col("id").alias("start")).distinct().join(e, F.col("start") == F.col("src")).select("start", F.col("dst").alias("node"))
    out = front
    for _ in range(max_edges - 1):
        front = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        out = out.unionByName(front)
    return out.distinct()


def neighbourhood(edges: DataFrame, suspects: DataFrame) -> DataFrame:
    """Nodes one edge away from the suspects, either way, that are no suspects."""
    s = suspects.select("id").distinct()
    ways = edges.join(s, edges.src == s.id).select(F.col("dst").alias("node")).unionByName(edges.join(s, edges.dst == s.id).select(F.col("src").alias("node")))
    return ways.distinct().join(s.withColumnRenamed("id", "node"), "node", "left_anti")


def first_neighbours(edges: DataFrame, key: str, other: str, order: str, n: int = 5) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order, other)
    return edges.withColumn("ordinal", F.row_number().over(w).cast("long")).where(F.col("ordinal") <= n).select(key, other, "ordinal")


def resolve_names(wanted: DataFrame, symbols: DataFrame, name: str, symbol_name: str = "name", symbol_id: str = "id") -> DataFrame:
    """wanted with the id of the only symbol of that name, or a reason: no match, multiple matches."""
    by = symbols.groupBy(F.col(symbol_name).alias("_n")).agg(F.count("*").alias("_c"), F.min(symbol_id).alias("_id"))
    out = wanted.join(by, F.col(name) == F.col("_n"), "left")
    reason = F.when(F.col("_c").isNull(), "no match").when(F.col("_c") > 1, "multiple matches")
    return out.select(*wanted.columns, F.when(F.col("_c") == 1, F.col("_id")).alias("resolved_id"), reason.alias("reason"))


def build_edges(references: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends are nodes, once for each (src, dst, edge_type) with their last line, and the references that are none, with a reason.

    references: (src, dst, edge_type, line); nodes: (id). Reasons: no match (nothing named), caller not found, external.
    """
    n = nodes.select("id").distinct()
    both = references.join(n.select(F.col("id").alias("_s")), F.col("src") == F.col("_s"), "left").join(n.select(F.col("id").alias("_d")), F.col("dst") == F.col("_d"), "left")
    reason = F.when(F.col("dst").isNull(), "no match").when(F.col("_s").isNull(), "caller not found").when(F.col("_d").isNull(), "external")
    judged = both.withColumn("reason", reason)
    edges = judged.where("reason is null").groupBy("src", "dst", "edge_type").agg(F.max("line").alias("line"))
    return edges, judged.where("reason is not null").select("src", "dst", "edge_type", "line", "reason")


def tests_to_sources(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(test_id, source_id): what each test calls that is no test."""
    t = nodes.where("is_test").select(F.col("id").alias("src"))
    s = nodes.where("not is_test").select(F.col("id").alias("dst"))
    return edges.join(t, "src").join(s, "dst").select(F.col("src").alias("test_id"), F.col("dst").alias("source_id")).distinct()


#: Rounds of inherited() after which it looks for cycles; a chain without any goes on.
ROUNDS = 32


def inherited(bases: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, name, member): a class's member of each name, its own or the nearest base's, bases in order and depth first.

    Members go down to the classes that lack them, one step a round, each with its way as ordinals; a class that has the name itself ends the way, so a class
    and name meet in as many rows as there are lengths of ways to the name, not in one for each base above. Of the ways the first one holds. Chains of any
    depth are followed; classes above which bases form a cycle are answered by _inherited_round.
    """
    order = lambda way: F.min(F.struct(F.col(way).alias("way"), "member")).alias("_b")
    no_way = F.array().cast("array<int>")
    own = cut(members.groupBy("cls", "name").agg(F.min("member").alias("member")), "own")
    up = cut(bases.where("cls <> base").select("cls", "base", F.col("ordinal").cast("int").alias("ordinal")), "bases")  # a way over oneself is never the first
    front, rounds, circles = own.withColumn("way", no_way), [], None
    while True:
        step = front.select(F.col("cls").alias("base"), "name", "member", F.col("way").alias("_way")).join(up, "base")
        step = step.withColumn("way", F.concat(F.array("ordinal"), "_way")).join(own.select("cls", "name"), ["cls", "name"], "left_anti")
        step = step.join(circles, "cls", "left_anti") if circles is not None else step
        front = cut(step.groupBy("cls", "name").agg(order("way")).select("cls", "name", "_b.member", "_b.way"), "inherited-step")
        if front.isEmpty():
            break
        rounds.append(front.cut_at)
        if len(rounds) == ROUNDS:
            circles = _above_cycles(up)
            front = front.join(circles, "cls", "left_anti")
    out = own.select("cls", "name", "member")
    if rounds:
        found = front.sparkSession.read.schema(front.schema).parquet(*rounds)
        found = found.join(circles, "cls", "left_anti") if circles is not None else found
        out = out.unionByName(found.groupBy("cls", "name").agg(order("way")).select("cls", "name", "_b.member"))
    if circles is not None:
        out = out.join(circles, "cls", "left_anti").unionByName(_inherited_round(circles, up, own))
    return cut(out, "inherited")


def _above_cycles(up: DataFrame) -> DataFrame:
    """(cls): classes from which bases lead into a cycle: what is left when classes without bases are taken away, again and again."""
    left, before = up, -1
    while (n := left.count()) != before:
        before, left = n, cut(left.join(left.select(F.col("cls").alias("base")).distinct(), "base", "left_semi"), "circles")
    return cut(left.select("cls").distinct(), "circles")


def _inherited_round(origins: DataFrame, bases: DataFrame, members: DataFrame) -> DataFrame:
    """inherited() of the origins (cls), whatever cycles they lead into.

    For each origin and base the first way to it is kept, as ordinals; a step extends the ways that became earlier, until none does. A way round a cycle is
    never earlier, so cycles end.
    """
    best = cut(origins.select(F.col("cls").alias("origin"), F.col("cls").alias("at"), F.array().cast("array<int>").alias("way")), "ways")
    front = best
    while not front.isEmpty():
        step = front.join(bases, F.col("at") == F.col("cls")).select("origin", F.col("base").alias("at"), F.concat("way", F.array(F.col("ordinal").cast("int"))).alias("way"))
        step = step.groupBy("origin", "at").agg(F.min("way").alias("way"))
        known = best.select(F.col("origin").alias("_o"), F.col("at").alias("_a"), F.col("way").alias("_w"))
        earlier = step.join(known, (F.col("origin") == F.col("_o")) & (F.col("at") == F.col("_a")), "left").where("_w is null or way < _w")
        front = cut(earlier.select("origin", "at", "way"), "ways")
        best = cut(best.unionByName(front).groupBy("origin", "at").agg(F.min("way").alias("way")), "ways")
    found = best.join(members, F.col("at") == F.col("cls")).groupBy("origin", "name").agg(F.min_by("member", F.struct("way", "member")).alias("member"))
    return found.withColumnRenamed("origin", "cls")
