"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests. DataFrame functions only.

A paragraph is a stretch of a line up to a word that ends in one of a few letters or signs, of 24 words at most: where paragraphs end depends on the words
alone, so a word put in changes the paragraph round it and leaves the others. Each distinct paragraph's 64-bit digest goes to one cell in each of three
tables; a cell has the number of its digests, their XOR and the XOR of their checks. Sketches of two versions subtract cell by cell: what they share
cancels, and peeling recovers the rest: a cell with one digest left gives it away, and taking it out of its other cells makes more such cells.

A fingerprint is a sketch of four cells a table, as text. Two versions are compared by sketches of the larger one's size class, a power of two of cells for
each table; where peeling is left with something, with larger ones. Sketches of that size have few cells that are not empty, so they are kept as rows (cell,
count, XOR, check) and subtract in an aggregation, without a shuffle of their own. Likeness is the share of paragraph digests, of both versions together,
that are not recovered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.columns import let
from gleanery.llm.common import cut, width

#: Cells of a table of a fingerprint.
SMALL = 4
#: Cells of a table for each digest of the larger version, and for each retry; rounded up to a power of two.
WIDE = (32, 128, 1024, 16384)
ROUNDS = 12
FIRST = -(2**63)
#: A word that ends a paragraph, by its last letter or sign.
ENDS = r"[^ \n]*[lmpw.!?:;](?![^ \n])"
PARAGRAPH = rf"(?:(?!{ENDS})[^ \n]++ *+){{0,23}}[^ \n]++ *+"


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs, sorted."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))))


def empty_cell() -> Column:
    return F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))


def put(cell: Column, n: Column, key: Column) -> Column:
    return F.struct((cell["c"] + n).alias("c"), cell["k"].bitwiseXOR(key).alias("k"), cell["h"].bitwiseXOR(F.xxhash64(key)).alias("h"))


def first_sketch(keys: Column) -> Column:
    """The sketch of an array of digests that is its fingerprint: 3 * SMALL cells; low bits of a digest say where it belongs."""
    belongs = lambda k, t, i: F.shiftright(k, 8 * t).bitwiseAND(F.lit(SMALL - 1).cast("long")) == F.lit(i).cast("long")
    cell = lambda t, i: F.aggregate(F.filter(keys, lambda k: belongs(k, t, i)), empty_cell(), lambda a, k: put(a, F.lit(1), k))
    return F.array(*[cell(t, i) for t in range(3) for i in range(SMALL)])


def cell_of(key: Column, t: Column, m: Column, seed: int) -> Column:
    """The cell of table t, of m cells, m a power of two, that a digest belongs to."""
    return F.xxhash64(key, t, F.lit(seed)).bitwiseAND(m - 1)


def peel(found: Column, left: Column, m: Column, seed: int) -> Column:
    """Number of digests recovered from a difference of sketches; -1 if something is left.

    found: what cells with one digest give away: (k, c) each, c the sign of its version; left: the other cells that are not empty: (t, j, c, k, h).
    """

    def without(cells: Column, keys: Column) -> Column:
        mine = lambda x: F.filter(keys, lambda p: cell_of(p["k"], x["t"], m, seed) == x["j"])
        less = lambda x: F.aggregate(mine(x), F.struct(x["c"].alias("c"), x["k"].alias("k"), x["h"].alias("h")), lambda a, p: put(a, -p["c"], p["k"]))
        return F.transform(cells, lambda x: let(less(x), lambda y: F.struct(x["t"].alias("t"), x["j"].alias("j"), y["c"].alias("c"), y["k"].alias("k"), y["h"].alias("h"))))

    def pure(cells: Column) -> Column:
        alone = F.filter(cells, lambda x: (F.abs(x["c"]) == 1) & (F.xxhash64(x["k"]) == x["h"]))
        return F.array_distinct(F.transform(alone, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"))))

    def step(s: Column, _: Column) -> Column:
        again = let(without(s["cells"], s["keys"]), lambda cells: F.struct(cells.alias("cells"), pure(cells).alias("keys"), (s["n"] + F.size(s["keys"])).alias("n")))
        return F.when(F.size(s["keys"]) > 0, again).otherwise(s)

    start = F.struct(left.alias("cells"), found.alias("keys"), F.lit(0).alias("n"))
    rest = lambda s: F.exists(s["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0)) | (F.size(s["keys"]) > 0)
    slow = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(rest(s), F.lit(-1)).otherwise(s["n"]))
    return F.when(F.size(left) == 0, F.size(found)).otherwise(slow)


def recovered(pairs: DataFrame, keys: list[str], wide: int, seed: int) -> DataFrame:
    """(keys, n) of pairs (keys, a, b) of arrays of digests that differ: how many digests peeling recovers from their sketches' difference, or -1.

    Each version's sketch adds its digests to cells, the second with the opposite sign. pairs are dealt by the first key already, so nothing is shuffled.
    """
    m = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size("a"), F.size("b"), F.lit(1)) * F.lit(wide)))).cast("long")
    one = pairs.select(*keys, m.alias("m"), F.size("a").alias("na"), F.posexplode(F.concat("a", "b")).alias("i", "k"))
    one = one.select(*keys, "m", "k", F.when(F.col("i") < F.col("na"), 1).otherwise(-1).cast("long").alias("sign"), F.explode(F.array(*[F.lit(t) for t in range(3)])).alias("t"))
    one = one.withColumn("j", cell_of(F.col("k"), F.col("t"), F.col("m"), seed))
    cells = one.groupBy(*keys, "m", "t", "j").agg(F.sum("sign").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor(F.xxhash64("k")).alias("h")).where("c <> 0 or k <> 0 or h <> 0")
    pure = (F.abs("c") == 1) & (F.xxhash64("k") == F.col("h"))
    per = cells.groupBy(*keys, "m").agg(F.collect_set(F.when(pure, F.struct("k", "c"))).alias("found"), F.collect_list(F.when(~pure, F.struct("t", "j", "c", "k", "h"))).alias("left"))
    return per.select(*keys, peel(F.col("found"), F.col("left"), F.col("m"), seed).alias("n"))


def text_of(cells: Column) -> Column:
    """A sketch as text: the cells in order, each as count, XOR and check."""
    return F.array_join(F.transform(cells, lambda x: F.concat(x["c"].cast("string"), F.lit(":"), F.hex(x["k"]), F.lit(":"), F.hex(x["h"]))), " ")


def with_next(rows: DataFrame, key: str, order: list[str], carried: list[str]) -> DataFrame:
    """Adds next_<column> of the following row, by key and then `order`, and the row's place (bucket, rn); after the last row comes the first.

    One shuffle: rows are dealt by bounds that are keys of the table, and a row that begins a stretch also goes, as a ghost, to the stretch before. The
    bounds, four for each shuffle partition, are a table of one row that is sent, and are looked up in two steps.
    """
    n = 4 * width(rows.sparkSession)
    found = rows.agg(F.percentile_approx(key, [k / n for k in range(n)], 100 * n)).first()[0]
    bounds = sorted(set(found or [0]))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[a : a + step] for a in range(0, len(bounds), step)]
    sent = rows.sparkSession.createDataFrame([([g[0] for g in groups], groups)], "_heads array<long>, _inner array<array<long>>")
    count = lambda xs, k: F.size(F.filter(xs, lambda x: x <= k))
    k = F.col(key)
    d = rows.crossJoin(F.broadcast(sent))  # one row
    d = d.withColumn("_g", F.greatest(F.lit(1), count(F.col("_heads"), k))).withColumn("_in", F.element_at("_inner", F.col("_g"))).withColumn("_i", F.greatest(F.lit(1), count(F.col("_in"), k)))
    own = (F.col("_g") - 1) * step + F.col("_i")
    ghost = F.when(own == 1, F.lit(len(bounds))).otherwise(own - 1)
    at = lambda b, g: F.struct(b.cast("int").alias("bucket"), F.lit(g).alias("ghost"))
    begins = F.element_at("_in", F.col("_i")) == k
    d = d.select(*rows.columns, F.explode(F.when(begins, F.array(at(own, False), at(ghost, True))).otherwise(F.array(at(own, False)))).alias("_at"))
    d = d.select(*rows.columns, F.col("_at.bucket").alias("bucket"), F.col("_at.ghost").alias("_ghost")).repartition(n, "bucket")
    w = Window.partitionBy("bucket").orderBy("_ghost", key, *order)
    out = d.select(*rows.columns, "bucket", "_ghost", F.row_number().over(w).alias("rn"), *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return out.where(~F.col("_ghost")).drop("_ghost")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: tuple[int, ...] = WIDE) -> DataFrame:
    """Fingerprints of every document and of its edited version, and their likeness.

    Edited: the last floor(n_chars / 4) code points are replaced by the first as many (or all) of the next document, by ascending id; after the last
    document comes the first. Returns id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs; one row for
    each row of docs; other columns are ignored. Equal texts have equal fingerprints.

    Defined results: a null text is empty; a text without a word has a sketch of empty cells, like only to another such one (1.0); texts with the same set
    of paragraphs are alike (1.0), whatever their order, how often each stands, or blank lines; a null id comes before all others; rows of one id follow one another by the
    text's hash and text, so reruns agree; a single row is its own next; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = with_next(d.withColumn("key", F.coalesce("id", F.lit(FIRST).cast("long"))).withColumn("h", F.xxhash64("text")), "key", ["h", "text", "id"], ["text"])  # id is there for either use of the rows, so they are dealt once
    out, some = None, d
    for seed, w in enumerate(wide):
        tried = _compared(some, w, seed)
        out = tried.where("n_edited >= 0 and n_next >= 0") if out is None else out.unionByName(tried.where("n_edited >= 0 and n_next >= 0"))
        failed = tried.where("n_edited < 0 or n_next < 0").select("bucket", "rn")
        if failed.isEmpty():
            break
        some = d.join(failed, ["bucket", "rn"], "left_semi")
    else:
        raise RuntimeError("a difference of sketches could not be peeled")
    like = lambda n, other: F.when(F.col("na") + F.col(other) == 0, F.lit(1.0)).otherwise(1.0 - F.col(n) / (F.col("na") + F.col(other)).cast("double"))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("n_edited", "nb").alias("near_edited"), like("n_next", "nc").alias("near_next"), F.col("na").cast("long").alias("n_paragraphs"))


def _compared(d: DataFrame, wide: int, seed: int) -> DataFrame:
    """Rows (bucket, rn, id, text, next_text) with what is said of them, and how many digests differ from the edited and the next text's; -1 where the
    sketches do not give it back. Stored. Rows stay where their bucket is: neither the sketches nor their join to the rest are dealt again."""
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), quarter))
    d = d.select("bucket", "rn", "id", F.length("text").cast("long").alias("n_chars"), digests(F.col("text")).alias("own"), digests(F.col("next_text")).alias("next_own"), edited.alias("edited"))
    d = d.select("*", digests(F.col("edited")).alias("new"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("pair"), F.col("new").alias("b")), F.struct(F.lit(1).alias("pair"), F.col("next_own").alias("b")))).alias("p")
    pairs = d.select("bucket", "rn", F.col("own").alias("a"), both).select("bucket", "rn", "p.pair", "a", "p.b").where("a <> b")
    of = lambda k: F.coalesce(F.max(F.when(F.col("pair") == k, F.col("n"))), F.lit(0))
    n = recovered(pairs, ["bucket", "rn", "pair"], wide, seed).groupBy(F.col("bucket").alias("_b"), F.col("rn").alias("_r")).agg(of(0).alias("n_edited"), of(1).alias("n_next"))
    said = d.select(
        "bucket", "rn", "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), text_of(first_sketch(F.col("own"))).alias("fingerprint"),
        text_of(first_sketch(F.col("new"))).alias("edited_fingerprint"), F.size("own").alias("na"), F.size("new").alias("nb"), F.size("next_own").alias("nc"),
    )
    out = said.join(n, (F.col("bucket") == F.col("_b")) & (F.col("rn") == F.col("_r")), "left").drop("_b", "_r")
    conf, key = d.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(key)
    conf.set(key, "false")  # both sides are dealt by bucket: that is enough
    try:
        return cut(out.fillna(0, ["n_edited", "n_next"]), "compared")
    finally:
        conf.set(key, before)
