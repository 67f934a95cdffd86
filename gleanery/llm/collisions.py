"""Near-duplicate vectors by counting collisions: many one-dimensional projections are sorted, each vector counts who falls into a window round it in how many
of them, and pairs with enough collisions are verified by their cosine.

Vectors are first dealt to blocks, several times over, by the halves of a few further projections that they lie in, so that a vector's windows are searched among
about a thousand others and not among all. Window, number of collisions and number of dealings follow from the recall that is asked for at the least cosine.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_bytes, cut, forget, lean
from gleanery.llm.components import components

#: Sorted projections of a block.
PROJECTIONS = 32
SEED = 20_240_501


def calibrated(rows: int, cosine: float, recall: float, block: int) -> tuple[float, int, int, int]:
    """(window, least collisions, halves, dealings) for so many vectors.

    Projections on Gaussian directions of two unit vectors differ by a normal deviate of the vectors' distance: a window of 1.1 distances catches a pair at the
    least cosine with probability 0.73, independently in each projection, so collisions are binomial; the least number loses half of what recall allows at
    most. Two such vectors lie in the same half with probability 1 - angle / pi, so a dealing by h halves brings them together with its h-th power, and the dealings
    are as many as the other half of the loss allows.
    """
    apart = math.sqrt(2 * (1 - cosine))
    window, p = 1.1 * apart, math.erf(1.1 / math.sqrt(2))
    lost, least = 0.0, 0
    while lost + math.comb(PROJECTIONS, least) * p**least * (1 - p) ** (PROJECTIONS - least) <= (1 - recall) / 2:
        lost += math.comb(PROJECTIONS, least) * p**least * (1 - p) ** (PROJECTIONS - least)
        least += 1
    halves = min(60, max(0, math.ceil(math.log2(max(rows, 1) / block))))
    meet = (1 - math.acos(cosine) / math.pi) ** halves
    dealings = 1 if meet > 1 - 1e-12 else math.ceil(math.log((1 - recall) / 2) / math.log(1 - meet))
    return window, least, halves, dealings


@cache
def directions(dims: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed, dims]).standard_normal((dims, n))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, scaled first so that no square over- or underflows."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def halved(halves: int, dealings: int):
    """Adds `keys`: a vector's block in each dealing, as the bits of the halves it lies in."""

    def each(batches):
        for b in batches:
            at = b.schema.get_field_index("vec")
            vecs = b.column(at)
            sizes = np.asarray(vecs.value_lengths())
            keys = np.zeros((b.num_rows, dealings), np.int64)
            for d in np.unique(sizes) if halves else ():
                rows = np.flatnonzero(sizes == d)
                x = np.asarray(vecs.take(pa.array(rows)).flatten()).reshape(-1, d)
                side = unit(x) @ directions(int(d), halves * dealings, 0) >= 0
                keys[rows] = side.reshape(-1, dealings, halves) @ (1 << np.arange(halves, dtype=np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, dealings), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], [*b.schema.names, "keys"])

    return each


def counted(window: float, least: int, cosine: float):
    """Links of one tile of a block: (cls, n, other). n adds up to the weight of a vector's links; the pairs (cls, other) are a spanning forest of them."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def each(tile: pa.Table) -> pa.Table:
        i, j, t = (tile.column(c)[0].as_py() for c in ("i", "j", "t"))
        vecs = tile.column("vec").combine_chunks()
        x = unit(np.asarray(vecs.flatten()).reshape(tile.num_rows, -1))
        cls, w, sub = (tile.column(c).to_numpy() for c in ("cls", "w", "sub"))
        keys = np.asarray(tile.column("keys").combine_chunks().flatten()).reshape(tile.num_rows, -1)[:, :t]
        left, right = np.flatnonzero(sub == i), np.flatnonzero(sub == j)
        place = x @ directions(x.shape[1], PROJECTIONS, 1)
        order = np.argsort(place[right], axis=0, kind="stable").astype(np.int32)
        ranked = np.take_along_axis(place[right], order, axis=0)
        low = np.stack([np.searchsorted(ranked[:, p], place[left, p] - window, "left") for p in range(PROJECTIONS)], 1)
        high = np.stack([np.searchsorted(ranked[:, p], place[left, p] + window, "right") for p in range(PROJECTIONS)], 1)
        by = np.ascontiguousarray(order.T)
        n, label, edges = np.zeros(tile.num_rows, np.int64), np.arange(tile.num_rows), []
        for q, a in enumerate(left):
            hits = np.bincount(np.concatenate([by[p, low[q, p] : high[q, p]] for p in range(PROJECTIONS)]), minlength=len(right))
            found = right[hits >= least]
            if i == j:
                found = found[found > a]
            if t:  # a pair counts in the first dealing that brings it together
                found = found[(keys[found] != keys[a]).all(axis=1)]
            found = found[x[found] @ x[a] >= cosine]
            if not len(found):
                continue
            n[a] += w[found].sum()
            n[found] += w[a]
            strange, where = np.unique(label[found], return_index=True)
            for name, b in zip(strange, found[where], strict=True):
                if name != label[a]:
                    edges.append((cls[a], cls[b]))
                    label[label == name] = label[a]
        some = np.flatnonzero(n)
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        nothing = pa.nulls(len(some), pa.int64())
        return pa.concat_tables(
            [
                pa.Table.from_arrays([pa.array(cls[some]), pa.array(n[some]), nothing], schema=schema),
                pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(np.zeros(len(pairs), np.int64)), pa.array(pairs[:, 1])], schema=schema),
            ]
        )

    return each


def usable(vec: Column) -> Column:
    """Whether a vector has a direction: all components finite, one not zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, recall: float = 0.95, block: int = 1024) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: the number of other rows whose cosine is at least `cosine`, and the smallest id that links reach.

    Equal vectors are one class with a weight, whatever their number; classes are dealt, and only numbers and a spanning forest of the links leave a block. A
    block of more than `block` classes is cut into tiles of two parts each, so no task holds more than two parts of about `block`; of a family of n vectors
    that all lie in one block, n * n / block rows are sent. All links found are verified in double precision; a pair at exactly `cosine` is found
    with probability `recall` or more, nearer pairs more often.

    Defined results: vectors that are null, zero, empty, or have null or non-finite components link with nothing; vectors of different length do not link;
    rows of one id are rows of their own; a null id links like any other but names no component unless no member has an id, and is kept only then. An empty table
    gives no rows; further columns are not read.
    """
    spark = vectors.sparkSession
    arrow_bytes(spark)
    vec = F.when(usable(F.col(vec_col)), F.col(vec_col))
    read = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    hashed = lambda *c: F.when(F.col("vec").isNotNull(), F.xxhash64(*c))
    named = read.withColumn("k1", hashed("vec")).withColumn("k2", hashed(F.lit(1), F.reverse("vec")))
    window, least, halves, dealings = calibrated(vectors.count(), cosine, recall, block)
    classes = named.where("vec IS NOT NULL").groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.count("*").alias("w"), F.min("id").alias("least"))
    classes = classes.withColumn("cls", F.monotonically_increasing_id())
    kind = vectors.schema[vec_col].dataType.simpleString()
    dealt = cut(classes.mapInArrow(lean(halved(halves, dealings)), f"k1 bigint, k2 bigint, vec {kind}, w bigint, least bigint, cls bigint, keys array<bigint>"), "near-vectors")
    rows = dealt.select("cls", "w", "vec", "keys", F.size("vec").alias("dims"), F.posexplode("keys").alias("t", "key"))
    place = ["t", "dims", "key"]
    large = rows.groupBy(*place).count().where(F.col("count") > block).select(*place, F.ceil(F.col("count") / block).cast("int").alias("parts"))
    placed = rows.join(large, place, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    tile = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("sub", o).alias("i"), F.greatest("sub", o).alias("j")))
    tiles = placed.withColumn("_t", F.explode(tile)).select(*place, "_t.i", "_t.j", "cls", "w", "vec", "keys", "sub")
    found = cut(tiles.groupBy(*place, "i", "j").applyInArrow(lean(counted(window, least, cosine)), "cls bigint, n bigint, other bigint"), "near-links")
    sums = found.groupBy("cls").agg(F.sum("n").alias("n"))
    groups = components(found.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    known = dealt.select("cls", "k1", "k2", "w", "least").join(sums, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    known = known.select("k1", "k2", F.coalesce("n", F.lit(0)).alias("n"), "w", "least", F.coalesce("component", "cls").alias("component"))
    names = known.groupBy("component").agg(F.min("least").alias("name"))
    known = cut(known.join(names, "component").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("n") + F.col("w") - 1).alias("n"), "name"), "near-classes")
    out = named.drop("vec").join(known, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    forget(dealt)
    forget(found)
    own = F.when(F.col("c1").isNull(), F.col("id")).otherwise(F.col("name"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
