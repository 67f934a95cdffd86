"""Components of documents that share most of their word shingles: an exact Jaccard join by T-occurrence search.

Documents with one shingle set are one class. With the rare shingles of every set first (any order that all sets share is right), two linked sets share
some of their first shingles. A first pass, in an order from a bounded table of counts, leaves the classes that share any; a second counts the shingles
of these, and in this exact order connects classes that share first ones to families. Linked classes are always of one family; most classes have none. A family's texts come to one block, small families together; there the T-occurrence search
finds the links: over the inverted lists of the block's rare-first prefixes, a class merges its short lists by a heap, looks what these bring up in its
long lists by binary search (DivideSkip), and retains the partners that reach the required overlap, which are then compared set by set. Partners
that are connected already are passed over, so a block returns fewer links than it has classes, however alike they are.

A family beyond a block's size is dealt over several. Its parts are searched by themselves first; what that leaves unconnected to the family's main
component is then searched for in every part. So a family of copies costs in proportion to its size, and only one of texts that are alike but do not link
costs more: its classes, squared, over the classes of a block, in rows sent; no pair is ever sent.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_bytes, cut, forget, held, lean, pack, text_bytes, unpack, width
from gleanery.llm.components import components

#: Shingles of a block's sets together, about; a single set may be larger.
BLOCK = 1 << 21
#: Length bands of a search: partners of a narrower range of sizes must share more.
BANDS = 4
LOWER = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _power(n: int) -> list[np.ndarray]:
    """Powers 0 to n - 1 (at least) of the base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, x in enumerate((BASE, INVERSE)):
            p = np.full(2 * n, x, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def all_shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its shingles; with fewer words, of the whole sequence; empty without a word.

    Words are hashed by differences of running sums of byte values times powers of a base, for about a megabyte of texts at a time.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < 1 << 20):
            size += len(texts[upto]) + 1
            upto += 1
        out += _some_shingles(texts[at:upto], words)
        at = upto
    return out


def _some_shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    blank = BLANK[data]
    edge = np.diff(np.r_[True, blank].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(BYTES[data] * power[: len(data)], dtype=np.uint64)]
        h = _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        first = np.searchsorted(starts, np.r_[0, text_ends])
        n_words = np.diff(first)
        rolled = np.full(max(0, len(h) - words + 1), words, np.uint64)
        for i in range(words):
            rolled = _mixed((rolled ^ h[i : i + len(rolled)]) * np.uint64(BASE))
        out = []
        for k, n in enumerate(n_words.tolist()):
            a = int(first[k])
            if n >= words:
                s = np.sort(rolled[a : a + n - words + 1])
                out.append(s[np.r_[True, s[1:] != s[:-1]]])
            elif n:
                x = np.full(1, n, np.uint64)
                for i in range(n):
                    x = _mixed((x ^ h[a + i : a + i + 1]) * np.uint64(BASE))
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def required(n, m, num: int, den: int):
    """Smallest overlap of two sets of n and m members whose Jaccard similarity is num / den or more."""
    return -(-num * (n + m) // (num + den))


def first_ones(n: int, num: int, den: int) -> tuple[int, int]:
    """How many of a set's first members get lists, and how many of these a linked set shares at least (if its own number is no smaller)."""
    least = -(-num * n // den)  # the overlap with the smallest set that may link
    t = 1 + n // 50
    return min(n, n - least + t), t


def scan(docs: DataFrame, words: int) -> DataFrame:
    """kind 0: (id, n, class) of each document. kind 1: shingles (as id) that several classes of one batch have, and how many (n)."""

    def run(batches):
        held("jaccard")
        for b in batches:
            ids, ns, cs, sets = b.column(0).to_pylist(), [], [], {}
            for s in all_shingles(b.column(1).to_pylist(), words):
                c = class_of(s)
                sets[c] = s
                ns.append(len(s)), cs.append(c)
            every, count = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            often = count >= 3
            hot, hot_n = every[often].view(np.int64), count[often]
            none = np.zeros(len(hot), np.int64)
            kinds = pa.array(np.r_[np.zeros(len(ids), np.int32), np.ones(len(hot), np.int32)])
            yield pa.RecordBatch.from_arrays([kinds, pa.concat_arrays([pa.array(ids, pa.int64()), pa.array(hot)]), pa.array(np.r_[np.array(ns, np.int64), hot_n]), pa.array(np.r_[np.array(cs, np.int64), none])], ["kind", "id", "n", "class"])

    return docs.mapInArrow(lean(run), "kind int, id long, n long, class long")


def _dealt(key: np.ndarray, shards: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """(shard, block): the entries of parallel arrays, dealt by key."""
    shard = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    blocks = [(k, pack(*(x[o] for x in arrays))) for k in range(shards) if len(o := order[cuts[k] : cuts[k + 1]])]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], ["shard", "block"])


def _gathered(table: pa.Table, *types: str) -> list[np.ndarray]:
    """The entries of a shard's blocks."""
    parts = [unpack(x, *types) for x in table.column("block").to_pylist()]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _on_lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, class, n) by token, of the tokens that two classes or more have."""
    token, c, n = _gathered(table, "<u8", "<i8", "<i8")
    order = np.lexsort((c, token))
    token, c, n = token[order], c[order], n[order]
    fresh = np.r_[True, (token[1:] != token[:-1]) | (c[1:] != c[:-1])]
    token, c, n = token[fresh], c[fresh], n[fresh]
    same = np.r_[False, token[1:] == token[:-1], False]
    many = same[1:] | same[:-1]
    return token[many], c[many], n[many]


def sharing(docs: DataFrame, sent, words: int, shards: int, num: int, den: int) -> DataFrame:
    """(class, shared, n): of each shard of shingles, the classes that have first ones in common with other classes, and how many. The order of shingles is
    that of the counts sent, so it is rough: classes may share a passage whose frequency these counts do not know."""

    def run(batches):
        hot, hot_n = sent.value
        for b in batches:
            seen, cols = set(), ([], [], [])
            for s in all_shingles(b.column(0).to_pylist(), words):
                c = class_of(s)
                if len(s) * (den - num) < num or c in seen:  # a set this small links to no other
                    continue
                seen.add(c)
                often = np.zeros(len(s), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    often = np.where(hot[at] == s, hot_n[at], 0)
                k = first_ones(len(s), num, den)[0]
                cols[0].append(s[np.lexsort((s, often))[:k]])
                cols[1].append(np.full(k, c, np.int64))
                cols[2].append(np.full(k, len(s), np.int64))
            if seen:
                token, c, n = map(np.concatenate, cols)
                yield _dealt(token, shards, token, c, n)

    def count(table: pa.Table) -> pa.Table:
        _, c, n = _on_lists(table)
        classes, first, shared = np.unique(c, return_index=True, return_counts=True)
        return pa.table({"class": classes, "shared": shared.astype(np.int64), "n": n[first]})

    blocks = docs.select("text").mapInArrow(lean(run), "shard int, block binary")
    return blocks.groupBy("shard").applyInArrow(lean(count), "class long, shared long, n long")


def families(texts: DataFrame, words: int, shards: int, num: int, den: int) -> DataFrame:
    """(class, root, shared, n) of classes (class, text): by shard of shingles, the least class that common first ones connect a class with, and how many
    first ones it shares. Shingles are in the order of the number of these classes that have them: exact, so first ones are common to like texts alone.

    Three rounds by shard: shingles are counted; each class is told the counts above one and picks its first ones; lists of these connect classes.
    """

    def deal(batches):
        for b in batches:
            sets = all_shingles(b.column(1).to_pylist(), words)
            n = np.array([len(s) for s in sets], np.int64)
            if n.sum():
                token = np.concatenate(sets)
                yield _dealt(token, shards, token, np.repeat(np.array(b.column(0).to_pylist(), np.int64), n), np.repeat(n, n))

    def count(table: pa.Table) -> pa.Table:
        token, c, n = _on_lists(table)
        _, of, often = np.unique(token, return_inverse=True, return_counts=True)
        return pa.Table.from_batches([_dealt(c.view(np.uint64), shards, token, c, n, often[of].astype(np.int64))], pa.schema([("shard", pa.int32()), ("block", pa.binary())]))

    def pick(table: pa.Table) -> pa.Table:
        token, c, n, often = _gathered(table, "<u8", "<i8", "<i8", "<i8")
        order = np.lexsort((token, often, c))
        token, c, n = token[order], c[order], n[order]
        begins = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])[: len(c)]
        own = np.diff(np.r_[begins, len(c)])
        least = -(-num * n // den)
        first = np.minimum(n, n - least + 1 + n // 50) - (n - np.repeat(own, own))  # members of one class alone come before all others
        keep = np.arange(len(c)) - np.repeat(begins, own) < first
        return pa.Table.from_batches([_dealt(token[keep], shards, token[keep], c[keep], n[keep])], pa.schema([("shard", pa.int32()), ("block", pa.binary())]))

    def connect(table: pa.Table) -> pa.Table:
        token, c, n = _on_lists(table)
        classes, first, of = np.unique(c, return_index=True, return_inverse=True)
        begins = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])[: len(token)]
        sizes = np.diff(np.r_[begins, len(token)])
        root = np.arange(len(classes))
        while len(token):
            least = np.repeat(np.minimum.reduceat(root[of], begins), sizes)
            after = root.copy()
            np.minimum.at(after, of, least)
            np.minimum.at(after, root[of], least)
            after = after[after]
            if np.array_equal(after, root):
                break
            root = after
        return pa.table({"class": classes, "root": classes[root], "shared": np.bincount(of, minlength=len(classes)).astype(np.int64), "n": n[first]})

    blocks = texts.select("class", "text").mapInArrow(lean(deal), "shard int, block binary")
    for step in (count, pick):
        blocks = blocks.groupBy("shard").applyInArrow(lean(step), "shard int, block binary")
    return blocks.groupBy("shard").applyInArrow(lean(connect), "class long, root long, shared long, n long")


def fewest_shared(n, m, num: int, den: int):
    """How many of their first ones two sets of n and m members share at least, if they link.

    Of two sets, the one whose first ones end earlier in the common order has all other common members behind them; so the overlap is at most what the
    first ones share and what stands behind the first ones of one of the two.
    """
    behind = lambda k: np.maximum(0, -(-num * k // den) - 1 - k // 50)
    return np.maximum(1, required(n, m, num, den) - np.maximum(behind(n), behind(m)))


def divide_skip(lists: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Which of len(need) records stand on at least need[record] of the lists (sorted record numbers): the T-occurrence problem by DivideSkip.

    The longest lists, fewer than the smallest need, are set aside; the others are merged by a heap. A record whose count the long lists can lift to its
    need is looked up in each of them by binary search.
    """
    counts = np.zeros(len(need), np.int64)
    lists = sorted(lists, key=len)
    t = int(need.min()) if len(need) else 0
    if len(lists) < t:
        return np.zeros(0, np.int64)
    n_long = max(0, min(t - 1, len(lists)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    for group in _merged(short):
        counts[group[0]] += group[1]
    alive = np.flatnonzero(counts + len(long) >= need) if n_long < t else np.arange(len(need))
    alive = alive[counts[alive] > 0] if n_long < t else alive
    for x in reversed(long):
        at = np.searchsorted(x, alive)
        counts[alive] += (at < len(x)) & (x[np.minimum(at, len(x) - 1)] == alive)
    return np.flatnonzero(counts >= need)


def _merged(lists: list[np.ndarray]):
    """(record, how many lists) in record order, from a heap of the lists' heads."""
    last, n = -1, 0
    for r in heapq.merge(*(x.tolist() for x in lists)):
        if r == last:
            n += 1
        else:
            if n:
                yield last, n
            last, n = r, 1
    if n:
        yield last, n


def search(sets: list[np.ndarray], roots: np.ndarray, probes: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (a, b) between the sets, sorted arrays, that connect what roots (equal numbers: connected already) leaves apart; one side is always a probe.

    Together with roots, they connect every two linked sets of which one is a probe; a link between connected sets is not looked for.
    """
    links: list[tuple[int, int]] = []
    order = np.argsort([len(s) for s in sets], kind="stable")
    n = np.array([len(sets[i]) for i in order], np.int64)
    if not len(n):
        return links
    root, probe = np.unique(roots, return_inverse=True)[1][order], probes[order]
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(n)), n)
    by = np.argsort(tokens, kind="stable")
    fresh = np.r_[True, tokens[by[1:]] != tokens[by[:-1]]]
    number = np.empty(len(tokens), np.int64)
    number[by] = np.cumsum(fresh) - 1
    often = np.bincount(number)[number]
    by = np.lexsort((number, often, owner))  # each set's members, those on the shortest lists first
    ends = np.cumsum(n)
    place = np.arange(len(by)) - np.repeat(ends - n, n)
    own = [number[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]  # in one order for all sets, as the tokens are sorted in each
    k = np.minimum(n, n + (num * n // -den) + 1 + n // 50)
    listed = by[(place < np.repeat(k, n)) & (often[by] > 1)]
    mine = np.split(number[listed], np.searchsorted(owner[listed], np.arange(1, len(n))))
    listed = listed[np.argsort(number[listed], kind="stable")]
    cuts = np.flatnonzero(np.diff(number[listed])) + 1
    lists = dict(zip(number[listed[np.r_[0, cuts]]].tolist() if len(listed) else [], np.split(owner[listed], cuts), strict=False))
    members = {r: [i] for i, r in enumerate(root.tolist())} if len(np.unique(root)) == len(root) else {r: np.flatnonzero(root == r).tolist() for r in np.unique(root).tolist()}
    alone = bool(probe.all())
    for q in np.flatnonzero(probe).tolist():
        if not len(mine[q]):
            continue
        size = int(n[q])
        low, high = -(-num * size // den), size if alone else den * size // num
        edges = np.unique(np.r_[low + (size - low) * np.arange(BANDS) // BANDS, size, size + (high - size) * np.arange(1, BANDS + 1) // BANDS, high + 1])
        at = np.searchsorted(n, edges)
        if alone:
            at = np.minimum(at, q)
        need = fewest_shared(size, n[at[0] : at[-1]], num, den)
        own_lists = [lists[t] for t in mine[q].tolist()]
        slices = [np.searchsorted(x, at).tolist() for x in own_lists]
        for b in range(len(at) - 1):
            r0, r1 = int(at[b]), int(at[b + 1])
            if r0 == r1:
                continue
            some = [x[c[b] : c[b + 1]] - r0 for x, c in zip(own_lists, slices, strict=True) if c[b] < c[b + 1]]
            good = divide_skip(some, need[r0 - at[0] : r1 - at[0]]) + r0 if some else np.zeros(0, np.int64)
            while len(good := good[root[good] != root[q]]):
                r, good = int(good[-1]), good[:-1]
                common = len(np.intersect1d(own[q], own[r], assume_unique=True))
                if common >= required(size, int(n[r]), num, den):
                    links.append((int(order[q]), int(order[r])))
                    x, y = sorted((int(root[q]), int(root[r])), key=lambda v: len(members[v]))
                    root[members[x]] = y
                    members[y] += members.pop(x)
    return links


def linked(blocks: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) found in each block; blocks: (block, class, text, label, probe), where a class may come as a probe and again as none."""

    def run(table: pa.Table) -> pa.Table:
        cols = [table.column(c).to_pylist() for c in ("class", "text", "label", "probe")]
        rows = {c: (t, label) for c, t, label in zip(*cols[:3], strict=True)}
        probes = {c for c, p in zip(cols[0], cols[3], strict=True) if p}
        classes = sorted(rows)
        sets = all_shingles([rows[c][0] for c in classes], words)
        found = search(sets, np.array([rows[c][1] for c in classes], np.int64), np.array([c in probes for c in classes], bool), num, den)
        return pa.table({"a": pa.array([classes[a] for a, _ in found], pa.int64()), "b": pa.array([classes[b] for _, b in found], pa.int64())})

    return blocks.select("block", "class", "text", "label", "probe").groupBy("block").applyInArrow(lean(run), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, num: int = 85, den: int = 100, block: int = BLOCK, most_hot: int = 1 << 18) -> DataFrame:
    """Set size and component of every document, where two documents link if den * intersection >= num * union of their shingle sets.

    Shingles are `words` consecutive words, A-Z in lower case; a shorter text is one shingle, its whole sequence of words. Returns id_col, n_shingles,
    component_id (the smallest id that links reach, the document's own included); one row for each row of docs; other columns are ignored. Exact but for
    hashes of 64 bits: no candidate or partner is capped; the counts of the `most_hot` most frequent shingles only order the members of sets.

    Defined results: a null, empty or blank text has no shingles, links with nothing and is its own component; a null id keeps a null component unless
    its component has an id; repeated rows and equal texts share a component; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    arrow_bytes(spark, 8 << 20)
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    scanned = cut(scan(d, words), "shingle-sets", by="kind")
    rows = scanned.where("kind = 0").select("id", "n", "class")
    often = scanned.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(most_hot).toArrow()  # at most most_hot pairs of numbers
    hot, hot_n = often.column("id").to_numpy().view(np.uint64), often.column("n").to_numpy().astype(np.int64)
    order = np.argsort(hot)
    sent = spark.sparkContext.broadcast((hot[order], hot_n[order]))
    fewest = F.lit(1) + F.floor(F.ceil(F.max("n") * num / den) / 50)  # a link shares this many first ones or more
    able = lambda t: t.groupBy("class").agg(F.max("n").alias("n"), (F.sum("shared") >= fewest).alias("able")).where("able").select("class", "n")
    some = cut(able(sharing(d, sent, words, 2 * width(spark), num, den)), "sharing-classes")
    texts = _class_texts(d, rows, some, words)
    found = cut(families(texts, words, 2 * width(spark), num, den), "shingle-families")
    family = cut(components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))), "families")
    members = cut(able(found).join(family, F.col("class") == F.col("node")).select("class", "n", F.col("component").alias("family")), "family-members")
    plan = members.groupBy("family").agg(F.count("*").alias("classes"), F.ceil(F.sum("n") / F.lit(block)).alias("parts")).where("classes > 1")
    plan = cut(members.join(plan, "family").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))), "family-parts")
    small = plan.where("parts = 1").agg(F.sum("n")).first()[0] or 0
    n_blocks = max(2 * width(spark), -(-small // block))
    own = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("family"), F.lit(n_blocks))).otherwise(F.xxhash64("family", "part"))
    blocks = plan.select("class", own.alias("block"), F.col("class").alias("label"), F.lit(True).alias("probe"))
    links = cut(linked(blocks.join(texts, "class"), words, num, den), "links")
    merged = cut(components(links), "components")
    if not plan.where("parts > 1").isEmpty():
        more = cut(linked(_across(plan, merged, block).join(texts, "class"), words, num, den), "links")
        merged = cut(components(links.unionByName(more)), "components")
    out = rows.join(merged, F.col("class") == F.col("node"), "left").select("id", "n", F.coalesce("component", "class").alias("label"))
    least = out.where("n > 0").groupBy("label").agg(F.min("id").alias("least"))
    out = out.join(least.withColumnRenamed("label", "_label"), (F.col("label") == F.col("_label")) & (F.col("n") > 0), "left")
    for x in (some, found, family, members, texts, plan):
        forget(x)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _across(plan: DataFrame, merged: DataFrame, block: int) -> DataFrame:
    """Blocks for families of several parts: each part, with each part of the classes that are not of the family's main component as probes."""
    labels = plan.where("parts > 1").join(merged, F.col("class") == F.col("node"), "left").withColumn("label", F.coalesce("component", "class"))
    sizes = labels.groupBy("family", "label").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    main = sizes.groupBy("family").agg(F.max(F.struct("count", "label"))["label"].alias("main"), F.sum("n").alias("every"), F.max(F.struct("count", "label", "n"))["n"].alias("mains"))
    main = main.select("family", "main", F.ceil((F.col("every") - F.col("mains")) / F.lit(block)).alias("stretches"))
    d = cut(labels.join(main, "family").select("family", "class", "label", "part", "parts", "main", "stretches"), "family-labels")
    index = d.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.col("stretches") - 1))).where("stretches > 0").withColumn("probe", F.lit(False))
    probes = d.where("label <> main").withColumn("stretch", F.pmod(F.xxhash64("class", F.lit(1)), F.col("stretches"))).withColumn("probe", F.lit(True))
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cols = ["class", F.xxhash64("family", "part", "stretch").alias("block"), "label", "probe"]
    return index.where("stretches > 0").select(*cols).unionByName(probes.select(*cols))


def _class_texts(d: DataFrame, rows: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(class, text) of one document of each of the classes."""
    several = rows.groupBy("id").agg((F.min("class") < F.max("class")).alias("several"), F.count("*").alias("times"))
    least_ids = rows.join(classes.select("class"), "class", "left_semi").groupBy("class").agg(F.min("id").alias("id"))
    reps = least_ids.join(several, "id")
    if several.where("times > 1 AND id IS NOT NULL").isEmpty():
        texts = _texts(d, reps, words)
    else:  # an id of several rows: one row for each of its classes
        texts = _texts(d, reps.where("times = 1"), words).unionByName(_texts(d, reps.where("times > 1"), words).dropDuplicates(["class"]))
    if not rows.where("id is null").isEmpty():
        texts = texts.unionByName(_nameless_texts(d.where("id is null"), least_ids.where("id is null"), words))
    return cut(texts, "shingle-texts")


def _texts(d: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """(class, text) of one document of each class in reps (class, id, and whether the id stands for several classes)."""
    joined = d.join(reps.select(F.col("id").alias("_id"), "class", "several"), F.col("id") == F.col("_id")).select("class", "text", "several")

    def own(batches):
        for b in batches:
            texts, several = b.column(1).to_pylist(), b.column(2).to_pylist()
            doubtful = iter(all_shingles([t for t, x in zip(texts, several, strict=True) if x], words))
            keep = [not x or class_of(next(doubtful)) == c for c, x in zip(b.column(0).to_pylist(), several, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["class", "text"])

    return joined.mapInArrow(lean(own), "class long, text binary")


def _nameless_texts(d: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(class, text) of one row of d for each class in classes, found by its class: these rows have no id to fetch them by."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in all_shingles(b.column(0).to_pylist(), words)], pa.int64()), b.column(0)], ["class", "text"])

    return d.select("text").mapInArrow(lean(run), "class long, text binary").join(classes, "class", "left_semi").dropDuplicates(["class"])


#: The registered query in DuckDB: all pairs by a join on shingles, components by reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
