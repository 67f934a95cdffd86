"""Removal of byte strings that an earlier document has, found on Burrows-Wheeler transforms.

A string of `length` bytes has one minimizer: the leftmost of its k-byte substrings with the smallest hash. Equal strings have equal minimizers, so only
strings round a minimizer that two documents share can repeat; and all strings round one minimizer go to one shard, as contexts: the bytes of a
run of strings with the same minimizer. Each shard orders the suffixes of its distinct contexts as far as the threshold, and derives from the
transform where neighbouring suffixes begin to differ: level by level, a breadth-first backward extension turns the intervals of common prefixes of
length n into those of length n + 1, and stops at the threshold. What is left are intervals of equal strings; the smallest document of each is the
first that has the string.

The transform decides between contexts that differ, share a minimizer and agree on one side of it as far as two must that share a string. A context that is the only one round its minimizer, however many documents have
it (as those of whole copies are), is one string to its shard and needs no extension, nor does a string that is dealt by its own hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_bytes, cut, forget, lean, pack, text_bytes, unpack, width

K = 16
CHUNK = 1 << 20
NO_ID = 2**63 - 1
#: Bytes of text that a part, and a shard's share of contexts, has on average at most: a part is held whole by one task.
PART_BYTES = 96 << 20
BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def minimizers(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of `length` bytes that share a minimizer: first and last start, and the minimizer's hash."""
    return minimizer_runs(data, ends, length)[:3]


def minimizer_runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of `length` bytes that share a minimizer: first and last start, the minimizer's hash, and where it starts.

    data: documents one after another, ends: where each ends. No string crosses an end. Long data go in chunks that overlap by a string.
    """
    firsts, lasts, hashes, places = [], [], [], []
    w = length - K + 1
    limit = np.repeat(ends, np.diff(np.r_[0, ends])) - length  # last start of a string in the byte's document
    for c0 in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[c0 : c0 + CHUNK + length - 1]
        with np.errstate(over="ignore"):
            h, step, power = BYTES[part], 1, BASE
            while step < K:
                h = h[:-step] * np.uint64(power) + h[step:]
                step, power = 2 * step, power * power % 2**64
            h = _mixed(h)
        low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span < w:
            by = min(span, w - span)
            low = np.minimum(low[:-by], low[by:])
            span += by
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        starts = np.arange(c0, c0 + len(at))
        inside = starts <= limit[c0 : c0 + len(at)]
        fresh = inside & np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1]]
        stop = inside & np.r_[(at[1:] != at[:-1]) | ~inside[1:], True]
        firsts.append(starts[fresh])
        lasts.append(starts[stop])
        hashes.append(h[at[fresh]])
        places.append(c0 + at[fresh])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes), np.concatenate(places)


def may_share(contexts: list[bytes], places: list[int], length: int) -> list[bool]:
    """Whether a context may share a string of `length` bytes with another that has the same minimizer, which begins at the given place in each.

    Such a string has half of its other bytes, at least, on one side of the minimizer, so the two contexts agree in as many bytes there.
    """
    side = (length - K + 1) // 2
    left = [c[p - side : p + K] if p >= side else None for c, p in zip(contexts, places, strict=True)]
    right = [c[p : p + K + side] if len(c) - p >= K + side else None for c, p in zip(contexts, places, strict=True)]
    lefts, rights = Counter(left), Counter(right)
    return [(x is not None and lefts[x] > 1) or (y is not None and rights[y] > 1) for x, y in zip(left, right, strict=True)]


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of `length` bytes that begin at the starts."""
    out = [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(length, BASE, np.uint64))
        for k in range(0, len(starts), 1 << 14):
            out.append(_mixed((BYTES[data[starts[k : k + (1 << 14), None] + np.arange(length)]] * powers).sum(axis=1, dtype=np.uint64)))
    return np.concatenate(out)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def bounded_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first `depth` symbols at least (below 512 each): by seven, then by prefix doubling of those that are still alike."""
    n = len(symbols)
    padded = np.r_[symbols.astype(np.uint64), np.zeros(7, np.uint64)]
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = key << np.uint64(9) | padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    fresh = np.r_[True, key[1:] != key[:-1]][:n]
    begins = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begins, np.diff(np.r_[begins, n]))
    h = 7
    while h < depth:
        rows = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
        if not len(rows):
            break
        at = order[rows]
        key = rank[at] << 32 | np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[rows] = at
        fresh[rows] = new = np.r_[True, key[1:] != key[:-1]]
        begins = np.flatnonzero(new)
        rank[at] = np.repeat(rows[begins], np.diff(np.r_[begins, len(at)]))
        h *= 2
    return order


def common_intervals(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each whether its first `length` symbols differ from those of the suffix before.

    Breadth first, by increasing common prefix: row j, with symbol bwt[j] before its suffix, leads to row lf[j] of the suffix that begins with it. Where
    an interval of rows with a common prefix of n symbols has been split, each of its parts is extended backward: the first row of a part with some symbol
    leads to a row that differs, from the n + 1st symbol on at the latest, from the row before. Intervals that were not split, and rows whose place is
    known to differ, are not looked at again; the levels end at `length`. Prefixes that contain the end of a context (symbol 0) are of no use.
    """
    n = len(symbols)
    order = bounded_order(symbols, length)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    bwt, lf = symbols[order - 1], rank[order - 1]
    del rank
    first = np.empty(n, symbols.dtype)
    first[lf] = bwt
    differ = np.r_[True, first[1:] != first[:-1]][:n]
    back = np.empty(n, np.int64)
    back[lf] = np.arange(n)
    before = np.full(n, -1)  # for each row, the last one before it with its symbol
    inner = np.flatnonzero(~differ)
    before[back[inner]] = back[inner - 1]
    del back
    new = np.flatnonzero(differ)
    for _ in range(length - 1):
        begins = np.flatnonzero(differ)
        size = np.r_[begins[1:], n][np.searchsorted(begins, new)] - new
        rows = np.arange(size.sum()) + np.repeat(new - (np.cumsum(size) - size), size)
        new = lf[rows[before[rows] < np.repeat(new, size)]]
        new = np.sort(new[~differ[new]])
        if not len(new):
            break
        differ[new] = True
    return order, differ


def first_owners(contexts: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string of `length` bytes of the contexts, in order: its context's number, and the smallest owner of a context that has the string."""
    lens = np.array([len(c) for c in contexts], np.int64)
    symbols = np.zeros(int(lens.sum()) + len(lens), np.uint16)
    begin = np.cumsum(np.r_[0, lens[:-1] + 1])
    number = np.repeat(np.arange(len(lens)), lens + 1)
    at = np.arange(len(symbols)) - begin[number]
    symbols[at < lens[number]] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.uint16) + 1
    whole = at <= (lens - length)[number]
    order, differ = common_intervals(symbols, length)
    rows = np.cumsum(differ)
    keep = whole[order]
    order, rows = order[keep], rows[keep]
    least = np.empty(len(symbols), np.int64)
    begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    if len(rows):
        mins = np.minimum.reduceat(owners[number[order]], begins)
        least[order] = np.repeat(mins, np.diff(np.r_[begins, len(rows)]))
    return number[whole], least[whole]


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Bytes, ends, order numbers and ids of the documents of one part, by order number and text."""
    z = zstandard.ZstdDecompressor()
    rows = sorted(zip(table.column("ord").to_pylist(), (z.decompress(x) for x in table.column("z").to_pylist()), table.column("id").to_pylist(), strict=True), key=lambda r: r[:2])
    ends = np.cumsum([len(r[1]) for r in rows]).astype(np.int64)
    return np.frombuffer(b"".join(r[1] for r in rows), np.uint8), ends, np.array([r[0] for r in rows], np.int64), [r[2] for r in rows]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_text: bool = True, most: int = 1 << 14) -> DataFrame:
    """Removes every byte that a string of `length` bytes covers which also starts in a document with a smaller id.

    Texts are their UTF-8 bytes; strings overlap, never cross documents, and are judged on the input. Returns id_col, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, and with with_text also kept (the remaining bytes); one row for each row of docs; other columns are ignored.

    Defined results: a null text is empty; texts shorter than `length` stay whole; a null id comes after all others, and rows of one id do not remove from
    one another; repeated rows fare alike; an empty table gives an empty result. length must be at least 32.

    Strings whose minimizer more than `most` documents have are dealt by their own hashes, so that a passage of very many documents spreads over all
    shards.
    """
    if not 32 <= length <= 255:
        raise ValueError("length must be from 32 to 255")
    spark = docs.sparkSession
    arrow_bytes(spark, 8 << 20)
    read = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = shards = max(2 * width(spark), size // PART_BYTES + 1)
    d = read.select("id", F.coalesce("id", F.lit(NO_ID)).alias("ord"), "text", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int").alias("part"))

    def announce(batches):
        """Hashes of minimizers to shards, with the parts that have them and in how many documents of the batch."""
        for b in batches:
            texts = b.column(0).to_pylist()
            part = b.column(1).to_numpy().astype(np.int64)
            ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
            first, _, h = minimizers(np.frombuffer(b"".join(texts), np.uint8), ends, length)
            doc = np.searchsorted(ends, first, side="right")
            order = np.lexsort((doc, part[doc], h))
            h, doc = h[order], doc[order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)]
            h, at = h[fresh], part[doc[fresh]]
            begins = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])][: len(h)])
            h, at, n = h[begins], at[begins], np.diff(np.r_[begins, len(h)])
            shard = shard_of(h, shards)
            order = np.lexsort((h & np.uint64(0xFFFFFFFF), shard))
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            out = [(k, pack((h[o] & np.uint64(0xFFFFFFFF)).astype(np.uint32), at[o].astype(np.uint32), n[o].astype(np.uint32))) for k in range(shards) if len(o := order[cuts[k] : cuts[k + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["shard", "block"])

    def shared(table: pa.Table) -> pa.Table:
        """To each part, its hashes that two documents have, and whether very many have them."""
        blocks = [unpack(x, "<u4", "<u4", "<u4") for x in table.column("block").to_pylist()]
        h, part, n = (np.concatenate(x) for x in zip(*blocks, strict=True))
        order = np.argsort(h, kind="stable")
        h, part, n = h[order], part[order], n[order].astype(np.int64)
        begins = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[: len(h)]
        total = np.repeat(np.add.reduceat(n, begins) if len(h) else n, np.diff(np.r_[begins, len(h)]))
        keep = total > 1
        h, part, hot = h[keep], part[keep], total[keep] > most
        order = np.lexsort((h, part))
        h, part, hot = h[order], part[order], hot[order]
        fresh = np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])][: len(h)]
        h, part, hot = h[fresh], part[fresh], hot[fresh]
        at, which = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])[: len(part)], len(part)], np.unique(part)
        shard = table.column("shard")[0].as_py()
        return pa.table({"part": pa.array(which.astype(np.int32)), "shard": pa.array([shard] * len(which), pa.int32()), "block": pa.array([pack(h[x:y], hot[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.binary())})

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        """kind 0: the part's distinct contexts, to shards. kind 1: where they stand, for the part itself."""
        part = (left if left.num_rows else right).column("part")[0].as_py()
        data, ends, ords, _ = _documents(left)
        wanted = [unpack(x, "<u4", "?") for x in right.column("block").to_pylist()]
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.uint64(s) << np.uint64(32) | x[0].astype(np.uint64) for s, x in zip(right.column("shard").to_pylist(), wanted, strict=True))])
        by = np.argsort(keys)
        keys, often = keys[by], np.concatenate([np.zeros(0, bool), *(x[1] for x in wanted)])[by]
        first, last, h, place = minimizer_runs(data, ends, length)
        key = shard_of(h, shards).astype(np.uint64) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
        keep = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        first, last, h, place, hot = first[keep], last[keep], h[keep], place[keep], often[at[keep]] if len(keys) else np.zeros(0, bool)
        if hot.any():  # strings round a minimizer of very many documents go each by its own hash
            n = (last - first + 1)[hot]
            starts = np.arange(n.sum()) + np.repeat(first[hot] - (np.cumsum(n) - n), n)
            first, last, h, place = np.r_[first[~hot], starts], np.r_[last[~hot], starts], np.r_[h[~hot], string_hashes(data, starts, length)], np.r_[place[~hot], starts]
            by = np.argsort(first)
            first, last, h, place = first[by], last[by], h[by], place[by]
        owner = ords[np.searchsorted(ends, first, side="right")]
        raw, seen, texts = data.tobytes(), {}, []
        number = np.empty(len(first), np.int64)
        for i, (a, b) in enumerate(zip(first.tolist(), (last + length).tolist(), strict=True)):
            c = raw[a:b]
            k = seen.setdefault(c, len(texts))
            if k == len(texts):
                texts.append(c)
            number[i] = k
        if not texts:
            return pa.table({"kind": pa.array([], pa.int32()), "key": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "base": pa.array([], pa.int64()), "block": pa.array([], pa.binary())})
        n = len(texts)
        begin = np.unique(number, return_index=True)[1]
        low, high, hashes, offsets = np.full(n, NO_ID), np.full(n, -(2**63)), h[begin], (place - first)[begin].astype(np.uint8)
        np.minimum.at(low, number, owner)
        np.maximum.at(high, number, owner)
        order = np.argsort(shard_of(hashes, shards), kind="stable")
        cuts = np.searchsorted(shard_of(hashes, shards)[order], np.arange(shards + 1))
        renumbered = np.empty(n, np.int64)
        renumbered[order] = np.arange(n)
        out = []
        for k in range(shards):
            o = order[cuts[k] : cuts[k + 1]]
            if len(o):
                some = [texts[i] for i in o.tolist()]
                out.append((0, k, part, int(cuts[k]), pack(hashes[o], low[o], high[o], offsets[o], np.array([len(c) for c in some], np.uint16), np.frombuffer(b"".join(some), np.uint8))))
        out.append((1, part, part, 0, pack(renumbered[number].astype(np.uint32), np.diff(np.r_[0, first]).astype(np.uint32))))
        cols = list(zip(*out, strict=True))
        return pa.table({k: pa.array(c, t) for k, c, t in zip(("kind", "key", "part", "base", "block"), cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)})

    def judge(table: pa.Table) -> pa.Table:
        """To each part: for its contexts, runs of strings (offsets) with the first document that has them, where that is before some owner of the part."""
        seen, texts, ids, places, entries = {}, [], [], [], []
        for part, base, block in zip(table.column("part").to_pylist(), table.column("base").to_pylist(), table.column("block").to_pylist(), strict=True):
            h, low, high, place, lens, raw = unpack(block, "<u8", "<i8", "<i8", "u1", "<u2", "u1")
            raw, at = raw.tobytes(), 0
            numbers = np.empty(len(lens), np.int64)
            for i, (n, x, p) in enumerate(zip(lens.tolist(), h.tolist(), place.tolist(), strict=True)):
                c = raw[at : at + n]
                at += n
                k = seen.setdefault(c, len(texts))
                if k == len(texts):
                    texts.append(c)
                    ids.append(x)
                    places.append(p)
                numbers[i] = k
            entries.append((numbers, low, high, np.full(len(lens), part), base + np.arange(len(lens))))
        number, low, high, part, own = (np.concatenate(x) for x in zip(*entries, strict=True))
        owners = np.full(len(texts), NO_ID)
        np.minimum.at(owners, number, low)
        _, group, sizes = np.unique(np.array(ids, np.uint64), return_inverse=True, return_counts=True)
        some = np.flatnonzero(sizes[group] > 1)  # a context alone round its minimizer has nothing to share
        fit = may_share([texts[i] for i in some.tolist()], [places[i] for i in some.tolist()], length)
        several = some[np.array(fit, bool)]
        alone = np.setdiff1d(np.arange(len(texts)), several, assume_unique=True)
        where, least = first_owners([texts[i] for i in several.tolist()], owners[several], length) if len(several) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        where = several[where]
        begins = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])[: len(where)]
        offset = np.arange(len(where)) - np.repeat(begins, np.diff(np.r_[begins, len(where)]))
        change = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (least[1:] != least[:-1])])[: len(where)]
        stop = np.r_[change[1:], len(where)][: len(change)] - 1
        lens = np.array([len(c) for c in texts], np.int64)
        run = np.concatenate([where[change], alone])
        o0 = np.concatenate([offset[change], np.zeros(len(alone), np.int64)])
        o1 = np.concatenate([offset[stop], lens[alone] - length])
        m = np.concatenate([least[change], owners[alone]])
        order = np.argsort(run, kind="stable")
        run, o0, o1, m = run[order], o0[order], o1[order], m[order]
        a, b = np.searchsorted(run, number), np.searchsorted(run, number, side="right")
        e = np.repeat(np.arange(len(number)), b - a)
        r = np.arange(len(e)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[e]
        keep = m[r] < high[e]
        e, r = e[keep], r[keep]
        order = np.argsort(part[e], kind="stable")
        e, r = e[order], r[order]
        which, at = np.unique(part[e], return_index=True)
        at = np.r_[at, len(e)]
        blocks = [pack(own[e[x:y]].astype(np.uint32), o0[r[x:y]].astype(np.uint8), o1[r[x:y]].astype(np.uint8), m[r[x:y]]) for x, y in zip(at, at[1:], strict=False)]
        return pa.table({"part": pa.array(which.astype(np.int32)), "kind": pa.array([2] * len(which), pa.int32()), "block": pa.array(blocks, pa.binary())})

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        data, ends, ords, ids = _documents(left)
        stands, runs = [], []
        for kind, block in zip(right.column("kind").to_pylist(), right.column("block").to_pylist(), strict=True):
            (stands if kind == 1 else runs).append(block)
        gone = np.zeros(len(data), bool)
        if stands and runs:
            number, first = unpack(stands[0], "<u4", "<u4")
            first = np.cumsum(first.astype(np.int64))
            of, o0, o1, m = (np.concatenate(x) for x in zip(*(unpack(x, "<u4", "u1", "u1", "<i8") for x in runs), strict=True))
            order = np.argsort(of, kind="stable")
            of, o0, o1, m = of[order], o0[order].astype(np.int64), o1[order].astype(np.int64), m[order]
            a, b = np.searchsorted(of, number), np.searchsorted(of, number, side="right")
            e = np.repeat(np.arange(len(number)), b - a)
            r = np.arange(len(e)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[e]
            owner = ords[np.searchsorted(ends, first[e], side="right")]
            keep = m[r] < owner
            e, r = e[keep], r[keep]
            depth = np.bincount(first[e] + o0[r], minlength=len(data) + 1) - np.bincount(first[e] + o1[r] + length, minlength=len(data) + 1)
            gone = np.cumsum(depth)[: len(data)] > 0
        begins = np.r_[0, ends[:-1]] if len(ends) else ends
        total = np.r_[0, np.cumsum(gone)]
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        inner = begins[(begins > 0) & (begins < len(data))]
        rise[inner] = gone[inner]
        rises = np.r_[0, np.cumsum(rise)]
        rest, at = data[~gone].tobytes(), np.r_[0, np.cumsum(~gone)]
        kept = [rest[at[x] : at[y]] for x, y in zip(begins, ends, strict=True)]
        out = {
            "id": pa.array(ids, pa.int64()),
            "n_bytes": pa.array(ends - begins),
            "n_removed": pa.array(total[ends] - total[begins]),
            "n_spans": pa.array(rises[ends] - rises[begins]),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    def squeezed(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([z.compress(t) for t in b.column(3).to_pylist()], pa.binary())], ["part", "ord", "id", "z"])

    rows = d.select("part", "ord", "id", "text").mapInArrow(lean(squeezed), "part int, ord long, id long, z binary")
    wanted = d.select("text", "part").mapInArrow(lean(announce), "shard int, block binary").groupBy("shard").applyInArrow(lean(shared), "part int, shard int, block binary")
    wanted = cut(wanted, "repeat-hashes")
    found = rows.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(lean(contexts), "kind int, key int, part int, base long, block binary")
    found = cut(found, "repeat-contexts", by="kind")
    runs = found.where("kind = 0").select("key", "part", "base", "block").groupBy("key").applyInArrow(lean(judge), "part int, kind int, block binary")
    marks = cut(runs.unionByName(found.where("kind = 1").select("part", F.col("kind").cast("int").alias("kind"), "block")), "repeat-runs")
    forget(wanted)
    forget(found)
    out = rows.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(lean(remove), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    return out.withColumnRenamed("id", id_col)
