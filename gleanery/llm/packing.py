"""Best-fit packing of token sequences by minimum bin slack.

For each bin the fullest feasible combination of the lengths that are left is found by a subset-sum dynamic programme over a bitset, and removed.
All pieces of one length are alike, so the search runs on the histogram of lengths (at most `capacity` rows, whatever the input's size): one
combination fills as many bins as its scarcest length allows. What is distributed is the tokenising, the ranking of the pieces of each length, and
the lookup of a piece's place by its length and rank.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_bytes, cut, held, lean, text_bytes, width

PIECES = "id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first_rank long, end_rank long, per_bin long, first_bin long, base long"

#: Lower-case letters whose handling is the same in every Unicode version: ASCII and the precomposed letters of Latin-1.
LETTERS = "a-zß-öø-ÿ"
#: Chunks of these characters only are split here; any other chunk goes through the tokenizer whole.
SIMPLE = re.compile(rf"[!-~{LETTERS}À-ÖØ-Þ]+")
#: Fixed value: the pre-tokenizer's pattern of word_bpe vocabularies, for the characters of SIMPLE in lower case.
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")

#: What most often stands behind a word, each a pre-token of its own.
MARKS = frozenset((b".", b",", b";", b":", b"!", b"?"))


class WordEncoder:
    """Ids of texts under a vocabulary that drops white space and marks word ends with </w>: what stands between white space is encoded once and kept.

    The memory is bounded: the table is emptied when it holds `most` entries.
    """

    def __init__(self, vocab_path: str, most: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(vocab_path), most
        self.chunks: dict[bytes, bytes] = {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        """Keep the ids of chunks. A pre-token in lower case is a chunk as well: chunks are put together from such words."""
        one, two, split, whole, known = [], [], [], [], self.chunks
        words: set[bytes] = set()
        for c in chunks:
            if c.isalpha():  # ASCII letters: one word
                w = c.lower()
                words.add(w)
                if w != c:
                    one.append((c, w))
            elif c[-1:] in MARKS and c[:-1].isalpha():  # and a mark behind it
                w = c[:-1].lower()
                words.add(w)
                two.append((c, w, c[-1:]))
            elif SIMPLE.fullmatch(s := c.decode("utf-8", "replace")) and "<|" not in s:
                ws = [w.encode() for w in PRETOKEN.findall(s.lower())]
                words.update(ws)
                split.append((c, ws))
            else:
                whole.append(c)
        if two:
            words.update(MARKS)
        new = list(words.difference(known))
        for a in range(0, len(new), 2000):
            some = new[a : a + 2000]
            ids = self._ids([b" ".join(some).decode()])[0]
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some):
                raw, cuts = ids.tobytes(), [0, *(4 * at).tolist()]
                known.update(zip(some, [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:  # a word that isn't one pre-token after all: each on its own
                known.update((w, i.tobytes()) for w, i in zip(some, self._ids([w.decode() for w in some]), strict=True))
        known.update([(c, known[w]) for c, w in one])
        known.update([(c, known[w] + known[m]) for c, w, m in two])
        known.update([(c, b"".join([known[w] for w in ws])) for c, ws in split if len(ws) != 1 or ws[0] != c])
        known.update((c, i.tobytes()) for c, i in zip(whole, self._ids([c.decode("utf-8", "replace") for c in whole]), strict=True))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers."""
        for a in range(0, len(texts), 500):
            parts = [t.split() for t in texts[a : a + 500]]
            if len(self.chunks) > self.most:
                self.chunks.clear()
            missing = set().union(*map(set, parts)).difference(self.chunks)
            if missing:
                self._learn(list(missing))
            get = self.chunks.__getitem__
            for p in parts:
                yield b"".join(map(get, p))


_encoders: dict[str, WordEncoder] = {}


def word_encoder(vocab_path: str) -> WordEncoder:
    """One encoder for each vocabulary and Python worker."""
    if vocab_path not in _encoders:
        _encoders[vocab_path] = WordEncoder(vocab_path)
    return _encoders[vocab_path]


def pieces(docs: DataFrame, vocab_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Each document's ids, then end_id, in pieces of `capacity`; only the last may be shorter."""
    arrow_bytes(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        held("packing", _encoders.clear)
        enc = word_encoder(vocab_path)
        for b in batches:
            out: list[tuple] = []
            for i, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")).mapInArrow(lean(run), PIECES)


def fullest(counts: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """The lengths of one bin that holds `first` and is otherwise as full as the multiset `counts` allows."""
    room = capacity - first
    goal, mask, reach, steps = 1 << room, (2 << room) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length] - (length == first), room // length), 1
        while left > 0 and not reach & goal:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= (reach << take * length) & mask
            left, k = left - take, 2 * k
        if reach & goal:
            break
    at, out = reach.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= take * length
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN: the pieces of a length with ranks from first_rank to end_rank go, per_bin at a time, to the bins from first_bin on, at offset base.

    Every combination uses up some length but for a remainder smaller than one bin's need of it, so the rows are bounded by the capacity alone.
    """
    left, used, bins, rows = {k: v for k, v in histogram.items() if v}, dict.fromkeys(histogram, 0), 0, []
    while left:
        need = fullest(left, max(left), capacity)
        copies = min(left[x] // n for x, n in need.items())
        base = 0
        for length, n in sorted(need.items(), reverse=True):
            rows.append((length, used[length], used[length] + n * copies, n, bins, base))
            used[length] += n * copies
            base += n * length
            left[length] -= n * copies
            if not left[length]:
                del left[length]
        bins += copies
    return rows


def pack_lengths(items: DataFrame, capacity: int, length_col: str, keys: list[str]) -> DataFrame:
    """Adds sequence_id and offset to items of 1 to `capacity` long. keys: columns that tell the items apart, so that reruns agree.

    No window is larger than a fraction of a shuffle partition: a common length is dealt over as many salts as its count asks for.
    """
    spark = items.sparkSession
    histogram = {r[0]: r[1] for r in items.groupBy(F.col(length_col).cast("long")).count().collect()}  # at most `capacity` rows
    if any(not x or not 0 < x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    most = max(64, sum(histogram.values()) // (4 * width(spark)))
    salts = F.broadcast(spark.createDataFrame([(x, -(-n // most)) for x, n in histogram.items()], "_length long, _salts long"))  # at most `capacity` rows
    salted = items.join(salts, F.col(length_col) == F.col("_length"), "inner").withColumn("_salt", F.pmod(F.xxhash64(*keys), F.col("_salts")))
    before = Window.partitionBy("_length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("_length", "_salt").count().select("_length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_n", F.row_number().over(Window.partitionBy("_length", "_salt").orderBy(*keys)) - 1)
    ranked = ranked.join(starts, ["_length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_n"))
    rows = spark.createDataFrame(plan(histogram, capacity), PLAN)
    p = F.broadcast(rows.select(*[F.col(c).alias(f"_p_{c}") for c in rows.columns]))  # bounded by the capacity alone
    placed = ranked.join(p, (F.col("_length") == F.col("_p_length")) & (F.col("_rank") >= F.col("_p_first_rank")) & (F.col("_rank") < F.col("_p_end_rank")))
    k = F.col("_rank") - F.col("_p_first_rank")
    per = F.col("_p_per_bin")
    return placed.select(*items.columns, (F.col("_p_first_bin") + F.floor(k / per)).cast("long").alias("sequence_id"), (F.col("_p_base") + k % per * F.col("_length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into as few sequences of at most `capacity` tokens as minimum bin slack finds.

    A document is its ids by the vocabulary (no special tokens), then end_id. Documents longer than the capacity are cut into pieces of exactly that
    many tokens, the last may be shorter; no other document is cut. Returns id_col, piece, start, length, ids_crc32, sequence_id, offset: one row for
    each piece; offsets within a sequence are gapless from 0. Other columns of docs are ignored.

    Defined results: a null or empty text is the end id alone; a repeated row is packed as often as it stands there; a null id stays null; an empty
    table gives an empty result; rows of one length are ranked by their number in the stored pieces, so equal rows are spread like any others.
    """
    kept = cut(pieces(docs, vocab_path, capacity, end_id, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack_lengths(kept, capacity, "length", ["row"]).drop("row").withColumnRenamed("id", id_col)
