"""Counts of the tokens of texts, made where a text is read: one row for each text goes on, not one for each of its words.

What is a token is stated in functions.text; a Python worker remembers what it has made of words that are split or stemmed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.stem import stem
from gleanery.functions.text import DIVIDED

WORD = re.compile("[a-zA-Z0-9_]+")
_DIVIDED, _SIGNS = re.compile(DIVIDED), re.compile("[^a-zA-Z0-9]+")
#: Two characters between which an identifier is parted, or three capitals' last that begins a word; read from left to right, each character in one match.
_TURN = re.compile("[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][a-zA-Z]|[A-Z][A-Z][a-z]")
#: So many distinct words are remembered by a worker before it starts anew, and so many characters of texts are counted before their rows go on.
KNOWN, CHARS = 500_000, 8_000_000
_known: dict[tuple, dict[str, list[str]]] = {}


def light_stem(w: str) -> str:
    """functions.text.light_stem."""
    for suffix, least, off, new in (("ies", 4, 3, "y"), ("ed", 5, 2, ""), ("ing", 6, 3, ""), ("ates", 5, 1, ""), ("es", 5, 2, "")):
        if w.endswith(suffix) and len(w) > least:
            return w[:-off] + new
    return w[:-1] if w.endswith("s") and len(w) > 3 and not w.endswith("ss") else w


def terms_of(word: str, stemmer: str, stop: Collection[str], min_length: int = 2) -> list[str]:
    """The tokens that functions.text.tokenize makes of one word, or bm25.term_rows with the stemmer porter2."""
    ok = lambda x: len(x) >= min_length and x not in stop
    stems = {"none": None, "light": light_stem, "porter2": stem}[stemmer]
    pieces = _TURN.sub(lambda m: f"{m[0][:1]} {m[0][1:]}", _SIGNS.sub(" ", word)).lower().split() if _DIVIDED.search(word) else [word.lower()]
    own = [stems(p) for p in pieces if ok(p)] if stems else pieces
    return [t for t in (own + [word.lower()] if len(pieces) > 1 else own) if ok(t)]


def counted(docs: DataFrame, text_col: str, stemmer: str = "none", stop: Collection[str] = (), wanted: Collection[str] | None = None) -> DataFrame:
    """docs without the text, with `length`, the number of its tokens, and `terms`: (term, tf) of each distinct token, or of the wanted ones."""
    rest = [c for c in docs.columns if c != text_col]
    stop, wanted = frozenset(stop), None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known.setdefault((stemmer, stop), {})
        plain = stemmer == "none"

        def rows(kept: pa.RecordBatch, sizes: list[int], ends: list[int], terms: list[str], tfs: list[int]) -> pa.RecordBatch:
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["term", "tf"])
            lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pairs)
            return pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes, pa.int64()), lists], [*rest, "length", "terms"])

        for b in batches:
            kept = b.select(rest)
            texts, first, chars = b.column(text_col), 0, 0
            sizes, ends, terms, tfs = [], [], [], []
            for i in range(b.num_rows):
                text = texts[i].as_py() or ""
                tf: dict[str, int] = {}
                length = 0
                for word, n in Counter(WORD.findall(text)).items():
                    if plain and word.isalpha() and (word.islower() or word[1:].islower()):  # most words: one piece, as it is
                        w = word.lower()
                        if len(w) > 1 and w not in stop:
                            length += n
                            if wanted is None or w in wanted:
                                tf[w] = tf.get(w, 0) + n
                        continue
                    own = known.get(word)
                    if own is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        own = known[word] = terms_of(word, stemmer, stop)
                    length += n * len(own)
                    for t in own:
                        if wanted is None or t in wanted:
                            tf[t] = tf.get(t, 0) + n
                sizes.append(length)
                terms += tf
                tfs += tf.values()
                ends.append(len(terms))
                chars += len(text)
                if chars >= CHARS:
                    yield rows(kept.slice(first, i + 1 - first), sizes, ends, terms, tfs)
                    first, chars = i + 1, 0
                    sizes, ends, terms, tfs = [], [], [], []
            if first < b.num_rows:
                yield rows(kept.slice(first), sizes, ends, terms, tfs)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(run, f"{kept}, length long, terms array<struct<term: string, tf: bigint>>")


def merged(counts: DataFrame, id_col: str) -> DataFrame:
    """Stored counts with one row (id, length, terms) for each id: as they are if they have no id twice."""
    counts = counts.select(id_col, "length", "terms")
    if counts.groupBy(id_col).count().where("count > 1").isEmpty():
        return counts
    tf = exploded(counts, id_col).groupBy(id_col, "term").agg(F.sum("tf").alias("tf")).groupBy(id_col).agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    lengths = counts.groupBy(id_col).agg(F.sum("length").alias("length"))
    whole = lengths.join(tf.withColumnRenamed(id_col, "_id"), lengths[id_col].eqNullSafe(F.col("_id")), "left")
    return whole.select(id_col, "length", F.coalesce("terms", F.array().cast("array<struct<term: string, tf: bigint>>")).alias("terms"))


def exploded(counts: DataFrame, *cols: str | Column) -> DataFrame:
    """A row (cols, term, tf) for each term of counted texts."""
    return counts.select(*cols, F.explode("terms").alias("_t")).select("*", "_t.term", "_t.tf").drop("_t")
