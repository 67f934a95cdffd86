"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

The terms of a document are the shapes of its text: trigrams of character classes, runs of one class counted once and, in a second table, as they
stand; and terms for repeated words, repeated lines, word lengths and capitals, in steps. Term weights (square root of the share, times inverse document
frequency) of a bounded set of labelled documents are factored by a truncated singular value decomposition. Every document is projected into that space,
and its cosines to all labelled vectors are computed exactly, block by block; the nearest ones vote with their similarity as weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_bytes, lean, text_bytes
from gleanery.llm.labelled import held_out, training_rows

CLASSES = 12
STEPS = 24
STATS = 6
TERMS = 2 * CLASSES**3 + STATS * STEPS


def _classes() -> np.ndarray:
    """Class of each byte: letters (also bytes of other scripts), capitals, digits, blanks, line ends, and kinds of signs."""
    out = np.full(256, 10, np.int32)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"|", b"!?", b"#*$%&<>~^@=")):
        out[list(chars)] = k
    out[list(b"-_/'")] = 11
    out[128:] = 0
    return out


CLASS_OF = _classes()


def features(text: bytes) -> np.ndarray:
    """Term counts as shares: each of the two trigram tables and each statistic sums to 1, an empty text is all zeros."""
    out = np.zeros(TERMS, np.float32)
    if not text.strip():
        return out
    k = CLASS_OF[np.frombuffer(text, np.uint8)]
    n = CLASSES**3
    for at, seq in ((0, k), (n, k[np.r_[True, k[1:] != k[:-1]]])):
        if len(seq) > 2:
            out[at : at + n] = np.bincount((seq[:-2] * CLASSES + seq[1:-1]) * CLASSES + seq[2:], minlength=n)
            out[at : at + n] /= len(seq) - 2
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    stats = (
        len(set(words)) / len(words),
        same / len(words),
        len(set(lines)) / len(lines),
        min(1.0, sum(map(len, words)) / len(words) / 16),
        float((k == 1).mean()) * 2,
        min(1.0, np.log2(len(words) + 1) / 16),
    )
    for j, v in enumerate(stats):
        out[2 * n + j * STEPS + min(STEPS - 1, int(v * (STEPS - 1) + 0.5))] = 0.5 if j < 3 else 0.1
    return out


class Space:
    """The latent-semantic space of labelled documents: projection, unit vectors, labels."""

    def __init__(self, shares: np.ndarray, labels: np.ndarray, dims: int):
        self.labels, self.mean = labels.astype(np.float32), float(labels.mean()) if len(labels) else 0.0
        df = (shares > 0).sum(0)
        self.used = np.flatnonzero(df)
        self.idf = (np.log((1 + len(shares)) / (1 + df[self.used])) + 1).astype(np.float32)
        x = np.sqrt(shares[:, self.used]) * self.idf
        values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.project = np.ascontiguousarray(vectors[:, np.argsort(-values)[:dims]], np.float32)
        self.vectors = self.unit(x @ self.project)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def vote(self, shares: np.ndarray, k: int, sharpness: float, block: int = 1024) -> np.ndarray:
        """Label share among the k nearest vectors, weighted by similarity; documents without a term get the mean label."""
        if not len(self.labels):
            return np.zeros(len(shares))
        out = np.empty(len(shares))
        k = min(k, len(self.labels))
        for a in range(0, len(shares), block):
            s = shares[a : a + block, self.used]
            cosines = self.unit((np.sqrt(s) * self.idf) @ self.project) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosines, near, 1), 0.0) ** sharpness + 1e-9
            out[a : a + block] = np.where(s.any(1), (w * self.labels[near]).sum(1) / w.sum(1), self.mean)
        return np.clip(out, 0.0, 1.0)


def fit(rows: DataFrame, dims: int) -> Space:
    """rows: (id, text, label), bounded by the caller; their shares come to the driver as half-precision numbers."""

    def run(batches):
        for b in batches:
            shares = [features(t).astype(np.float16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shares, pa.binary()), b.column(2)], ["id", "shares", "label"])

    got = rows.select("id", text_bytes("text").alias("text"), "label").mapInArrow(lean(run), "id long, shares binary, label int").collect()
    got.sort(key=lambda r: (r.id, r.label, bytes(r.shares)))
    shares = np.array([np.frombuffer(r.shares, np.float16) for r in got], np.float32).reshape(len(got), TERMS)
    return Space(shares, np.array([r.label for r in got]), dims)


def with_quality(docs: DataFrame, labels: DataFrame, score: str = "score", id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, fold: int = 2, most_rows: int = 4_000, dims: int = 48, k: int = 15, sharpness: float = 8.0) -> DataFrame:
    """docs with one more column, the quality score (0 to 1): the similarity-weighted share of label 1 among the k nearest labelled documents.

    Learns from at most about `most_rows` labelled rows outside the fold; that many vectors of `dims` numbers are broadcast, whatever the input's size.
    A column of docs named as the score is replaced; all others stay as they are.

    Defined results: a null, empty or blank text gets the mean label of the training rows; without usable labels every score is 0; labels other than 0
    and 1 and null ids are not learned from, of several labels of a document the largest counts; repeated rows score alike; an empty table gives an
    empty result.
    """
    arrow_bytes(docs.sparkSession, 4 << 20)
    docs = docs.drop(score)
    space = fit(training_rows(docs, labels, label_col, id_col, text_col, folds, fold, most_rows), dims)
    sent = docs.sparkSession.sparkContext.broadcast(space)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column(at).to_pylist()]
            scores = np.concatenate([sent.value.vote(np.array([features(t) for t in texts[a : a + 1024]], np.float32), k, sharpness) for a in range(0, len(texts), 1024)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, score])

    return docs.mapInArrow(lean(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{score}` double"]))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2, threshold: float = 0.7, **options) -> DataFrame:
    """id_col, held_out, score and predicted (1 from the threshold on) of every row of docs; options and defined results: with_quality."""
    scored = with_quality(docs.select(id_col, text_col), labels, "score", id_col, text_col, folds=folds, fold=fold, **options)
    return scored.select(id_col, held_out(id_col, folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
