"""Toxic passages as maximum-scoring segments over token log-odds.

Learning: tokens of labelled documents get the log-odds of toxic against clean use under a Dirichlet prior (a flat part and a part in proportion to the
token's use overall), and those that are significantly toxic or significantly clean become the lexicon. Scanning: a token scores its log-odds less a small
loss, a token whose log-odds are not significant that loss;
the linear-time all-maximal-segments scan finds every disjoint passage that no extension improves. Calibration: under the clean token distribution the
best score of a text of n tokens follows an extreme-value law with a decay that solves sum(p * exp(decay * score)) = 1, so a passage of score s has the
evidence decay * s - ln(n). A logistic curve over the evidence of the best passage and of all significant ones, fitted on the same labelled rows, gives
the score.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_bytes, cut, lean
from gleanery.llm.labelled import held_out, training_rows

#: ASCII signs and digits part tokens; letters of any script form them.
SPACED = bytes.maketrans(b"!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~", b" " * 42)
#: A broadcast lexicon takes some 100 MB at this size; with more tokens it is joined.
MOST_SENT = 500_000
SEGMENTS = "array<struct<start:long,end:long,score:double,evidence:double>>"


def tokens(text: bytes) -> list[bytes]:
    return text.translate(SPACED).split()


def lowered(col: str):
    return F.lower(F.coalesce(F.col(col), F.lit(""))).cast("binary")


def count_tokens(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean): in how many documents of either label a token stands."""

    def run(batches):
        for b in batches:
            seen = (Counter(), Counter())
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[label].update(set(tokens(text)))
            every = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([seen[1][t] for t in every], pa.int64()), pa.array([seen[0][t] for t in every], pa.int64())], ["token", "toxic", "clean"])

    found = rows.select("label", lowered("text").alias("text")).mapInArrow(lean(run), "token binary, toxic long, clean long")
    return found.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, flat: float = 0.5, prior: float = 500.0, significance: float = 3.0, clean_significance: float = 8.0, least_docs: int = 3) -> tuple[DataFrame, float, float]:
    """The lexicon (token, odds) of significant tokens, the loss of any other token, and the decay of the extreme-value law.

    Clean tokens must be more significant, as nearly all tokens are clean: the number comes from a fold of the training rows. Tokens of fewer than
    `least_docs` documents of the label that they speak for are left out: the normal law behind z does not hold for counts of one or two.
    """
    total = counts.agg(F.sum("toxic"), F.sum("clean"), F.count("*")).first()
    n1, n0 = float(total[0] or 0), float(total[1] or 0)
    if not n1 or not n0:
        return counts.sparkSession.createDataFrame([], "token binary, odds double"), 0.1, 1.0
    alpha = F.lit(flat) + F.lit(prior / (n1 + n0)) * (F.col("toxic") + F.col("clean"))
    mass = flat * total[2] + prior
    odds = lambda y, n: F.log((F.col(y) + alpha) / (F.lit(n + mass) - F.col(y) - alpha))
    scored = counts.withColumn("odds", odds("toxic", n1) - odds("clean", n0))
    scored = scored.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha)))
    toxic = (F.col("z") >= significance) & (F.col("toxic") >= least_docs)
    clean = (F.col("z") <= -clean_significance) & (F.col("clean") >= least_docs)
    rate = (F.col("clean") + flat) / F.lit(n0 + mass)
    best = cut(scored.where(toxic | clean).select("token", "odds", rate.alias("rate")), "toxic-lexicon")
    loss, low, high = 0.1, 1e-3, 20.0
    steps = [low * (high / low) ** (k / 63) for k in range(64)]
    grown = lambda lam: F.sum(F.col("rate") * F.exp(F.lit(lam) * (F.col("odds") - loss)))
    for _ in range(2):  # the decay lies between two neighbours of a grid, then of a finer one
        got = best.agg(F.sum("rate").alias("rate"), *[grown(x).alias(f"g{k}") for k, x in enumerate(steps)]).first()
        rest = max(1 - (got.rate or 0.0), 1e-9)
        over = [k for k, x in enumerate(steps) if rest * math.exp(-loss * x) + (got[f"g{k}"] or 0.0) > 1]
        k = min(over, default=len(steps) - 1)
        low, high = steps[max(k - 1, 0)], steps[k]
        steps = [low + (high - low) * i / 63 for i in range(64)]
    return best.select("token", "odds"), loss, max(low, 0.05)


def maximal_segments(hits: list[tuple[int, float]], loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence that scores at the hits (position, score) and loses `loss` anywhere else.

    Linear in the number of hits: a list of candidates, each with the running total before it and after it; a new hit joins the candidates back to
    the last one that begins lower than it begins and ends lower than it ends.
    """
    found: list[list[float]] = []  # start, end, total before, total after, index of the last candidate that begins lower
    total, last = 0.0, -1
    for at, gain in hits:
        total -= loss * (at - last - 1)
        last, before = at, total
        total += gain
        if gain <= 0:
            continue
        segment = [at, at + 1, before, total, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= segment[2]:
                j = int(found[j][4])
            segment[4] = j
            if j < 0 or found[j][3] >= segment[3]:
                break
            segment = [found[j][0], segment[1], found[j][2], segment[3], -1]
            del found[j:]
        found.append(segment)
    return [(int(s), int(e), after - before) for s, e, before, after, _ in found]


def find_segments(rows: DataFrame, lexicon: DataFrame, loss: float, decay: float, least: float, most_sent: int = MOST_SENT) -> DataFrame:
    """rows (key columns and `text`) with n_tokens, best, total and segments instead of the text. least: evidence of a significant passage.

    A lexicon (token, odds) of at most most_sent tokens is sent to the texts; to a larger one, the texts' tokens are joined.
    """
    keys = [c for c in rows.columns if c != "text"]
    arrow_bytes(rows.sparkSession, 8 << 20)
    out = rows.select(*keys, lowered("text").alias("text"))
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), "n_tokens long, best double, total double, segments " + SEGMENTS])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64())]))
    sent = None
    if lexicon.count() <= most_sent:
        got = lexicon.collect()  # at most most_sent tokens
        sent = rows.sparkSession.sparkContext.broadcast({bytes(r.token): r.odds - loss for r in got})
    else:
        stored = cut(out.withColumn("_row", F.monotonically_increasing_id()), "scanned")

        def spread(batches):
            for b in batches:
                found = [(r, i, t) for r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, t in enumerate(tokens(text))]
                r, i, t = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(i, pa.int64()), pa.array(t, pa.binary())], ["_r", "at", "token"])

        hits = stored.select("_row", "text").mapInArrow(lean(spread), "_r long, at long, token binary").join(lexicon, "token")
        hits = hits.groupBy("_r").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("odds") - loss).alias("gain")))).alias("_hits"))  # bounded by a document's tokens
        out = stored.join(hits, F.col("_row") == F.col("_r"), "left").select(*keys, "text", "_hits")

    def run(batches):
        for b in batches:
            n, best, total, segments = [], [], [], []
            texts = b.column(len(keys)).to_pylist()
            joined = b.column(len(keys) + 1).to_pylist() if sent is None else [None] * len(texts)
            for text, own in zip(texts, joined, strict=True):
                toks = tokens(text)
                hits = [(i, sent.value[t]) for i, t in enumerate(toks) if t in sent.value] if sent is not None else [(h["at"], h["gain"]) for h in own or ()]
                found = maximal_segments(hits, loss)
                base = math.log(max(len(toks), 1))
                found = [{"start": s, "end": e, "score": v, "evidence": decay * v - base} for s, e, v in found]
                n.append(len(toks))
                best.append(max((x["evidence"] for x in found), default=None))
                found = [x for x in found if x["evidence"] >= least]
                total.append(decay * sum(x["score"] for x in found) - base if found else None)
                segments.append(found)
            extra = [pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(total, pa.float64()), pa.array(segments, kind)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *extra], [*keys, "n_tokens", "best", "total", "segments"])

    return out.mapInArrow(lean(run), schema)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, fold: int = 0, most_rows: int = 20_000, least: float = -6.0, most_sent: int = MOST_SENT) -> DataFrame:
    """Every document's score (0 to 1), its tokens and its toxic passages (token spans, score, evidence).

    Learns from at most about `most_rows` labelled rows outside the fold (all, if there are no more). Returns id_col, held_out, score, predicted
    (1 from 0.5 on), n_tokens, segments; one row for each row of docs; other columns of docs are ignored.

    Defined results: a null or empty text has no passage and scores as the training rows without a passage do; without usable labels every score is 0;
    labels other than 0 and 1 and null ids are not learned from, of several labels of a document the largest counts; repeated rows score alike.
    """
    spark = docs.sparkSession
    rows = cut(training_rows(docs, labels, label_col, id_col, text_col, folds, fold, most_rows), "toxic-rows")
    lexicon, loss, decay = log_odds(cut(count_tokens(rows), "toxic-counts"))
    seen = find_segments(rows.select("label", "text"), lexicon, loss, decay, least, most_sent).select("label", "best", "total").collect()  # at most `most_rows` rows of numbers
    plain = [r.label for r in seen if r.best is None]
    base = (sum(plain) + 0.01) / (len(plain) + 1) if seen else 0.0
    fit = [(r.best, r.best if r.total is None else r.total, r.label) for r in seen if r.best is not None]
    a, b, c = 0.0, 0.0, -30.0
    if fit:
        m = np.array(fit, float)
        a, b, c = logistic(np.column_stack([m[:, :2], np.ones(len(m))]), m[:, 2]).tolist()
    found = find_segments(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), lexicon, loss, decay, least, most_sent)
    line = a * F.col("best") + b * F.coalesce("total", "best") + c
    score = F.when(F.col("best").isNull(), F.lit(float(base))).otherwise(1 / (1 + F.exp(-line)))
    return found.select(F.col("id").alias(id_col), held_out("id", folds, fold).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "n_tokens", "segments")
