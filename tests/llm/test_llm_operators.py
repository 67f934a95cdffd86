"""The training-data operators: edge cases on a hand-made table with clashing columns, and brute force on small tables."""

from __future__ import annotations

import binascii
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanery.llm import fingerprints, jaccard, lines, mixing, packing, quality, rules, suffixes, token_counts, toxicity
from gleanery.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, ord int, part int, z string, class string, n int, label int, row long, length int, score double, n_lines int, _c string"


def prose(rng: random.Random, n: int) -> str:
    ws = [rng.choice(("the", "of", "and", "river", "stone", "light", "garden", "winter", "open", "quiet")) + rng.choice(("", "s", "ed", "ing")) for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(ws)) + "."


def corpus() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(5)
    base, shared = prose(rng, 300), prose(rng, 60)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (50, 150, 250)]
    long = "\n".join(prose(rng, 40) for _ in range(120))
    out = [(1, base, "a"), (2, base, "b"), (3, near[0], "a"), (4, near[1], "c"), (5, near[2], None), (6, None, "a"), (7, "", "b"), (8, " \n\t ", "b"), (9, "One two.", "c"), (10, "one TWO.", None)]
    out += [(20 + k, prose(rng, 30) + "\n" + shared + "\n" + prose(rng, 30), "abcdefghij"[k]) for k in range(10)]
    out += [(40, long, "a"), (41, "ééß日本 " * 30, "d"), (42, "x" * 5000, "e"), (43, "Nav | Home | Shop | Help | Me\n" * 3, "f"), (None, prose(rng, 55), "g"), (9, "One two.", "c"), (44, "word " * 60, "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("en", None)
    rows = [(i, t, extra[0], s, None if t is None else len(t), 1, "k", 1, 1, "z", "c", 1, 1, 1, 1, 0.5, 1, None) for i, t, s in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(50)] + [(None, 1, 1), (3, None, None), (4, 7, 7), (5, 0, 0)], "doc_id long, quality int, toxic int")


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_packing(docs, empty):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = packing.pack_documents(docs, WORD_BPE, capacity=64).collect()
    want = []
    for i, t, _ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


def test_fullest_bin():
    rng = random.Random(1)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(1, 8)))
        first = max(counts)
        best = 0
        items = list((counts - Counter([first])).elements())
        for k in range(len(items) + 1):
            best = max([best, *(s for c in itertools.combinations(items, k) if (s := sum(c)) <= 40 - first)])
        out = packing.fullest(dict(counts), first, 40)
        assert sum(x * n for x, n in out.items()) == first + best and all(n <= counts[x] for x, n in out.items())


def test_word_encoder_on_odd_texts():
    tok, own = Tokenizer.from_file(WORD_BPE), packing.WordEncoder(WORD_BPE, most=50)
    texts = ["It's I'LL don't 'sx 12a3", "a b  c é İ ß ẞ ª", "<|endoftext|> x<|startoftext|>y", "日本語テキスト ok", "\x1c\x85 \x00 z", "--- !!! ?a? a?b", "ΑΣ ΑΣ.", "e\ń"]
    for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def brute_repeats(rows, length):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            o = float("inf") if i is None else i
            first[w] = min(first.get(w, o), o)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (float("inf") if i is None else i):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(docs, empty):
    out = suffixes.drop_repeats(docs)
    assert got(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats([r[:2] for r in corpus()], 50)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.collect())
    assert suffixes.drop_repeats(empty).count() == 0


@pytest.mark.parametrize("most", [1, 5, 1 << 14])
def test_repeats_of_a_common_passage(spark, most):
    """A passage that every document has, in neighbourhoods of its own, and a long text: strings of frequent minimizers are dealt one by one."""
    rng = random.Random(most)
    passage = prose(rng, 40)
    rows = [(k, prose(rng, rng.randrange(1, 30)) + passage[: len(passage) - k % 3] + prose(rng, 8)) for k in range(30)] + [(99, "".join(prose(rng, 900) for _ in range(2)) + passage)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(suffixes.drop_repeats(d, most=most), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 50)


def test_intervals():
    rng = np.random.default_rng(2)
    for n in (1, 2, 40, 400):
        s = rng.integers(1, 4, n).astype(np.uint16)
        order, differ = suffixes.common_intervals(s, 5)
        assert sorted(order.tolist()) == list(range(n))
        pieces = [tuple(s[i : i + 5]) for i in order]
        whole = [len(p) == 5 for p in pieces]
        for r in range(1, n):
            if whole[r] and whole[r - 1]:
                assert differ[r] == (pieces[r] != pieces[r - 1])


def test_minimizer_chunks(monkeypatch):
    data = np.frombuffer(prose(random.Random(1), 300).encode() + b"a" * 400, np.uint8)
    ends = np.array([100, 130, len(data)])
    whole = [x.tolist() for x in suffixes.minimizers(data, ends, 50)]
    monkeypatch.setattr(suffixes, "CHUNK", 97)
    first, last, h = suffixes.minimizers(data, ends, 50)
    starts = lambda a, b, c: {s: x for f, t, x in zip(a, b, c, strict=True) for s in range(f, t + 1)}
    assert starts(first.tolist(), last.tolist(), h.tolist()) == starts(*whole)


def test_fingerprints(docs, empty):
    rows = sorted(((i, t or "") for i, t, _ in corpus()), key=lambda r: (r[0] is not None, r[0] or 0))
    made = fingerprints.fingerprint_documents(docs).collect()
    split = lambda t: set(re.findall(fingerprints.PARAGRAPH, t))
    like = lambda a, b: 1.0 if not a | b else 1 - len(a ^ b) / (len(a) + len(b))
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(split(t), split(edited)), 9), round(like(split(t), split(nxt)), 9)))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in made), key=str) == sorted(want, key=str)
    same = {r.doc_id: r.fingerprint for r in made}
    assert same[1] == same[2] != same[3]
    assert fingerprints.fingerprint_documents(empty).count() == 0


def paragraphs_by_hand(text):
    """Words of each line, cut behind a word of the ending letters and behind the twenty-fourth."""
    out = set()
    for line in text.split("\n"):
        run = []
        for w in re.findall(r"[^ ]+ *", line):
            run.append(w)
            if w.rstrip(" ")[-1] in "lmpw.!?:;" or len(run) == 24:
                out.add("".join(run))
                run = []
        if run:
            out.add("".join(run))
    return out


def test_paragraphs(docs):
    for _, t, _ in corpus():
        assert set(re.findall(fingerprints.PARAGRAPH, t or "")) == paragraphs_by_hand(t or "")
    t = " ".join(f"w{k}x" for k in range(100)) + " end. and"
    assert set(re.findall(fingerprints.PARAGRAPH, t)) == paragraphs_by_hand(t) and len(paragraphs_by_hand(t)) == 6


@pytest.mark.parametrize("wide", [1, 4, 32, 1024])
def test_peeling(spark, wide):
    """The number recovered is that of the symmetric difference; narrow sketches may fail, and say so."""
    rng = random.Random(9)
    sets = []
    for n, m in ((0, 1), (3, 3), (1, 0), (40, 60), (300, 1), (0, 700), *((rng.randrange(30), rng.randrange(30)) for _ in range(60))):
        a, b = [rng.getrandbits(63) for _ in range(n)], [rng.getrandbits(63) for _ in range(m)]
        common = [rng.getrandbits(63) for _ in range(3)]
        sets.append((len(sets) % 3, len(sets), sorted(a + common), sorted(b + common), n + m))
    d = spark.createDataFrame(sets, "bucket int, rn int, a array<long>, b array<long>, want int")
    out = {r.rn: r.n for r in fingerprints.recovered(d, ["bucket", "rn"], wide, 5).collect()}
    assert all(out.get(rn, 0) in (want, -1) for _, rn, _, _, want in sets)
    failed = sum(n == -1 for n in out.values())
    assert failed > 0 if wide == 1 else wide < 32 or failed == 0


def test_fingerprints_retry(spark, docs):
    """Sketches that are too narrow are tried again larger, with the same result; with no larger one, an error says so."""
    want = got(fingerprints.fingerprint_documents(docs), "doc_id", "near_edited", "near_next")
    assert got(fingerprints.fingerprint_documents(docs, wide=(1, 2, 64, 4096)), "doc_id", "near_edited", "near_next") == want
    with pytest.raises(RuntimeError):
        fingerprints.fingerprint_documents(docs, wide=(1,))


def test_fingerprints_of_a_long_text(spark):
    """One word put in front of a line of a megabyte leaves nearly all its paragraphs; all pairs are decided by the first sketches."""
    rng = random.Random(12)
    words = [rng.choice("river stone light garden winter open quiet wind salt lamp".split()) + str(rng.randrange(9999)) + rng.choice(("", "", "d", "l", "s", "n")) for _ in range(120_000)]
    t = " ".join(words)
    assert len(t) > 1_000_000
    rows = [(1, t), (2, "first " + t), (3, " ".join(words[:80])), (4, "first " + " ".join(words[:80])), (5, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(d, wide=fingerprints.WIDE[:1]).collect()}
    assert out[1].near_next > 0.999 and out[3].near_next > 0.8 and out[2].near_next < 0.1 and out[1].n_paragraphs > 8_000


def test_rules(docs, empty):
    out = {(r.doc_id, r.n_words): r for r in rules.judge(docs).collect()}
    for i, t, _ in corpus():
        t = t or ""
        ws = WORD.findall(t)
        ls = [x for x in t.split("\n") if WORD.search(x)]
        tri = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        hit = {p + j for p in range(len(ws) - 2) if tri[tuple(ws[p : p + 3])] > 1 for j in range(3)}
        r = out[i, len(ws)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(hit))
        assert r.base_failed == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws))
    assert out[1, 300].kept and not out[44, 60].kept and rules.judge(empty).count() == 0
    assert out[43, 27].cleaned.strip() == ""


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(corpus()) and all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in out)
    assert got(mixing.mix(docs.repartition(7)), "doc_id", "size", "taken") == sorted(((r.doc_id, r.size, r.taken) for r in out), key=str)
    total = sum(r.size for r in out)
    goals = {r.source: r.target for r in out}
    sizes = {r.source: r.source_size for r in out}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want, left, free = {}, 1.5 * total, set(sizes)
    while True:
        rate = left / sum(weights[s] for s in free)
        over = {s for s in free if rate * weights[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
        free -= over
    want |= {s: rate * weights[s] for s in free}
    assert goals == pytest.approx(want)
    assert mixing.mix(empty).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), F.pmod(F.xxhash64("id"), F.lit(50)).cast("int") + 1).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    sums = mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 26 for r in sums)


def test_quality(docs, empty, labels, spark):
    out = quality.score_quality(docs, labels).collect()
    assert len(out) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and binascii.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert quality.score_quality(empty, labels).count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.0}
    kept = quality.with_quality(docs, labels, "score")
    assert kept.columns == [c for c in docs.columns if c != "score"] + ["score"]


def test_votes_are_exact():
    rng = np.random.default_rng(0)
    space = quality.Space(rng.random((50, quality.TERMS), np.float32), rng.integers(0, 2, 50), 8)
    x = rng.random((7, quality.TERMS), np.float32)
    u = space.unit((np.sqrt(x[:, space.used]) * space.idf) @ space.project)
    for row, score in zip(u, space.vote(x, 5, 2.0, block=3), strict=True):
        cos = sorted(((float(row @ v), y) for v, y in zip(space.vectors, space.labels, strict=True)), reverse=True)[:5]
        assert score == pytest.approx(sum(max(c, 0) ** 2 * y for c, y in cos) / sum(max(c, 0) ** 2 for c, _ in cos), rel=1e-3)


@pytest.mark.parametrize("name,label", [("quality", "quality"), ("toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    d = "/root/testdata/sf0.01"
    t = lambda x: spark.read.parquet(f"{d}/{x}.parquet")
    scored = (quality.score_quality if name == "quality" else toxicity.score_toxicity)(t("documents"), t("labels"))
    rows = scored.where("held_out").join(t("labels"), "doc_id").select("predicted", label).collect()
    assert sum(r[0] == r[1] for r in rows) / len(rows) >= 0.95


def test_lines(docs, empty):
    out = lines.drop_wide_lines(docs, min_sites=4)
    assert set(out.columns) == {*docs.columns, "n_removed"} and out.count() == len(corpus())
    shared = corpus()[10][1].split("\n")[1]
    sites = defaultdict(set)
    around = defaultdict(set)
    for _, t, s in corpus():
        ls = [None, *(t.split("\n") if t is not None else []), None]
        for a, b, c in zip(ls, ls[1:], ls[2:], strict=False):
            if b and b.strip():
                sites[b.strip()].add(s)
                around[a, b.strip(), c].add(s)
    for r in out.collect():
        if r.doc_id is not None and 20 <= r.doc_id < 30:
            assert r.n_removed == 1 and shared not in r.text and r.text.count("\n") == 1
        elif r.doc_id is not None:
            assert r.n_removed == 0
    assert len(sites[shared]) == 10
    assert lines.drop_wide_lines(empty).count() == 0
    joined = lines.drop_wide_lines(docs, min_sites=4, most_sent=0)
    assert got(joined, "doc_id", "text", "n_removed") == got(out, "doc_id", "text", "n_removed")


def brute_segments(scores):
    """All maximal segments by definition: the best segment, then the same left and right of it."""
    best = None
    for i in range(len(scores)):
        s = 0.0
        for j in range(i, len(scores)):
            s += scores[j]
            if s > 1e-12 and (best is None or s > best[2] + 1e-12):
                best = (i, j + 1, s)
    if best is None:
        return []
    i, j, _ = best
    right = [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]
    return [*brute_segments(scores[:i]), best, *right]


def test_segments():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(0, 25)
        hits = [(i, rng.choice((0.3, 0.7, 1.1, 1.9)) + rng.random() / 100) for i in range(n) if rng.random() < 0.4]
        scores = [-0.4] * n
        for i, g in hits:
            scores[i] = g
        mine = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(hits, 0.4)]
        assert mine == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def test_toxicity(docs, empty, labels):
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == len(corpus()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_of_repeats_and_large_lexicons(spark):
    """Repeated rows score alike, a text without a known token as the others without, and a joined lexicon finds the same passages as one that is sent."""
    rng = random.Random(15)
    plain, bad = [f"plain{k}" for k in range(60)], [f"bad{k}" for k in range(6)]
    rows, marks = [], []
    for i in range(300):
        ws = [rng.choice(plain) for _ in range(60)]
        if i % 3 == 0:
            ws[20:26] = bad
        rows.append((i, " ".join(ws)))
        marks.append((i, int(i % 3 == 0)))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (None, rows[0][1]), (1002, "unknown words only"), (1003, None), (1004, ""), (1005, ("plain1 " * 150_000) + " ".join(bad))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(marks, "doc_id long, toxic int")
    sent, joined = (toxicity.score_toxicity(d, lab, most_sent=n).collect() for n in (toxicity.MOST_SENT, 0))
    plainly = lambda rs: sorted(((r.doc_id, round(r.score, 9), r.n_tokens, [(x.start, x.end) for x in r.segments]) for r in rs), key=str)
    assert plainly(sent) == plainly(joined)
    of = {r.doc_id: r for r in sent}
    assert of[1000].score == of[1001].score == of[None].score == of[0].score and of[1002].score == of[1003].score == of[1004].score
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in sent if r.doc_id is not None and r.doc_id < 300)
    assert any(x.start <= 20 and x.end >= 26 for x in of[0].segments) and of[1005].n_tokens == 150_006


def test_mixing_of_repeated_rows(spark):
    """Rows of one id and text, thousands of them, go to many blocks; the source's words still meet the target."""
    rows = [(None, "a b c")] * 3000 + [(5, "x y")] * 700 + [(k, "w " * (k % 40 + 1)) for k in range(1000, 1400)]
    d = spark.createDataFrame([(i, t, "ab"[k % 2]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(5)
    out = mixing.mix(d).collect()
    assert len(out) == len(rows)
    for s in "ab":
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 40
    assert got(mixing.mix(d.repartition(3)), "doc_id", "size", "source", "taken") == sorted(((r.doc_id, r.size, r.source, r.taken) for r in out), key=str)


def test_rules_leave_prose_that_mentions_a_phrase(spark):
    prose_ = " ".join(f"Sentence{k} number {k} has its{k} own{k} words{k}." for k in range(40))  # words that repeat would fail the base rules
    d = spark.createDataFrame([(1, prose_.replace("number 7", "about JavaScript")), (2, prose_ + "\nAll rights reserved. Privacy policy.\nAlle Rechte vorbehalten.")], "doc_id long, text string")
    out = {r.doc_id: r for r in rules.judge(d).collect()}
    assert out[1].kept and out[1].cleaned == prose_.replace("number 7", "about JavaScript") and out[2].kept and out[2].cleaned == prose_


def test_token_counts(spark, docs, empty):
    tok = Tokenizer.from_file(BYTE_BPE)
    tok.encode_special_tokens = True
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rng = random.Random(8)
    own = token_counts.Counter(BYTE_BPE, public_tokenizers.PATTERN)
    for _ in range(300):
        text = "".join(rng.choice(("a", "'", "ll", "s", " ", "  ", "\n", "7", "é", "!", "the", "'ve")) for _ in range(rng.randrange(0, 60)))
        d = token_counts.Document(text, own)
        for _ in range(3):
            a = rng.randrange(0, len(d.text) + 1)
            b = rng.randrange(a, len(d.text) + 1)
            d.edit(a, b, rng.choice(("", "l", " ", "'", "\n\n", "xyz 1")))
            assert d.tokens == n(d.text) and "".join(own.pattern.findall(d.text)) == d.text
            assert d.starts == [0, *np.cumsum([len(w) for w in own.pattern.findall(d.text)]).tolist()]
    long = token_counts.Document(" word" * 5000, own)
    assert long.edit(10_000, 10_004, "x") < 10 and long.tokens == n(long.text)
    check_tree(long.tree.root)
    edits = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit(1).alias("start"), F.lit(10**6).alias("end"), F.lit(" new").alias("new")), F.struct(F.lit(None).cast("int").alias("start"), F.lit(-5).alias("end"), F.lit(None).cast("string").alias("new"))))
    out = token_counts.count_tokens(docs.withColumn("e", edits), BYTE_BPE, public_tokenizers.PATTERN, "e")
    want = []
    for i, t, _ in corpus():
        after = (t or "")[:1] + " new" if i is not None and i % 2 == 0 else t or ""
        want.append((i, n(t or ""), n(after)))
    assert got(out, "doc_id", "n_tokens", "n_edited_tokens") == sorted(want, key=str)
    assert token_counts.count_tokens(empty.withColumn("e", edits), BYTE_BPE, public_tokenizers.PATTERN, "e").count() == 0


def check_tree(node, most=2 * token_counts.FAN):
    """Sums and heights of all nodes; returns the height."""
    if node.kids is None:
        assert len(node.lens) == len(node.counts) == node.n <= most and (node.chars, node.tokens) == (sum(node.lens), sum(node.counts))
        return 0
    heights = {check_tree(k) for k in node.kids}
    assert len(heights) == 1 and len(node.kids) <= most
    assert (node.n, node.chars, node.tokens) == tuple(sum(getattr(k, x) for k in node.kids) for x in ("n", "chars", "tokens"))
    return heights.pop() + 1


def test_token_tree(monkeypatch):
    """Many edits of a text with a tree of several levels, against reading it anew."""
    monkeypatch.setattr(token_counts, "FAN", 4)
    rng = random.Random(5)
    own = token_counts.Counter(BYTE_BPE, public_tokenizers.PATTERN)
    d = token_counts.Document(" ".join(f"word{k}" for k in range(400)), own)
    for k in range(150):
        a = rng.randrange(len(d.text) + 1)
        b = min(len(d.text), a + rng.choice((0, 3, 40, 900)))
        d.edit(a, b, rng.choice(("", "x", " new words here", "\n\n", " ".join(f"more{j}" for j in range(60)))))
        assert check_tree(d.tree.root, 8) <= 9
        fresh = token_counts.Document(d.text, own)
        assert d.tree.leaves() == fresh.tree.leaves() and d.tokens == fresh.tokens
        if k % 10 == 0:
            d = token_counts.Document(d.text, own, d.stored())
    d.edit(0, len(d.text), "")
    assert d.tokens == d.pretokens == 0 and d.edit(0, 0, "a b") == 2


def test_kept_trees(spark):
    """A text of a megabyte and others: edits of a second call start from the kept trees and read little again."""
    words = ["stone", "river's", "12", "light,", "é"]
    texts = [(1, " ".join(words[k % 5] for k in range(200_000))), (2, ""), (None, None), (3, "a b c")]
    edit = lambda a, b, new: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(new).alias("new")))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    one = token_counts.count_tokens(d.withColumn("e", edit(10, 12, "XY")), BYTE_BPE, public_tokenizers.PATTERN, "e", keep=True)
    far = 10**9
    two = token_counts.count_tokens(one.withColumn("e", edit(far, far, " the end")), BYTE_BPE, public_tokenizers.PATTERN, "e", text_col="edited_text", tree_col="tree", keep=True).collect()
    tok = Tokenizer.from_file(BYTE_BPE)
    for r in two:
        assert r.n_edited_tokens == len(tok.encode(r.edited_text, add_special_tokens=False).ids) and r.n_reencoded < 12
    assert max(len(r.edited_text) for r in two) > 900_000
    own = token_counts.Counter(BYTE_BPE, public_tokenizers.PATTERN)
    with pytest.raises(ValueError):
        token_counts.Document("another text", own, token_counts.Document("a text", own).stored())


def shingle_sets(rows, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t in rows:
        ws = WORD.findall((t or "").translate(low))
        out.append({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set())
    return out


def brute_components(rows, k, num, den):
    sets = shingle_sets(rows, k)
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[top(x)] = min(i, least.get(top(x), i))
    return sorted(((i, len(sets[x]), least.get(top(x)) if sets[x] else i) for x, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard(docs, empty, k, num):
    rows = [r[:2] for r in corpus()]
    assert got(jaccard.jaccard_components(docs, words=k, num=num), "doc_id", "n_shingles", "component_id") == brute_components(rows, k, num, 100)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_borderline(spark):
    """Families of sets just at and below the threshold, in one block and dealt over many."""
    rng = random.Random(6)
    rows, i = [], 0
    for _ in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(12):
            ws = list(base)
            for _ in range(rng.randrange(0, 4)):
                ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(ws[: rng.randrange(52, 61)])))
            i += 1
    rows += [(1000 + n, " ".join(f"s{j}" for j in range(n))) for n in range(1, 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (jaccard.BLOCK, 300):
        for k, num in ((4, 85), (1, 80)):
            assert got(jaccard.jaccard_components(d, words=k, num=num, block=block), "doc_id", "n_shingles", "component_id") == brute_components(rows, k, num, 100)


@pytest.mark.parametrize("num", [80, 85])
def test_jaccard_search(num):
    """search() against all pairs: with every set a probe, and with some sets connected before and only the others probes."""
    rng = random.Random(num)
    base = [rng.sample(range(10**6), 90) for _ in range(5)]
    sets = [np.array(sorted({*rng.sample(b, rng.randrange(70, 91)), *rng.sample(range(10**6), rng.randrange(8))}), np.uint64) for b in base for _ in range(25)]
    sets += [np.arange(n, dtype=np.uint64) for n in range(9)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a]) and 100 * len(x := np.intersect1d(sets[a], sets[b])) >= num * (len(sets[a]) + len(sets[b]) - len(x))]

    def groups(links, start):
        up = list(start)
        for a, b in links:
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    alone = np.arange(len(sets))
    found = jaccard.search(sets, alone, np.ones(len(sets), bool), num, 100)
    assert groups(found, alone) == groups(pairs, alone) and len(found) < len(sets)
    assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in pairs}
    roots = np.array([0 if k < 25 else k for k in alone])
    probes = np.array([k >= 20 for k in alone])
    found = jaccard.search(sets, roots, probes, num, 100)
    assert groups(found, roots) == groups([x for x in pairs if probes[x[0]] or probes[x[1]]], roots)


def test_divide_skip():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 12)
        ls = [np.array(sorted(rng.sample(range(n), rng.randrange(1, n + 1)))) for _ in range(rng.randrange(1, 10))]
        need = np.array([rng.randrange(1, 8) for _ in range(n)])
        counts = Counter(x for x in itertools.chain(*(a.tolist() for a in ls)))
        assert jaccard.divide_skip(ls, need).tolist() == [r for r in range(n) if counts[r] >= need[r]]


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: top(x) for e in edges if e[0] != e[1] for x in e}


def test_a_stored_tree_is_read_where_it_is_edited():
    """Trees of any height come back with all their sums; an edit opens the nodes on its way and no others."""
    own = token_counts.Counter(BYTE_BPE, public_tokenizers.PATTERN)
    for n in (0, 1, 64, 65, 4096, 4097, 9000):
        d = token_counts.Document(" word" * n, own)
        back = token_counts.Document(d.text, own, d.stored())
        assert (back.pretokens, back.tokens, back.tree.root.chars) == (d.pretokens, d.tokens, 5 * n)
        assert back.stored() == d.stored() and back.tree.leaves() == d.tree.leaves()
    d = token_counts.Document(" word" * 20_000, own)
    back = token_counts.Document(d.text, own, d.stored())
    for x in (d, back):
        x.edit(50_003, 50_003, "s and more")
    closed = opened = 0
    todo = [back.tree.root]
    while todo:
        x = todo.pop()
        if x.kept is None:
            opened += 1
            todo += x.kids or []
        else:
            closed += 1
    assert opened < 10 < closed
    assert (back.tokens, back.pretokens) == (d.tokens, d.pretokens) == (lambda f: (f.tokens, f.pretokens))(token_counts.Document(d.text, own))
    assert back.tree.leaves() == d.tree.leaves()
    check_tree(back.tree.root)
