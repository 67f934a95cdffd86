"""Quality rules, lines first: each line is judged by itself, failing lines go, and a document that loses too much of its text is rejected.

DataFrame functions only. Punctuation: a line of more than `long_line` words needs a sentence mark, and signs that prose has no use for may not reach
half the number of words. Navigation: separators such as | may not reach a sixth of the words (two at least). Boilerplate: phrases that sites repeat, in
English, German, French or Spanish, may not reach one for each fifteen words, so prose that mentions one is no boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.columns import let, upto, words
from gleanery.llm.common import WORD

#: Patterns that Java and DuckDB read alike.
SENTENCE_MARK = "[.!?:;…]"
ODD_SIGN = r"[#*$%&<>!@^~=+{}\[\]\\]"
SEPARATOR = "[|»›•]"
BOILERPLATE = "(?i)(javascript|cookie|lorem ipsum|all rights reserved|privacy policy|terms of (use|service)|licensed under|released under|click here|subscribe|sign up|log in|alle rechte vorbehalten|datenschutz|impressum|nutzungsbedingungen|tous droits r|politique de confidentialit|conditions d.utilisation|todos los derechos reservados|pol.tica de privacidad|t.rminos de uso)"
SYMBOL = "[#*$%&|<>]"


def line_fails(line: Column, long_line: int = 10) -> Column:
    """Whether a line breaks the punctuation, navigation or boilerplate rule; a line without a word breaks none."""
    n = F.regexp_count(line, F.lit(WORD))
    return let(
        n,
        lambda n: ((n > long_line) & ~line.rlike(SENTENCE_MARK))
        | ((n > 0) & let(F.regexp_count(line, F.lit(ODD_SIGN)), lambda odd: (odd > 1) & (odd * 2 >= n)))
        | let(F.regexp_count(line, F.lit(SEPARATOR)), lambda s: (s > 1) & (s * 6 >= n))
        | let(F.regexp_count(line, F.lit(BOILERPLATE)), lambda b: (b > 0) & (b * 15 >= n)),
    )


def clean_lines(text: Column, long_line: int = 10) -> Column:
    """The text without its failing lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~line_fails(x, long_line)), "\n")


def repeated_words(ws: Column) -> Column:
    """How many words stand in a window of three that is found at least twice among the words."""
    triple = lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p"))
    windows = F.sort_array(F.transform(upto(F.size(ws) - 2), triple))
    twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    starts = let(windows, lambda s: F.array_sort(F.transform(twice(s), lambda x: x["p"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    return F.aggregate(starts, start, step, lambda a: a["n"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_kept: float = 0.5, long_line: int = 10, min_words: int = 50, max_repeated: int = 50) -> DataFrame:
    """Counts, the base rules' verdict, the method's verdict and the cleaned text of every document.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), cleaned (the text without its
    failing lines); one row for each row of docs, without a shuffle; other columns are ignored. A document passes the method if its cleaned lines have
    at least min_kept of the characters of all its lines.

    Defined results: a null or empty text has zero counts, fails the base rules and cleans to an empty text; a null id stays null; repeated rows are
    judged alike; an empty table gives an empty result; of equal lines, all but the first count as repeated.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("ws", words(F.col("text"))).withColumn("cleaned", clean_lines(F.col("text"), long_line))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    chars = lambda c: F.length(F.regexp_replace(c, r"\n", ""))
    d = d.select(
        "id",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).cast("long").alias("n_repeat_words"),
        (chars(F.col("cleaned")) >= F.lit(float(min_kept)) * chars(F.col("text"))).alias("_enough"),
        "cleaned",
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("_enough")).alias("kept"), "cleaned")


#: The same in DuckDB: columns of the registered query.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
judged AS (SELECT doc_id, line, len(regexp_extract_all(line, '{WORD}')) AS n, len(regexp_extract_all(line, '{ODD_SIGN}')) AS odd,
    len(regexp_extract_all(line, '{SEPARATOR}')) AS seps, len(regexp_extract_all(line, '{BOILERPLATE}')) AS phrases FROM lines),
ok AS (SELECT doc_id, line, NOT ((n > 10 AND NOT regexp_matches(line, '{SENTENCE_MARK}')) OR (n > 0 AND odd * 2 >= n AND odd > 1)
    OR (seps > 1 AND seps * 6 >= n) OR (phrases > 0 AND phrases * 15 >= n)) AS good, n FROM judged),
by_doc AS (SELECT doc_id, sum(length(line)) AS chars, sum(CASE WHEN good THEN length(line) ELSE 0 END) AS good_chars,
    count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines FROM ok GROUP BY doc_id),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM d),
tri AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS t FROM pos),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, t) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY doc_id),
base AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{SYMBOL}'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    good_chars >= 0.5 * chars AS enough FROM d JOIN by_doc USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND enough) AS kept FROM base
"""
