"""BM25 over any table of texts: term counts, postings, statistics, and ranked search for many queries at once.

idf = ln((N - df + 0.5) / (df + 0.5) + 1); a term adds weight * idf * tf (k1 + 1) / (tf + k1 (1 - b + b length / average length)), where the weight is how
often the query has it, two at most. A search needs counts of the query's terms only: documents' tokens are counted in place, and just the hits of
those terms are dealt, by document, so a document is scored for all queries in one task, and only the best are dealt by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.stem import with_stems
from gleanery.functions.terms import counted, exploded, merged
from gleanery.functions.text import STOPWORDS, english_stopwords, token_parts, tokenize
from gleanery.storage import cut

K1, B, CAP = 1.5, 0.75, 2
#: Up to so many rows of weights are sent to every task.
SENT = 100_000


def term_counts(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, term, tf) of all terms."""
    return docs.select(id_col, F.explode(tokens).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def postings(counts: DataFrame, id_col: str) -> DataFrame:
    """(term, df, postings sorted by id): the index as it is stored; for terms of any frequency use the counts themselves."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.array_sort(F.collect_list(F.struct(id_col, "tf"))).alias("postings"))


def corpus_stats(lengths: DataFrame, length_col: str = "length") -> DataFrame:
    """One row: n, tokens, avgdl; of the documents that have a token."""
    some = lengths.where(F.col(length_col) > 0)
    return some.agg(F.count("*").alias("n"), F.sum(length_col).alias("tokens"), (F.sum(length_col).cast("double") / F.count("*")).alias("avgdl"))


def query_weights(queries: DataFrame, query_col: str, terms_col: str, cap: int = CAP) -> DataFrame:
    """(query, term, weight) of array columns of terms; an empty query has no row."""
    exploded = queries.select(query_col, F.explode(terms_col).alias("term"))
    return exploded.groupBy(query_col, "term").agg(F.least(F.count("*"), F.lit(cap)).cast("long").alias("weight"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def search(docs: DataFrame, weights: DataFrame, id_col: str, text_col: str, query_col: str = "query_id", k: int = 10, k1: float = K1, b: float = B, stemmer: str = "none", most_terms: int = 100_000) -> DataFrame:
    """(query, id, rank, score, breakdown) of the k best documents of every query.

    Ranks go by the score rounded to six digits, then by id. Texts are read once: their tokens are counted where they are read, and each document's length and
    hits are kept; of at most most_terms distinct query terms no others are, beyond that all counts are joined. A query without terms, or whose terms no
    document has, has no rows.
    """
    terms = weights.select("term").distinct()
    some = [r[0] for r in terms.limit(most_terms + 1).collect()]  # bounded
    few = len(some) <= most_terms
    sized = merged(cut(counted(docs.select(id_col, text_col), text_col, stemmer, STOPWORDS, some if few else None), "hits"), id_col)
    tf = exploded(sized.repartition(id_col), id_col, "length")
    tf = tf if few else tf.join(terms, "term", "left_semi")
    return ranked(tf, corpus_stats(sized.select("length")), weights, id_col, query_col, k, k1, b)


def ranked(tf: DataFrame, stats: DataFrame, weights: DataFrame, id_col: str, query_col: str = "query_id", k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """What search() returns, from the counts (id, length, term, tf) of at least the query's terms and the corpus's statistics.

    Where tf is dealt by id, and weights are few enough to be sent, scores are summed where they arise. Breakdowns are made for the k best alone.
    """
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(stats)  # one row
    norm = F.col("tf") + F.lit(k1) * (1 - F.lit(b) + F.lit(b) * F.col("length") / F.col("avgdl"))
    gains = df.join(weights, "term")
    gains = F.broadcast(gains) if weights.limit(SENT + 1).count() <= SENT else gains
    scored = tf.join(gains, "term").crossJoin(stats)
    scored = scored.withColumn("idf", idf(F.col("n"), F.col("df"))).withColumn("contribution", F.col("weight") * F.col("idf") * F.col("tf") * (k1 + 1) / norm)
    total = scored.groupBy(query_col, id_col).agg(F.round(F.sum("contribution"), 6).alias("score"))
    best = top_k(total.where("score > 0"), query_col, id_col, k)
    part = F.struct("term", "df", F.round("idf", 6).alias("idf"), "tf", "weight", F.round("contribution", 6).alias("contribution"))
    own = scored.join(best.select(query_col, id_col), [query_col, id_col], "left_semi")
    parts = own.groupBy(query_col, id_col).agg(F.array_sort(F.collect_list(part)).alias("breakdown"))
    return best.join(parts, [query_col, id_col], "left").select(query_col, id_col, "score", "breakdown", "rank")


def top_k(scored: DataFrame, query_col: str, id_col: str, k: int) -> DataFrame:
    """The k best rows of each query, with their rank from 1."""
    w = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def top_contributions(breakdown: Column, n: int = 3) -> Column:
    """The n terms that add most, ties by term."""
    order = F.transform(breakdown, lambda x: F.struct((-x["contribution"]).alias("o"), x["term"].alias("term")))
    return F.transform(F.slice(F.array_sort(order), 1, n), lambda x: x["term"])


def searchable(chunks: DataFrame, include_tests: bool = False) -> DataFrame:
    out = chunks.where("token_count > 0")
    return out if include_tests else out.where("not is_test")


def chunk_text(kind: Column, name: Column, signature: Column, docstring: Column, source: Column) -> Column:
    """What a symbol is searched by: modules by name and docstring, classes without their source, all others with it."""
    return F.concat_ws(" ", name, F.when(kind != "module", signature), docstring, F.when(~kind.isin("module", "class"), source))


def term_rows(docs: DataFrame, id_col: str, text_col: str, stemmer: str = "porter2", stopwords: tuple[str, ...] | list[str] | None = None) -> DataFrame:
    """(id, term) for each token; what tokenize() yields, but for the stemmer porter2, which stems each distinct piece once.

    Without stopwords, these are the English ones and Python's keywords.
    """
    stop = english_stopwords() if stopwords is None else stopwords
    if stemmer != "porter2":
        return docs.select(id_col, F.explode(tokenize(F.col(text_col), stemmer, stop)).alias("term"))
    parts = docs.select(id_col, F.explode(token_parts(F.col(text_col), stop)).alias("_p")).select(id_col, "_p.*")
    stemmed = with_stems(parts, "term").select(id_col, F.when(F.col("piece"), F.col("stem")).otherwise(F.col("term")).alias("term"))
    return stemmed.where((F.length("term") >= 2) & ~F.col("term").isin(*stop))


def build_index(docs: DataFrame, id_col: str, text_col: str, path: str, stemmer: str = "porter2", stopwords: tuple[str, ...] | list[str] | None = None, buckets: int = 64) -> None:
    """Counts, lengths and statistics of a table of texts, stored; documents without a token are left out."""
    stop = english_stopwords() if stopwords is None else stopwords
    counts = merged(cut(counted(docs.select(id_col, text_col), text_col, stemmer, stop), "counts"), id_col).where("length > 0")
    save_index(exploded(counts, id_col), counts.select(id_col, "length"), id_col, path, buckets)


def term_counts_of(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def search_index(spark, path: str, weights: DataFrame, id_col: str, query_col: str = "query_id", k: int = 10, buckets: int = 64, most_terms: int = 10_000) -> DataFrame:
    """search() over a stored index: only the buckets of the queries' terms are read, and no text. Beyond most_terms distinct terms, counts are joined. Counts
    meet lengths by document, whatever Spark guesses of their size: so they are scored there."""
    terms = weights.select("term").distinct()
    some = [r[0] for r in terms.limit(most_terms + 1).collect()]  # bounded
    counts, lengths, stats = load_index(spark, path, some if len(some) <= most_terms else None, buckets)
    if len(some) > most_terms:
        counts = counts.join(terms, "term", "left_semi")
    return ranked(counts.join(lengths.hint("merge"), id_col), stats, weights, id_col, query_col, k)


def code_chunks(symbols: DataFrame, files: DataFrame, stemmer: str = "porter2", with_token: bool = True) -> DataFrame:
    """(id, kind, file, is_test, text) of symbols, what each is searched by; source lines come from files (path, text). With with_token, of those that have one:
    an index needs no such test, as it leaves the others out."""
    lines = F.slice(F.split("_text", "\n"), F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0)))
    j = symbols.join(files.select(F.col("path").alias("file"), F.col("text").alias("_text")).hint("merge"), "file")  # sources grow with the input, whatever size Spark guesses
    text = chunk_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("docstring"), F.array_join(lines, "\n"))
    chunks = j.select("id", "kind", "file", F.coalesce("is_test", F.lit(False)).alias("is_test"), text.alias("text"))
    if not with_token:
        return chunks
    chunks = cut(chunks, "chunks")
    return chunks.join(term_rows(chunks, "id", "text", stemmer).select("id").distinct(), "id", "left_semi")


def save_index(counts: DataFrame, lengths: DataFrame, id_col: str, path: str, buckets: int = 64) -> None:
    """The index as Parquet: counts dealt by term, so that a search reads a few files; lengths; statistics."""
    dealt = counts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").sortWithinPartitions("term", id_col).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    corpus_stats(lengths).write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark, path: str, terms: list[str] | None = None, buckets: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts, lengths and statistics; with terms, only the buckets that can have them are read."""
    counts = spark.read.parquet(f"{path}/counts")
    if terms is not None:
        wanted = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).distinct().collect()]
        counts = counts.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    return counts.drop("bucket"), spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/stats")
