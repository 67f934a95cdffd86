"""Removal of lines that stand on many sites, by the spread of each line hash over distinct sites.

Each line of a document is hashed; each site is one value of a column. A HyperLogLog sketch of sites for each line hash is built where the lines are read
and merged by aggregation. Lines whose estimate is near the threshold are counted exactly. A line beyond it is boilerplate wherever it stands, be it alone,
within a block of such lines or in a document that is copied whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import arrow_bytes, cut, forget, lean, text_bytes, unused

#: A broadcast set of line hashes takes up to 8 MB; more lines than that are joined.
MOST_SENT = 1_000_000


def line_hashes(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    """The lines of each text, and the hashes of all of them, one text after another; 0 for a blank line."""
    lines = [t.split(b"\n") for t in texts]
    digest = xxhash.xxh3_64_intdigest
    return lines, np.array([digest(y) if (y := x.strip()) else 0 for ls in lines for x in ls], np.uint64)


def among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(h), bool)
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h


def spread_rows(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """(line, site): distinct pairs of each batch."""

    def run(batches):
        for b in batches:
            lines, h = line_hashes(b.column(1).to_pylist())
            site = np.repeat(b.column(0).to_numpy(), [len(x) for x in lines])
            order = np.lexsort((site, h))
            h, site = h[order], site[order]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (site[1:] != site[:-1])][: len(h)] & (h != 0)
            yield pa.RecordBatch.from_arrays([pa.array(h[fresh].view(np.int64)), pa.array(site[fresh])], ["line", "site"])

    return docs.select(F.xxhash64(F.col(site_col)).alias("site"), text_bytes(text_col).alias("text")).mapInArrow(lean(run), "line long, site long")


def wide_lines(rows: DataFrame, min_sites: int, lg_k: int = 10, band: float = 0.2) -> DataFrame:
    """(line, sites) of the hashes on at least min_sites distinct sites.

    Estimates come from merged sketches. Their standard error is under a sixth of `band` for the default lg_k, so a hash outside the band round the
    threshold is on its side of it; those inside the band are counted exactly, from the rows of these hashes alone.
    """
    two = rows.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a < b").select("line") if min_sites > 1 else None
    some = rows if two is None else rows.join(two, "line", "left_semi")
    sketched = some.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    est = cut(sketched.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - band)), "line-spread")
    near = est.where(F.col("sites") <= min_sites * (1 + band)).select("line")
    exact = rows.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites"))
    return est.where(F.col("sites") > min_sites * (1 + band)).unionByName(exact.where(F.col("sites") >= min_sites))


def drop_wide_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 8, most_sent: int = MOST_SENT) -> DataFrame:
    """docs with two more columns, n_lines and n_removed, and with the text less its boilerplate lines.

    A line (without surrounding blanks) that stands on at least min_sites distinct sites is removed; a null site is a site of its own. Every other column
    stays as it is, but for n_lines and n_removed of docs, which are replaced; one row for each row of docs, in no stated order.

    Defined results: a null text stays null with no lines; an empty text has one blank line, and blank lines are never removed; ids take no part, so null
    or repeated ids and repeated rows make no difference; an empty table gives an empty result. Hashes of 64 bits stand for lines.
    """
    spark = docs.sparkSession
    arrow_bytes(spark, 8 << 20)
    rows = cut(spread_rows(docs.withColumn(site_col, F.coalesce(F.col(site_col).cast("string"), F.lit("\0null"))), site_col, text_col), "line-rows")
    wide = cut(wide_lines(rows, min_sites), "wide-lines")
    if wide.count() <= most_sent:
        sent = spark.sparkContext.broadcast(np.sort(wide.select("line").toArrow().column("line").to_numpy().view(np.uint64)))  # at most `most_sent` numbers
        out = _apply(docs, text_col, sent, None)
    else:
        out = _apply(docs, text_col, None, wide)
    forget(rows)
    return out


def _apply(docs: DataFrame, text_col: str, sent, wide: DataFrame | None) -> DataFrame:
    """Removes the lines whose hashes were sent, or those of the joined table `wide` when that is too large to send."""
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    if wide is not None:
        row, marks = unused(docs, "_row"), unused(docs, "_wide")
        keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")

        def hashes(batches):
            for b in batches:
                lines, h = line_hashes(b.column(1).to_pylist())
                at = np.repeat(b.column(0).to_numpy(), [len(x) for x in lines])
                yield pa.RecordBatch.from_arrays([pa.array(at[h != 0]), pa.array(h[h != 0].view(np.int64))], ["row", "line"])

        found = keyed.select(row, text_bytes(text_col).alias("text")).mapInArrow(lean(hashes), "row long, line long").join(wide, "line", "left_semi")
        found = found.groupBy(F.col("row").alias(row)).agg(F.collect_set("line").alias(marks))  # bounded by a document's lines
        docs = keyed.join(found, row, "left").select(*names, marks)
    at = names.index(text_col)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "n_lines long, n_removed long"])

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            lines, h = line_hashes([(t or "").encode() for t in texts])
            ends = np.cumsum([len(x) for x in lines]).tolist()
            if sent is not None:
                out = among(h, sent.value)
            else:
                own = [np.sort(np.array(x or [], np.int64).view(np.uint64)) for x in b.column(len(names)).to_pylist()]
                out = np.concatenate([np.zeros(0, bool), *(among(h[e - len(x) : e], w) for x, e, w in zip(lines, ends, own, strict=True))])
            total = np.r_[0, np.cumsum(out)]
            gone = [int(total[e] - total[e - len(x)]) for x, e in zip(lines, ends, strict=True)]
            for k, g in enumerate(gone):
                if g:
                    texts[k] = b"\n".join([x for x, o in zip(lines[k], out[ends[k] - len(lines[k]) :].tolist(), strict=False) if not o]).decode()
            n = [0 if null else len(x) for null, x in zip(b.column(at).is_null().to_pylist(), lines, strict=True)]
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_removed"])

    return docs.mapInArrow(lean(run), schema)


#: op7_line_dedup in DuckDB, with exact counts of sites.
ORACLE = """
WITH d AS (SELECT doc_id, text, coalesce(source, 'null') AS site, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x FROM l),
one AS (SELECT x, count(DISTINCT site) AS k FROM t WHERE x <> '' GROUP BY x),
j AS (SELECT t.*, coalesce(one.k >= 8, false) AS gone FROM t LEFT JOIN one ON one.x = t.x)
SELECT doc_id, (CASE WHEN any_value(text) IS NULL THEN 0 ELSE count(*) END)::BIGINT AS n_lines, count(*) FILTER (gone) AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
