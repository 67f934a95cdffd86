"""What comes from outside as text, judged: answers that should be JSON objects, and names of repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(answer: Column) -> Column:
    """An answer as a variant: the text itself if it is JSON, else what stands from its first { to its last }; null if neither parses."""
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(F.trim(answer)), F.try_parse_json(F.when(inner != "", inner)))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) == kind, F.lit(False))


def judged(v: Column, first: Column, last: Column) -> Column:
    """struct(verdict, category, line_start, line_end, reason) of a reviewer's answer (a variant) about the lines first to last.

    verdict is ok, no_bugs (valid, and nothing is reported), or the first reason to reject it: not_an_object, category, lines, reason (missing, of another
    type or blank), order (the first line is behind the last), bounds (outside the lines asked about). Only an ok answer has values.
    """
    text = lambda c: F.try_variant_get(v, f"$.{c}", "string")
    line = lambda c: F.try_variant_get(v, f"$.{c}", "bigint")
    filled = lambda c: _is(v, c, "STRING") & (F.trim(F.coalesce(text(c), F.lit(""))) != "")
    a, b = line("line_start"), line("line_end")
    verdict = (
        F.when(v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False)), "not_an_object")
        .when(_is(v, "no_bugs", "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$.no_bugs", "boolean"), F.lit(False)), "no_bugs")
        .when(~filled("category"), "category")
        .when(~(_is(v, "line_start", "BIGINT") & _is(v, "line_end", "BIGINT")), "lines")
        .when(~filled("reason"), "reason")
        .when(a > b, "order")
        .when((a < first) | (b > last), "bounds")
        .otherwise("ok")
    )
    ok = lambda c: F.when(verdict == "ok", c)
    return F.struct(verdict.alias("verdict"), ok(text("category")).alias("category"), ok(a).alias("line_start"), ok(b).alias("line_end"), ok(text("reason")).alias("reason"))


def repository(url: Column) -> Column:
    """struct(repo, error): `owner/name` of a repository's address, or why it is none: empty, host (a full address elsewhere than on github.com), no_owner, identifier."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    full = F.contains(raw, F.lit("://"))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(raw, "://([^/?#]*)", 1)), "^.*@", ""), ":.*$", "")
    rest = F.regexp_replace(F.regexp_replace(raw, "^.*?://", ""), "[?#].*$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), ":.*$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"(?i)^www\.", ""), r"(?i)^github\.com/", "")
    repo = F.regexp_replace(F.regexp_replace(rest, "/+$", ""), r"\.git$", "")
    fits = repo.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$") & ~repo.rlike(r"(^|/)\.{1,2}(/|$)")
    short = ~full & ~raw.rlike(r"(?i)^(www\.)?github\.com/") & ~F.contains(raw, F.lit("/"))
    error = F.when(raw == "", "empty").when(full & ~host.isin("github.com", "www.github.com"), "host").when(short, "no_owner").when(~fits, "identifier")
    return F.struct(F.when(error.isNull(), repo).alias("repo"), error.alias("error"))
