"""Scalar text functions as column expressions: identifiers, tokens, stems, messages, paths, hashes."""

from __future__ import annotations

import keyword

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that say nothing about code.
STOPWORDS = ("def", "return", "self", "cls", "if", "else", "elif", "for", "in", "is", "not", "and", "or", "import", "from", "as", "none", "true", "false", "pass", "try", "except", "with", "while", "lambda", "the", "of", "to", "a", "an")
#: Letters and digits, and their classes in the same places.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CLASSES = "a" * 26 + "A" * 26 + "0" * 10
#: Neighbouring classes that part an identifier, and the end of a run of capitals whose last begins a word.
TURNS, CAPITALS = ("aA", "a0", "A0", "0a", "0A"), "AAa"
#: What marks a line of a failure message as boilerplate.
BOILERPLATE = ("full diff", "use -v", "use `-v", "-vv", "full output truncated", "truncating", "[truncated]", "lines hidden", "at index")
#: Shapes of secrets.
SECRETS = ("AKIA[0-9A-Z]{16}", "sk-[A-Za-z0-9]{20,}", "-----BEGIN [A-Z]+ PRIVATE KEY-----")
CREDENTIALS = ("gh[pousr]_[A-Za-z0-9]{16,}", "github_pat_[A-Za-z0-9_]{20,}", r"(?i)authorization\s*:\s*\S+\s+\S+", r"(?i)https?://[^/\s:@]+:[^/\s:@]+@")


#: The published list of English stopwords of the Natural Language Toolkit.
ENGLISH = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in
out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than
too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
"""


def english_stopwords() -> list[str]:
    """English stopwords and Python's keywords."""
    return sorted({*ENGLISH.split(), *(k.lower() for k in keyword.kwlist)})


def pieces_of(identifier: Column) -> Column:
    """The parts of an identifier at signs and at case and digit boundaries, in order, in their own case."""
    plain = F.regexp_replace(identifier, "[^a-zA-Z0-9]+", " ")
    both = F.transform(F.array(F.struct(plain.alias("text"), F.translate(plain, LETTERS, CLASSES).alias("classes"))), _parted)
    spaced = F.element_at(both, 1)
    return F.filter(F.split(F.trim(spaced), " +"), lambda x: x != "")


def _parted(word: Column) -> Column:
    """A word's text with a blank where its classes turn, or before the last of several capitals that goes on in lower case; read from left to right, where a
    character that stands at a boundary belongs to no second one."""
    at = lambda i, n: F.substr(word["classes"], i, F.lit(n))

    def step(s: Column, i: Column) -> Column:
        free = i >= s["free"]
        turn, capitals = free & at(i, 2).isin(*TURNS), free & (at(i, 3) == CAPITALS)
        text = F.concat(s["text"], F.substr(word["text"], i, F.lit(1)), F.when(turn | capitals, " ").otherwise(""))
        return F.struct(text.alias("text"), F.when(turn, i + 2).when(capitals, i + 3).otherwise(s["free"]).alias("free"))

    whole = F.aggregate(F.sequence(F.lit(1), F.length(word["text"])), F.struct(F.lit("").alias("text"), F.lit(1).alias("free")), step)["text"]
    return F.when(word["classes"].rlike("|".join([*TURNS, CAPITALS])), whole).otherwise(word["text"])


def split_identifier(identifier: Column) -> Column:
    """Lower-case pieces, then the whole identifier where there is more than one piece."""
    p = pieces_of(identifier)
    return F.transform(F.when(F.size(p) > 1, F.concat(p, F.array(identifier))).otherwise(p), lambda x: F.lower(x))


def light_stem(word: Column) -> Column:
    """Suffix rules in order: ies, ed, ing, ates, es, s; each asks for a length, the first that fits holds."""
    cut = lambda n: F.left(word, F.length(word) - n)
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("ed") & (n > 5), cut(2))
        .when(word.endswith("ing") & (n > 6), cut(3))
        .when(word.endswith("ates") & (n > 5), cut(1))
        .when(word.endswith("es") & (n > 5), cut(2))
        .when(word.endswith("s") & (n > 3) & ~word.endswith("ss"), cut(1))
        .otherwise(word)
    )


#: What a word has that split_identifier splits.
DIVIDED = "_|[a-z][A-Z]|[A-Z][A-Z][a-z]|[a-zA-Z][0-9]|[0-9][a-zA-Z]"


def tokenize(text: Column, stemmer: str = "none", stopwords: tuple[str, ...] | list[str] = STOPWORDS, min_length: int = 2) -> Column:
    """Tokens of a text in order, repeats kept: words are split as identifiers, short ones and stopwords go, then pieces are stemmed and checked again.

    stemmer: none or light; the whole identifier of a split word is never stemmed. For Porter's second algorithm see stem.with_stems.
    """
    ok = lambda x: (F.length(x) >= min_length) & ~x.isin(*stopwords)
    stems = (lambda xs: F.transform(F.filter(xs, ok), light_stem)) if stemmer == "light" else (lambda xs: xs)

    def of(word: Column) -> Column:
        several = lambda p: F.when(F.size(p) > 1, F.concat(stems(p), F.array(F.lower(word)))).otherwise(stems(p))
        split = F.element_at(F.transform(F.array(F.transform(pieces_of(word), lambda x: F.lower(x))), several), 1)  # pieces are computed once
        return F.when(word.rlike(DIVIDED), split).otherwise(stems(F.array(F.lower(word))))

    return F.filter(F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9_]+"), F.lit(0)), of)), ok)


def token_parts(text: Column, stopwords: tuple[str, ...] | list[str] = STOPWORDS, min_length: int = 2) -> Column:
    """Array of (term, piece) in order, repeats kept: what tokenize() stems (piece) and what it leaves whole, before stemming; both are checked."""
    ok = lambda x: (F.length(x["term"]) >= min_length) & ~x["term"].isin(*stopwords)
    part = lambda x, piece: F.struct(F.lower(x).alias("term"), F.lit(piece).alias("piece"))

    def of(word: Column) -> Column:
        own = F.transform(pieces_of(word), lambda x: part(x, True))
        several = lambda p: F.when(F.size(p) > 1, F.concat(p, F.array(part(word, False)))).otherwise(p)
        return F.when(word.rlike(DIVIDED), F.element_at(F.transform(F.array(own), several), 1)).otherwise(F.array(part(word, True)))

    return F.filter(F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9_]+"), F.lit(0)), of)), ok)


def query_terms(*sources: Column) -> Column:
    """Terms of several sources: repeats go within a source, stay between sources; all-digit terms go."""
    return F.filter(F.concat(*[F.array_distinct(s) for s in sources]), lambda x: ~x.rlike("^[0-9]+$"))


def test_name_terms(name: Column, stemmer: str = "none") -> Column:
    return F.filter(tokenize(F.element_at(F.split(name, "::"), -1), stemmer), lambda x: ~x.isin("test", "tests"))


def clean_message(text: Column) -> Column:
    """A failure message without its line marks and boilerplate lines, blanks squeezed."""
    lines = F.split(F.regexp_replace(text, r"(?m)^E[ \t]+", ""), "\n")
    drop = lambda x: F.exists(F.array(*[F.lit(b) for b in BOILERPLATE]), lambda b: F.contains(F.lower(x), b))
    return F.trim(F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~drop(x)), "\n"), r"[ \t\n\r]+", " "))


def estimated_tokens(text: Column) -> Column:
    """ceil(length / 3.5 * 1.15); 0 for null or empty."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))).cast("double") / F.lit(3.5) * F.lit(1.15)).cast("long")


def approximate_tokens(text: Column) -> Column:
    """A quarter of the length, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long"))


def group_key(ids: Column) -> Column:
    """First 16 digits of the SHA-1 of the sorted ids, joined by |."""
    return F.substring(F.sha1(F.array_join(F.array_sort(ids), "|").cast("binary")), 1, 16)


def normal_message(text: Column) -> Column:
    """Blanks squeezed, addresses and line numbers masked."""
    squeezed = F.regexp_replace(text, r"[ \t\n\r]+", " ")
    return F.regexp_replace(F.regexp_replace(squeezed, "0x[0-9a-fA-F]+", "0x..."), "at line [0-9]+", "at line N")


def bug_id(node: Column, error: Column, message: Column) -> Column:
    return F.concat(F.lit("b_"), F.substring(F.sha1(F.concat_ws("|", node, error, normal_message(message)).cast("binary")), 1, 12))


def redact(text: Column, patterns: tuple[str, ...] = SECRETS) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def secrets_found(text: Column, patterns: tuple[str, ...] = SECRETS) -> Column:
    """How many matches redact() replaces."""
    found, out = F.lit(0), text
    for p in patterns:
        found = found + F.regexp_count(out, F.lit(p))
        out = F.regexp_replace(out, p, "[REDACTED]")
    return found.cast("long")


def posix_path(path: Column, root: str) -> Column:
    """Forward slashes, relative to root where it lies below; else as it is."""
    p = F.translate(path, "\\", "/")
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(base), F.substring(p, F.lit(len(base) + 1), F.length(p))).otherwise(F.regexp_replace(p, r"^\./", ""))


def is_external(path: Column, root: str) -> Column:
    """Absolute and not below root, or in a folder of installed packages."""
    p = posix_path(path, root)
    return p.startswith("/") | p.rlike("^[A-Za-z]:/") | F.contains(p, F.lit("site-packages"))


def node_parts(node: Column) -> Column:
    """file, class (null without one) and test of a test's node id; parameters in brackets stay with the test."""
    parts = F.split(node, "::")
    return F.struct(F.get(parts, F.lit(0)).alias("file"), F.when(F.size(parts) > 2, F.element_at(parts, -2)).alias("class"), F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("test"))


def failure_kind(error: Column, message: Column, path: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    imported = F.contains(m, F.lit("import")) | F.coalesce(error, F.lit("")).isin("ImportError", "ModuleNotFoundError")
    return (
        F.when(imported & (F.contains(path, F.lit("conftest")) | ~path.endswith(".py")), "collection_error")
        .when(imported, "import_error")
        .when((F.coalesce(error, F.lit("")) == "AssertionError") | F.contains(m, F.lit("assert")), "assertion")
        .when(F.contains(m, F.lit("timeout")), "timeout")
        .otherwise("exception")
    )


#: Operators of assertions, those of two words first: `is not` is no `is` with a value of `not`.
COMPARISONS = ("is not", "not in", "==", "!=", "<=", ">=", "<", ">", "is", "in")


def assertion_parts(message: Column) -> Column:
    """operator, actual and expected of the first comparison; nulls without one."""
    blank, word = r"[ \t\n]+", r"[^ \t\n]+"
    pattern = f"assert{blank}(.+?){blank}({'|'.join(COMPARISONS)}){blank}({word})"
    part = lambda k: F.nullif(F.trim(F.regexp_extract(F.coalesce(message, F.lit("")), pattern, k)), F.lit(""))
    return F.struct(part(2).alias("operator"), part(1).alias("actual"), part(3).alias("expected"))


def severity(message: Column, module: Column) -> Column:
    m, s = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(module, F.lit("")))
    has = lambda c, w: F.contains(c, F.lit(w))
    return F.when(has(m, "zero") | has(s, "auth") | has(s, "security"), "High").when(has(m, "assert") | has(s, "string"), "Medium").otherwise("Low")


#: Kinds of log lines, by what a line begins with or contains; the first that fits holds.
LOG_KINDS = (
    ("cmd", ("Running command:", "Initializing git clone", "Staging files:", "Committing", "Pushing", "Opening Pull Request", "Spawning docker"), ()),
    ("err", ("E  ", ">  "), ("FAILURES", "AssertionError", "FAILED", "ERROR:")),
    ("ok", (), ("PASSED", "passed", "SUCCESS", "successful", "COMPLETED", "done.")),
    ("info", ("[STATUS]", "[INFO]", "[SYSTEM]"), ()),
    ("add", ("+",), ()),
)


def log_kind(line: Column) -> Column:
    out = None
    for kind, begins, has in LOG_KINDS:
        test = F.lit(False)
        for x in begins:
            test = test | line.startswith(x)
        for x in has:
            test = test | F.contains(line, F.lit(x))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    out = out.when(line.startswith("-") & ~line.startswith("---"), "rem")
    return out.when(line.startswith("@@") | line.startswith("---"), "meta").when(line.startswith("==="), "sep").otherwise("default")


def progress(step: Column, steps: Column, status: Column) -> Column:
    """Percent done: half-way through the step that runs, at most 98; 100 when completed, 65 when failed."""
    now = F.floor(step * 100.0 / steps + 50.0 / steps + 0.5)
    return F.when(status == "completed", 100).when(status == "failed", 65).otherwise(F.least(now, F.lit(98))).cast("long")


def numbered_lines(text: Column, first: int, last: int) -> Column:
    """Lines first to last (from 1), each behind its number."""
    lines = F.slice(F.split(text, "\n"), first, last - first + 1)
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), x)), "\n")


def preview(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percent, rounded half up; 0 for nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part.cast("double") * 100 / whole, digits))


def json_object(text: Column) -> Column:
    """The JSON object in an answer: without code fences, from the first { to the last }; null if there is none."""
    inner = F.regexp_extract(F.regexp_replace(text, "```[a-z]*", ""), r"(?s)(\{.*\})", 1)
    return F.when(inner != "", inner)


def explain_path(path: Column) -> Column:
    """`a -calls-> b` of an array of struct(src, edge_type) that ends with struct(node, null)."""
    return F.array_join(F.transform(path, lambda x: F.when(x["edge_type"].isNull(), x["src"]).otherwise(F.concat(x["src"], F.lit(" -"), x["edge_type"], F.lit("-> ")))), "")


def tier(kind: Column, score: Column, full: float = 0.60, signature: float = 0.25) -> Column:
    return (
        F.when((kind == "class") & (score >= signature), "SKELETON")
        .when((kind == "constant") & (score >= signature), "FULL")
        .when(~kind.isin("class", "constant") & (score >= full), "FULL")
        .when(~kind.isin("class", "constant") & (score >= signature), "SIGNATURE")
        .otherwise("DROP")
    )


def verification(source: Column) -> Column:
    return F.when(source == "pytest", "confirmed").when(source == "ruff", "not_applicable").otherwise("unconfirmed")


def age_label(at: Column, now: Column) -> Column:
    """Today, Yesterday, `n days ago` within a week, else the date."""
    d = F.datediff(now, at)
    return F.when(d <= 0, "Today").when(d == 1, "Yesterday").when(d < 7, F.concat(d.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(at, "yyyy-MM-dd"))


def duration_label(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    return F.when(h > 0, text(h, "h ", m, "m ", r, "s")).when(m > 0, text(m, "m ", r, "s")).otherwise(text(r, "s"))


def denied(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a pattern is part of the path, or matches it as a glob."""
    test = F.lit(False)
    for p in patterns:
        glob = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in r"\.+^$()[]{}|" else c) for c in p)
        test = test | F.contains(path, F.lit(p)) | path.rlike(f"^{glob}$")
    return test


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any folder or file name of the path is a pattern, or the path ends with one."""
    test = F.lit(False)
    for p in patterns:
        test = test | F.array_contains(F.split(path, "/"), p) | path.endswith(p)
    return test


def is_test_path(path: Column, folders: tuple[str, ...] = ("test", "tests")) -> Column:
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    inside = F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(f) for f in folders]))
    return inside | name.rlike(r"^test_.*\.py$") | name.rlike(r"_test\.py$") | (name == "conftest.py")


def content_hash(files: DataFrame, version: str, path_col: str = "path", sha_col: str = "sha1") -> DataFrame:
    """One row (files, content_hash): changes when any file, path or the version does. Files are hashed on their own; only (path, digest) pairs meet."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(path_col, sha_col))), lambda x: F.concat_ws(":", x[path_col], x[sha_col]))
    return files.agg(F.count("*").alias("files"), F.sha2(F.concat_ws("\n", F.lit(version), F.array_join(pairs, "\n")).cast("binary"), 256).alias("content_hash"))


def tree_digest(files: DataFrame, version: str, path_col: str = "path", sha_col: str = "sha1", levels: tuple[int, ...] = (4, 2, 0)) -> DataFrame:
    """One row (files, tree_digest) for any number of files: a tree whose leaves are the files whose hashed path begins with the same `levels[0]` hex digits.

    A leaf's digest is that of its files in order, a node's that of its children, the root's that of the version and the nodes below it. Which leaf a file
    is in follows from its path alone, so partitioning makes no difference; any file, path or version does. With 4 digits a leaf has one in 65,536 files.
    """
    at = files.select(F.sha2(F.col(path_col).cast("binary"), 256).alias("_at"), F.concat_ws(":", path_col, sha_col).alias("_line"), F.lit(1).cast("long").alias("_n"))
    node = at.select("_at", "_line", "_n")
    for width in levels:
        joined = F.array_join(F.array_sort(F.collect_list("_line")), "\n")
        content = joined if width else F.concat_ws("\n", F.lit(version), joined)
        key = F.substring("_at", 1, width) if width else F.lit("")
        node = node.groupBy(key.alias("_key")).agg(F.sha2(content.cast("binary"), 256).alias("_d"), F.sum("_n").alias("_n"))
        node = node.select(F.col("_key").alias("_at"), F.concat_ws(":", "_key", "_d").alias("_line"), "_n", "_d")
    empty = F.sha2(F.lit(version).cast("binary"), 256)
    return node.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("files"), F.coalesce(F.max("_d"), empty).alias("tree_digest"))
