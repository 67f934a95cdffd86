"""Facts of Python sources, parsed with the standard library's ast and never run: symbols, imports, calls, references, failures.

Resolution of names is not done here but by joins (operators.resolve); one pass over the files yields every fact as a row of (kind, file) with one typed column for each kind, of which a fact fills its own.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

SYMBOL = "id string, kind string, name string, qualified_name string, file string, line_start int, line_end int, signature string, docstring string, parent string, is_test boolean, is_async boolean, decorators array<string>, bases array<string>, params array<string>, branches int, calls int, returns int, constant_return string, same_branch boolean"
IMPORT = "file string, style string, level int, line int, module string, name string, asname string"
CALL = "caller string, file string, cls string, receiver string, name string, line int"
ATTR = "owner string, file string, attr string, type_name string"
LOAD = "caller string, file string, name string"
FAILURE = "file string, stage string, line int, reason string"


def _plain(e: ast.expr) -> str:
    """ast.unparse, which is slow, with its answer for names and chains of names given at once."""
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute) and isinstance(e.value, (ast.Name, ast.Attribute)):
        return f"{_plain(e.value)}.{e.attr}"
    return ast.unparse(e)


def _plain_args(a: ast.arguments) -> str:
    if a.posonlyargs or a.kwonlyargs or a.vararg or a.kwarg or a.defaults:
        return ast.unparse(a)
    return ", ".join(f"{x.arg}: {_plain(x.annotation)}" if x.annotation else x.arg for x in a.args)


def _walk(body: list[ast.stmt]) -> list[ast.AST]:
    """The nodes of ast.walk for each statement in turn, but for the contexts of names."""
    out = []
    for stmt in body:
        queue = [stmt]
        for n in queue:
            for v in n.__dict__.values():
                if type(v) is list:
                    queue += [x for x in v if isinstance(x, ast.AST)]
                elif isinstance(v, ast.AST) and not isinstance(v, ast.expr_context):
                    queue.append(v)
        out += queue
    return out


def _receiver(f: ast.expr) -> tuple[str | None, str] | None:
    if isinstance(f, ast.Name):
        return None, f.id
    if isinstance(f, ast.Attribute):
        v = f.value
        if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id == "super":
            return "super()", f.attr
        text = _plain(v)
        return (text if text.replace("_", "a").replace(".", "a").isalnum() else "<expr>"), f.attr
    return None


def _name(e: ast.expr | None) -> str | None:
    """The plain name of a type or class expression: `a.B` is B, `B | None` and `Optional[B]` are B."""
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Attribute):
        return e.attr
    if isinstance(e, ast.Constant) and isinstance(e.value, str):
        return e.value
    if isinstance(e, ast.BinOp):
        return _name(e.left)
    if isinstance(e, ast.Subscript):
        return _name(e.slice) if _name(e.value) == "Optional" else _name(e.value)
    if isinstance(e, ast.Call):
        return _name(e.func)
    return None


def facts(path: str, text: str, is_test: bool, symbols_alone: bool = False) -> Iterator[tuple[str, dict]]:
    """All facts of one file, or its symbols; a file that does not parse yields one failure."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        yield "failure", {"file": path, "stage": "parse", "line": getattr(e, "lineno", None), "reason": type(e).__name__}
        return
    first = lambda node: (ast.get_docstring(node) or "").split("\n")[0] or None
    yield "symbol", {"id": f"{path}::<module>", "kind": "module", "name": path.rsplit("/", 1)[-1].removesuffix(".py"), "qualified_name": "<module>", "file": path, "line_start": 1, "line_end": max(1, len(text.splitlines())), "docstring": first(tree), "is_test": is_test}

    imports = "import" in text and not symbols_alone  # without the word there are none, anywhere
    for node in _walk([tree]) if imports else ():
        if isinstance(node, ast.Import):
            for a in node.names:
                yield "import", {"file": path, "style": "import", "level": 0, "line": node.lineno, "module": a.name, "name": a.name, "asname": a.asname}
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield "import", {"file": path, "style": "from", "level": node.level, "line": node.lineno, "module": node.module, "name": a.name, "asname": a.asname}

    def inside(nodes: list[ast.AST], caller: str, cls: str | None, local: set[str]) -> Iterator[tuple[str, dict]]:
        for n in nodes:
            if isinstance(n, ast.Name):
                if isinstance(n.ctx, ast.Load) and n.id not in local:
                    yield "load", {"caller": caller, "file": path, "name": n.id}
            elif isinstance(n, ast.Call):
                if r := _receiver(n.func):
                    yield "call", {"caller": caller, "file": path, "cls": cls, "receiver": r[0], "name": r[1], "line": n.lineno}
            elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                plain = isinstance(n, ast.Assign)
                target = n.target if not plain else n.targets[0] if len(n.targets) == 1 else None
                kind = _name(n.annotation) if not plain else _name(n.value) if isinstance(n.value, ast.Call) else None
                if isinstance(target, ast.Name) and kind:
                    yield "attr", {"owner": caller, "file": path, "attr": target.id, "type_name": kind}
                elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self" and cls:
                    source = n.value.id if plain and isinstance(n.value, ast.Name) else None
                    kind = kind or annotated.get((caller, source))
                    if kind:
                        yield "attr", {"owner": cls, "file": path, "attr": target.attr, "type_name": kind}

    annotated: dict[tuple[str, str | None], str] = {}

    def function(node, parent: str | None, prefix: str) -> Iterator[tuple[str, dict]]:
        qualified = prefix + node.name
        sid = f"{path}::{qualified}"
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]
        inner = _walk(node.body)
        returns = [n for n in inner if isinstance(n, ast.Return)]
        constants = {ast.dump(n.value) for n in returns if isinstance(n.value, ast.Constant)}
        ifs = [n for n in inner if isinstance(n, ast.If)]
        same = any(n.orelse and [ast.dump(x) for x in n.body] == [ast.dump(x) for x in n.orelse] for n in ifs)
        one = ast.unparse(returns[0].value) if len(returns) > 1 and len(constants) == 1 and all(isinstance(n.value, ast.Constant) for n in returns) and ifs else None
        head = ("async def " if isinstance(node, ast.AsyncFunctionDef) else "def ") + node.name + "(" + _plain_args(node.args) + ")" + (" -> " + _plain(node.returns) if node.returns else "")
        yield "symbol", {
            "id": sid, "kind": "method" if parent else "function", "name": node.name, "qualified_name": qualified, "file": path, "line_start": start, "line_end": node.end_lineno, "signature": head, "docstring": first(node), "parent": parent, "is_test": is_test and node.name.startswith("test_"),
            "is_async": isinstance(node, ast.AsyncFunctionDef), "decorators": [d for d in map(_name, node.decorator_list) if d], "params": [a.arg for a in args], "branches": len(ifs), "calls": sum(isinstance(n, ast.Call) for n in inner), "returns": len(returns), "constant_return": one, "same_branch": same,
        }
        if symbols_alone:
            return
        for a in args:
            if a.annotation and (t := _name(a.annotation)):
                annotated[sid, a.arg] = t
                yield "attr", {"owner": sid, "file": path, "attr": a.arg, "type_name": t}
        local = {a.arg for a in args} | {n.id for n in inner if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        yield from inside(inner, sid, parent, local)

    loose: list[ast.stmt] = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield from function(node, None, "")
        elif isinstance(node, ast.ClassDef):
            cid = f"{path}::{node.name}"
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            yield "symbol", {"id": cid, "kind": "class", "name": node.name, "qualified_name": node.name, "file": path, "line_start": start, "line_end": node.end_lineno, "signature": "class " + node.name, "docstring": first(node), "is_test": is_test, "decorators": [d for d in map(_name, node.decorator_list) if d], "bases": [b for b in map(_name, node.bases) if b]}
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield from function(m, cid, node.name + ".")
        else:
            loose.append(node)
            targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
            for t in targets:
                if isinstance(t, ast.Name):
                    yield "symbol", {"id": f"{path}::{t.id}", "kind": "constant", "name": t.id, "qualified_name": t.id, "file": path, "line_start": node.lineno, "line_end": node.end_lineno, "is_test": is_test}
    if not symbols_alone:
        yield from inside(_walk(loose), f"{path}::<module>", None, set())


#: The typed column of each kind of fact.
KINDS = {"symbol": SYMBOL, "import": IMPORT, "call": CALL, "attr": ATTR, "load": LOAD, "failure": FAILURE}


def parse(files: DataFrame, symbols_alone: bool = False) -> DataFrame:
    """(kind, file, and one struct column for each kind) of files (path, text, kind). Store it: the functions below each read one column of it. Where symbols
    alone are asked for, and read once, nothing else is looked for and it need not be stored.

    Files of one path meet in one task, next to each other, so symbols that are defined again are settled there.
    """
    arrow = {k: to_arrow_type(StructType.fromDDL(ddl)) for k, ddl in KINDS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, latest = None, {}  # symbols of a path wait for its next file: of one id, the last definition holds

        for b in batches:
            kinds, paths, own, place = [], [], {k: [] for k in arrow}, {k: [] for k in arrow}

            def add(k: str, p: str, v: dict) -> None:
                place[k].append(len(kinds))
                own[k].append(v)
                kinds.append(k)
                paths.append(p)

            for p, t, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != path:
                    for v in latest.values():
                        add("symbol", path, v)
                    path, latest = p, {}
                for k, v in facts(p, t or "", kind == "test", symbols_alone):
                    if k != "symbol":
                        add(k, p, v)
                    elif v["id"] not in latest or latest[v["id"]]["line_start"] <= v["line_start"]:
                        latest[v["id"]] = v
            yield batch(kinds, paths, own, place)
        n = len(latest)
        yield batch(["symbol"] * n, [path] * n, {k: list(latest.values()) if k == "symbol" else [] for k in arrow}, {k: list(range(n)) if k == "symbol" else [] for k in arrow})

    def batch(kinds: list[str], paths: list[str], own: dict[str, list], place: dict[str, list]) -> pa.RecordBatch:
        typed = []
        for k, t in arrow.items():  # a kind's structs, spread over all rows; null in those of other kinds
            at = np.full(len(kinds), -1, np.int64)
            at[place[k]] = np.arange(len(own[k]))
            typed.append(pa.array(own[k], t).take(pa.array(at, mask=at < 0)))
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(paths, pa.string()), *typed], ["kind", "file", *arrow])

    schema = ", ".join(["kind string, file string", *(f"`{k}` struct<{ddl.replace(' ', ':').replace(',:', ', ')}>" for k, ddl in KINDS.items())])
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("path", "text", "kind").repartition(n, "path").sortWithinPartitions("path")  # parsing is what takes the time: a small table of files is spread too
    return dealt.mapInArrow(run, schema)


def _kind(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.where(F.col(kind).isNotNull()).select(f"`{kind}`.*")


def symbols(parsed: DataFrame) -> DataFrame:
    """One row for each id, as parse() left them: the last definition of a name holds."""
    return _kind(parsed, "symbol")


def imports(parsed: DataFrame) -> DataFrame:
    return _kind(parsed, "import")


def calls(parsed: DataFrame) -> DataFrame:
    return _kind(parsed, "call")


def attribute_types(parsed: DataFrame) -> DataFrame:
    return _kind(parsed, "attr").distinct()


def failures(parsed: DataFrame) -> DataFrame:
    return _kind(parsed, "failure")


def constant_references(parsed: DataFrame, known: DataFrame, import_map: DataFrame) -> DataFrame:
    """(src, dst): functions that read a constant of their file, or an imported one, under a name that is not their own."""
    loads = _kind(parsed, "load").distinct()
    constants = known.where("kind = 'constant'")
    own = loads.join(constants.select(F.col("file").alias("_f"), F.col("name").alias("_n"), F.col("id").alias("_id")), (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_n")))
    named = import_map.join(constants.select(F.col("id").alias("target")), "target").select(F.col("file").alias("_f"), F.col("alias").alias("_n"), F.col("target").alias("_id"))
    other = loads.join(named, (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_n")))
    return own.select(F.col("caller").alias("src"), F.col("_id").alias("dst")).unionByName(other.select(F.col("caller").alias("src"), F.col("_id").alias("dst"))).distinct()


def review_targets(known: DataFrame) -> DataFrame:
    """Functions and methods that are no tests and branch, call or return."""
    return known.where("kind in ('function', 'method') and not is_test and (branches > 0 or calls > 0 or returns > 0)")


def heuristics(known: DataFrame) -> DataFrame:
    """(id, file, line_start, line_end, category): functions whose returns are all one constant in spite of a branch, and those with two equal branches."""
    kinds = F.array(F.when(F.col("constant_return").isNotNull(), "constant_return"), F.when(F.col("same_branch"), "identical_branch"))  # one pass: known may not be stored
    return known.select("id", "file", "line_start", "line_end", F.explode(F.array_compact(kinds)).alias("category"))


#: Fixed value: comments that give a test's outcome away.
TELLING = re.compile(r"#.*\bshould\s+(fail|pass)\b.*", re.IGNORECASE)


def _scopes(tree: ast.Module) -> list[ast.AST]:
    """The module, classes and functions of a tree, at any depth of statements; no expression can hold one."""
    queue, out = [tree], []
    for n in queue:
        if isinstance(n, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(n)
        for part in ("body", "orelse", "finalbody", "handlers", "cases"):
            below = getattr(n, part, None)
            if type(below) is list:  # a lambda's or a conditional expression's is none
                queue += below
    return out


def without_docs(text: str) -> tuple[str, int, int]:
    """A source with its docstrings blanked and telling comments cut, line numbers kept; how many of each. Sources that don't parse lose comments only."""
    lines, docs = text.split("\n"), 0
    try:
        nodes = _scopes(ast.parse(text)) if '"' in text or "'" in text else []  # no docstring without a quote
    except (SyntaxError, ValueError):
        nodes = []
    for n in nodes:
        d = n.body[0] if n.body else None
        if isinstance(d, ast.Expr) and isinstance(d.value, ast.Constant) and isinstance(d.value.value, str):
            docs += 1
            indent = lines[d.lineno - 1][: d.col_offset]
            alone = len(n.body) == 1 and not isinstance(n, ast.Module)
            lines[d.lineno - 1 : d.end_lineno] = [indent + "pass" if alone else "", *[""] * (d.end_lineno - d.lineno)]
    comments = 0
    for i, line in enumerate(lines):
        cut = TELLING.sub("", line) if "#" in line else line
        if cut != line:
            comments += 1
            lines[i] = cut.rstrip()
    return "\n".join(lines), docs, comments


def sanitized(files: DataFrame, text_col: str = "text") -> DataFrame:
    """files with the text sanitized, and docstrings_removed and comments_removed; a small table of files is spread over tasks too, as parsing takes the time."""

    @F.pandas_udf("text string, docs int, comments int")
    def clean(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without_docs(t or "") for t in s], columns=["text", "docs", "comments"])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = files.repartition(n).withColumn("_c", clean(F.col(text_col)))
    return out.withColumn(text_col, F.col("_c.text")).withColumn("docstrings_removed", F.col("_c.docs")).withColumn("comments_removed", F.col("_c.comments")).drop("_c")
