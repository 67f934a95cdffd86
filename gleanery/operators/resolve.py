"""Resolution of names in source code: imports to files, calls to symbols, failures to suspects. Rules are joins, tried in order; the first that fits holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.interval import enclosing


def resolve_imports(imports: DataFrame, files: DataFrame, roots: tuple[str, ...] = ("",)) -> DataFrame:
    """imports (file, module, level) with resolved_file: under each root `a/b.py`, then `a/b/__init__.py`; null if the project has neither.

    A relative import starts at the folder of its file, and goes up one folder less than its level.
    """
    path = F.translate(F.coalesce("module", F.lit("")), ".", "/")
    folder = F.split("file", "/")
    up = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.size(folder) - F.col("level"), F.lit(0))), "/")
    relative = F.when(up == "", path).otherwise(F.when(path == "", up).otherwise(F.concat_ws("/", up, path)))
    forms = lambda p: [F.concat(p, F.lit(".py")), F.when(p == "", F.lit("__init__.py")).otherwise(F.concat(p, F.lit("/__init__.py")))]
    absolute = [f for r in roots for f in forms(F.concat(F.lit(r.rstrip("/") + "/"), path) if r else path)]
    candidates = F.when(F.col("level") > 0, F.array(*forms(relative))).otherwise(F.array(*absolute))
    rows = imports.withColumn("_row", F.monotonically_increasing_id())
    tried = rows.select("*", F.posexplode(candidates).alias("_prio", "_path")).join(files.select(F.col("path").alias("_file")).hint("merge"), F.col("_path") == F.col("_file"), "left")
    first = F.min_by("_file", F.when(F.col("_file").isNotNull(), F.col("_prio"))).alias("resolved_file")
    return tried.groupBy("_row", *imports.columns).agg(first).drop("_row")


def import_map(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, alias, target, resolved_file): what each imported name means: a symbol of the imported file, or the file itself; both null if outside the project."""
    named = imports.select("file", F.coalesce("asname", "name").alias("alias"), "name", "resolved_file")
    s = symbols.select("id", F.col("file").alias("_f"), F.col("name").alias("_n")).where("id = concat(_f, '::', _n)")
    j = named.join(s, (F.col("resolved_file") == F.col("_f")) & (F.col("name") == F.col("_n")), "left")
    return j.select("file", "alias", F.col("id").alias("target"), "resolved_file")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, bases: DataFrame, attr_types: DataFrame, builtins: list[str], params: DataFrame, builtin_methods: tuple[str, ...] = ()) -> DataFrame:
    """calls with callee, rule and reason.

    calls: caller, file, cls (id of the enclosing class or null), receiver (null for a bare name; self, cls, super(), a name, a chain of names, or <expr>), name,
    line. imports: import_map's. bases: (cls, base, ordinal). attr_types: (owner, attr, cls): types of attributes by class, of locals by caller. params:
    (caller, name).

    What a call is looked up in goes by its receiver, and the first rule that fits holds. A bare name: builtin, parameter, import, same file. super(): the bases'
    nearest method. self, cls: own class, then inherited. A chain: the type of the attribute of self or of a typed local, then a module of that dotted
    name. A name: typed local, imported module, the first class of the file that has the method, builtin method. What is left has a reason: parameter_call,
    not_found, external_module, super_unresolved, method_on_unknown_receiver, attribute_type_unknown, dynamic_call.
    """
    from gleanery.operators.graph import inherited

    members = symbols.where("parent is not null").select(F.col("parent").alias("cls"), "name", F.col("id").alias("member"))
    every = inherited(bases, members)
    from_base = every.select(F.col("cls").alias("_b"), F.col("name").alias("_bn"), F.col("member").alias("_bm"))
    above = bases.join(from_base, F.col("base") == F.col("_b")).groupBy("cls", "_bn").agg(F.min_by("_bm", F.struct("ordinal", "_bm")).alias("_bm"))
    top = symbols.where("parent is null and kind <> 'module'").select(F.col("file").alias("_tf"), F.col("name").alias("_tn"), F.col("id").alias("_top"))
    chain = F.split("receiver", "[.]")
    form = F.when(F.col("receiver").isNull(), "bare").when(F.col("receiver") == "super()", "super").when(F.col("receiver").isin("self", "cls"), "self")
    form = form.when(F.col("receiver") == "<expr>", "expr").when(F.size(chain) > 1, "chain").otherwise("name")
    of = lambda *forms: calls.withColumn("_form", form).where(F.col("_form").isin(*forms))
    named = imports.select(F.col("file").alias("_if"), F.col("alias").alias("_ia"), F.col("target").alias("_imported"), F.col("resolved_file").alias("_module")).dropDuplicates(["_if", "_ia"])
    imported = lambda c: c.join(named, (F.col("file") == F.col("_if")) & (F.coalesce("receiver", "name") == F.col("_ia")), "left")

    # each form meets only what it is looked up in, so a call is dealt as often as its own form needs
    plain = imported(of("bare")).join(top, (F.col("file") == F.col("_tf")) & (F.col("name") == F.col("_tn")), "left")
    plain = plain.join(params.select(F.col("caller").alias("_pc"), F.col("name").alias("_pn")).distinct(), (F.col("caller") == F.col("_pc")) & (F.col("name") == F.col("_pn")), "left")
    own = every.select(F.col("cls").alias("_oc"), F.col("name").alias("_on"), F.col("member").alias("_own"))
    selfs = of("self").join(own, (F.col("cls") == F.col("_oc")) & (F.col("name") == F.col("_on")), "left")
    up = above.select(F.col("cls").alias("_uc"), F.col("_bn").alias("_un"), F.col("_bm").alias("_above"))
    supers = of("super").join(up, (F.col("cls") == F.col("_uc")) & (F.col("name") == F.col("_un")), "left")

    types = attr_types.select("owner", "attr", "cls").dropDuplicates(["owner", "attr"])
    two = (F.col("_form") == "chain") & (F.size(chain) == 2)
    c = of("name", "chain").withColumn("_head", F.when(F.col("_form") == "name", F.col("receiver")).when(two, F.get(chain, F.lit(0)))).withColumn("_tail", F.when(two, F.get(chain, F.lit(1))))
    local = types.select(F.col("owner").alias("_lo"), F.col("attr").alias("_la"), F.col("cls").alias("_lc"))
    c = c.join(local, (F.col("caller") == F.col("_lo")) & (F.col("_head") == F.col("_la")), "left")
    c = c.withColumn("_of", F.when(F.col("_tail").isNull(), None).when(F.col("_head") == "self", F.col("cls")).otherwise(F.col("_lc")))
    attr = types.select(F.col("owner").alias("_ao"), F.col("attr").alias("_aa"), F.col("cls").alias("_ac"))
    chains = c.where("_form = 'chain'").join(attr, (F.col("_of") == F.col("_ao")) & (F.col("_tail") == F.col("_aa")), "left").withColumn("_type", F.when(F.col("_tail").isNotNull(), F.col("_ac")).otherwise(F.col("_lc")))
    c = chains.unionByName(c.where("_form = 'name'").withColumn("_type", F.col("_lc")), allowMissingColumns=True).drop("_of", "_lo", "_la", "_lc", "_ao", "_aa", "_ac", "_head", "_tail")
    typed = every.select(F.col("cls").alias("_mc"), F.col("name").alias("_mn"), F.col("member").alias("_typed"))
    c = imported(c.join(typed, (F.col("_type") == F.col("_mc")) & (F.col("name") == F.col("_mn")), "left"))
    in_module = symbols.where("parent is null").select(F.col("file").alias("_qf"), F.col("name").alias("_qn"), F.col("id").alias("_in_module")).dropDuplicates(["_qf", "_qn"])
    c = c.join(in_module, (F.col("_module") == F.col("_qf")) & (F.col("name") == F.col("_qn")), "left")
    names = c.where("_form = 'name'")
    of_class = every.select(F.col("cls").alias("_cc"), F.col("name").alias("_cn"), F.col("member").alias("_of_class"))
    names = names.join(of_class, (F.col("_imported") == F.col("_cc")) & (F.col("name") == F.col("_cn")), "left")
    same = symbols.where("parent is not null").groupBy(F.col("file").alias("_sf"), F.col("name").alias("_sn")).agg(F.min_by("id", F.struct("line_start", "id")).alias("_any"))
    names = names.join(same, (F.col("file") == F.col("_sf")) & (F.col("name") == F.col("_sn")), "left")

    looked_up = ("_pc", "_ia", "_imported", "_module", "_top", "_above", "_own", "_typed", "_in_module", "_of_class", "_any")
    parts = [p.select(*calls.columns, "_form", *[F.col(x) if x in p.columns else F.lit(None).cast("string").alias(x) for x in looked_up]) for p in (plain, selfs, supers, of("expr"), c.where("_form = 'chain'"), names)]
    c = reduce(DataFrame.unionByName, parts)
    bare, named_form = F.col("_form") == "bare", F.col("_form") == "name"
    builtin, param, known = bare & F.col("name").isin(builtins), F.col("_pc").isNotNull(), F.col("_ia").isNotNull()
    method = named_form & ~known & F.col("name").isin(*builtin_methods) if builtin_methods else F.lit(False)
    in_project = F.coalesce("_in_module", "_of_class")
    steps = (
        ("builtin", builtin, None),
        ("parameter", param, None),
        ("import", bare & F.col("_imported").isNotNull(), F.col("_imported")),
        ("same file", bare & ~known & F.col("_top").isNotNull(), F.col("_top")),
        ("super", F.col("_above").isNotNull(), F.col("_above")),
        ("class", F.col("_own").isNotNull(), F.col("_own")),
        ("typed", F.col("_typed").isNotNull(), F.col("_typed")),
        ("module", in_project.isNotNull(), in_project),
        ("any class", ~known & F.col("_any").isNotNull(), F.col("_any")),
        ("builtin method", method, None),
    )
    rule = callee = None
    for name, test, value in steps:
        test = F.coalesce(test, F.lit(False))
        value = F.lit(None).cast("string") if value is None else value
        rule, callee = (F.when(test, name), F.when(test, value)) if rule is None else (rule.when(test, name), callee.when(test, value))
    left = (
        F.when(param, "parameter_call")
        .when(bare, F.when(known & F.col("_module").isNull(), "external_module").otherwise("not_found"))
        .when(F.col("_form") == "super", "super_unresolved")
        .when(F.col("_form") == "chain", "attribute_type_unknown")
        .when(F.col("_form") == "expr", "dynamic_call")
        .when(named_form & known, "external_module")
        .otherwise("method_on_unknown_receiver")
    )
    settled = callee.isNotNull() | builtin | F.coalesce(method, F.lit(False))
    return c.select(*calls.columns, callee.alias("callee"), rule.alias("rule"), F.when(~settled, left).alias("reason"))


def resolve_bases(bases: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(cls, name, base, ordinal): a base or decorator by name: the file's own, then imported, then the only symbol of that name; null if none."""
    own = symbols.where("parent is null").select(F.col("file").alias("_f"), F.col("name").alias("_n"), F.col("id").alias("_own")).dropDuplicates(["_f", "_n"])
    by = symbols.groupBy(F.col("name").alias("_g")).agg(F.count("*").alias("_c"), F.min("id").alias("_only"))
    named = imports.select(F.col("file").alias("_if"), F.col("alias").alias("_ia"), F.col("target").alias("_imported")).dropDuplicates(["_if", "_ia"])
    j = bases.join(own, (F.col("file") == F.col("_f")) & (F.col("name") == F.col("_n")), "left")
    j = j.join(named, (F.col("file") == F.col("_if")) & (F.col("name") == F.col("_ia")), "left").join(by, F.col("name") == F.col("_g"), "left")
    return j.select("cls", "name", F.coalesce("_own", "_imported", F.when(F.col("_c") == 1, F.col("_only"))).alias("base"), "ordinal")


def children(symbols: DataFrame) -> DataFrame:
    """(id, children) of classes, sorted."""
    return symbols.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sort_array(F.collect_set("id")).alias("children"))


def resolve_seeds(reports: DataFrame, symbols: DataFrame) -> DataFrame:
    """reports (bug_id, file, symbol, line) with seed: the named symbol, else the innermost at the line."""
    s = symbols.select(F.col("id").alias("_sid"))
    exact = reports.join(s, F.concat_ws("::", "file", "symbol") == F.col("_sid"), "left")
    spans = symbols.where("kind <> 'module'").select("file", "line_start", "line_end", "id")
    at = enclosing(reports.select("bug_id", "file", "line"), spans, "file", "line", "line_start", "line_end", "id", ["bug_id"]).withColumnRenamed("id", "_at")
    return exact.join(at, "bug_id", "left").select(*reports.columns, F.coalesce("_sid", "_at").alias("seed"))


def evidence_seeds(frames: DataFrame, failing: DataFrame, symbols: DataFrame) -> DataFrame:
    """(group_id, id, score 1.0): failing tests, and the symbols of frames (group_id, frame_no, file, line) that are no tests."""
    spans = symbols.where("kind <> 'module'").select("file", "line_start", "line_end", "id")
    at = enclosing(frames, spans, "file", "line", "line_start", "line_end", "id", ["group_id", "frame_no"]).where("id is not null")
    plain = at.join(symbols.where("is_test").select("id"), "id", "left_anti").select("group_id", "id")
    return plain.unionByName(failing.select("group_id", "id")).distinct().withColumn("score", F.lit(1.0))


def suspects(frames: DataFrame, called: DataFrame, symbols: DataFrame) -> DataFrame:
    """(bug_id, suspect): the deepest frame's symbol that is no test, else the first resolved call (bug_id, ordinal, symbol_id)."""
    spans = symbols.where("kind <> 'module'").select("file", "line_start", "line_end", "id")
    at = enclosing(frames, spans, "file", "line", "line_start", "line_end", "id", ["bug_id", "frame_no"]).where("id is not null")
    deep = at.join(symbols.where("is_test").select("id"), "id", "left_anti").groupBy("bug_id").agg(F.max_by("id", "frame_no").alias("_deep"))
    first = called.where("symbol_id is not null").groupBy("bug_id").agg(F.min_by("symbol_id", "ordinal").alias("_first"))
    return deep.join(first, "bug_id", "full").select("bug_id", F.coalesce("_deep", "_first").alias("suspect"))


def called_before(calls: DataFrame, asserts: DataFrame) -> DataFrame:
    """Calls of each test up to its failing assertion, each name once, in order: calls (test, name, line), asserts (test, assert_line)."""
    w = Window.partitionBy("test", "name").orderBy("line")
    upto = calls.join(asserts, "test").where(F.col("line") <= F.col("assert_line"))
    once = upto.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return once.select("test", "name", "line", F.row_number().over(Window.partitionBy("test").orderBy("line", "name")).cast("long").alias("ordinal"))


def code_context(points: DataFrame, files: DataFrame, symbols: DataFrame, k: int = 5) -> DataFrame:
    """points (point_id, file, line) with the outermost function round the line: its id, its lines (code), and the k lines before and behind it.

    Null where no function has the line or the file is unknown; of functions of the same span the smallest id.
    """
    f = symbols.where("kind IN ('function', 'method')").select(F.col("file").alias("_f"), F.col("id").alias("_id"), F.col("line_start").alias("_s"), F.col("line_end").alias("_e"))
    hit = points.join(f.hint("merge"), (F.col("file") == F.col("_f")) & F.col("line").between(F.col("_s"), F.col("_e")))
    outer = hit.groupBy("point_id").agg(F.min_by(F.struct("_id", "_s", "_e"), F.struct(F.col("_s") - F.col("_e"), "_id")).alias("_o")).select("point_id", "_o.*")
    text = files.select(F.col("path").alias("_path"), F.split(F.regexp_replace("text", "\n$", ""), "\n").alias("_lines")).hint("merge")  # sources grow with the input, whatever size Spark guesses
    j = points.join(outer.hint("merge"), "point_id", "left").join(text, F.col("file") == F.col("_path"), "left")
    some = lambda a, b: F.array_join(F.slice("_lines", F.greatest(a, F.lit(1)), F.greatest(b - F.greatest(a, F.lit(1)) + 1, F.lit(0))), "\n")
    part = lambda a, b: F.when(F.col("_id").isNotNull(), some(a, b))
    s, e = F.col("_s"), F.col("_e")
    return j.select(*points.columns, F.col("_id").alias("function_id"), part(s, e).alias("code"), part(s - k, s - 1).alias("before"), part(e + 1, e + k).alias("behind"))
