"""Resolving symbolic references to nodes: indexes, the nine steps, their chain, and what it reports.

A step is a function from references to (ref_id, status, target), ``hit`` or ``stop``; the chain takes each reference's first by
priority.  Steps list candidate ids in order, and one equi join with the node ids finds the first that exists, so a step costs one
shuffle of references whatever the number of its rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import languages as L
from weftgraph.functions import signatures as S
from weftgraph.functions.paths import base_name, dir_name, language_of
from weftgraph.operators.graph import cut, first_by

SELF = ("cls", "self", "this")


@dataclass(frozen=True)
class Index:
    """nodes: id, label, type, source_file, signature, seq; bindings: node_id, var, bound; imported: file, local, target_file, original; wildcards: file, ord, target_file."""

    nodes: DataFrame
    bindings: DataFrame
    imported: DataFrame
    wildcards: DataFrame


def symbol_index(nodes: DataFrame) -> DataFrame:
    """(label, n, first_id, class_like, files): what each label may mean."""
    symbols = nodes.where("type <> 'file'")
    return symbols.groupBy("label").agg(F.count("*").alias("n"), F.min_by("id", "seq").alias("first_id"), F.count_if(F.col("type").isin(*L.CLASS_LIKE)).alias("class_like"), F.count_distinct("source_file").alias("files"))


def global_symbols(nodes: DataFrame, class_like: bool = False) -> DataFrame:
    """(label, ids): ids of a label in order of appearance."""
    symbols = nodes.where(F.col("type").isin(*L.CLASS_LIKE) if class_like else F.col("type") != "file")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"])
    return symbols.groupBy("label").agg(F.array_join(ids, ",").alias("ids"))


def declared_symbols(nodes: DataFrame) -> DataFrame:
    """(file, label, id): the last declaration of a label in a file."""
    return nodes.where("type <> 'file'").groupBy(F.col("source_file").alias("file"), "label").agg(F.max_by("id", "seq").alias("id"))


def methods_by_class(nodes: DataFrame) -> DataFrame:
    """(parent, label, id) of the members of each symbol."""
    own = nodes.where("id LIKE '%::%.%'").withColumn("parent", F.regexp_extract("id", r"^(.*)\.[^.]*$", 1))
    return own.groupBy("parent", "label").agg(F.max_by("id", "seq").alias("id"))


def dir_symbols(nodes: DataFrame) -> DataFrame:
    """(dir, label, first_id, n) of the symbols in each directory."""
    return nodes.where("type <> 'file'").groupBy(dir_name(F.col("source_file")).alias("dir"), "label").agg(F.min_by("id", "seq").alias("first_id"), F.count("*").alias("n"))


def return_types(nodes: DataFrame) -> DataFrame:
    t = S.return_type(F.col("signature"), language_of(F.col("source_file")))
    return nodes.where("type IN ('function', 'method')").select("id", t.alias("type")).where("type IS NOT NULL")


def folded(path: Column) -> Column:
    """A relative path without ``.`` and ``..``; what leads out of the workspace keeps its leading ``..`` and so names no file."""
    last = lambda a: F.try_element_at(a, F.lit(-1))
    step = lambda a, x: F.when((x == "") | (x == "."), a).when((x == "..") & (F.size(a) > 0) & (last(a) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() AS array<string>)"), step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, target_file) for imports (ref_id, source_file, target): the first candidate path that is a file, or ends one.

    Every file path is exploded into its own endings, so that the search by ending is an equi join.
    """
    lang = F.coalesce(language_of(F.col("source_file")), F.lit("python"))
    path = S.is_path_target(F.col("target"), lang)
    here = folded(F.concat_ws("/", S.null_if_empty(dir_name(F.col("source_file"))), F.col("target")))
    sufs = F.try_element_at(F.create_map(*[x for k, v in S.SUFFIXES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), lang)
    whole = F.concat(F.array(here), F.transform(sufs, lambda s: F.concat(here, s)))
    rows = imports.withColumn("_path", path).withColumn("_c", F.when(path, F.concat(whole, F.array(base_name(F.col("target"))))).otherwise(S.import_candidates(F.col("target"), lang)))
    rows = rows.select("ref_id", "_path", F.size("_c").alias("_n"), F.posexplode("_c").alias("pos", "cand"))
    segs = F.split("file", "/")
    ends = files.select("file", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_join(F.slice(segs, i, F.size(segs)), "/"))).alias("end"))
    hits = rows.join(ends, F.col("cand") == F.col("end")).withColumn("exact", F.col("file") == F.col("end"))
    hits = hits.where(~F.col("_path") | F.col("exact") | (F.col("pos") == F.col("_n") - 1))
    return first_by(hits, ["ref_id"], "pos", F.desc("exact"), "seq").select("ref_id", F.col("file").alias("target_file"))


def import_scope(imports: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``imported`` and ``wildcards`` of resolved imports (ref_id, source_file, target, import_map)."""
    rows = imports.join(resolved, "ref_id").withColumn("lang", language_of(F.col("source_file")))
    named = rows.select("ref_id", F.col("source_file").alias("file"), "target_file", F.explode("import_map").alias("local", "original"))
    stem = F.regexp_replace(base_name(F.col("target_file")), r"\.[^.]*$", "")
    empty = rows.where(F.size("import_map") == 0).select("ref_id", F.col("source_file").alias("file"), stem.alias("local"), "target_file", stem.alias("original"))
    plain = named.where("original <> '*'").select("ref_id", "file", "local", "target_file", "original").unionByName(empty)
    last = plain.groupBy("file", "local").agg(F.max_by(F.struct("target_file", "original"), "ref_id").alias("x")).select("file", "local", "x.target_file", "x.original")
    stars = named.where("original = '*'").select("ref_id", "file", "target_file").unionByName(rows.where("lang IN ('c', 'cpp')").select("ref_id", F.col("source_file").alias("file"), "target_file"))
    return last, stars.groupBy("file", "target_file").agg(F.min("ref_id").alias("ord")).select("file", "ord", "target_file")


def wide(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with all that the steps look at: file, dir, lang, parts, main, rest, last, parent."""
    at = nodes.select(F.col("id").alias("caller"), F.col("source_file").alias("file"))
    r = refs.join(at, "caller").withColumns({"parts": S.callee_parts(F.col("callee")), "lang": F.coalesce(language_of(F.col("file")), F.lit("python")), "dir": dir_name(F.col("file"))})
    dotted = F.replace("callee", F.lit("::"), F.lit("."))
    rest = F.when(F.size("parts") > 1, F.substring(dotted, F.instr(dotted, ".") + 1, F.length(dotted))).otherwise("")
    return r.withColumns({"main": F.get("parts", 0), "rest": rest, "last": F.try_element_at("parts", F.lit(-1)), "parent": F.when(F.contains("caller", F.lit(".")), F.regexp_extract("caller", r"^(.*)\.[^.]*$", 1))}).where("main IS NOT NULL")


def _first_existing(rows: DataFrame, candidates: Column, nodes: DataFrame) -> DataFrame:
    """(ref_id, hit, target): the first candidate id that is a node."""
    c = rows.select("ref_id", F.posexplode(candidates).alias("pos", "cand")).where("cand IS NOT NULL")
    found = c.join(nodes.select(F.col("id").alias("cand")), "cand")
    return found.groupBy("ref_id").agg(F.min_by("cand", "pos").alias("target")).select("ref_id", F.lit("hit").alias("status"), "target")


def _with_rest(base: Column) -> list[Column]:
    return [F.when(F.col("rest") != "", F.concat(base, F.lit("."), "rest")), base]


def step_builtin(r: DataFrame, ix: Index) -> DataFrame:
    return r.where(L.is_builtin(F.col("lang"), F.col("main"))).select("ref_id", F.lit("stop").alias("status"), F.lit(None).cast("string").alias("target"))


def lookup_class(rows: DataFrame, ix: Index) -> DataFrame:
    """(ref_id, class_id) for rows (ref_id, file, dir, lang, name): by id, in the file, by import, by label."""
    spell = F.array_distinct(F.array("name", S.normalize_type(F.col("name")), F.element_at(F.split(S.normalize_type(F.col("name")), r"::|\."), -1)))
    s = rows.select("ref_id", "file", "dir", "lang", F.posexplode(spell).alias("k", "sp"))
    ids = s.select("ref_id", F.posexplode(F.array("sp", F.concat("file", F.lit("::"), "sp"))).alias("j", "cand"), "k").select("ref_id", (F.col("k") * 2 + F.col("j")).alias("pos"), "cand")
    imp = s.join(ix.imported.toDF("file", "sp", "tf", "orig"), ["file", "sp"]).select("ref_id", (F.col("k") + 100).alias("pos"), F.concat("tf", F.lit("::"), "orig").alias("cand"))
    direct = ids.unionByName(imp).join(ix.nodes.select(F.col("id").alias("cand")), "cand").select("ref_id", "pos", "cand", F.lit(None).alias("seq"))
    classes = ix.nodes.where(F.col("type").isin(*L.CLASS_LIKE)).select(F.col("label").alias("sp"), F.col("id").alias("cand"), "seq", dir_name(F.col("source_file")).alias("cd"))
    near = F.col("lang").isin(*L.SIBLINGS) & (F.col("cd") == F.col("dir"))
    label = s.join(classes, "sp").select("ref_id", F.when(near, F.col("k") * 2 + 200).otherwise(F.col("k") * 2 + 201).alias("pos"), "cand", "seq")
    return first_by(direct.unionByName(label), ["ref_id"], "pos", "seq", "cand").select("ref_id", F.col("cand").alias("class_id"))


def find_method(rows: DataFrame, ix: Index) -> DataFrame:
    """(ref_id, method_id) for rows (ref_id, class_id, method): the class's member, else one of an equally named class."""
    own = rows.select("ref_id", F.concat("class_id", F.lit("."), "method").alias("id")).join(ix.nodes.select("id"), "id").select("ref_id", F.lit(0).alias("pos"), F.lit(None).alias("seq"), "id")
    members = ix.nodes.where("type IN ('function', 'method') AND id LIKE '%::%.%'").select(F.col("label").alias("method"), "id", "seq", F.regexp_extract("id", r"(?:::|\.)([^.:]+)\.[^.]*$", 1).alias("cls"))
    name = F.element_at(F.split("class_id", r"::|\."), -1)
    other = rows.withColumn("cls", name).join(members, ["method", "cls"]).select("ref_id", F.lit(1).alias("pos"), "seq", "id")
    return first_by(own.unionByName(other), ["ref_id"], "pos", "seq", "id").select("ref_id", F.col("id").alias("method_id"))


def transfer_type(rows: DataFrame, ix: Index) -> DataFrame:
    """(ref_id, class_id): the class that a method (ref_id, file, dir, lang, method_id) returns."""
    t = rows.join(return_types(ix.nodes).toDF("method_id", "name"), "method_id").select("ref_id", "file", "dir", "lang", "name")
    return lookup_class(t, ix)


def step_local_binding(r: DataFrame, ix: Index) -> DataFrame:
    """A typed variable's method, segment by segment; a miss stops the chain."""
    typed = r.where(F.size("parts") >= 2).join(ix.bindings.toDF("caller", "main", "name"), ["caller", "main"])
    state = typed.select("ref_id", "file", "dir", "lang", "parts", "name")
    state = cut(state.join(lookup_class(state, ix), "ref_id"))
    deepest = r.agg(F.max(F.size("parts"))).first()[0] or 0
    hits = None
    for k in range(1, deepest):
        seg = state.where(F.size("parts") > k).withColumn("method", S.strip_call(F.col("parts")[k]))
        found = seg.join(find_method(seg.select("ref_id", "class_id", "method"), ix), "ref_id")
        done = found.where(F.size("parts") == k + 1).select("ref_id", F.col("method_id").alias("target"))
        hits = done if hits is None else hits.unionByName(done)
        going = found.where(F.size("parts") > k + 1).select("ref_id", "file", "dir", "lang", "parts", "method_id")
        state = cut(going.join(transfer_type(going, ix), "ref_id").drop("method_id"))
    out = typed.select("ref_id")
    if hits is None:
        return out.select("ref_id", F.lit("stop").alias("status"), F.lit(None).cast("string").alias("target"))
    return out.join(hits, "ref_id", "left").select("ref_id", F.when(F.col("target").isNull(), "stop").otherwise("hit").alias("status"), "target")


def step_self(r: DataFrame, ix: Index) -> DataFrame:
    own = r.where(F.col("main").isin(*SELF) & F.col("parent").isNotNull() & (F.size("parts") > 1))
    return _first_existing(own, F.array(F.concat("parent", F.lit("."), "rest"), F.concat("parent", F.lit("."), "last")), ix.nodes)


def _base_then_rest(rows: DataFrame, base: Column, ix: Index) -> DataFrame:
    """Hit only where the base exists; its member by ``rest`` is preferred."""
    there = rows.withColumn("_b", base).join(ix.nodes.select(F.col("id").alias("_b")), "_b", "left_semi")
    return _first_existing(there, F.array(*_with_rest(F.col("_b"))), ix.nodes)


def step_class(r: DataFrame, ix: Index) -> DataFrame:
    return _base_then_rest(r.where("parent IS NOT NULL"), F.concat("parent", F.lit("."), "main"), ix)


def step_file(r: DataFrame, ix: Index) -> DataFrame:
    return _base_then_rest(r, F.concat("file", F.lit("::"), "main"), ix)


def step_package(r: DataFrame, ix: Index) -> DataFrame:
    own = ix.nodes.where("type <> 'file'").select(dir_name(F.col("source_file")).alias("dir"), F.regexp_extract("id", "::(.*)$", 1).alias("main"), F.col("id").alias("_s"), "seq")
    near = r.where(F.col("lang").isin(*L.SIBLINGS)).join(own, ["dir", "main"])
    near = first_by(near, ["ref_id"], "seq")
    return _first_existing(near, F.array(*_with_rest(F.col("_s"))), ix.nodes)


def step_import(r: DataFrame, ix: Index) -> DataFrame:
    """By explicit import.  An imported symbol stands in for a member that it lacks; if it does not exist itself the chain stops; a module's missing member goes on."""
    i = r.join(ix.imported.toDF("file", "main", "tf", "orig"), ["file", "main"])
    stem = F.regexp_replace(base_name(F.col("tf")), r"\.[^.]*$", "")
    i = cut(i.withColumn("module", (F.col("orig") == "*") | (F.col("orig") == stem)))
    mod = i.where("module")
    last = ix.nodes.select(F.col("source_file").alias("tf"), F.regexp_extract("id", r"\.([^.:]+)$", 1).alias("last"), F.col("id").alias("_s"), "seq").where("last <> ''")
    within = first_by(mod.where("rest <> ''").join(last, ["tf", "last"]), ["ref_id"], "seq").select("ref_id", "_s")
    mod = mod.join(within, "ref_id", "left")
    cand = F.when(F.col("rest") != "", F.array(F.concat("tf", F.lit("::"), "rest"), F.col("_s"))).otherwise(F.array(F.concat("tf", F.lit("::"), "main"), F.col("tf")))
    hits = _first_existing(mod, cand, ix.nodes)
    sym = i.where("NOT module").withColumn("_b", F.concat("tf", F.lit("::"), "orig")).withColumn("_t", F.when(F.col("rest") != "", F.concat("_b", F.lit("."), "rest")))
    ids = lambda c: ix.nodes.select(F.col("id").alias(c), F.lit(True).alias(c + "_ok"))
    there = sym.join(ids("_b"), "_b", "left").join(ids("_t"), "_t", "left")
    target = F.when(F.col("_b_ok"), F.when(F.col("_t_ok"), F.col("_t")).otherwise(F.col("_b")))
    return hits.unionByName(there.select("ref_id", F.when(F.col("_b_ok"), "hit").otherwise("stop").alias("status"), target.alias("target")))


def step_wildcard(r: DataFrame, ix: Index) -> DataFrame:
    w = r.join(ix.wildcards.toDF("file", "ord", "tf"), "file").withColumn("_b", F.concat("tf", F.lit("::"), "main"))
    there = first_by(w.join(ix.nodes.select(F.col("id").alias("_b")), "_b", "left_semi"), ["ref_id"], "ord")
    return _first_existing(there, F.array(*_with_rest(F.col("_b"))), ix.nodes)


def step_global(r: DataFrame, ix: Index) -> DataFrame:
    """A label that is unique everywhere, or else in the caller's directory."""
    known = r.join(ix.imported.select("file", F.col("local").alias("main")), ["file", "main"], "left_anti")
    free = known.where(~L.is_builtin(F.col("lang"), F.col("main")) & ~L.is_stdlib(F.col("lang"), F.col("main")))
    free = free.where((F.size("parts") == 1) | ~F.col("last").isin(*L.COMMON_METHODS)).withColumn("label", F.when(F.size("parts") > 1, F.col("last")).otherwise(F.col("main")))
    # Counts per label and per directory answer uniqueness; the ids of a frequent label are never listed.
    anywhere = ix.nodes.where("type <> 'file'").groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    near = ix.nodes.where("type <> 'file'").groupBy("label", dir_name(F.col("source_file")).alias("dir")).agg(F.count("*").alias("m"), F.min("id").alias("mine"))
    both = free.join(anywhere, "label").join(near, ["label", "dir"], "left")
    return both.where("n = 1 OR m = 1").select("ref_id", F.lit("hit").alias("status"), F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("mine")).alias("target"))


CHAIN = (step_builtin, step_local_binding, step_self, step_class, step_file, step_package, step_import, step_wildcard, step_global)


def resolve(refs: DataFrame, ix: Index, chain=CHAIN, by_language: dict[str, tuple] | None = None) -> DataFrame:
    """(ref_id, step, status, target) of each reference (ref_id, caller, callee); ``miss`` where no step decides.

    ``by_language`` gives references of a language a chain of their own.
    """
    r, own = cut(wide(refs, ix.nodes)), by_language or {}
    out = None
    for lang, steps in [(None, chain), *own.items()]:
        rows = r.where(F.col("lang") == lang) if lang else r.where(~F.col("lang").isin(*own)) if own else r
        for k, step in enumerate(steps, 1):
            got = step(rows, ix).select("ref_id", F.lit(k).alias("step"), "status", "target")
            out = got if out is None else out.unionByName(got)
    best = out.groupBy("ref_id").agg(F.min_by(F.struct("step", "status", "target"), "step").alias("x"))
    return refs.select("ref_id").join(best, "ref_id", "left").select("ref_id", F.coalesce("x.step", F.lit(0)).alias("step"), F.coalesce("x.status", F.lit("miss")).alias("status"), "x.target")


def evaluate(todo: DataFrame, state: DataFrame, ix: Index, chain=CHAIN, transfer=None) -> DataFrame:
    """(node_id, var, value): what the variables of ``todo`` (node_id, var, bound) stand for; no row where nothing is found.

    A name bound in the same node passes its value on once that is a node; other names are a class by id or by unique label, or what the
    chain resolves them to: a class is itself, a function its return type, looked up in its own file, then by the chain from
    there, then left as a name.  ``transfer(type, id)`` may give another type first, as a column.
    """
    ids = ix.nodes.select("id")
    other = state.select("node_id", F.col("var").alias("bound"), F.col("bound").alias("value"))
    alias = todo.join(other, ["node_id", "bound"]).select("node_id", "var", "bound", "value")
    passed = alias.join(ids, alias.value == ids.id, "left_semi").select("node_id", "var", "value")
    probe = F.trim(F.split_part(F.regexp_replace(F.trim("bound"), r"\(\)$", ""), F.lit("["), F.lit(1)))
    rest = cut(todo.join(alias.select("node_id", "var"), ["node_id", "var"], "left_anti").withColumn("probe", probe))
    if rest.isEmpty():
        return passed
    direct = rest.join(ids, rest.probe == ids.id, "left_semi").select("node_id", "var", F.col("probe").alias("value"), F.lit(0).alias("rank"))
    classes = ix.nodes.where(F.col("type").isin(*L.CLASS_LIKE)).groupBy(F.col("label").alias("probe")).agg(F.count("*").alias("n"), F.min("id").alias("value")).where("n = 1")
    direct = cut(direct.unionByName(rest.join(classes, "probe").select("node_id", "var", "value", F.lit(1).alias("rank"))))
    asked = rest.join(direct.select("node_id", "var"), ["node_id", "var"], "left_anti")
    name = F.concat_ws("\u0000", "node_id", "var")
    asked = cut(asked.select("node_id", "var", F.posexplode(F.array_distinct(F.array("bound", "probe"))).alias("k", "callee")).withColumn("ref_id", F.concat(name, F.lit("\u0000"), F.col("k").cast("string"))))
    found = direct
    if not asked.isEmpty():
        hits = resolve(asked.select("ref_id", F.col("node_id").alias("caller"), "callee"), ix, chain).where("status = 'hit'")
        kinds = ix.nodes.select(F.col("id").alias("target"), "type", "source_file")
        hits = asked.join(hits, "ref_id").join(kinds, "target")
        hits = cut(first_by(hits, ["node_id", "var"], "k").select("node_id", "var", "target", "type", "source_file"))
        own = hits.where(F.col("type").isin(*L.CLASS_LIKE)).select("node_id", "var", F.col("target").alias("value"), F.lit(2).alias("rank"))
        made = hits.where("type IN ('function', 'method')").join(return_types(ix.nodes).toDF("target", "made"), "target", "left")
        if transfer is not None:
            made = hits.where(~F.col("type").isin(*L.CLASS_LIKE)).join(return_types(ix.nodes).toDF("target", "made"), "target", "left")
            made = made.withColumn("made", F.coalesce(transfer(F.col("type"), F.col("target")), F.when(F.col("type").isin("function", "method"), F.col("made"))))
        made = cut(made.where("made IS NOT NULL").withColumn("ref_id", name))
        short = F.split_part(F.element_at(F.split("made", r"\."), -1), F.lit("["), F.lit(1))
        spelt = made.select("ref_id", "source_file", F.posexplode(F.array("made", short)).alias("k", "label"))
        at_home = spelt.join(declared_symbols(ix.nodes).select(F.col("file").alias("source_file"), "label", "id"), ["source_file", "label"])
        at_home = cut(first_by(at_home, ["ref_id"], "k").select("ref_id", F.col("id").alias("home")))
        typed = made.join(at_home, "ref_id", "left").withColumn("found", F.col("home"))
        away = cut(made.join(at_home, "ref_id", "left_anti"))
        if not away.isEmpty():
            far = resolve(away.select("ref_id", F.col("target").alias("caller"), F.col("made").alias("callee")), ix, chain).where("status = 'hit'")
            typed = typed.join(far.select("ref_id", F.col("target").alias("far")), "ref_id", "left").withColumn("found", F.coalesce("home", "far"))
        typed = typed.select("node_id", "var", F.coalesce("found", "made").alias("value"), F.lit(3).alias("rank"))
        found = found.unionByName(own).unionByName(typed)
    return passed.unionByName(first_by(found, ["node_id", "var"], "rank").select("node_id", "var", "value"))


def propagate_types(ix: Index, rounds: int = 10, chain=CHAIN, transfer=None) -> DataFrame:
    """(node_id, var, bound): bindings with what they stand for, to a fixpoint or for ``rounds`` evaluations of a variable.

    The first round evaluates every binding that is no node id; later ones those whose first name is a variable that changed.
    """
    state = cut(ix.bindings.select("node_id", "var", "bound"))
    ids = ix.nodes.select("id")
    main = F.get(S.callee_parts(F.col("bound")), 0)
    depends = cut(state.select("node_id", F.col("var").alias("user"), main.alias("var")).where("user <> var").join(state.select("node_id", "var"), ["node_id", "var"], "left_semi"))
    todo = cut(state.join(ids, state.bound == ids.id, "left_anti"))
    for _ in range(rounds):
        if todo.isEmpty():
            break
        got = evaluate(todo, state, Index(ix.nodes, state, ix.imported, ix.wildcards), chain, transfer)
        new = cut(todo.join(got, ["node_id", "var"]).where("value IS NOT NULL AND value <> bound").select("node_id", "var", "value"))
        if new.isEmpty():
            break
        state = cut(state.join(new, ["node_id", "var"], "left").select("node_id", "var", F.coalesce("value", "bound").alias("bound")))
        again = depends.join(new.select("node_id", "var"), ["node_id", "var"], "left_semi").select("node_id", F.col("user").alias("var")).distinct()
        todo = state.join(again, ["node_id", "var"], "left_semi")
        todo = cut(todo.join(ids, todo.bound == ids.id, "left_anti"))
    return state


def classify(attempts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``attempts`` (relation, target, lang, resolved) with ``category``: internal, external, builtin or attribute."""
    labels = nodes.where("type <> 'file'").select(F.col("label").alias("_m")).distinct().withColumn("_known", F.lit(True))
    parts = S.callee_parts(F.col("target"))
    a = attempts.withColumns({"_p": parts, "_m": F.get(parts, 0)}).join(labels, "_m", "left")
    lang, known = F.col("lang"), F.coalesce("_known", F.lit(False))
    root = F.split_part(F.split_part("target", F.lit("."), F.lit(1)), F.lit("/"), F.lit(1))
    path = S.is_path_target(F.col("target"), lang)
    imports = F.when(L.is_stdlib(lang, root) | L.is_builtin(lang, root), "external").when(path, "internal").otherwise("external")
    last = F.try_element_at("_p", F.lit(-1))
    dotted = F.when(last.isin(*L.COMMON_METHODS) & ~known, "builtin").otherwise("attribute")
    symbol = F.when(F.size("_p") == 0, "external").when(L.is_builtin(lang, F.col("_m")), "builtin").when(L.is_stdlib(lang, F.col("_m")), "external").when(F.size("_p") > 1, dotted).when(known, "internal").otherwise("external")
    out = F.when(F.col("resolved") | (F.col("relation") == "contains"), "internal").when(F.col("relation") == "imports", imports).otherwise(symbol)
    return a.withColumn("category", out).drop("_p", "_m", "_known")


CATEGORIES = ("internal", "external", "builtin", "attribute")


def resolution_stats(attempts: DataFrame) -> DataFrame:
    """(dim, value, attempted, resolved, unresolved): overall, by relation and by category, in one pass; every category has a row."""
    g = attempts.groupingSets([[], [F.col("relation")], [F.col("category")]], "relation", "category").agg(F.grouping_id("relation", "category").alias("g"), F.count("*").alias("attempted"), F.count_if("resolved").alias("resolved"))
    dim = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "relation").otherwise("category")
    rows = g.select(dim.alias("dim"), F.coalesce("relation", "category", F.lit("all")).alias("value"), "attempted", "resolved")
    none = attempts.sparkSession.range(1).select(F.lit("category").alias("dim"), F.explode(F.array(*map(F.lit, CATEGORIES))).alias("value"), F.lit(0).cast("long").alias("attempted"), F.lit(0).cast("long").alias("resolved"))
    both = rows.unionByName(none).groupBy("dim", "value").agg(F.sum("attempted").alias("attempted"), F.sum("resolved").alias("resolved"))
    return both.select("dim", "value", "attempted", "resolved", (F.col("attempted") - F.col("resolved")).alias("unresolved"))


def resolve_rates(attempts: DataFrame) -> DataFrame:
    """One row: overall and internal rate; 1 where nothing was attempted."""
    internal = F.col("category") == "internal"
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(1.0)), 6)
    return attempts.agg(rate(F.count_if("resolved"), F.count("*")).alias("resolve_rate"), rate(F.count_if(F.col("resolved") & internal), F.count_if(internal)).alias("internal_rate"))


def unresolved_samples(attempts: DataFrame, per_category: int = 12, most: int = 40) -> DataFrame:
    """The first unresolved attempts, a few of each category."""
    from pyspark.sql import Window as W

    r = attempts.where(~F.col("resolved")).withColumn("rn", F.row_number().over(W.partitionBy("category").orderBy("seq")))
    return r.where(F.col("rn") <= per_category).orderBy("seq").limit(most).select("seq", "relation", *(c for c in ("source",) if c in attempts.columns), "target", "category")


def resolution_summary(attempts: DataFrame) -> DataFrame:
    """One row: attempted, resolved and unresolved, the same of internal attempts, and the two rates."""
    internal = F.col("category") == "internal"
    sums = attempts.agg(F.count("*").alias("attempted"), F.count_if("resolved").alias("resolved"), F.count_if(internal).alias("internal_attempted"), F.count_if(F.col("resolved") & internal).alias("internal_resolved"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(1.0)), 6)
    return sums.select("*", (F.col("attempted") - F.col("resolved")).alias("unresolved"), (F.col("internal_attempted") - F.col("internal_resolved")).alias("internal_unresolved"), rate("resolved", "attempted").alias("resolve_rate"), rate("internal_resolved", "internal_attempted").alias("internal_rate"))


#: Gates on numbers that must not be exceeded; all others must be reached.
AT_MOST = ("unresolved", "internal_unresolved")


def quality_gates(summary: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(gate, value, required, passed) of the columns of ``summary`` that have a limit."""
    cols = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("required"), (F.col(k) <= v if k in AT_MOST else F.col(k) >= v).alias("passed")) for k, v in sorted(limits.items())]
    return summary.select(F.inline(F.array(*cols)))


def enforce(gates: DataFrame) -> None:
    """Raises if a gate fails."""
    bad = gates.where("NOT passed").collect()  # one row per gate
    if bad:
        raise RuntimeError("; ".join(f"{r.gate} is {r.value:g}, {'at most' if r.gate in AT_MOST else 'at least'} {r.required:g} is asked for" for r in bad))
