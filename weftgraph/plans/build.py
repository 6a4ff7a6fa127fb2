"""From a source tree to a resolved, clustered and analysed graph, its pages and exports."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import languages as L
from weftgraph.functions.paths import component_filename, is_test_path, language_of, node_filename
from weftgraph.operators import components as C
from weftgraph.operators import graph as G
from weftgraph.operators import incremental as I
from weftgraph.operators import render as V
from weftgraph.operators import resolve as R
from weftgraph.plans import report
from weftgraph.plans.store import delete, load_table, parse, read_file, save_table, uri_of, write_file, write_pages, written_pages
from weftgraph.sources.extract import REGISTERED, Extractors, tables
from weftgraph.sources.scan import load_config, scan_files

STAGES = ("discovering", "parsing", "resolving", "clustering", "analyzing", "rendering", "exporting", "completed")


@dataclass(frozen=True)
class Config:
    """Settings of a build; None leaves a gate open."""

    workspace: str
    output: str | None = None
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    exclude_tests: bool = True
    naming: str = "hybrid"
    min_resolve_rate: float | None = None
    min_internal_resolve_rate: float | None = None
    max_unresolved_edges: int | None = None
    max_internal_unresolved_edges: int | None = None
    report_language: str = "en"
    strict: bool = False
    cache: bool = True
    export_json: bool = True

    @classmethod
    def merged(cls, workspace: str, **given) -> Config:
        """Arguments before the workspace's file before the defaults; exclusions add up."""
        own = {k.replace("-", "_"): v for k, v in load_config(workspace).items()}
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in cls.__dataclass_fields__ and k != "workspace"}
        extra = {k: v for k, v in given.items() if v is not None}
        extra["exclude"] = tuple(known.get("exclude", ())) + tuple(extra.get("exclude", ()))
        return cls(workspace=workspace, **{**known, **extra})


@dataclass(frozen=True)
class Hooks:
    """Extensions of a build: parsers by language, the resolution chain, chains of single languages, and types that a symbol hands over."""

    extractors: Extractors | None = None
    chain: tuple = R.CHAIN
    by_language: dict[str, tuple] | None = None
    transfer: Callable[[Column, Column], Column] | None = None


@dataclass
class Build:
    """What a build found, as DataFrames."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    attempts: DataFrame
    member: DataFrame
    names: DataFrame
    errors: DataFrame
    analysis: dict[str, DataFrame] = field(default_factory=dict)
    #: parsed, reused (files); snapshot (1 if the graph came from one); rendered, skipped (pages); write, keep, delete (files of the vault).
    counts: dict[str, int] = field(default_factory=dict)


def resolve_edges(nodes: DataFrame, bindings: DataFrame, raw: DataFrame, hooks: Hooks | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, attempts): every raw edge resolved by the rules of its relation."""
    at = nodes.select(F.col("id").alias("source"), "source_file")
    raw = G.cut(raw.where("source <> target").join(at, "source").withColumn("ref_id", F.col("seq")))
    files = nodes.where("type = 'file'").select(F.col("id").alias("file"), "seq")
    imports = raw.where("relation = 'imports'").select("ref_id", "source_file", "target", "import_map")
    found = G.cut(R.resolve_imports(imports, files))
    imported, wild = R.import_scope(imports, found)
    ix = R.Index(nodes, bindings, G.cut(imported), G.cut(wild.select("file", F.col("ord").alias("ord"), "target_file")))
    hooks = hooks or Hooks()
    ix = R.Index(nodes, R.propagate_types(ix, chain=hooks.chain, transfer=hooks.transfer), ix.imported, ix.wildcards)
    refs = raw.where("relation IN ('calls', 'inherits', 'implements')").select("ref_id", F.col("source").alias("caller"), F.col("target").alias("callee"))
    hits = R.resolve(refs, ix, hooks.chain, hooks.by_language).where("status = 'hit'").select("ref_id", F.col("target").alias("dst"))
    ids = nodes.select(F.col("id").alias("dst"))
    own = raw.where("relation = 'contains'").join(ids, F.col("target") == F.col("dst")).select("ref_id", "dst")
    done = G.cut(hits.join(ids, "dst", "left_semi").select("ref_id", "dst").unionByName(found.select("ref_id", F.col("target_file").alias("dst"))).unionByName(own))
    tried = raw.join(done, "ref_id", "left").withColumn("resolved", F.col("dst").isNotNull())
    tried = tried.withColumn("lang", F.coalesce(language_of(F.col("source_file")), F.lit("python")))
    attempts = G.cut(R.classify(tried.select("seq", "source", "dst", "relation", "target", "lang", "resolved"), nodes))
    good = attempts.where("resolved").select(F.col("source").alias("src"), "dst", "relation", "seq")
    return G.cut(G.dedup_edges(good)), attempts


TABLES = ("nodes", "edges", "attempts", "member", "names")


def build(spark: SparkSession, config: Config, progress: Callable[[str], None] = lambda stage: None, hooks: Hooks | None = None) -> Build:
    """Builds the graph; with an output and a cache, only what changed is parsed, resolved and rendered again."""
    hooks = hooks or Hooks()
    if unknown := [x for x in config.languages if x not in L.BUILTINS and x not in (hooks.extractors or REGISTERED)]:
        warnings.warn(f"unknown languages: {', '.join(unknown)}", stacklevel=2)
    vault = uri_of(config.output) if config.output else None
    root = f"{vault}/.cache" if vault else None
    progress("discovering")
    extractors = REGISTERED if hooks.extractors is None else hooks.extractors
    endings = {e: x.language for x in extractors.values() for e in x.endings}
    files = scan_files(spark, config.workspace, exclude=config.exclude, include=config.include, languages=config.languages, endings=endings)
    progress("parsing")
    parsed, dirty, counts = parse(spark, files, root, config.cache, extractors)
    nodes, bindings, raw, errors = tables(parsed)
    errors = G.cut(errors)
    if config.strict and not errors.isEmpty():
        raise RuntimeError("files that could not be parsed: " + ", ".join(r.path for r in errors.limit(5).collect()))
    knobs = {"naming": config.naming, "exclude_tests": config.exclude_tests, "hooks": hooks != Hooks()}
    mark = I.fingerprint(parsed.select("path", "md5"), **knobs).first().fingerprint or "empty"
    known = {t: load_table(spark, root, t, mark) for t in TABLES} if root and config.cache and hooks == Hooks() else {}
    counts["snapshot"] = int(bool(known) and all(df is not None for df in known.values()))
    progress("resolving")
    if not counts["snapshot"]:
        nodes, bindings = G.cut(G.first_by(nodes, ["id"], F.desc("seq"))), G.cut(bindings)
        edges, attempts = resolve_edges(nodes, bindings, raw, hooks)
    progress("clustering")
    if counts["snapshot"]:
        out = Build(files, *[known[t] for t in TABLES], errors, counts=counts)
    else:
        member, names = cluster(nodes, edges, config)
        found = dict(zip(TABLES, (nodes, edges, attempts, member, names)))
        if root:
            found = {t: save_table(df, root, t, mark) for t, df in found.items()}
        out = Build(files, *found.values(), errors, counts=counts)
    progress("analyzing")
    analyse(out)
    enforce(out, config)
    if vault:
        progress("rendering")
        write_vault(out, config.output, config.cache, dirty, config.report_language)
        progress("exporting")
        if config.export_json:
            export(out, config.output)
    progress("completed")
    return out


def cluster(nodes: DataFrame, edges: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(member, names) of the components."""
    test = is_test_path(F.col("source_file"))
    grouped = nodes.where(~test) if config.exclude_tests else nodes
    if grouped.isEmpty():
        grouped = nodes
    found = C.louvain(C.weighted_edges(grouped, edges, False), grouped)
    order = C.ranked(found)
    member = found.join(order, "comp").select("id", F.col("rank").alias("comp"))
    rest = nodes.join(grouped, "id", "left_anti")
    tests = C.attach_tests(rest, edges, member)
    last = (order.agg(F.max("rank")).first()[0] or 0) + 1
    naming = C.names(C.hub(nodes, edges, member), C.common_dir(member, nodes), config.naming)
    member = G.cut(member.unionByName(tests.select("id", F.coalesce("comp", F.lit(last)).alias("comp"))))
    return member, G.cut(naming.unionByName(member.where(F.col("comp") == last).limit(1).select("comp", F.lit("tests").alias("name"))))


def analyse(b: Build) -> None:
    imports, calls = G.between(b.edges, b.nodes, "imports", True), G.between(b.edges, b.nodes, "calls", False)
    b.analysis = {
        "god_nodes": G.god_nodes(b.nodes, b.edges),
        "import_cycles": G.cut(G.simple_cycles(imports)),
        "call_cycles": G.cut(G.call_cycles(calls)),
        "inter_component": G.cut(G.inter_component(b.edges, b.member)),
        "cohesion": G.cut(C.cohesion(b.member, b.edges)),
        "metrics": G.graph_metrics(b.nodes, b.edges),
        "relations": G.relation_counts(b.edges),
        "resolution": R.resolution_stats(b.attempts),
        "summary": G.cut(R.resolution_summary(b.attempts)),
        "samples": R.unresolved_samples(b.attempts),
    }


def enforce(b: Build, config: Config) -> None:
    """Raises if a gate that is set fails."""
    limits = {"resolve_rate": config.min_resolve_rate, "internal_rate": config.min_internal_resolve_rate, "unresolved": config.max_unresolved_edges, "internal_unresolved": config.max_internal_unresolved_edges}
    limits = {k: v for k, v in limits.items() if v is not None}
    if limits:
        R.enforce(R.quality_gates(b.analysis["summary"], limits))


def write_vault(b: Build, output: str, cache: bool = True, dirty: DataFrame | None = None, language: str = "en") -> dict[str, int]:
    """Render and write the pages whose signature changed, that are missing, or whose file is dirty or next to one that is; delete pages no longer
    wanted; write the overview and the prompt.  Returns how many pages were written, kept and deleted.

    Pages are compared and written by the tasks that rendered them; ``output`` is a folder that all of them reach.
    """
    spark, vault = b.nodes.sparkSession, uri_of(output)
    folders = ("nodes", "components")
    for d in folders:
        write_file(f"{vault}/{d}/.keep", iter([""]))
    named = b.nodes.join(b.member, "id").join(b.names, "comp")
    page = lambda folder, name: F.concat(F.lit(folder + "/"), name)
    signed = I.node_signatures(named, b.edges).select(F.col("id").alias("key"), page("nodes", node_filename(F.col("id"))).alias("path"), "signature")
    comps = I.component_signatures(named, b.analysis["inter_component"]).join(b.analysis["cohesion"].select("comp", "cohesion"), "comp", "left").join(b.names, "comp")
    mark = F.md5(F.concat_ws("#", "signature", "name", F.coalesce(F.col("cohesion").cast("string"), F.lit("")), F.lit(V.__name__)))
    comps = comps.select(F.concat(F.lit("component "), F.col("comp").cast("string")).alias("key"), page("components", component_filename(F.col("name"))).alias("path"), mark.alias("signature"))
    new = G.cut(signed.unionByName(comps))
    old = load_table(spark, f"{vault}/.cache", "signatures") if cache else None
    disk = G.cut(written_pages(spark, vault, folders))
    forced = b.nodes.select(F.col("id").alias("key")).limit(0)
    if dirty is not None:
        imports = G.between(b.edges, b.nodes, "imports", True)
        near = G.dependents(imports, dirty.select(F.col("path").alias("file")))
        forced = b.nodes.join(near, b.nodes.source_file == near.file, "left_semi").select(F.col("id").alias("key"))
    old = new.limit(0).select("key", "signature") if old is None else old
    there = new.join(disk, "path", "left_semi").select(F.col("key").alias("id"))
    plan = I.render_plan(new.select(F.col("key").alias("id"), "signature"), old.select(F.col("key").alias("id"), "signature"), there, forced.select(F.col("key").alias("id")), cache)
    todo = G.cut(plan.where("action = 'render'").select(F.col("id").alias("key")))
    n = _node_pages(named, b.edges, todo)
    c = V.component_documents(named, b.names, b.analysis["cohesion"], b.analysis["inter_component"])
    c = c.withColumn("key", F.concat(F.lit("component "), F.col("comp").cast("string"))).join(todo, "key", "left_semi")
    pages = n.select(page("nodes", F.col("path")).alias("path"), "content").unionByName(c.select(page("components", F.col("path")).alias("path"), "content"))
    pages = pages.groupBy("path").agg(F.max("content").alias("content"))
    done = write_pages(pages, vault, I.obsolete(disk, new.select("path"), new.select("path").limit(0)))
    b.counts |= {"rendered": todo.count(), "skipped": new.count() - todo.count(), **done}
    save_table(new.select("key", "signature"), f"{vault}/.cache", "signatures")
    readme = f"{vault}/README.md"
    write_file(readme, report.overview(b, Path(output).resolve().parent.name, report.kept_insights(read_file(readme))))
    write_file(f"{vault}/AGENT_PROMPT.md", iter([report.agent_prompt(b, language)]))
    above, own = vault.rsplit("/", 1)
    rules = f"{above}/AGENTS.md"
    if text := report.rules_file(read_file(rules), own):
        write_file(rules, iter([text]))
    return done


def _node_pages(named: DataFrame, edges: DataFrame, todo: DataFrame) -> DataFrame:
    """Pages of the nodes of ``todo`` (key); only edges that touch one of them are read."""
    ids = todo.select("key")
    near = edges.join(ids, edges.src == ids.key, "left_semi").unionByName(edges.join(ids, edges.dst == ids.key, "left_semi")).distinct()
    pages = V.node_documents(named, near)
    return pages.join(ids, pages.id == ids.key, "left_semi")


def clear_vault(output: str) -> None:
    """Remove all that builds wrote to ``output``, with their cache; what a reader put there stays."""
    vault = uri_of(output)
    for name in ("nodes", "components", "graph", ".cache", "README.md", "AGENT_PROMPT.md", "graph.json", "graph.html"):
        delete(f"{vault}/{name}")


def export(b: Build, output: str) -> None:
    """The graph as Parquet tables, and as one JSON file that is streamed from them."""
    base = f"{uri_of(output)}/graph"
    b.nodes.join(b.member, "id", "left").write.mode("overwrite").parquet(f"{base}/nodes")
    b.edges.write.mode("overwrite").parquet(f"{base}/edges")
    b.analysis["import_cycles"].write.mode("overwrite").parquet(f"{base}/import_cycles")
    write_file(f"{uri_of(output)}/graph.json", report.json_export(b))


def visualize(b: Build, output: str, most: int = report.DRAWN) -> str:
    """Write graph.html; returns its address."""
    target = f"{uri_of(output)}/graph.html"
    write_file(target, iter([report.picture(b, Path(output).resolve().parent.name, most)]))
    return target


def snapshot_write(df: DataFrame, path: str, fingerprint: str) -> None:
    """A table that is valid for one fingerprint only; the manifest comes last, so a broken write is a miss."""
    df.write.mode("overwrite").parquet(f"{path}/{fingerprint}/data")
    spark = df.sparkSession
    spark.createDataFrame([(1, fingerprint)], "version int, fingerprint string").coalesce(1).write.mode("overwrite").json(f"{path}/{fingerprint}/manifest")


def snapshot_read(spark: SparkSession, path: str, fingerprint: str) -> DataFrame | None:
    """The table of this fingerprint, or None if there is none."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.json(f"{path}/{fingerprint}/manifest").first()
        return spark.read.parquet(f"{path}/{fingerprint}/data") if row and row.version == 1 and row.fingerprint == fingerprint else None
    except AnalysisException:
        return None
