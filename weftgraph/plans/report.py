"""What a build tells its readers: the overview, the prompt for an analyst, the rules file, the JSON export and the picture."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.paths import component_filename, node_filename
from weftgraph.operators import components as C
from weftgraph.operators import graph as G
from weftgraph.operators import render as V

if TYPE_CHECKING:
    from weftgraph.plans.build import Build

#: What a reader wrote below this heading survives later builds, as does what older builds kept below the others.
MARKER = "## Architectural Insights"
OLDER = ("## Insights", "## Notes")
EMPTY = "_Nothing has been written here yet. AGENT_PROMPT.md says what belongs here._"
#: Lists of the overview name so many entries; the tables beside it hold all.
SHOWN = 100


def kept_insights(text: str | None) -> str:
    """What stands below the first marker that the old overview has."""
    for marker in (MARKER, *OLDER):
        if text and marker in text:
            return text.split(marker, 1)[1].strip() or EMPTY
    return EMPTY


def component_lines(b: Build) -> DataFrame:
    """(comp, name, cohesion, size, path) in order of rank."""
    size = b.member.groupBy("comp").agg(F.count("*").alias("size"))
    score = b.analysis["cohesion"].select("comp", "cohesion")
    return size.join(b.names, "comp").join(score, "comp", "left").select("comp", "name", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"), "size", component_filename(F.col("name")).alias("path")).orderBy("comp")


def component_graph(b: Build) -> list[str]:
    """Diagram lines of the heaviest dependencies between components, or of the components if there are none."""
    a, z = b.names.toDF("src_comp", "s"), b.names.toDF("dst_comp", "d")
    deps = b.analysis["inter_component"].join(a, "src_comp").join(z, "dst_comp").orderBy(F.desc("n"), "src_comp", "dst_comp").limit(SHOWN).collect()
    lines = [f'  comp_{r.src_comp}["{r.s}"] -->|{r.n}| comp_{r.dst_comp}["{r.d}"]' for r in deps]
    return lines or [f'  comp_{r.comp}["{r["name"]}"]' for r in b.names.orderBy("comp").limit(SHOWN).collect()]


def architecture(b: Build) -> list[str]:
    """Top-level folders with examples, and where a program may start."""
    out = [f"- `{r.dir}`: {r.n} files ({r.sample})" for r in C.top_dirs(b.nodes).orderBy(F.desc("n"), "dir").limit(SHOWN).collect()]
    starts = C.entry_points(b.nodes).collect()
    return out + ([f"- Entry points: {', '.join(f'`{r.id}`' for r in starts)}"] if starts else [])


def numbers(b: Build) -> tuple[list[str], dict]:
    m, r = b.analysis["metrics"].first(), b.analysis["summary"].first()
    unresolved = {x.value: x.unresolved for x in b.analysis["resolution"].where("dim = 'category'").collect()}
    mix = V.readme_stats(b.edges).first()
    lines = [
        f"- Files: {m.files}",
        f"- Symbols: {m.symbols}",
        f"- Edges: {m.edges}",
        f"- Resolved: {r.resolved} of {r.attempted} ({r.resolve_rate:.1%}), unresolved: {r.unresolved}",
        f"- Internal: {r.internal_resolved} of {r.internal_attempted} ({r.internal_rate:.1%}), unresolved: {r.internal_unresolved}",
        "- Unresolved by category: " + ", ".join(f"{k} {unresolved.get(k, 0)}" for k in ("external", "builtin", "attribute", "internal")),
        f"- Relations: {mix.relation_mix if mix else ''}",
    ]
    return lines, m.asDict()


def overview(b: Build, title: str, insights: str) -> Iterator[str]:
    """The README of a vault."""
    text, _ = numbers(b)
    yield "\n".join([f"# Code graph of {title}", "", "## Statistics", *text, "", "## Architecture", *architecture(b), ""])
    yield "\n".join(["", "## Component Graph", "```mermaid", "flowchart TD", *component_graph(b), "```", "", "## Components", "", "| Component | Cohesion | Size |", "|-|-|-|", ""])
    for r in component_lines(b).toLocalIterator():
        yield f"| [{r['name']}](components/{r.path}) | {r.cohesion} | {r['size']} |\n"
    yield "\n## Hubs\n\n| Symbol | Type | Degree | In | Out | File |\n|-|-|-|-|-|-|\n"
    hubs = b.analysis["god_nodes"].join(b.nodes.select("id", "source_file"), "id").select("*", node_filename(F.col("id")).alias("path")).orderBy(F.desc("degree"), "id")
    for r in hubs.collect():  # ten at most
        yield f"| [{r.label}](nodes/{r.path}) | `{r.type}` | {r.degree} | {r.in_degree} | {r.out_degree} | `{r.source_file}` |\n"
    samples = b.analysis["samples"].limit(20).collect()
    if samples:
        yield "\n## Unresolved References (a few of each kind)\n\n| Category | Relation | Source | Target |\n|-|-|-|-|\n"
        yield "".join(f"| `{r.category}` | `{r.relation}` | `{r.source}` | `{r.target}` |\n" for r in samples)
    cycles = b.analysis["import_cycles"].orderBy("length", "path").limit(SHOWN).collect()
    yield "\n## Import Cycles\n\n" + ("".join(f"{k}. {r.path}\n" for k, r in enumerate(cycles, 1)) or "There are none.\n")
    calls = b.analysis["call_cycles"].orderBy("length", "path").limit(10).collect()
    if calls:
        yield "\n## Call Cycles (the shortest)\n\n" + "".join(f"{k}. {r.path}\n" for k, r in enumerate(calls, 1))
    yield f"\n{MARKER}\n\n{insights}\n"


PROMPTS = {
    "en": ("Analyse this code base", f"Read the figures, then the pages they link to. Write your findings in English below the heading `{MARKER}` of README.md; later builds keep what stands there.", "Figures", "Components", "Dependencies", "Hubs", "Import cycles", "none", "Cover three things: how the folders and the components match; which hubs carry too much; which dependencies or cycles to cut first, and how."),
    "zh": ("分析此代码库", f"先阅读下列数据, 再阅读其链接的页面。请用中文把结论写在 README.md 的 `{MARKER}` 标题之下; 以后的构建会保留这些内容。", "数据", "组件", "依赖", "枢纽", "循环导入", "无", "请说明三点: 目录与组件是否一致; 哪些枢纽承担过多; 应先切断哪些依赖或循环, 以及如何切断。"),
}


def agent_prompt(b: Build, language: str = "en") -> str:
    """What an analyst of the vault is asked, in English, or in Chinese for any ``zh``."""
    title, task, figures, parts, deps, hubs, cycles, none, ask = PROMPTS["zh" if language.lower().startswith("zh") else "en"]
    text, _ = numbers(b)
    comps = [f"- {r['name']}: {r.cohesion}, {r['size']}" for r in component_lines(b).limit(SHOWN).collect()]
    top = [f"- {r.label} ({r.type}): {r.degree}, {r.id}" for r in b.analysis["god_nodes"].collect()]
    loops = [f"- {r.path}" for r in b.analysis["import_cycles"].orderBy("length", "path").limit(SHOWN).collect()] or [none]
    return "\n".join([f"# {title}", "", task, "", f"## {figures}", *text, "", f"## {parts}", *comps, "", f"## {deps}", "```mermaid", "flowchart TD", *component_graph(b), "```", "", f"## {hubs}", *top, "", f"## {cycles}", *loops, "", ask, ""])


RULES = "## Code graph"


def rules_file(old: str | None, vault: str) -> str | None:
    """AGENTS.md of the project: what it says already, and once where the graph is; None if nothing is to be written."""
    if old and RULES in old:
        return None
    body = f"{RULES}\n\nA graph of this code base lies in `{vault}/`.\n\n- Questions about structure: begin with `{vault}/README.md`, then `{vault}/components/` and `{vault}/nodes/`.\n- `{vault}/AGENT_PROMPT.md` asks for an analysis; its answer belongs below `{MARKER}` in the README, nothing else changes by hand.\n- After code has changed, build the graph again.\n"
    return f"{old.rstrip()}\n\n{body}" if old and old.strip() else body


def json_export(b: Build) -> Iterator[str]:
    """graph.json in pieces: rows come from the cluster one partition at a time and are never held together."""
    _, m = numbers(b)
    yield '{"statistics": ' + json.dumps({k: m[k] for k in ("nodes", "edges", "files", "symbols")})

    def rows(df: DataFrame) -> Iterator[str]:
        first = True
        for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            yield ("\n" if first else ",\n") + r.j
            first = False

    members = b.member.groupBy("comp").agg(F.array_sort(F.collect_list("id")).alias("members"))
    tables = {
        "nodes": b.nodes.select("id", "label", "type", "source_file", "line_start", "line_end", "signature").orderBy("id"),
        "edges": b.edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation").orderBy("source", "target"),
        "components": component_lines(b).drop("path").join(members, "comp").withColumnRenamed("comp", "id").orderBy("id"),
        "god_nodes": b.analysis["god_nodes"],
        "import_cycles": b.analysis["import_cycles"].orderBy("length", "path"),
        "call_cycles": b.analysis["call_cycles"].orderBy("length", "path"),
        "resolution": b.analysis["resolution"].orderBy("dim", "value"),
        "unresolved_samples": b.analysis["samples"],
        "relation_counts": b.analysis["relations"].orderBy("relation"),
        "inter_component_dependencies": b.analysis["inter_component"].orderBy("src_comp", "dst_comp"),
    }
    for name, df in tables.items():
        yield f',\n"{name}": ['
        yield from rows(df)
        yield "]"
    yield ', "metrics": ' + json.dumps(m) + "}\n"


#: One page shows so many nodes, those of highest degree; a picture of more helps no reader.
DRAWN = 1500
COLOURS = ("#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#ff8ab7", "#a463f2", "#97bbf5", "#9c6b4e", "#9498a0")


def picture(b: Build, title: str, most: int = DRAWN) -> str:
    """A page with the graph as SVG: circles by degree, coloured by component, with tooltips and a filter."""
    degree = G.degrees(b.nodes, b.edges)
    top = G.cut(b.nodes.join(degree.select("id", "degree"), "id").orderBy(F.desc("degree"), "id").limit(most).select("id", "label", "type", "source_file", "degree"))
    lines = G.cut(G.valid_edges(b.edges, top))
    at = V.spring_layout(top.select("id"), lines.select("src", "dst"))
    info = top.join(V.viz_nodes(top.drop("degree"), top.select("id", "degree")).select("id", F.col("size").alias("marker")), "id").join(b.member, "id", "left").join(b.names, "comp", "left")
    rows = {r.id: r for r in info.join(at, "id").collect()}  # at most ``most``
    xs, ys = [r.x for r in rows.values()] or [0.0], [r.y for r in rows.values()] or [0.0]
    place = lambda v, lo, hi: 30 + 1140 * (v - lo) / ((hi - lo) or 1)
    where = {k: (place(r.x, min(xs), max(xs)), place(r.y, min(ys), max(ys))) for k, r in rows.items()}
    esc = lambda t: html.escape(str(t or ""), quote=True)
    out = [f"<!doctype html><meta charset=utf-8><title>{esc(title)}</title>", "<style>body{font:14px sans-serif;margin:1em}svg{width:100%;height:90vh}line{stroke:#bbb;stroke-width:.6}circle{stroke:#fff}.off{opacity:.07}</style>"]
    out.append(f"<h1>{esc(title)}</h1><p>{len(rows)} nodes <input id=q placeholder='filter'></p><svg viewBox='0 0 1200 1200'>")
    for e in lines.collect():  # edges among the nodes drawn
        (x1, y1), (x2, y2) = where[e.src], where[e.dst]
        out.append(f"<line x1='{x1:.1f}' y1='{y1:.1f}' x2='{x2:.1f}' y2='{y2:.1f}'><title>{esc(e.src)} {esc(e.relation)} {esc(e.dst)}</title></line>")
    for k, r in sorted(rows.items()):
        colour = COLOURS[(r.comp or 0) % len(COLOURS)]
        out.append(f"<circle cx='{where[k][0]:.1f}' cy='{where[k][1]:.1f}' r='{r.marker / 4:.1f}' fill='{colour}' data-t='{esc(k).lower()}'><title>{esc(r.label)} ({esc(r.type)})\n{esc(r.source_file)}\n{esc(r['name'])}, degree {r.degree}</title></circle>")
    out.append("</svg><script>q.oninput=()=>document.querySelectorAll('circle').forEach(c=>c.classList.toggle('off',!c.dataset.t.includes(q.value.toLowerCase())))</script>")
    return "\n".join(out)
