"""Symbols and relations of source files: one table function for all languages.

Python is parsed by its own grammar.  The other languages go through a scanner that blanks comments and strings, follows braces (or, in
OCaml, indentation) and recognises declarations, imports and calls by the language's rules; it is approximate by design.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "struct<id:string,label:string,type:string,source_file:string,line_start:int,line_end:int,signature:string,docstring:string,local_bindings:map<string,string>>"
EDGE = "struct<source:string,target:string,relation:string,import_map:map<string,string>>"
ROWS = f"path string, lang string, error string, nodes array<{NODE}>, edges array<{EDGE}>"


Extractors = dict[str, "Extractor"]


@dataclass(frozen=True)
class Extractor:
    """A language's parser: ``parse(path, text)`` returns a :class:`Found`; files are known by their endings."""

    language: str
    endings: tuple[str, ...]
    parse: Callable[[str, str], Found]


REGISTERED: Extractors = {}


def register(extractor: Extractor) -> Extractor:
    """Adds a language, or replaces a built-in one, for all builds of this session that name no other."""
    REGISTERED[extractor.language] = extractor
    return extractor


@dataclass
class Found:
    """Collects one file's rows."""

    path: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    error: str | None = None  # what was skipped

    def node(self, id, label, type, start, end, signature="", docstring="", bindings=None, parent=None):
        self.nodes.append({"id": id, "label": label, "type": type, "source_file": self.path, "line_start": start, "line_end": end, "signature": signature, "docstring": docstring, "local_bindings": dict(bindings or {})})
        if parent:
            self.edge(parent, id, "contains")
        return id

    def edge(self, source, target, relation, import_map=None):
        self.edges.append({"source": source, "target": target, "relation": relation, "import_map": dict(import_map or {})})


def type_name(node) -> str | None:
    """The name inside an annotation: the first parameter of wrappers, the first alternative of unions."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return type_name(ast.parse(node.value, mode="eval").body)
        except SyntaxError:
            return None
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return ast.unparse(node)
    if isinstance(node, ast.Call):
        return type_name(node.func)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        left = type_name(node.left)
        return type_name(node.right) if left in (None, "None") else left
    if isinstance(node, ast.Subscript):
        head = type_name(node.value)
        if head and head.rsplit(".", 1)[-1] in ("Optional", "Union", "Annotated", "Final", "ClassVar", "Type", "type"):
            inner = node.slice.elts[0] if isinstance(node.slice, ast.Tuple) else node.slice
            return type_name(inner)
        return head
    return None


def _mended(text: str, most: int = 50) -> tuple[ast.Module, str | None]:
    """The tree of a text without the lines that break it, and the first error; a text that stays broken after ``most`` lines raises."""
    lines, first = text.split("\n"), None
    for _ in range(most):
        try:
            return ast.parse("\n".join(lines)), first
        except SyntaxError as e:
            first = first or f"SyntaxError: {e}"
            at = min(max(1, e.lineno or 1), len(lines)) - 1
            while at and (not lines[at].strip() or lines[at].strip() == "pass"):
                at -= 1
            kept = lines[at]
            lines[at] = kept[: len(kept) - len(kept.lstrip())] + "pass"
            if lines[at] == kept:
                break
    return ast.parse("\n".join(lines)), first


def _python(path: str, text: str) -> Found:
    lines = text.splitlines() or [""]
    tree, bad = _mended(text)
    out = Found(path, error=bad)
    out.node(path, path.rsplit("/", 1)[-1], "file", 1, len(lines), "", ast.get_docstring(tree) or "")

    def own(body):
        """Nodes of a body that belong to no inner definition."""
        todo = list(body)
        while todo:
            n = todo.pop(0)
            yield n
            if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                todo[:0] = list(ast.iter_child_nodes(n))

    def bindings(fn) -> dict:
        a, got = fn.args, {}
        for arg in [*a.posonlyargs, *a.args, *a.kwonlyargs]:
            if arg.annotation and (t := type_name(arg.annotation)):
                got[arg.arg] = t
        for n in own(fn.body):
            if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and (t := type_name(n.annotation)):
                got[n.target.id] = t
            elif isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                if isinstance(n.value, ast.Call) and (t := type_name(n.value.func)):
                    got[n.targets[0].id] = t
                elif isinstance(n.value, ast.Name):
                    got[n.targets[0].id] = n.value.id
            elif isinstance(n, (ast.With, ast.AsyncWith)):
                for item in n.items:
                    if isinstance(item.context_expr, ast.Call) and isinstance(item.optional_vars, ast.Name) and (t := type_name(item.context_expr.func)):
                        got[item.optional_vars.id] = t
        return got

    def walk(body, scope: str, cls: str | None):
        for n in own(body):
            if isinstance(n, ast.ClassDef):
                cid = out.node(f"{path}::{n.name}", n.name, "class", n.lineno, n.end_lineno, f"class {n.name}", ast.get_docstring(n) or "", parent=scope)
                for b in n.bases:
                    if isinstance(b, (ast.Name, ast.Attribute)):
                        out.edge(cid, ast.unparse(b), "inherits")
                walk(n.body, cid, cid)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                fid = f"{cls}.{n.name}" if cls else f"{path}::{n.name}"
                head = "\n".join(lines[n.lineno - 1 : max(n.lineno, n.body[0].lineno - 1)])
                returns = f" -> {ast.unparse(n.returns)}" if n.returns else ""
                sig = f"def {n.name}({ast.unparse(n.args)}){returns}" if head else ""
                out.node(fid, n.name, "method" if cls else "function", n.lineno, n.end_lineno, sig, ast.get_docstring(n) or "", bindings(n), cls or scope)
                walk(n.body, fid, None)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    out.edge(path, a.name, "imports", {a.asname: "*"} if a.asname else {})
            elif isinstance(n, ast.ImportFrom):
                target = "." * n.level + (n.module or "")
                if n.level:  # leading dots name directories
                    up = path.split("/")[: -n.level]
                    target = ".".join([*up, *([n.module] if n.module else [])]) or "."
                out.edge(path, target, "imports", {a.asname or a.name: a.name for a in n.names})
            elif isinstance(n, ast.Call):
                out.edge(scope, ast.unparse(n.func), "calls")

    walk(tree.body, path, None)
    return out


_ID = r"[A-Za-z_$][\w$]*"
#: Declarations: (pattern with groups name, maybe base; type).  Imports: pattern with group target.
RULES = {
    "javascript": dict(
        decl=[(rf"\bclass\s+(?P<name>{_ID})(?:\s*<[^>{{]*>)?(?:\s+extends\s+(?P<base>[\w$.]+))?[^{{;]*(?={{)", "class"), (rf"\binterface\s+(?P<name>{_ID})[^{{;]*(?={{)", "interface"), (rf"\benum\s+(?P<name>{_ID})\s*(?={{)", "enum"),
              (rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*(?:<[^>]*>)?\([^)]*\)[^{{;=]*(?={{)", "function"), (rf"(?m)^\s*(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?P<name>(?!(?:if|for|while|switch|catch|function|return|new|constructor\b\s*\.)\b){_ID})\s*(?:<[^>]*>)?\([^)]*\)\s*(?::[^{{;=]+)?(?={{)", "method")],
        imports=[r"""\bimport\s+(?P<what>[^'"`;]*?)\s*(?:from\s*)?(?P<q>['"])(?P<target>[^'"]+)(?P=q)""", r"""\brequire\(\s*(?P<q>['"])(?P<target>[^'"]+)(?P=q)\s*\)"""],
        binding=[rf"(?P<var>{_ID})\s*\??:\s*(?P<type>[A-Z][\w.]*)", rf"\b(?:const|let|var)\s+(?P<var>{_ID})[^=;\n]*=\s*new\s+(?P<type>[\w.$]+)"],
    ),
    "kotlin": dict(
        decl=[(r"\binterface\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s*:\s*(?P<base>[\w.]+))?[^{\n]*(?={)", "interface"), (r"\b(?:class|object)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<base>[\w.]+))?[^{\n]*", "class"), (r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<name>\w+)\s*\([^)]*\)(?:\s*:\s*[\w<>?., ]+)?", "function")],
        imports=[r"(?m)^\s*import\s+(?P<target>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<alias>\w+))?"],
        binding=[r"\b(?P<var>\w+)\s*:\s*(?P<type>[A-Z]\w*)", r"\bva[lr]\s+(?P<var>\w+)\s*=\s*(?P<type>[A-Z]\w*)\("],
    ),
    "go": dict(
        decl=[(r"\btype\s+(?P<name>\w+)\s+struct\b", "struct"), (r"\btype\s+(?P<name>\w+)\s+interface\b", "interface"), (r"\bfunc\s+(?:\(\s*\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\([^)]*\)[^{\n]*", "function")],
        imports=[r"""(?m)(?:\bimport\s+|^\s+)(?P<alias>[\w.]+\s+)?(?P<q>")(?P<target>[^"\n]+)(?P=q)\s*$"""],
        binding=[],
    ),
    "rust": dict(
        decl=[(r"\bstruct\s+(?P<name>\w+)", "struct"), (r"\benum\s+(?P<name>\w+)", "enum"), (r"\btrait\s+(?P<name>\w+)", "interface"), (r"\bimpl(?:\s*<[^>]*>)?\s+(?:(?P<trait>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)[^{;]*(?={)", "impl"), (r"\bfn\s+(?P<name>\w+)\s*(?:<[^>]*>)?\([^)]*\)[^{;]*", "function")],
        imports=[r"\buse\s+(?P<target>[\w:]+(?:::\{[^}]*\}|::\*)?)(?:\s+as\s+(?P<alias>\w+))?\s*;"],
        binding=[r"\b(?P<var>\w+)\s*:\s*&?(?:mut\s+)?(?P<type>[A-Z]\w*)", r"\blet\s+(?:mut\s+)?(?P<var>\w+)\s*=\s*(?P<type>[A-Z]\w*)(?:::\w+\(|\s*\{)"],
    ),
    "swift": dict(
        decl=[(r"\bprotocol\s+(?P<name>\w+)(?:\s*:\s*(?P<base>\w+))?", "interface"), (r"\bstruct\s+(?P<name>\w+)(?:\s*:\s*(?P<base>\w+))?", "struct"), (r"\benum\s+(?P<name>\w+)(?:\s*:\s*(?P<base>\w+))?", "enum"), (r"\bclass\s+(?P<name>(?!func\b|var\b)\w+)(?:\s*:\s*(?P<base>\w+))?", "class"), (r"\bfunc\s+(?P<name>\w+)\s*(?:<[^>]*>)?\([^)]*\)[^{\n]*", "function"), (r"(?<![.\w])(?P<name>init|deinit)\b\s*\??(?:\([^)]*\))?[^{\n]*(?={)", "function")],
        imports=[r"(?m)^\s*import\s+(?P<target>[\w.]+)"],
        binding=[r"\b(?P<var>\w+)\s*:\s*(?P<type>[A-Z]\w*)", r"\b(?:let|var)\s+(?P<var>\w+)\s*=\s*(?P<type>[A-Z]\w*)\("],
    ),
    "c": dict(
        decl=[(r"\bnamespace\s+(?P<name>\w+)\s*(?={)", "namespace"), (r"\bclass\s+(?P<name>\w+)(?:\s*:\s*(?:public|private|protected)?\s*(?P<base>[\w:]+))?[^;{(]*(?={)", "class"), (r"\bstruct\s+(?P<name>\w+)(?:\s*:\s*(?:public|private|protected)?\s*(?P<base>[\w:]+))?\s*(?={)", "struct"), (r"\bunion\s+(?P<name>\w+)\s*(?={)", "union"), (r"\benum\s+(?:class\s+)?(?P<name>\w+)[^;{]*(?={)", "enum"),
              (r"(?m)^[ \t]*(?:[\w:<>,*&]+[ \t*&]+)+(?P<name>(?!(?:if|for|while|switch|return|else)\b)~?[\w:]+)\s*\([^;{)]*\)\s*(?:const|override|noexcept)?\s*(?={)", "function")],
        imports=[r"""(?m)^\s*#\s*include\s*[<"](?P<target>[^>"\n]+)[>"]"""],
        binding=[],
    ),
    "dart": dict(
        decl=[(r"\babstract\s+class\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>\w+))?[^{]*(?={)", "interface"), (r"\bclass\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<base>\w+))?[^{]*(?={)", "class"), (r"\benum\s+(?P<name>\w+)\s*(?={)", "enum"), (r"\bmixin\s+(?P<name>\w+)[^{]*(?={)", "mixin"), (r"\bextension\s+(?P<name>\w+)\s+on[^{]*(?={)", "extension"), (r"(?m)^[ \t]*(?:static\s+)?(?:[\w<>?,]+[ \t]+)+(?P<name>(?!(?:if|for|while|switch|catch|return)\b)\w+)\s*\([^;{]*\)\s*(?:async\s*)?(?={|=>)", "function"), (r"(?m)^[ \t]*(?P<name>[A-Z]\w*)\([^)]*\)\s*(?=;|{)", "constructor")],
        imports=[r"""(?m)^\s*(?:import|export)\s+(?P<q>['"])(?P<target>[^'"]+)(?P=q)(?:\s+as\s+(?P<alias>\w+))?"""],
        binding=[r"\b(?:final|var)\s+(?P<var>\w+)\s*=\s*(?P<type>[A-Z]\w*)\("],
    ),
    "ocaml": dict(
        decl=[(r"(?m)^\s*module\s+(?P<name>\w+)\s*(?::[^=]*)?=\s*struct", "class"), (r"(?m)^\s*type\s+(?:'\w+\s+)?(?P<name>\w+)\s*=", "struct"), (r"(?m)^(?P<indent>[ ]{0,2})let\s+(?:rec\s+)?(?P<name>[a-z_]\w*)[^=\n]*=", "function")],
        imports=[r"(?m)^\s*(?:open|include)\s+(?P<target>[\w.]+)"],
        binding=[],
    ),
}
RULES["typescript"] = RULES["javascript"]
RULES["cpp"] = RULES["c"]
_CALL = re.compile(r"(?<![\w$.:])(?:new\s+)?((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*!?)\s*\(")
_OCAML_CALL = re.compile(r"(?<![\w.])((?:[A-Z]\w*\.)+[a-z_]\w*)\s+[\w(\"]")
_NOT_CALLS = set("import if for while switch catch return func fun fn function sizeof match else when super init guard def let in".split())
_INNER = ("method",)
CLASSES = {"class", "struct", "interface", "enum", "mixin", "extension", "union", "namespace", "impl"}


def _blank(text: str, lang: str, strings: bool = True) -> str:
    """The text with comments (and strings) as spaces of equal length."""
    line, block = ("", r"\(\*.*?\*\)") if lang == "ocaml" else (r"//[^\n]*", r"/\*.*?\*/")
    parts = [p for p in (block, line) if p]
    parts.append(r'"(?:\\.|[^"\\\n])*"|`[^`]*`' + ("" if lang in ("rust", "ocaml") else r"|'(?:\\.|[^'\\\n])*'"))
    pattern = re.compile("|".join(f"({p})" for p in parts), re.S)

    def cover(m):
        keep = not strings and m.lastindex == len(parts)
        return m.group() if keep else re.sub(r"[^\n]", " ", m.group())

    return pattern.sub(cover, text)


def _end(text: str, at: int, lang: str) -> int:
    """Where the body that begins at or after ``at`` ends."""
    if lang == "ocaml":
        line = text.rfind("\n", 0, at) + 1
        head = text[line:at]
        indent = len(head) - len(head.lstrip())
        if re.match(r"\s*module\b", text[line:]):
            m = re.compile(rf"(?m)^ {{0,{indent}}}end\b").search(text, at)
            return m.end() if m else len(text)
        m = re.compile(rf"(?m)^ {{0,{indent}}}\S").search(text, at)
        return m.start() if m else len(text)
    stop = re.compile(r"[{;\n]" if lang in ("kotlin", "swift", "go") else r"[{;]|=>").search(text, at)
    if not stop or stop.group() != "{":
        nl = text.find("\n", at)
        return nl if nl >= 0 else len(text)
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, stop.start()):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _import(lang: str, m, path: str) -> tuple[str, dict]:
    g = m.groupdict()
    target, alias = g["target"], (g.get("alias") or "").strip()
    if lang in ("javascript", "typescript"):
        names, what = {}, (g.get("what") or "").strip()
        if star := re.search(r"\*\s+as\s+(\w+)", what):
            names[star[1]] = "*"
        if braces := re.search(r"\{([^}]*)\}", what):
            for item in filter(None, (x.strip() for x in braces[1].split(","))):
                old, _, new = item.partition(" as ")
                names[(new or old).strip()] = old.strip()
        if first := re.match(r"(\w+)\s*(?:,|$)", what):
            names[first[1]] = "default"
        return target, names
    if lang == "kotlin":
        if target.endswith(".*"):
            return target[:-2], {"*": "*"}
        pkg, _, name = target.rpartition(".")
        return pkg or target, {alias or name: name}
    if lang == "rust":
        if target.endswith("::*"):
            return target[:-3], {"*": "*"}
        if "{" in target:
            base, _, rest = target.partition("::{")
            return base, {(x.split(" as ")[-1]).strip(): x.split(" as ")[0].strip() for x in rest.rstrip("}").split(",") if x.strip()}
        base, _, name = target.rpartition("::")
        return base or target, {alias or name: name}
    if lang == "go":
        return target, {"*": "*"} if alias == "." else {alias: "*"} if alias else {}
    if lang == "ocaml":
        return target, {"*": "*"}
    return target, {alias: "*"} if alias else {}


def _other(path: str, lang: str, text: str) -> Found:
    out, rules = Found(path), RULES[lang]
    code = _blank(text, lang)
    line = lambda at: text.count("\n", 0, at) + 1
    out.node(path, path if lang == "dart" else path.rsplit("/", 1)[-1], "file", 1, max(1, len(text.splitlines())))
    scopes: list[tuple[int, int, str, str]] = []  # start, end, id, type
    seen: set[tuple[int, int]] = set()
    decls = sorted(((m.start(), -m.end(), m, t) for p, t in rules["decl"] for m in re.finditer(p, code)), key=lambda x: x[:2])
    for start, _, m, kind in decls:
        name = m["name"]
        if (m.start("name"), m.end("name")) in seen:
            continue
        inside = [s for s in scopes if s[0] < start < s[1]]
        outer = inside[-1] if inside else None
        cls = outer if outer and outer[3] in CLASSES else None
        if kind in _INNER and not cls or kind == "constructor" and not cls:
            continue
        if lang == "ocaml" and kind == "function" and m["indent"] and not cls:
            continue
        seen.add((m.start("name"), m.end("name")))
        end = _end(code, m.end(), lang)
        if kind == "impl":
            own = f"{path}::{name}"
            if m["trait"]:
                out.edge(own, m["trait"], "implements")
            scopes.append((start, end, own, "impl"))
            continue
        sig = " ".join(text[start : m.end()].split())
        before = re.search(r"((?:[ \t]*(?:///?[^\n]*|/\*.*?\*/|\(\*.*?\*\))[ \t]*\n)+)[^\n]*$", text[:start] if start else "", re.S)
        doc = " ".join(re.sub(r"^\s*(///?|/\*+|\*+/?|\(\*+)|\*+[/)]\s*$", "", x).strip() for x in before[1].splitlines()).strip() if before else ""
        recv = m.groupdict().get("recv")
        if "::" in name and kind == "function":  # defined outside its class
            owner, _, name = name.rpartition("::")
            nid, typ, parent = f"{path}::{owner.replace('::', '.')}.{name}", "method", path
        elif recv:
            nid, typ, parent = f"{path}::{recv}.{name}", "method", f"{path}::{recv}"
        elif cls:
            typ = "method" if kind == "function" else kind
            nid, parent = f"{cls[2]}.{name}", cls[2]
        else:
            nid, typ, parent = f"{path}::{name}", kind, path
        names = {}
        if typ in ("function", "method"):
            for p in rules["binding"]:
                for b in re.finditer(p, code[start:end]):
                    names.setdefault(b["var"], b["type"])
        out.node(nid, name, typ, line(start), line(max(start, end - 1)), sig, doc, names, parent)
        if m.groupdict().get("base"):
            out.edge(nid, m["base"], "inherits")
        scopes.append((start, end, nid, typ))
        scopes.sort()
    bare = _blank(text, lang, strings=False)
    spans = []
    for p in rules["imports"]:
        for m in re.finditer(p, bare):
            if lang == "go" and not re.search(r"\bimport\b", bare[: m.end()]):
                continue
            target, names = _import(lang, m, path)
            out.edge(path, target, "imports", names)
            spans.append(m.span())
    heads = [(m.start(), m.end()) for _, _, m, _ in decls]
    for m in (_OCAML_CALL if lang == "ocaml" else _CALL).finditer(code):
        name = m[1].replace("->", ".")
        if name in _NOT_CALLS or any(a <= m.start(1) < b for a, b in heads + spans):
            continue
        inside = [s for s in scopes if s[0] < m.start() < s[1] and s[3] not in CLASSES]
        out.edge(inside[-1][2] if inside else path, name, "calls")
    return out


def extract_file(path: str, lang: str, content: bytes, extractors: Extractors | None = None) -> tuple[list[dict], list[dict], str | None]:
    """(nodes, edges, error) of one file; a file that cannot be read gives its error and no rows, one with broken lines both."""
    try:
        text = content.decode("utf-8", "replace")
        if extractors and lang in extractors:
            out = extractors[lang].parse(path, text)
        else:
            out = _python(path, text) if lang == "python" else _other(path, lang, text)
        return out.nodes, out.edges, out.error
    except KeyError:
        return [], [], f"no extractor for {lang}"
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], [], f"{type(e).__name__}: {e}"


def extract(files: DataFrame, extractors: Extractors | None = None) -> DataFrame:
    """(path, lang, error, nodes, edges) of files (path, lang, content)."""
    own = dict(REGISTERED if extractors is None else extractors)  # travels with the task

    def run(batches):
        for batch in batches:
            rows = [dict(zip(("path", "lang", "content"), r)) for r in zip(*(c.to_pylist() for c in batch.columns))]
            out = []
            for r in rows:
                nodes, edges, error = extract_file(r["path"], r["lang"], r["content"] or b"", own)
                pairs = lambda d, k: {**d, k: list(d[k].items())}
                out.append({"path": r["path"], "lang": r["lang"], "error": error, "nodes": [pairs(n, "local_bindings") for n in nodes], "edges": [pairs(e, "import_map") for e in edges]})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow())

    return files.select("path", "lang", "content").mapInArrow(run, ROWS)


def _arrow() -> pa.Schema:
    m = pa.map_(pa.string(), pa.string())
    s = pa.string()
    node = pa.struct([("id", s), ("label", s), ("type", s), ("source_file", s), ("line_start", pa.int32()), ("line_end", pa.int32()), ("signature", s), ("docstring", s), ("local_bindings", m)])
    edge = pa.struct([("source", s), ("target", s), ("relation", s), ("import_map", m)])
    return pa.schema([("path", s), ("lang", s), ("error", s), ("nodes", pa.list_(node)), ("edges", pa.list_(edge))])


def tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, bindings, raw edges, errors); ``seq``, a string that is unique, orders by path and place in the file."""
    key = lambda pos: F.concat("path", F.lit("\u0000"), F.lpad(F.col(pos).cast("string"), 10, "0"))
    n = extracted.select("path", F.posexplode("nodes").alias("pos", "n")).select("n.*", key("pos").alias("seq"))
    e = extracted.select("path", F.posexplode("edges").alias("pos", "e")).select("e.*", key("pos").alias("seq"))
    b = n.select(F.col("id").alias("node_id"), F.explode("local_bindings").alias("var", "bound"))
    return n.drop("local_bindings"), b, e, extracted.where("error IS NOT NULL").select("path", "error")
