"""Path predicates and names as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_SEGMENTS = tuple("__tests__ spec specs test testing tests".split())
TEST_ENDINGS = tuple("_test.go _test.js _test.kt _test.py _test.rs _test.swift _test.ts _test.tsx .spec.js .spec.ts .spec.tsx .test.js .test.ts .test.tsx test.java tests.swift".split())
_BY_LANGUAGE = "c:.h,.c cpp:.hpp,.hxx,.cc,.cpp,.cxx dart:.dart go:.go javascript:.cjs,.js,.mjs kotlin:.kts,.kt ocaml:.mli,.ml python:.py rust:.rs swift:.swift typescript:.tsx,.ts"
EXTENSIONS = {ext: lang for lang, many in (x.split(":") for x in _BY_LANGUAGE.split()) for ext in many.split(",")}
EXCLUDED = tuple(
    ".build .cache .dart_tool .weftgraph .git .idea .next .nuxt .pub-cache .pytest_cache .venv .vscode bin build build_ios build_ios_sim build_mac build_output Carthage "
    "DerivedData dist node_modules obj out Pods __pycache__ target third_party vendor venv".split()
)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def is_test_path(path: Column) -> Column:
    """A test segment, a test file prefix, or a test file ending."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = base_name(low)
    ends = F.lit(False)
    for e in TEST_ENDINGS:
        ends = ends | F.endswith(low, F.lit(e))
    return F.coalesce(F.exists(F.split(low, "/"), lambda s: s.isin(*TEST_SEGMENTS)) | F.startswith(name, F.lit("test_")) | F.startswith(name, F.lit("test-")) | ends, F.lit(False))


def is_excluded(path: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """Names match any segment, whatever the case; patterns with a slash match the whole path or its beginning."""
    low = F.lower(path)
    names = [p.lower() for p in patterns if "/" not in p]
    out = F.exists(F.split(low, "/"), lambda s: s.isin(*names)) if names else F.lit(False)
    for p in (p.strip("/").lower() for p in patterns if "/" in p):
        out = out | (low == p) | F.startswith(low, F.lit(p + "/"))
    return out


def language_of(path: Column) -> Column:
    ext = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), ext)


_UNSAFE = '[\\\\/.: *?#^\\[\\]"<>|%s]+'


def node_filename(node_id: Column) -> Column:
    return F.concat(F.regexp_replace(node_id, _UNSAFE % "", "_"), F.lit(".md"))


def component_filename(name: Column) -> Column:
    return F.concat(F.regexp_replace(name, _UNSAFE % "()", "_"), F.lit(".md"))


def mermaid_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def line_count(text: Column) -> Column:
    """Lines as a reader counts them, one at least: a trailing line break opens no new line."""
    return F.greatest(F.lit(1), F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n"))).cast("long")
