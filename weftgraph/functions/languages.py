"""What the resolver knows of each language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_C = "calloc exit fclose fopen fprintf free malloc memcpy memset printf realloc scanf sizeof sprintf strcat strcmp strcpy strlen"
_JS = (
    "Array Boolean Date Error JSON Map Math Number Object Promise RegExp Set String clearInterval clearTimeout console decodeURI document encodeURI eval exports global isFinite isNaN module "
    "parseFloat parseInt process require setInterval setTimeout window"
)
BUILTINS = {
    "python": "abs all any dict dir enumerate filter hash id input int isinstance issubclass len list map max min open print range repr set str sum super tuple type zip",
    "javascript": _JS,
    "typescript": _JS,
    "go": "append cap close complex copy delete imag len make new panic print println real recover",
    "rust": "Default Err None Ok Option Result Some assert! assert_eq! format! panic! print! println! vec!",
    "swift": "abs assert count fatalError max min precondition print",
    "c": _C,
    "cpp": _C + " cerr cin cout endl std",
    "kotlin": "also apply arrayOf check emptyList emptyMap emptySet error let listOf mapOf mutableListOf mutableMapOf mutableSetOf print println repeat require run setOf takeIf takeUnless",
    "ocaml": "failwith ignore print_endline print_string raise ref",
    "dart": "assert identical identityHashCode print",
}
STDLIB = {
    "python": "collections functools hashlib itertools json log logger logging math multiprocessing os pathlib pytest re shutil socket subprocess sys threading time typing unittest urllib",
    "javascript": "fs path",
    "typescript": "fs path",
    "go": "bufio bytes context errors fmt http io net os strconv strings sync time",
    "rust": "alloc core std",
    "swift": "AppKit Combine Foundation SwiftUI UIKit",
    "kotlin": "java kotlin kotlinx",
    "ocaml": "Array Hashtbl List Map Printf Set String",
    "dart": "dart",
}
SIBLINGS = ("go", "ocaml", "swift")
COMMON_METHODS = frozenset(
    "add append as_mut as_ref as_str cancel clear clone close contains copy count decode default encode err expect filter find first flush forEach format from get index insert into into_iter isEmpty "
    "is_empty items iter iter_mut join keys last len length map new next ok parse pop push read receive reduce remove resume send set size sorted split start stop suspend to_str to_string unwrap update "
    "values write".split()
)
CLASS_LIKE = ("class", "enum", "interface", "struct")


def _member(table: dict[str, str], lang: Column, symbol: Column) -> Column:
    return F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))]), lang), symbol), F.lit(False))


def is_builtin(lang: Column, symbol: Column) -> Column:
    return _member(BUILTINS, lang, symbol)


def is_stdlib(lang: Column, symbol: Column) -> Column:
    return _member(STDLIB, lang, symbol)


def sql_list(table: dict[str, str]) -> str:
    """The table as rows (lang, symbol) for SQL."""
    return ", ".join(f"('{k}', '{s}')" for k, v in table.items() for s in v.split())
