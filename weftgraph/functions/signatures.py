"""Scalar functions over callees, type names and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def callee_parts(callee: Column) -> Column:
    """``a::b. c`` as [a, b, c]: separators unified, trimmed, empty parts dropped."""
    return F.filter(F.transform(F.split(F.replace(callee, F.lit("::"), F.lit(".")), r"\."), lambda x: F.trim(x)), lambda x: x != "")


def normalize_type(name: Column) -> Column:
    """A type name without call parentheses and without parameters."""
    return F.trim(F.split_part(F.regexp_replace(F.trim(name), r"\(\)$", ""), F.lit("["), F.lit(1)))


def strip_call(segment: Column) -> Column:
    return F.trim(F.split_part(segment, F.lit("("), F.lit(1)))


def null_if_empty(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def _last(c: Column, pattern: str) -> Column:
    return F.element_at(F.split(c, pattern), -1)


def after_last_paren(signature: Column) -> Column:
    return F.when(F.instr(signature, ")") > 0, _last(signature, r"\)"))


def arrow_return_type(signature: Column) -> Column:
    """The type after ``->``: the inner one of a generic, without its path."""
    whole = F.regexp_extract(signature, r"->\s*([A-Za-z0-9_:.<>]+)", 1)
    inner = F.regexp_extract(whole, r"<([A-Za-z0-9_:.]+)>", 1)
    return null_if_empty(_last(F.when(inner != "", inner).otherwise(whole), r"::|\."))


def go_return_type(signature: Column) -> Column:
    """The last word between the last parenthesis and the body; nothing for several values, or for errors and plain values."""
    words = F.split(F.trim(F.split_part(after_last_paren(signature), F.lit("{"), F.lit(1))), r"\s+")
    t = F.regexp_replace(F.regexp_replace(F.element_at(words, -1), r"^\*+", ""), r"^[\[\]]+", "")
    return F.when(t.isin("", "error", "bool", "int", "string"), None).otherwise(t)


def kotlin_return_type(signature: Column) -> Column:
    whole = F.regexp_extract(after_last_paren(signature), r":\s*([A-Za-z0-9_<>]+)", 1)
    inner = F.regexp_extract(whole, r"<([A-Za-z0-9_]+)>", 1)
    return null_if_empty(F.when(inner != "", inner).otherwise(whole))


C_WORDS = ("inline", "static", "virtual", "friend", "const", "constexpr")


def c_return_type(signature: Column) -> Column:
    """The first word that is no storage or type qualifier, unless it holds a parenthesis."""
    words = F.split(F.trim(signature), r"\s+")
    bare = F.get(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), F.forall(F.slice(words, F.lit(1), i), lambda v: v.isin(*C_WORDS)).alias("lead"))), lambda x: x["lead"] & ~x["w"].isin(*C_WORDS)), 0)["w"]
    return F.when(bare.rlike("[()]"), None).otherwise(null_if_empty(_last(F.regexp_replace(bare, "[*&]", ""), "::")))


def dart_return_type(signature: Column) -> Column:
    lead = F.regexp_extract(signature, r"^\s*([\w<>,.\s]+?)\s+[\w$]+\s*\(", 1)
    inner = F.regexp_extract(lead, r"(?:Future|Stream)<([\w.]+)>", 1)
    return null_if_empty(_last(F.when(inner != "", inner).otherwise(lead), r"\."))


def return_type(signature: Column, lang: Column) -> Column:
    """A signature's return type by the rules of its language; none for languages without types in front or behind."""
    return (
        F.when(lang.isin("python", "rust", "swift"), arrow_return_type(signature))
        .when(lang == "go", go_return_type(signature))
        .when(lang == "kotlin", kotlin_return_type(signature))
        .when(lang.isin("c", "cpp"), c_return_type(signature))
        .when(lang == "dart", dart_return_type(signature))
    )


_BY_LANGUAGE = "python:.py,/__init__.py javascript:.js,.mjs,.cjs typescript:.ts,.tsx kotlin:.kt,.kts go:.go rust:.rs,/mod.rs swift:.swift c:.h,.hpp,.hxx,.c,.cpp,.cc,.cxx cpp:.h,.hpp,.hxx,.c,.cpp,.cc,.cxx ocaml:.ml,.mli dart:.dart"
#: In the order in which an import tries them.
SUFFIXES = {lang: tuple(many.split(",")) for lang, many in (x.split(":") for x in _BY_LANGUAGE.split())}


def import_candidates(target: Column, lang: Column) -> Column:
    """Paths an import may mean, the likeliest first."""
    slash = F.replace(target, F.lit("."), F.lit("/"))
    rust = F.replace(F.replace(target, F.lit("::"), F.lit("/")), F.lit("."), F.lit("/"))
    out = None
    for name, many in SUFFIXES.items():
        base = rust if name == "rust" else slash
        if name == "ocaml":
            forms = [target, F.lower(target), F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, 2, 1_000_000))]
            value = F.array_distinct(F.array(*[F.concat(f, F.lit(s)) for f in forms for s in many]))
        elif name == "dart":
            own = F.regexp_replace(target, "^package:[^/]+/", "lib/")
            value = F.array_distinct(F.array(own, F.when(F.endswith(own, F.lit(".dart")), own).otherwise(F.concat(own, F.lit(".dart")))))
        else:
            value = F.array(base, *[F.concat(base, F.lit(s)) for s in many])
        out = F.when(lang == name, value) if out is None else out.when(lang == name, value)
    return out


def is_path_target(target: Column, lang: Column) -> Column:
    """An import that names a file, not a module."""
    plain = F.startswith(target, F.lit(".")) | F.contains(target, F.lit("/")) | F.contains(target, F.lit("\\"))
    return plain | (lang.isin("c", "cpp") & target.rlike(r"\.(h|hpp|hxx|c|cpp|cc|cxx)$"))
