"""What changed, and what has to be built again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dirty_files(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, reason): files whose time or size differs, new ones, and removed ones.  Both tables: path, mtime_ns, size."""
    c = cached.select(F.col("path").alias("p"), F.col("mtime_ns").alias("m"), F.col("size").alias("s"))
    both = current.join(c, current.path == c.p, "full_outer")
    reason = F.when(F.col("p").isNull(), "new").when(F.col("path").isNull(), "removed").when((F.col("m") != F.col("mtime_ns")) | (F.col("s") != F.col("size")), "changed")
    return both.select(F.coalesce("path", "p").alias("path"), reason.alias("reason")).where("reason IS NOT NULL")


def removed_files(current: DataFrame, cached: DataFrame) -> DataFrame:
    return cached.select("path").join(current.select("path"), "path", "left_anti")


def obsolete(on_disk: DataFrame, rendered: DataFrame, skipped: DataFrame) -> DataFrame:
    """Pages on disk that no run wants any more."""
    return on_disk.join(rendered.select("path").unionByName(skipped.select("path")), "path", "left_anti")


def vault_plan(new: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(path, action): write, keep (equal content) or delete.  Tables: path, md5."""
    d = on_disk.select(F.col("path").alias("p"), F.col("md5").alias("old"))
    both = new.join(d, new.path == d.p, "full_outer")
    action = F.when(F.col("path").isNull(), "delete").when(F.col("md5").eqNullSafe(F.col("old")), "keep").otherwise("write")
    return both.select(F.coalesce("path", "p").alias("path"), action.alias("action"))


#: Stands for null, so that (a, null) and (null, a) have different digests.
NULL = "\u2205"


def listed(*parts) -> Column:
    """A list of a group's strings in order, as one string."""
    return F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *[F.coalesce(p, F.lit(NULL)) for p in parts]))), ";")


def ends_by_node(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key or id, relation, other) of the edges from each node and of those to it; ``other`` is an id where ``nodes`` has keys, too."""
    if "key" not in nodes.columns:
        return edges.select(F.col("src").alias("id"), "relation", F.col("dst").alias("other")), edges.select(F.col("dst").alias("id"), "relation", F.col("src").alias("other"))
    names = nodes.where("key IS NOT NULL").groupBy("key").agg(F.first("id").alias("other"))
    one, two = (edges.join(names.withColumnRenamed("key", far), far, "left").select(F.col(near).alias("key"), "relation", "other") for near, far in (("src", "dst"), ("dst", "src")))
    return one, two


def node_signatures(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, signature): a digest of all that a node's page shows: its attributes, its edges in order, and its component.

    If ``nodes`` has a ``key``, a number that stands for the id, the ends of ``edges`` are keys.
    """
    out, into = ends_by_node(nodes, edges)
    key = "key" if "key" in nodes.columns else "id"
    out = out.groupBy(key).agg(listed("relation", "other").alias("o"))
    into = into.groupBy(key).agg(listed("relation", "other").alias("i"))
    rows = nodes.join(out, key, "left").join(into, key, "left")
    known = [c for c in ("id", "label", "type", "source_file", "line_start", "line_end", "signature", "docstring", "name", "comp") if c in nodes.columns]
    text = F.concat_ws("#", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in known], F.coalesce("o", F.lit("")), F.coalesce("i", F.lit("")))
    return rows.select("id", F.md5(text).alias("signature"))


def component_signatures(nodes: DataFrame, inter: DataFrame) -> DataFrame:
    """(comp, signature) of members and dependencies."""
    m = nodes.groupBy("comp").agg(F.array_join(F.array_sort(F.collect_list("id")), ";").alias("m"))
    d = inter.groupBy(F.col("src_comp").alias("comp")).agg(listed(F.col("dst_comp").cast("string"), F.col("n").cast("string")).alias("d"))
    return m.join(d, "comp", "left").select("comp", F.md5(F.concat_ws("#", F.col("comp").cast("string"), "m", F.coalesce("d", F.lit("")))).alias("signature"))


def fingerprint(files: DataFrame, **knobs) -> DataFrame:
    """One row: a digest of all file digests and of the settings that change a build.  ``files``: path, md5."""
    # Files are digested by their directory first, so that no list grows with the workspace's files alone.
    dirs = files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir")).agg(F.md5(listed("path", "md5")).alias("h"))
    own = ",".join(f"{k}={v}" for k, v in sorted(knobs.items()))
    return dirs.agg(F.md5(F.concat(listed("dir", "h"), F.lit("#" + own))).alias("fingerprint"))


def render_plan(new: DataFrame, old: DataFrame, on_disk: DataFrame, forced: DataFrame, cache: bool = True) -> DataFrame:
    """(id, action): reuse a page if the cache is on, its signature is equal, it is on disk and not forced; else render."""
    o = old.select("id", F.col("signature").alias("was"))
    d = on_disk.select("id", F.lit(True).alias("there"))
    f = forced.select("id", F.lit(True).alias("forced"))
    rows = new.join(o, "id", "left").join(d, "id", "left").join(f, "id", "left")
    reuse = F.lit(cache) & (F.col("signature") == F.col("was")) & F.col("there") & F.col("forced").isNull()
    return rows.select("id", F.when(F.coalesce(reuse, F.lit(False)), "reuse").otherwise("render").alias("action"))


def section_after(text: Column, marker: str) -> Column:
    """What follows the marker, kept across builds."""
    return F.when(F.contains(text, F.lit(marker)), F.substring(text, F.instr(text, marker) + F.lit(len(marker)), F.length(text)))
