"""Communities of the code graph: weighting, detection, cohesion, naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.paths import base_name, dir_name, is_test_path
from weftgraph.operators.graph import cut, degrees, first_by

WEIGHTS = {"contains": 10.0, "imports": 2.0}
SAME_DIR = 1.5
#: The totals of so many communities are sent to all tasks.
SENT = 1 << 16


def weighted_edges(nodes: DataFrame, edges: DataFrame, exclude_tests: bool = True) -> DataFrame:
    """(a, b, weight), a <= b: both directions added up, by relation, more within a directory; test nodes left out."""
    kept = nodes.where(~is_test_path(F.col("source_file"))) if exclude_tests else nodes
    kept = kept.select("id", dir_name(F.col("source_file")).alias("dir"))
    both = edges.join(kept.toDF("src", "ds"), "src").join(kept.toDF("dst", "dd"), "dst")
    w = F.when(F.col("relation") == "contains", WEIGHTS["contains"]).when(F.col("relation") == "imports", WEIGHTS["imports"]).otherwise(1.0)
    w = w * F.when((F.col("ds") != "") & (F.col("ds") == F.col("dd")), SAME_DIR).otherwise(1.0)
    return both.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(w).alias("weight"))


def cohesion(member: DataFrame, edges: DataFrame, digits: int = 2) -> DataFrame:
    """(comp, size, edges, cohesion): directed density of the subgraph each component induces."""
    a, b = member.select(F.col("id").alias("src"), F.col("comp").alias("ca")), member.select(F.col("id").alias("dst"), F.col("comp").alias("cb"))
    inner = edges.join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("comp")).agg(F.count("*").alias("m"))
    size = member.groupBy("comp").agg(F.count("*").alias("size"))
    m, n = F.coalesce("m", F.lit(0)), F.col("size")
    return size.join(inner, "comp", "left").select("comp", "size", m.alias("edges"), F.when(n > 1, F.round(m / (n * (n - 1)), digits)).otherwise(0.0).alias("cohesion"))


def hub(nodes: DataFrame, edges: DataFrame, member: DataFrame) -> DataFrame:
    """(comp, id, label) of each component's naming hub: production symbols first, then by degree, then id."""
    d = degrees(nodes, edges).select("id", "degree")
    rows = member.join(nodes.select("id", "label", "type", "source_file"), "id").join(d, "id")
    rank = F.struct(is_test_path(F.col("source_file")).cast("int"), (F.col("type") == "file").cast("int"), -F.col("degree"), F.col("id"))
    return rows.groupBy("comp").agg(F.min_by(F.struct("id", "label"), rank).alias("h")).select("comp", "h.id", "h.label")


def ranked(member: DataFrame) -> DataFrame:
    """(comp, rank): components by size, largest first, ties by their smallest member; from 1."""
    size = member.groupBy("comp").agg(F.count("*").alias("size"), F.min("id").alias("low"))
    return size.select("comp", "size", F.row_number().over(W.orderBy(F.desc("size"), "low")).alias("rank"))


def common_dir(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """(comp, dir): the longest directory that holds all members; empty if there is none.

    Sorted by segments, the prefix that the first and the last path share is the one all share, so two aggregates do.
    """
    d = member.join(nodes.select("id", dir_name(F.col("source_file")).alias("d")), "id").where("d <> ''")
    ends = d.groupBy("comp").agg(F.min(F.split("d", "/")).alias("lo"), F.max(F.split("d", "/")).alias("hi"))
    same = F.transform(F.arrays_zip("lo", "hi"), lambda z: F.coalesce(z["lo"] == z["hi"], F.lit(False)))
    n = F.array_position(F.array_append(same, F.lit(False)), False) - 1
    found = ends.select("comp", F.array_join(F.slice("lo", F.lit(1), n.cast("int")), "/").alias("dir"))
    return member.select("comp").distinct().join(found, "comp", "left").select("comp", F.coalesce("dir", F.lit("")).alias("dir"))


def names(hubs: DataFrame, dirs: DataFrame, mode: str = "hybrid") -> DataFrame:
    """(comp, name) from hub label and directory, by ``mode``: hybrid, package or symbol; equal names are told apart."""
    clean = F.split_part(F.replace(F.col("label"), F.lit("()"), F.lit("")), F.lit("."), F.lit(1))
    parts = F.split("dir", "/")
    short = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(F.col("dir"))
    rows = hubs.join(dirs, "comp").select("comp", "dir", clean.alias("clean"), short.alias("pkg"))
    has = F.col("dir") != ""
    if mode == "symbol":
        candidate = F.col("clean")
    elif mode == "package":
        candidate = F.when(has, F.col("pkg")).otherwise(F.col("clean"))
    else:
        both = F.concat("pkg", F.lit(" ("), "clean", F.lit(")"))
        candidate = F.when(has & (F.col("clean") != ""), F.when((F.col("pkg") != F.col("clean")) & ~F.startswith("clean", "pkg"), both).otherwise(F.col("pkg"))).when(has, F.col("pkg")).otherwise(F.col("clean"))
    rows = rows.withColumn("cand", candidate)
    twins = rows.groupBy("cand").agg(F.count("*").alias("twins"))
    apart = F.concat("cand", F.lit(" ("), "clean", F.lit(")")) if mode != "symbol" else F.concat("clean", F.lit(" ("), "pkg", F.lit(")"))
    numbered = F.concat("clean", F.lit(" (Component "), F.col("comp").cast("string"), F.lit(")"))
    return rows.join(twins, "cand").select("comp", F.when(F.col("twins") == 1, F.col("cand")).when(has, apart).otherwise(numbered).alias("name"))


def attach_tests(tests: DataFrame, edges: DataFrame, member: DataFrame) -> DataFrame:
    """(id, comp): each test node goes where most of its neighbours are, ties to the lowest component; null without any."""
    node = tests.select(F.col("id").alias("node"))
    near = [edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour")).join(node, "node", "left_semi") for a, b in (("src", "dst"), ("dst", "src"))]
    near = near[0].union(near[1]).distinct()
    votes = near.join(member.toDF("neighbour", "comp"), "neighbour").groupBy("node", "comp").agg(F.count("*").alias("n"))
    best = first_by(votes, ["node"], F.desc("n"), "comp").select(F.col("node").alias("id"), "comp")
    return tests.select("id").join(best, "id", "left")


def modularity(weighted: DataFrame, member: DataFrame) -> DataFrame:
    """One row: weighted modularity of a partition; the edges are computed once."""
    weighted = cut(weighted)
    a, b = member.toDF("a", "ca"), member.toDF("b", "cb")
    e = weighted.join(a, "a").join(b, "b")
    total = F.sum("weight")
    strength = weighted.select(F.col("a").alias("id"), "weight").unionAll(weighted.select(F.col("b").alias("id"), "weight")).join(member, "id")
    k = strength.groupBy("comp").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    m = e.agg(total.alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("w"))
    return m.crossJoin(k).select(F.round(F.col("w") / F.col("m") - F.col("k2") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))


def louvain(weighted: DataFrame, ids: DataFrame, *, marks: DataFrame | None = None, threshold: float = 1e-4, levels: int = 10, sweeps: int = 12) -> DataFrame:
    """(id, comp): communities by synchronous local moves and contraction.

    In each sweep every node compares the gain of its neighbours' communities and moves to the best; nodes of one parity of a hash
    move at a time, so that neighbours do not swap places for ever.  A level ends when a sweep gains less than ``threshold`` in
    modularity; communities then become nodes.  Community totals come from aggregates; nothing but the gain reaches the driver.
    Edges are gone through once a sweep, for both the modularity that it reached and the moves of the next.

    ``marks``: (id, tie, half) of all ids, if they stand for others whose hashes decide ties and turns.
    """
    member = cut(ids.select("id", F.col("id").alias("comp")))
    graph = cut(weighted.select("a", "b", "weight"))
    total = graph.agg(F.sum("weight")).first()[0] or 0.0
    if not total:
        return member
    if marks is None:
        marks = member.select("id").distinct().select("id", F.hash("id").alias("tie"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("half"))
    marks = cut(marks)
    for _ in range(levels):
        apart = graph.where("a <> b")
        arcs = apart.select(F.col("a").alias("id"), F.col("b").alias("o"), "weight").unionAll(apart.select(F.col("b").alias("id"), F.col("a").alias("o"), "weight"))
        own = graph.where("a = b")
        loops = own.agg(F.sum("weight")).first()[0] or 0.0
        k = arcs.select("id", F.col("weight").alias("k")).unionAll(own.select(F.col("a").alias("id"), (F.col("weight") * 2).alias("k"))).groupBy("id").agg(F.sum("k").alias("k"))

        def look(own):
            """(id, c, k, half, best community, weight towards its own) of every node, and the modularity."""
            own = cut(own)
            sums = cut(own.groupBy("c").agg(F.sum("k").alias("kc")).join(marks.select(F.col("id").alias("c"), "tie"), "c"))  # noqa: B023
            # Totals of few communities are sent to all tasks; those of many travel with the edges, which would else be shuffled by community too.
            few, at = sums.count() <= SENT, own.select(F.col("id").alias("o"), "c")
            at, carried = (at, []) if few else (at.join(sums, "c"), ["kc", "tie"])
            near = arcs.join(at, "o").select("id", "c", "weight", *carried).repartition("id")  # noqa: B023
            near = near.groupBy("id", "c").agg(F.sum("weight").alias("w"), *[F.first(c).alias(c) for c in carried])
            mine = own.join(sums, "c").select("id", F.col("c").alias("mine"), "k", "half", F.col("kc").alias("kc_mine"), F.col("tie").alias("tie_mine"))
            gain = F.round(F.col("w") - F.col("k") * (F.col("kc") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / (2 * total), 9)
            there = near.join(own.select("id", F.col("c").alias("mine"), "k"), "id")
            there = (there.join(F.broadcast(sums), "c") if few else there).select("id", F.struct(gain.alias("g"), (F.col("c") == F.col("mine")).cast("int").alias("is"), "tie", "c").alias("to"), F.when(F.col("c") == F.col("mine"), F.col("w")).otherwise(0.0).alias("w"))
            best = there.groupBy("id").agg(F.max("to").alias("to"), F.sum("w").alias("inner"))
            stay = F.struct(F.round(-F.col("k") * (F.col("kc_mine") - F.col("k")) / (2 * total), 9).alias("g"), F.lit(1).alias("is"), F.col("tie_mine").alias("tie"), F.col("mine").alias("c"))
            state = cut(mine.join(best, "id", "left").select("id", F.col("mine").alias("c"), "k", "half", F.greatest("to", stay)["c"].alias("best"), F.coalesce("inner", F.lit(0.0)).alias("inner")))
            inner = (state.agg(F.sum("inner")).first()[0] or 0.0) / 2 + loops  # noqa: B023
            k2 = sums.agg(F.sum(F.col("kc") * F.col("kc"))).first()[0]
            return state, inner / total - k2 / (4 * total * total)

        (state, q), moved = look(k.join(marks, "id").select("id", F.col("id").alias("c"), "k", "half")), False
        for sweep in range(sweeps):
            after, q2 = look(state.select("id", F.when(F.col("half") == sweep % 2, F.col("best")).otherwise(F.col("c")).alias("c"), "k", "half"))
            if q2 <= q + (threshold if sweep % 2 else 0.0):
                if q2 > q:
                    state, q, moved = after, q2, True
                if sweep % 2:
                    break
                continue
            state, q, moved = after, q2, True
        if not moved:
            break
        m = state.select("id", "c")
        member = cut(member.join(m.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("c", "comp").alias("comp")))
        graph = cut(graph.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight")))
    return member


def top_dirs(nodes: DataFrame, preview: int = 3) -> DataFrame:
    """(dir, n, sample): files per top-level directory, with the first file names."""
    files = nodes.where("type = 'file'").select(F.when(F.instr("id", "/") > 0, F.split_part("id", F.lit("/"), F.lit(1))).otherwise(F.lit(".")).alias("dir"), base_name(F.col("id")).alias("name"))
    r = files.withColumn("r", F.row_number().over(W.partitionBy("dir").orderBy("name")))
    few = r.where(F.col("r") <= preview).groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("sample"))
    n = files.groupBy("dir").agg(F.count("*").alias("n"))
    return n.join(few, "dir").select("dir", "n", F.when(F.col("n") > preview, F.concat("sample", F.lit(", etc."))).otherwise(F.col("sample")).alias("sample"))


def entry_points(nodes: DataFrame, n: int = 5) -> DataFrame:
    """The first functions and methods named like a program's start."""
    return nodes.where("type IN ('function', 'method')").where(F.lower("label").rlike("main|app|run|cli|serve")).orderBy("seq").limit(n).select("id", "label")
