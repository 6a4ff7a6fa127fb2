"""Operators over a directed graph of nodes and edges."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.paths import is_test_path



def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative plan: write to the folder the executors share and read it back."""
    spark: SparkSession = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="weft-"))
        shared = spark.sparkContext.getCheckpointDir()
    path = f"{shared.rstrip('/')}/weft-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dedup_edges(raw: DataFrame) -> DataFrame:
    """One edge per ordered pair: the last relation stays."""
    return raw.groupBy("src", "dst").agg(F.max(F.struct("seq", "relation")).alias("m")).select("src", "dst", F.col("m.relation").alias("relation"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges.src == ids.id, "left_semi").join(ids, edges.dst == ids.id, "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) of every node; a self-loop counts twice."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    got = nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))
    return got.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def god_nodes(nodes: DataFrame, edges: DataFrame, n: int = 10, exclude_tests: bool = True) -> DataFrame:
    """The ``n`` nodes of highest degree; ties in order of appearance."""
    kept = nodes.where(~is_test_path(F.col("source_file"))) if exclude_tests else nodes
    d = degrees(nodes, edges)
    return kept.join(d, "id").orderBy(F.desc("degree"), "seq").limit(n).select("id", "label", "type", "in_degree", "out_degree", "degree")


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, files, symbols, test files, edges."""
    test = is_test_path(F.col("source_file"))
    a = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") != "file").alias("symbols"), F.count_if((F.col("type") == "file") & test).alias("test_files"))
    return a.crossJoin(edges.agg(F.count("*").alias("edges")))


def between(edges: DataFrame, nodes: DataFrame, relation: str, files: bool) -> DataFrame:
    """Edges of one relation between files, or between symbols other than themselves."""
    kind = nodes.where((F.col("type") == "file") == F.lit(files)).select("id")
    own = edges.where(F.col("relation") == relation)
    own = own if files else own.where("src <> dst")
    return own.join(kind, own.src == kind.id, "left_semi").join(kind, own.dst == kind.id, "left_semi").select("src", "dst")


def neighborhood(edges: DataFrame) -> DataFrame:
    """(node, neighbour): successors and predecessors, each once."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"))).distinct()


def dependents(imports: DataFrame, dirty: DataFrame) -> DataFrame:
    """The dirty files and those one import away, in either direction."""
    d = dirty.select("file")
    into = imports.join(d, imports.dst == d.file, "left_semi").select(F.col("src").alias("file"))
    out = imports.join(d, imports.src == d.file, "left_semi").select(F.col("dst").alias("file"))
    return d.union(into).union(out).distinct()


def inter_component(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(src_comp, dst_comp, n): edges between different components; ``member``: id, comp."""
    a, b = member.select(F.col("id").alias("src"), F.col("comp").alias("src_comp")), member.select(F.col("id").alias("dst"), F.col("comp").alias("dst_comp"))
    return edges.join(a, "src").join(b, "dst").where("src_comp <> dst_comp").groupBy("src_comp", "dst_comp").agg(F.count("*").alias("n"))


#: Graphs of so many edges are solved in one task, whose memory they bound; larger ones by rounds over all tasks.
ONE_TASK = 1 << 20


def _components(batches):
    """(id, scc) of the nodes on cycles, by depth-first search without recursion over all edges of this task."""
    out: dict = {}
    for b in batches:
        for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            out.setdefault(a, []).append(z)
    index, low, stack, on, found = {}, {}, [], set(), []
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        work = [(start, iter(out[start]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = [stack.pop()]
                    while group[-1] != v:
                        group.append(stack.pop())
                    on.difference_update(group)
                    if len(group) > 1:
                        name = min(group)
                        found += [(x, name) for x in group]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found]), pa.array([y for _, y in found])], names=["id", "scc"])


def scc(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, scc): strongly connected components, named by their smallest member.

    Small graphs are solved by one depth-first search.  Larger ones: trims nodes that cannot lie on a cycle, then colours: the smallest node that reaches each node by forward propagation; the nodes of
    a colour that reach its root backwards form a component.  Every loop runs on distributed frontiers.
    """
    left = cut(edges.where("src <> dst").select("src", "dst").distinct())
    every = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    if left.count() <= one_task:
        kind = left.schema["src"].dataType.simpleString()
        found = left.coalesce(1).mapInArrow(_components, f"id {kind}, scc {kind}")
        return every.join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))
    found = None
    while True:
        while True:  # trim
            n = left.count()
            s, d = left.select(F.col("src").alias("k")).distinct(), left.select(F.col("dst").alias("k")).distinct()
            both = s.join(d, "k", "left_semi")
            left = cut(left.join(both, left.src == both.k, "left_semi").join(both, left.dst == both.k, "left_semi"))
            if left.count() == n:
                break
        if n == 0:
            break
        colour = cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("c", F.col("id")))
        while True:
            seen = left.join(colour, left.src == colour.id).select(F.col("dst").alias("id"), "c")
            new = cut(colour.unionByName(seen).groupBy("id").agg(F.min("c").alias("c")))
            changed = new.join(colour, ["id", "c"], "left_anti").limit(1).count()
            colour = new
            if not changed:
                break
        inner = left.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        inner = cut(inner)
        back = cut(colour.where("id = c").select("id", "c"))
        front = back
        while True:
            front = inner.join(front.toDF("dst", "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct().join(back, ["id", "c"], "left_anti")
            front = cut(front)
            if front.isEmpty():
                break
            back = cut(back.unionByName(front))
        got = back.toDF("id", "scc")
        found = got if found is None else found.unionByName(got)
        gone = got.select("id")
        left = cut(left.join(gone, left.src == gone.id, "left_anti").join(gone, left.dst == gone.id, "left_anti"))
    if found is None:
        return every.withColumn("scc", F.col("id"))
    return every.join(found, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


#: Between so many edges on cycles the walks run in the tasks, each from its own start nodes; among more they are rows of a frontier.
WALKED = 1 << 14


def _walks(out: dict[str, list[str]], max_len: int | None, min_len: int, sep: str):
    """A task that yields the cycles whose smallest node is one of its rows."""

    def run(batches):
        for batch in batches:
            found: list[tuple[str, int]] = []
            for first in batch.column(0).to_pylist():
                path, on, work = [first], {first}, [iter(out.get(first, ()))]
                while work:
                    for v in work[-1]:
                        if v == first and len(path) >= max(2, min_len):
                            found.append((sep.join(path), len(path)))
                        elif v > first and v not in on and (max_len is None or len(path) < max_len):
                            path.append(v)
                            on.add(v)
                            work.append(iter(out.get(v, ())))
                            break
                    else:
                        work.pop()
                        on.discard(path.pop())
                    if len(found) >= 1 << 14:
                        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in found]), "length": pa.array([n for _, n in found], pa.int32())})
                        found = []
            if found:
                yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in found]), "length": pa.array([n for _, n in found], pa.int32())})

    return run


def simple_cycles(edges: DataFrame, max_len: int | None = None, min_len: int = 1, sep: str = " > ", walked: int = WALKED) -> DataFrame:
    """(path, length): each simple cycle (of at most ``max_len`` nodes, if given) once, starting at its smallest node.

    The edges are computed once.  Those between strongly connected components are pruned first; the frontier holds open paths whose first node is the smallest.
    Without a bound the loop ends when no open path is left; cycles can be exponential in their length.
    """
    edges = cut(edges.select("src", "dst"))
    loops = edges.where("src = dst").select(F.col("src").alias("path"), F.lit(1).alias("length")).distinct() if min_len <= 1 else None
    comp = cut(scc(edges))
    e = edges.where("src <> dst").select("src", "dst").distinct()
    e = cut(e.join(comp.toDF("src", "cs"), "src").join(comp.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst"))
    if e.count() <= walked:
        near: dict[str, list[str]] = {}
        for r in e.collect():  # at most ``walked`` rows
            near.setdefault(r.src, []).append(r.dst)
        starts = e.select(F.col("src").cast("string").alias("id")).distinct()
        text = {str(k): sorted(map(str, v)) for k, v in near.items()}
        found = starts.mapInArrow(_walks(text, max_len, min_len, sep), "path string, length int")
        return found if loops is None else loops.unionByName(found)
    front = e.where("dst > src").select(F.array("src", "dst").alias("p"))
    out = loops
    n = 1
    while max_len is None or n < max_len:
        n += 1
        front = cut(front)
        if front.isEmpty():
            break
        last = F.element_at("p", -1)
        step = front.join(e, last == e.src)
        closed = step.where(F.col("dst") == F.col("p")[0]).select(F.concat_ws(sep, "p").alias("path"), F.lit(n).alias("length"))
        if n >= min_len:
            out = closed if out is None else out.unionByName(closed)
        front = step.where((F.col("dst") > F.col("p")[0]) & ~F.array_contains("p", F.col("dst"))).select(F.array_append("p", F.col("dst")).alias("p"))
    return out if out is not None else edges.select(F.col("src").alias("path"), F.lit(0).alias("length")).limit(0)


def call_cycles(edges: DataFrame, most: int = 20, max_len: int = 8) -> DataFrame:
    """At most ``most`` call cycles of two to ``max_len`` nodes, shortest first."""
    return simple_cycles(edges, max_len, 2).orderBy("length", "path").limit(most)


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
