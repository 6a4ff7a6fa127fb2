"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One character that belongs to a word: anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where a local session names none, as in tests, a temporary folder of this machine is set; a cluster has to name one.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        given = spark.sparkContext.getCheckpointDir()
        if given:
            return given
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(known)
        return spark.sparkContext.getCheckpointDir()
    return known


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/weft/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def spent_shuffles_removed(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as their job has ended, not whenever the driver collects its garbage.

    Meant for steps that end in :func:`materialize`, since nothing reads their shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop_materialized(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table that :func:`materialize` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, whatever the optimizer collapses."""
    return F.transform(F.array(value), body)[0]


#: So many edges are contracted in one task, whose memory they bound; more are first contracted by rounds over all tasks.
ONE_TASK = 1 << 20


def _roots(batches):
    """(node, root) by union-find over all edges of this task; root = smallest node reachable."""
    parts = [np.stack([np.asarray(b.column(0)), np.asarray(b.column(1))], 1) for b in batches if b.num_rows]
    if not parts:
        return
    node, at = np.unique(np.concatenate(parts), return_inverse=True)
    up = list(range(len(node)))
    for a, b in at.reshape(-1, 2).tolist():
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a < b:
            up[b] = a
        else:
            up[a] = b
    for i, j in enumerate(up):  # parents are smaller, so theirs are settled
        up[i] = up[j]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[up])], names=["node", "root"])


def connected_components(edges: DataFrame, tag: str = "cc", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for all end points of ``edges(a, b)``; component = smallest node reachable.

    Contraction by random minima: every round each node maps to the neighbour (or itself) with the smallest hash,
    which removes a constant share of the nodes, so rounds grow with the logarithm of their number.  Minima combine
    before the shuffle, so a hub costs no more than its edges.  Once ``one_task`` edges or fewer are left, one task ends it.
    """
    edges = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), tag)
    maps, r = [], 0
    while edges.count() > one_task:
        rank = lambda c, r=r: F.struct(F.xxhash64(c, F.lit(r)).alias("h"), c.alias("v"))
        both = edges.select(F.col("a").alias("node"), rank(F.col("b")).alias("o")).unionAll(
            edges.select(F.col("b").alias("node"), rank(F.col("a")).alias("o"))
        )
        step = both.groupBy("node").agg(F.min("o").alias("o")).select("node", F.least("o", rank(F.col("node")))["v"].alias("root"))
        step = materialize(step, tag)
        maps.append(step)
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        after = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        after = materialize(after, tag)
        drop_materialized(edges.sparkSession, edges)
        edges, r = after, r + 1
    maps.append(edges.coalesce(1).mapInArrow(_roots, "node long, root long"))
    found = maps[0]
    for step in maps[1:]:
        found = found.join(step.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    if not r:
        return found.select("node", F.col("root").alias("component"))
    smallest = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(smallest, "root").select("node", "component")
