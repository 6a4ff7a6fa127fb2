"""A stream of new and changed source files into the table of extracted symbols."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.paths import EXCLUDED, is_excluded, language_of
from weftgraph.sources.extract import extract

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, workspace: str, table: str, checkpoint: str):
    """Extract all files that arrived since the last run into ``table`` (Parquet, one partition per batch); returns the finished query.

    Paths are relative to the workspace, as in the batch scan, so ids agree.  A batch replaces its own partition: if it is run again after a
    failure, no row stands twice.  A file source reports no deletions; those are an anti join of the batch operators.
    """
    root = str(Path(workspace).resolve())
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(workspace)
    below = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(root) + "/", "")

    def batch(df: DataFrame, n: int) -> None:
        src = df.withColumn("path", below).withColumn("lang", language_of(F.col("path")))
        src = src.where(F.col("lang").isNotNull() & ~is_excluded(F.col("path"), EXCLUDED))
        extract(src.select("path", "lang", "content")).write.mode("overwrite").parquet(f"{table}/batch={n}")

    query = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The newest extraction of each file."""
    rows = spark.read.parquet(table)
    new = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(new, ["path", "batch"], "left_semi")
