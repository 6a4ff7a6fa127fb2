"""The corpus pipeline: language ID, line dedup, near-duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last return the columns of documents:
texts change in line dedup alone, and mixing repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import language_id, line_dedup, mixing, packing, simhash
from weftgraph.llm.common import materialize, read_table

STAGES = [
    ("language_id", language_id.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash", simhash.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]
#: Clustering, near-duplicate search and packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
