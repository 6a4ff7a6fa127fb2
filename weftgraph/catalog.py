"""All queries of the engine's own operators with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.plans import code, docs, trade, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for module in (trade, code, docs, workspace):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
