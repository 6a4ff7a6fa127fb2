"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 8).

Every document gets an exponential key ``-ln(u) / w`` (``u`` a hash of its id, ``w`` its quality weight); within a source the
documents with the smallest keys are a weighted sample without replacement.  A source whose target exceeds its size first
gives complete epochs (every document once more each), then the part that is left is filled by the prefix of the key order.

Scale: the text is reduced to one count per row in the scan.  Prefix sums run over (source, bucket of the key): bucket sums
combine before the shuffle, so a source with a third of all rows is spread over ``buckets`` groups.  The sources, one aggregated row each,
are ranked by a sort of that small table (it spills, and is never collected); their targets come from aggregates (water filling).

Cases: very long texts are one row with a large size (a source is off its target by half of one document at most); null or empty texts have size 0 and ``taken`` 0 (they add no words); a null source is a source of its own, last in
order; equal ids get equal keys and are told apart by size, then are interchangeable; an empty table gives an empty result; extra columns
are kept in ``mix`` and never clash, since working columns are prefixed ``_m_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, materialize, read_table

#: Sources by code point, null last, take these weights in turn.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
SYMBOLS = "#*$%&|<>0123456789"


def quality_weight(text: Column) -> Column:
    """0.25 to 1: the share of characters that are neither digits nor markup symbols."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    return F.lit(0.25) + F.lit(0.75) * F.when(chars > 0, F.length(F.translate(text, SYMBOLS, "")) / chars).otherwise(F.lit(1.0))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) per source.

    ``share`` times all sizes is split by weight; a source stops at ``most`` times its size and the excess is shared again by
    weight among the rest, until none is above.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = materialize(ranked, "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(float(most))
        row = ranked.agg(
            F.sum(F.when(above, F.col("source_size") * F.lit(float(most))).otherwise(0.0)).alias("full"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("w"),
        ).first()
        after = (budget - row.full) / row.w if row.w else level
        if not row.w or after <= level:
            break
        level = after
    target = F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(float(most)))
    return ranked.withColumn("target", target)


def mix(docs: DataFrame, size: Column, weight: Column, *, id_col: str = "doc_id", source_col: str = "source", seed: int = 20, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` with ``_m_size``, ``_m_source_size``, ``_m_target`` and ``_m_copies`` (how often the mix takes the row)."""
    key = -F.log(uniform(F.col(id_col), seed)) / F.col("_m_w")
    rows = docs.withColumns({"_m_size": size, "_m_w": weight}).withColumns({"_m_key": key, "_m_src": F.col(source_col)})
    sums = materialize(rows.groupBy(F.col("_m_src").alias("source")).agg(F.sum("_m_size").alias("source_size"), F.count("*").alias("n")), "mix-sizes")
    n = sums.agg(F.max("n")).first()[0] or 0
    buckets = max(16, 2 ** math.ceil(math.log2(max(1, n) / 20_000 + 1)) * 16)
    targets = source_targets(sums.select("source", "source_size"), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = materialize(targets, "mix-targets")
    t = targets.select(F.col("source").alias("_m_s"), F.col("source_size").alias("_m_source_size"), F.col("target").alias("_m_target"), F.col("epochs").alias("_m_epochs"), F.col("rest").alias("_m_rest"))

    rows = rows.withColumn("_m_b", F.floor((F.lit(1.0) - F.exp(-F.col("_m_key"))) * buckets))
    slim = rows.select(F.col(id_col).alias("_m_id"), "_m_src", "_m_b", "_m_key", "_m_size")
    by_bucket = slim.groupBy("_m_src", "_m_b").agg(F.sum("_m_size").alias("_m_sum"))
    before = by_bucket.withColumn("_m_before", F.sum("_m_sum").over(W.partitionBy("_m_src").orderBy("_m_b").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(F.col("_m_src").alias("_m_s2"), F.col("_m_b").alias("_m_b2"), F.coalesce("_m_before", F.lit(0)).alias("_m_before"))
    inside = W.partitionBy("_m_src", "_m_b").orderBy("_m_key", id_col, "_m_size").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_m_upto", F.sum("_m_size").over(inside))
    out = out.join(before, F.col("_m_src").eqNullSafe(F.col("_m_s2")) & (F.col("_m_b") == F.col("_m_b2")))
    out = out.join(t, F.col("_m_src").eqNullSafe(F.col("_m_s")))
    # The document in which the target falls is taken if that comes nearer to the target.
    more = (F.col("_m_before") + F.col("_m_upto") - F.col("_m_size") / 2.0 <= F.col("_m_rest")) & (F.col("_m_rest") > 0)
    out = out.withColumn("_m_copies", (F.col("_m_epochs") + more.cast("int")).cast("long"))
    return out.drop("_m_w", "_m_src", "_m_key", "_m_b", "_m_upto", "_m_s2", "_m_b2", "_m_before", "_m_s", "_m_epochs", "_m_rest")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    slim = docs.select("doc_id", "source", F.coalesce(count_words(F.col("text")), F.lit(0)).alias("size"), quality_weight(F.col("text")).alias("w"))
    out = mix(materialize(slim, "mix-docs"), F.col("size"), F.col("w"))
    return out.select("doc_id", "size", F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), (F.col("_m_copies") * F.col("size")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; documents without a word are in no budget and go."""
    names = docs.columns
    slim = docs.select("doc_id", "source", F.coalesce(count_words(F.col("text")), F.lit(0)).alias("size"), quality_weight(F.col("text")).alias("w"), F.xxhash64("text").alias("h"))
    copies = mix(materialize(slim, "mix-docs"), F.col("size"), F.col("w")).where("_m_copies > 0 AND _m_size > 0")
    copies = copies.select(F.col("doc_id").alias("_m_id"), F.col("h").alias("_m_h"), F.col("_m_copies"))
    copies = copies.groupBy("_m_id", "_m_h").agg(F.max("_m_copies").alias("_m_copies"))
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_m_id")) & (F.xxhash64("text") == F.col("_m_h")))
    return joined.withColumn("_m_i", F.explode(F.sequence(F.lit(1), F.col("_m_copies").cast("int")))).select(*names)
