r"""Repeated runs of lines across all documents, found by distributed prefix doubling (operator 10).

The suffixes of all line sequences are grouped by their first ``h`` lines; a round doubles ``h`` by naming each suffix after
the pair (its group, the group of the suffix ``h`` lines on).  Only suffixes whose group has two members or more stay active.
The array is depth-limited: doubling ends at ``min_lines``, where a group is an interval of suffixes whose longest common prefix has that many
lines at least.  More order would not change a run: a maximal repeated run is the union of its windows of ``min_lines`` lines, each of which
has an earlier copy if the run has, and the other way round; so consecutive flagged suffixes merge into the maximal runs (the oracle
extends suffixes to their full common prefixes instead, and must agree).  Of each group the smallest (doc_id, position) is the first copy; every later one is
deleted.  A run of one line counts if it has ``min_words`` words or more.

Only DataFrame functions are used.  Text is split once into 128-bit line names; the groups' first members come from an
aggregate with map-side combine, so a line that a third of all documents hold is one row per task before the shuffle, and the
join back is one that adaptive execution can split.  No window covers more than one document.

Cases: lines without a word are kept and stand in no run; null text stays null and has no lines, empty text has one; rows with equal doc_id
and equal text count as one document and each gets the same result; a null doc_id sorts first; repeats inside one document
count; ties are copies, told apart by place; very long texts are split inside their row; an empty table gives an empty result; other columns are
kept, also such as are named like the query's; working columns are prefixed ``_l_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialize, read_table

MIN_LINES, MIN_WORDS = 2, 10
HAS_WORD = "[^\\x20\\x09-\\x0D]"
KEY = ["_l_d", "_l_t"]
LOWEST = -(1 << 63)


def _key(id_col: str, text_col: str) -> dict:
    return {"_l_d": F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)), "_l_t": F.xxhash64(F.col(text_col))}


def _name(*parts) -> dict:
    return {"_l_a": F.xxhash64(*parts), "_l_b": F.xxhash64(F.lit(7), *parts)}


def _grouped(suffixes: DataFrame, tag: str) -> DataFrame:
    """The suffixes whose name occurs twice or more, with ``_l_later``: an earlier suffix has the same name."""
    me = F.struct("_l_d", "_l_t", "_l_p")
    groups = suffixes.groupBy("_l_a", "_l_b").agg(F.min(me).alias("_l_m"), F.count("*").alias("_l_c")).where("_l_c > 1").drop("_l_c")
    found = suffixes.join(groups, ["_l_a", "_l_b"]).withColumn("_l_later", F.col("_l_m") < me).drop("_l_m")
    return materialize(found, tag)


def removed_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(_l_d, _l_t, _l_gone, _l_runs) for each document that loses lines: their indices from 0, and the maximal runs' number."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"].rlike(HAS_WORD))
    rows = docs.select(F.col(id_col), F.col(text_col)).withColumns(_key(id_col, text_col)).select(*KEY, F.posexplode(lines).alias("_l_p", "_l_s"))
    rows = rows.select(*KEY, "_l_p", F.col("_l_s.i").alias("_l_i"), *[c.alias(n) for n, c in _name(F.col("_l_s.x")).items()], F.regexp_like(F.col("_l_s.x"), F.lit(f"(?:{WORD}[\\x20\\x09-\\x0D]+){{{min_words - 1}}}{WORD}")).alias("_l_long"))
    single = _grouped(materialize(rows, "lines"), "lines-1")

    h, level = 1, single.select(*KEY, "_l_p", "_l_a", "_l_b", F.lit(True).alias("_l_later"))
    while h < min_lines:
        step = min(h, min_lines - h)
        after = W.partitionBy(*KEY).orderBy("_l_p").rangeBetween(step, step)
        level = level.select(*KEY, "_l_p", "_l_a", "_l_b", F.first("_l_a").over(after).alias("_l_na"), F.first("_l_b").over(after).alias("_l_nb")).where("_l_na IS NOT NULL")
        names = _name("_l_a", "_l_b", "_l_na", "_l_nb")
        level = _grouped(level.select(*KEY, "_l_p", *[c.alias(n) for n, c in names.items()]).distinct(), f"lines-{h + step}")
        h += step
    flagged = level.where("_l_later").select(*KEY, "_l_p", F.lit(1).alias("_l_run")).distinct()

    near = W.partitionBy(*KEY).orderBy("_l_p").rangeBetween(-(min_lines - 1), 0)
    own = single.join(flagged, [*KEY, "_l_p"], "left") if min_lines > 1 else single.withColumn("_l_run", F.col("_l_later").cast("int"))
    gone = own.withColumn("_l_cover", F.max("_l_run").over(near)).where("_l_cover = 1 OR (_l_later AND _l_long)")
    prev = F.lag("_l_p").over(W.partitionBy(*KEY).orderBy("_l_p"))
    gone = gone.select(*KEY, "_l_p", "_l_i").distinct().withColumn("_l_start", (prev.isNull() | (prev < F.col("_l_p") - 1)).cast("int"))
    return gone.groupBy(*KEY).agg(F.sort_array(F.collect_set("_l_i")).alias("_l_gone"), F.sum("_l_start").alias("_l_runs"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``_l_kept`` (the text without deleted lines), ``_l_lines``, ``_l_removed`` and ``_l_runs``."""
    gone = removed_lines(docs, id_col=id_col, text_col=text_col, min_lines=min_lines, min_words=min_words)
    out = docs.withColumns(_key(id_col, text_col)).join(gone, KEY, "left").drop(*KEY)
    # Both arrays are in line order, so a map of the few deleted indices is built once per document.
    lines = F.split(text_col, "\n")
    marked = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_l_gone"))
    kept = F.when(F.col("_l_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(marked, lambda i: lines[i]), "\n"))
    return out.withColumns({"_l_kept": kept, "_l_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"), "_l_removed": F.when(F.col("_l_gone").isNull(), 0).otherwise(F.size("_l_gone")).cast("long"), "_l_runs": F.coalesce("_l_runs", F.lit(0)).cast("long")}).drop("_l_gone")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_l_lines").alias("n_lines"), F.col("_l_removed").alias("n_removed"), F.col("_l_runs").alias("n_runs"), F.sha2(F.coalesce("_l_kept", F.lit("")), 256).alias("kept_sha256"))


# The oracle does not know of windows: it extends every suffix line by line for as long as its prefix occurs elsewhere, takes the longest
# prefix of each that has an earlier copy, and deletes that whole run if it has two lines, or one of ten words.
OP10_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), w AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), x(doc_id, p, n, k, later) AS (
  SELECT doc_id, p, 1, k, r > 1 FROM (
    SELECT doc_id, p, md5(line) AS k, count(*) OVER (PARTITION BY line) AS c, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) AS r FROM w
  ) WHERE c > 1
  UNION ALL
  SELECT doc_id, p, n, k, r > 1 FROM (
    SELECT doc_id, p, n, k, count(*) OVER (PARTITION BY k) AS c, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM (
      SELECT x.doc_id, x.p, x.n + 1 AS n, md5(x.k || chr(10) || w.line) AS k FROM x JOIN w ON w.doc_id = x.doc_id AND w.p = x.p + x.n
    )
  ) WHERE c > 1
), m AS (
  SELECT doc_id, p, max(n) AS n FROM x WHERE later GROUP BY doc_id, p
), c AS (
  SELECT DISTINCT m.doc_id, m.p + o.o AS p FROM m JOIN w ON w.doc_id = m.doc_id AND w.p = m.p, unnest(range(m.n)) AS o(o)
  WHERE m.n >= 2 OR w.nw >= 10
), s AS (
  SELECT w.doc_id, w.i, c.p - coalesce(lag(c.p) OVER (PARTITION BY c.doc_id ORDER BY c.p), -1) > 1 AS starts FROM c JOIN w ON w.doc_id = c.doc_id AND w.p = c.p
), a AS (
  SELECT l.doc_id, count(*) AS n_lines, count(s.i) AS n_removed, count(*) FILTER (WHERE s.starts) AS n_runs,
         string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE s.i IS NULL) AS kept
  FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.i = s.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their deleted lines; documents of which no word is left go."""
    names = docs.columns
    out = dedup_lines(docs).where((F.col("_l_removed") == 0) | F.col("_l_kept").rlike(HAS_WORD))
    new = {"text": F.col("_l_kept")} | ({"n_chars": F.length("_l_kept").cast("long")} if "n_chars" in names else {})
    return out.withColumns(new).select(*names)
