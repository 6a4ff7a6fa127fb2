r"""Quality rules combined by weak supervision (operator 5).

Every rule votes good (1), bad (-1) or abstains (0) on a document.  Expectation-maximisation over the counts of vote patterns
estimates how often each rule is right on good and on bad documents, and the share of good ones; the posterior of "good" replaces a filter that all
rules must pass.

Only DataFrame functions touch the rows.  The one thing that reaches the driver is the count of each vote pattern: at most
3 ** 6 = 729 rows, whatever the input; the estimates go back as literals.  All features of a text are computed inside its own
row, so nothing but patterns is shuffled.

Cases: null and empty texts have no word and fail the base check; very long texts are sorted by window inside their row;
repeated rows each get their own result; a posterior of exactly ``KEEP`` is kept, and texts of equal votes get equal posteriors; an empty table gives
an empty result; other columns are kept, but those named like the operator's own are replaced; working columns are prefixed ``_q_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, read_table

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
ROUNDS, PRIOR = 30, 0.8
#: On good documents a rule is trusted no less than a coin toss; on either kind no further than this.
BOUNDS = (0.5, 0.998)
KEEP = 0.5
OWN = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept"}


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    other = [c for c in docs.columns if c not in OWN and c != text_col and not c.startswith(("_q_", "vote_"))]
    d = docs.select(
        *other,
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "\\p{Lu}", ""))).cast("long").alias("_q_upper"),
        F.array_remove(F.split(text, SPACE), "").alias("_q_w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_q_l"),
    )
    n = F.size("_q_w")
    gram = lambda i: F.xxhash64(F.col("_q_w")[i], F.col("_q_w")[i + 1], F.col("_q_w")[i + 2])
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(gram(i).alias("h"), i.alias("i")))).otherwise(F.expr("array()").cast("array<struct<h:bigint,i:int>>"))
    d = d.select(*other, "word_chars", "n_symbols", "_q_upper", n.cast("long").alias("n_words"), F.size("_q_l").cast("long").alias("_q_lines"), (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines"), F.sort_array(windows).alias("_q_s"))
    s = F.col("_q_s")
    twice = lambda x, j: F.coalesce((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), F.get(s, j - 1)["h"] == x["h"], F.get(s, j + 1)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(twice(x, j), x["i"])), lambda i: i.isNotNull()))
    d = d.withColumn("_q_at", at).drop("_q_s")
    # Words under those windows: each adds up to where the next begins, three at most.
    spans = F.zip_with("_q_at", F.slice("_q_at", 2, F.greatest(F.size("_q_at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return d.withColumn("n_repeat_words", F.aggregate(spans, F.lit(0), lambda x, y: x + y).cast("long")).drop("_q_at")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """What each rule says; -1 bad, 1 good, 0 nothing."""
    n, c = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": _vote(F.col("n_symbols") * 50 <= n, F.col("n_symbols") * 10 >= n),
        "word_length": _vote((c >= 3 * n) & (c <= 10 * n), (c < 2 * n) | (c > 14 * n)),
        "upper": _vote(F.col("_q_upper") * 8 <= c, F.col("_q_upper") * 3 >= c),
        "repeated_words": _vote(F.col("n_repeat_words") * 20 <= n, F.col("n_repeat_words") * 4 >= n),
        "repeated_lines": _vote((F.col("n_dup_lines") == 0) & (F.col("_q_lines") > 3), F.col("n_dup_lines") * 4 >= F.col("_q_lines")),
        "length": _vote(n >= 100, n < 20),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """(share of good, per rule (how often its vote is right on good, on bad documents)) by EM over (votes, count).

    It starts from "the more bad votes, the worse"; a rule's vote may lose all its weight but never turn its meaning.
    """
    k = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    belief = [1 / (1 + math.exp(2.5 * v.count(-1) - 1.5)) for v, _ in patterns]
    prior, rates = PRIOR, []
    for _ in range(ROUNDS if total else 0):
        prior = min(0.98, max(0.5, sum(n * p for p, (_, n) in zip(belief, patterns)) / total))
        rates = []
        for r in range(k):
            said = [(p, n, v[r]) for p, (v, n) in zip(belief, patterns) if v[r]]
            good = sum(n * p for p, n, _ in said)
            bad = sum(n * (1 - p) for p, n, _ in said)
            on_good = (sum(n * p for p, n, v in said if v > 0) + 1) / (good + 2)
            on_bad = (sum(n * (1 - p) for p, n, v in said if v < 0) + 1) / (bad + 2)
            on_good = min(BOUNDS[1], max(BOUNDS[0], on_good))
            rates.append((on_good, min(BOUNDS[1], max(1 - on_good, on_bad))))
        belief = [posterior(v, prior, rates) for v, _ in patterns]
    return prior, rates


def weights(rates: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """What a good and a bad vote of each rule add to the log odds of "good"."""
    return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in rates]


def posterior(vote, prior: float, rates: list[tuple[float, float]]) -> float:
    x = math.log(prior / (1 - prior)) + sum(w[0] if v > 0 else w[1] if v < 0 else 0.0 for v, w in zip(vote, weights(rates)))
    return 1 / (1 + math.exp(-x))


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Features, votes, ``base_failed``, ``posterior`` and ``kept`` for each row of ``docs`` (without its text)."""
    rules = votes()
    voted = features(docs, text_col).withColumns({f"_q_v_{k}": v for k, v in rules.items()})
    voted = materialize(voted, "rules")
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    names = [f"_q_v_{k}" for k in rules]
    seen = voted.where(~base).groupBy(*names).count().collect()  # at most 3 ** rules rows
    prior, rates = fit(sorted((tuple(r[n] for n in names), r["count"]) for r in seen))
    x = F.lit(math.log(prior / (1 - prior)))
    for n, (good, bad) in zip(names, weights(rates)):
        x = x + F.when(F.col(n) > 0, good).when(F.col(n) < 0, bad).otherwise(0.0)
    voted = voted.withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).withColumn("base_failed", base)
    voted = voted.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))
    return voted.withColumnsRenamed({n: "vote_" + n[5:] for n in names}).drop("_q_upper", "_q_lines")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"]
    return out.select(*first, *[c for c in out.columns if c.startswith("vote_")])
