"""Language identification by nearest centroid (operator 2).

A text is a vector of hashed byte 2- and 3-grams of its letters, weighted by TF-IDF and normalised.  Every language has
several centroids, from spherical k-means over a sample of its texts; the language of the centroid with the largest cosine wins.  A text
farther from it than texts of its length ever are is rejected (``rejected``); so is one without a letter (``und``).

Fit: document frequencies count all training documents, and combine before the shuffle.  Centroids come from a bounded sample of labelled
documents: of each language those with the smallest hashes of (id, text), ``SAMPLE / languages`` or ``LEAST`` of them, whichever is more.  Every
language is learned.  The model has ``CENTROIDS`` vectors of ``DIMS`` numbers a language and travels with the task.

Cases: null text, or text without a letter (by Unicode category, so that numerals such as a superscript two are none): ``und``, score 0,
rejected; whole texts are read, however long, in slices of bounded size; ties between
centroids go to the first language by name; repeated rows get equal results; without any labelled document everything is ``und``; null ids
are not held out and take part in fitting; other columns are kept by ``identify``, but those named like its own are replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table
from .textbytes import slices

DIMS, SAMPLE, LEAST, CENTROIDS, STEPS = 4096, 3000, 40, 4, 12
#: A text is rejected below this share of the smallest usual cosine of training texts of its length.
SLACK, USUAL = 0.5, 0.01
_ASCII_LETTER = re.compile("[A-Za-z]")
_KEEP = np.zeros(256, np.uint8)
_KEEP[:] = 32
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
_TABLE = _KEEP.tobytes()


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray  # smallest accepted cosine by floor(log2(number of grams))


def gram_counts(texts: list[str]) -> np.ndarray:
    """(texts, DIMS) counts of hashed 2- and 3-grams of lower-case letters; anything else separates words."""
    data = [b" " + t.lower().encode("utf-8", "surrogatepass").translate(_TABLE) + b" " for t in texts]
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(d) for d in data])
    out = np.zeros(len(texts) * DIMS, np.int64)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    for gram, n in ((two, 1), (three, 2)):
        ok = (doc[:-n] == doc[n:]) & ~((b[:-n] == 32) & (b[1 : len(b) - n + 1] == 32))
        key = (gram[ok] * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(doc[:-n][ok] * DIMS + key, minlength=len(out))
    return out.reshape(len(texts), DIMS)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the mean's farthest texts, so it depends on the data alone."""
    centre = [x.mean(0)]
    near = x @ centre[0]
    for _ in range(min(k, len(x)) - 1):
        centre.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centre[-1])
    c = np.stack(centre)
    for _ in range(STEPS):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model | None:
    """The model of a labelled table, or None if it has no labelled text."""
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.abs(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(2))).alias("h"))

    def frequencies(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, rows=256):
                df += (gram_counts(texts[a:b]) > 0).sum(0)
            n += len(texts)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(DIMS + 1), pa.int32()), "n": np.append(df, n)})

    df = np.zeros(DIMS + 1)
    for r in rows.select("t").mapInArrow(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        df[r.dim] = r.n
    by_lang = rows.groupBy("l").count().collect()  # one row per language, as in the model
    if not by_lang:
        return None
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 0.1
    each = max(LEAST, sample // len(by_lang))
    # The hash of the last document drawn of each language, from rows without texts; a rank limit is applied before rows travel.
    nearest = F.row_number().over(W.partitionBy("l").orderBy("h"))
    ends = rows.select("l", "h").withColumn("r", nearest).where(F.col("r") <= each).groupBy("l").agg(F.max("h").alias("h")).collect()
    limit = F.create_map(*[F.lit(v) for r in ends for v in (r.l, r.h)])

    def vectors(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, rows=256):
                c = gram_counts(texts[a:b]).astype("<u4")
                yield pa.RecordBatch.from_pydict({"l": batch.column(1)[a:b], "h": batch.column(2)[a:b], "v": pa.array([zlib.compress(v.tobytes(), 1) for v in c], pa.binary())})

    # Where many rows share the last hash, the rank bounds what is collected.
    drawn = rows.where(F.col("h") <= F.try_element_at(limit, F.col("l"))).withColumn("r", nearest).where(F.col("r") <= each).drop("r")
    drawn = drawn.mapInArrow(vectors, "l string, h long, v binary").collect()  # at most ``each`` rows of a language
    languages = sorted({r.l for r in drawn})
    centroids, owner, sims, grams = [], [], [], []
    for k, name in enumerate(languages):
        mine = sorted((r.h, r.v) for r in drawn if r.l == name)[:each]
        counts = np.stack([np.frombuffer(zlib.decompress(v), "<u4") for _, v in mine])
        counts = counts[counts.sum(1) > 0]
        if not len(counts):
            continue
        x = weigh(counts, idf)
        c = _clusters(x, CENTROIDS)
        centroids.append(c)
        owner += [k] * len(c)
        sims.append((x @ c.T).max(1))
        grams.append(counts.sum(1))
    if not centroids:
        return None
    sims, size = np.concatenate(sims), np.log2(np.concatenate(grams).astype(float)).astype(int)
    floor = np.array([SLACK * np.quantile(sims[size == s], USUAL) if (size == s).sum() >= 5 else np.nan for s in range(64)])
    known = np.flatnonzero(~np.isnan(floor))
    # Shorter texts than any seen are taken on trust; longer ones are held to the longest seen.
    floor = np.zeros(64) if not len(known) else np.where(np.arange(64) < known[0], 0.0, np.interp(np.arange(64), known, floor[known]))
    return Model(languages, idf, np.concatenate(centroids), np.array(owner), floor)


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, cosine, rejected) of each text."""
    lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    live = [i for i, t in enumerate(texts) if t and has_letter(t)]
    if model is None:
        return lang, score, out
    own = [texts[i] for i in live]
    for a, b in slices(own, rows=256):
        counts = gram_counts(own[a:b])
        cosine = weigh(counts, model.idf) @ model.centroids.T
        best = cosine.argmax(1)
        value = np.clip(cosine.max(1), 0, 1)
        size = np.log2(np.maximum(1, counts.sum(1))).astype(int)
        for j, i in enumerate(live[a:b]):
            lang[i], score[i], out[i] = model.languages[model.owner[best[j]]], value[j], value[j] < model.floor[size[j]]
    return lang, score, out


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text", names=("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the predicted language, its cosine, and whether it is rejected."""
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            lang, score, out = predict(batch.column(at).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(out)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are rejected go; the others stay as they are."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, model, names=("_i_lang", "_i_score", "_i_out")).where(~F.col("_i_out")).select(*docs.columns)
