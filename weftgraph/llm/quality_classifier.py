"""Quality scores by attention-based multiple-instance learning (operator 7).

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded (shares of byte classes, word shape, repetition,
hashed words), a hidden layer maps it to a vector, gated attention weighs the vectors, and the weighted sum gives the score.  Weights
come from document labels alone, by Adam on a bounded sample of labelled rows: the ``SAMPLE`` with the smallest id hashes, or as many of them as have
``PASSAGES`` passages together (one at least), each with all its passages.  Scoring reads all passages of all documents.

Scale: the label table is joined to ids and texts of the training draw only, after a filter on the id hash; the model has a fixed size and
travels with the task; a worker holds one slice of texts.

Cases: null, empty and blank texts are a bag of one empty passage and get that bag's score; very long texts are bags of many passages, in
training too; repeated rows get equal scores and are learned from once; ties in the hash go by the text's hash and the label; several labels of
one id count once each; without labels, or with labels of one kind only, the score is the share of label 1 (0.5 if there is none); null labels are
left out; other columns are kept by ``score``, but one named like its own is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import count_words, read_table
from .textbytes import Words, slices

PASSAGE, SAMPLE, PASSAGES, HASHED = 64, 4000, 200_000, 32
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 20, 64, 0.01, 1e-4, 7
THRESHOLD = 0.3
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",", b"!", b"?", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"@", b":;", b"/\\", b"'\"", b"()[]{}", b"-_+=~^`"]
_CLASS = np.full(256, len(_KINDS), np.int64)
for _k, _chars in enumerate(_KINDS):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = len(_KINDS) + 1
CLASSES = len(_KINDS) + 2
WIDTH = CLASSES + 5 + HASHED


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None
    prior: float


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); a text without words has one empty passage."""
    w = Words(texts)
    n = np.maximum(1, -(-w.per_doc // PASSAGE))
    first = np.cumsum(n) - n
    total = int(n.sum())
    before = np.cumsum(w.per_doc) - w.per_doc
    rank = np.arange(len(w.doc)) - before[w.doc]
    own = first[w.doc] + rank // PASSAGE  # the passage of each word
    # A passage runs from its first word to the next passage's first; a text's first passage from the text's beginning.
    doc_start = np.concatenate([[0], w.doc_end[:-1]])
    cut = np.zeros(len(w.buf) + 1, np.int64)
    heads = (rank % PASSAGE == 0) & (rank > 0)
    np.add.at(cut, w.start[heads], 1)
    byte_doc = np.repeat(np.arange(len(texts)), np.diff(np.append(doc_start, len(w.buf))))
    inside = np.cumsum(cut[:-1])
    byte_own = first[byte_doc] + inside - inside[doc_start][byte_doc] + cut[doc_start][byte_doc]
    shares = np.bincount(byte_own * CLASSES + _CLASS[w.buf], minlength=total * CLASSES).reshape(total, CLASSES).astype(np.float64)
    size = shares.sum(1)
    shares /= np.maximum(1, size)[:, None]

    words = np.bincount(own, minlength=total).astype(np.float64)
    length = (w.end - w.start).astype(np.float64)
    mean = np.bincount(own, length, total) / np.maximum(1, words)
    square = np.bincount(own, length**2, total) / np.maximum(1, words)
    h = w.hashes()
    order = np.lexsort((h, own))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
    distinct = np.bincount(own[order][new], minlength=total) / np.maximum(1, words)
    bag = np.bincount(own * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED) / np.maximum(1, words)[:, None]
    rest = np.stack([np.log1p(words), mean, np.sqrt(np.maximum(0, square - mean**2)), distinct, np.log1p(size)], 1)
    return np.concatenate([shares, rest, bag], 1).astype(np.float32), n


def _forward(p: dict, x: np.ndarray, starts: np.ndarray, n: np.ndarray):
    h = np.tanh(x @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    s = (t * g) @ p["a"]
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), n))
    attention = e / np.repeat(np.add.reduceat(e, starts), n)
    z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
    return h, t, g, attention, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))


def gradients(p: dict, x: np.ndarray, k: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross entropy of bags of ``k`` passages ``x`` with labels ``y``."""
    starts = np.cumsum(k) - k
    h, t, g, att, z, out = _forward(p, x, starts, k)
    dl = (out - y) / len(y)
    dz = np.repeat(dl[:, None] * p["c"], k, axis=0)
    da = (h * dz).sum(1)
    ds = att * (da - np.repeat(np.add.reduceat(att * da, starts), k))
    dt = ds[:, None] * p["a"] * g * (1 - t**2)
    dg = ds[:, None] * p["a"] * t * g * (1 - g)
    dh = (att[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - h**2)
    return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "c": z.T @ dl, "d": np.array([dl.sum()])}


def train(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> Model:
    """Gated-attention weights from passages ``x`` of bags of ``n`` passages with labels ``y``."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or prior in (0.0, 1.0):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), None, prior)
    m, s = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - m) / s, -8, 8).astype(np.float64)
    rnd = np.random.default_rng(SEED)
    shape = {"w": (WIDTH, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rnd.normal(0, 1 / np.sqrt(v[0]), v) if k not in "bd" else np.zeros(v) for k, v in shape.items()}
    p["d"][0] = np.log(prior / (1 - prior))
    m1, m2, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
    first = np.cumsum(n) - n
    for _ in range(EPOCHS):
        order = rnd.permutation(len(y))
        for at in range(0, len(y), BATCH):
            docs = order[at : at + BATCH]
            k = n[docs]
            starts = np.cumsum(k) - k
            rows = np.repeat(first[docs] - starts, k) + np.arange(k.sum())
            grad = gradients(p, x[rows], k, y[docs])
            step += 1
            for q in p:
                d = grad[q] + DECAY * p[q] * (q not in "bd")
                m1[q] = 0.9 * m1[q] + 0.1 * d
                m2[q] = 0.999 * m2[q] + 0.001 * d**2
                p[q] = p[q] - RATE * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.999**step)) + 1e-8)
    return Model(m, s, p, prior)


def predict(texts: list[str | None], model: Model) -> np.ndarray:
    if model.weights is None:
        return np.full(len(texts), model.prior)
    out = [np.zeros(0)]
    texts = [t or "" for t in texts]
    for a, b in slices(texts, rows=4096):
        x, n = passages(texts[a:b])
        x = np.clip((x - model.mean) / model.scale, -8, 8)
        out.append(_forward(model.weights, x, np.cumsum(n) - n, n)[-1])
    return np.concatenate(out)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages_in_all: int = PASSAGES) -> Model:
    """Model of the labelled documents; ``labels`` holds the ids that may be learned from, and no others."""
    h = F.abs(F.xxhash64(F.col(id_col), F.lit(7)))
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_i"), F.col(label_col).cast("double").alias("_y"))
    known = known.withColumn("_h", F.abs(F.xxhash64("_i", F.lit(7))))
    n = known.count()
    limit = min((1 << 63) - 1, int((1 << 63) * min(1.0, (1.1 * sample + 50) / max(1, n))))
    drawn = known.where(F.col("_h") <= limit).orderBy("_h", "_i", "_y").limit(sample)  # a top-k, so the join's small side is bounded
    rows = docs.where(h <= limit).select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")).join(F.broadcast(drawn), "_i")
    rows = rows.select("_t", "_y", "_h", F.xxhash64("_t").alias("_g"))
    key = ["_h", "_g", "_y"]
    size = F.greatest(F.lit(1), F.ceil(F.coalesce(count_words(F.col("_t")), F.lit(0)) / PASSAGE)).alias("_k")
    total, last = 0, None
    for r in rows.select(*key, size).distinct().orderBy(*key).limit(sample).collect():
        total += r._k
        if last is not None and total > passages_in_all:
            break
        last = (r._h, r._g, r._y)
    if last is None:
        return train(np.zeros((0, WIDTH)), np.zeros(0, int), np.zeros(0))
    rows = rows.where(F.struct(*key) <= F.struct(*map(F.lit, last))).dropDuplicates(key)

    def encode(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts, rows=1024):
                x, k = passages(texts[a:b])
                parts = np.split(x, np.cumsum(k)[:-1])
                yield pa.RecordBatch.from_pydict({"x": pa.array([v.tobytes() for v in parts], pa.binary()), "y": batch.column(1)[a:b], "h": batch.column(2)[a:b]})

    got = sorted(rows.select("_t", "_y", "_h").mapInArrow(encode, "x binary, y double, h long").collect(), key=lambda r: (r.h, r.y, r.x))  # bounded by ``sample`` and ``passages_in_all``
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in got]
    return train(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([float(r.y > 0) for r in got]))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher where label 1 is likelier."""
    docs = docs.drop(name)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predict(batch.column(at).to_pylist(), model).astype(float))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = fit(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
