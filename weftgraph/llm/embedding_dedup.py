"""Near-duplicate embeddings by randomised-rotation binary codes (operator 9).

Vectors of equal label are linked if their cosine, in double precision, is ``THRESHOLD`` or more.

1. Every vector is rotated by a random orthogonal matrix (the same for all) and encoded once, as one sign bit per dimension and a
   correction factor, the inner product of the unit vector and its code.  Equal vectors of a label are one row with a count.
2. Buckets: tables take other random rotations' sign bits as keys.  Their number of bits grows with the label's size, so that a
   bucket holds about ``BUCKET`` rows, and the number of tables is such that a pair at the threshold shares a bucket with probability
   ``RECALL``; labels of up to ``BUCKET`` rows are one bucket and exact.  Buckets beyond ``BLOCK`` rows are compared block against block.
3. In a bucket, the codes and factors estimate each inner product without bias; where the upper confidence bound is below the
   threshold the pair is dropped, all others are computed exactly.  A pair counts in the first table that it shares, so no pair is counted
   twice and none has to be emitted: a bucket returns link counts per row and a spanning forest of its links.

Scale: a row travels to a bucket with its code, factor and keys, and with its components as they came (four bytes each for floats), since links
are counted where they are found: surviving pairs of a dense group are too many to leave it.  The sizes of labels and of dense buckets are
tables, joined (small ones by broadcast, after a count); a task holds one block pair.  Counts add up before the shuffle; components come from the
forests' edges.

Cases: null, empty, zero vectors, and those with null or non-finite components, link with nothing, and so do vectors with a null label;
vectors of other lengths are compared with their like only; equal rows link with each other; rows with equal vec_id are one vector (the first by
content) and each row gets its result; ties cannot arise, since a pair is linked or not; a null vec_id links with nothing and is kept; very long vectors
make rows of their size; extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, read_table

THRESHOLD, RECALL, BUCKET, BLOCK, SEED = 0.93, 1 - 1e-6, 4096, 8192, 5
#: Side tables of so many rows are broadcast; larger ones are joined by a shuffle.
SENT = 1 << 18
#: Width of the confidence bound, in standard errors of the estimate.
SIGMAS = 6.0
U = np.uint64


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of this dimension."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def plan(rows: int, dim: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many rows."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / BUCKET)))
    if not bits:
        return 0, 1
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) bucket keys: sign bits along random directions, orthogonal within a rotation."""
    n, dim = unit.shape
    if not bits:
        return np.zeros((n, tables), np.int64)
    need = bits * tables
    sign = np.concatenate([unit @ rotation(dim, 1 + k) > 0 for k in range(-(-need // dim))], 1)[:, :need]
    return (sign.reshape(n, tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of +-1, correction factors): the factor is the inner product of the rotated vector with its scaled code."""
    y = unit @ rotation(unit.shape[1], 0)
    code = np.where(y > 0, 1, -1).astype(np.int8)
    return code, np.abs(y).sum(1) / math.sqrt(unit.shape[1])


def screen(code: np.ndarray, factor: np.ndarray, rotated: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Pairs (i, j) whose inner product may reach the threshold: <code_i, rotated_j> / factor_i estimates it without bias."""
    dim = code.shape[1]
    estimate = (code.astype(np.float32) / math.sqrt(dim)) @ rotated.T / factor[:, None].astype(np.float32)
    error = np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, dim - 1)))
    # The error is that of the part of vector j orthogonal to vector i, of length sqrt(1 - threshold ** 2) at the threshold.
    return estimate >= threshold - SIGMAS * error[:, None] * math.sqrt(1 - threshold**2) - 1e-4


def _links(unit: np.ndarray, code: np.ndarray, factor: np.ndarray, key: np.ndarray, table: int, rows: np.ndarray, cols: np.ndarray, threshold: float):
    """Pairs of rows x cols (row index below column index, or another block) linked and first met in this table."""
    rotated = (unit @ rotation(unit.shape[1], 0)).astype(np.float32)
    for a in range(0, len(rows), 1024):
        mine = rows[a : a + 1024]
        maybe = screen(code[mine], factor[mine], rotated[cols], threshold)
        i, j = np.nonzero(maybe)
        i, j = mine[i], cols[j]
        ok = i < j
        i, j = i[ok], j[ok]
        for b in range(0, len(i), 1 << 16):
            x, y = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
            ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            if table:
                ok &= ~(key[x, :table] == key[y, :table]).any(1)
            yield x[ok], y[ok]


def _vectors(data: list[bytes], dim: int) -> np.ndarray:
    """Rows of ``dim`` numbers, of four or eight bytes each."""
    wide = bool(data) and len(data[0]) == 8 * dim
    v = np.frombuffer(b"".join(data), "<f8" if wide else "<f4").reshape(-1, dim).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= SENT else side


def links(vectors: DataFrame, *, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """From distinct vectors (node, label, dim, count, v): (node, n) partial link counts, and (a, b) edges that span the components."""
    sizes = materialize(vectors.groupBy("label", "dim").agg(F.count("*").alias("size")), "label-sizes")
    sized = vectors.join(_small(sizes), ["label", "dim"]).select("node", "label", "dim", "count", "v", "size")

    def spread(whole: bool):
        def run(batches):
            for batch in batches:
                groups: dict[tuple, list[int]] = {}
                for i, g in enumerate(zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), map(len, batch.column(4).to_pylist()))):
                    groups.setdefault(g, []).append(i)
                for (d, size, _), at in groups.items():
                    part = batch.take(pa.array(at))
                    unit = _vectors(part.column(4).to_pylist(), d)
                    bits, tables = plan(size, d, threshold)
                    k = keys(unit, bits, tables)
                    if not whole:
                        for t in range(tables):
                            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(np.full(len(at), t, np.int32)), pa.array(k[:, t])], names=["label", "dim", "t", "key"])
                        continue
                    code, factor = encode(unit)
                    code = pa.array([r.tobytes() for r in np.packbits(code > 0, axis=1)], pa.binary())
                    for t in range(tables):
                        seen = pa.array([r.tobytes() for r in np.ascontiguousarray(k[:, :t].astype("<i4" if bits < 31 else "<i8"))], pa.binary())  # keys of earlier tables
                        yield pa.RecordBatch.from_arrays([*part.columns[:5], code, pa.array(factor), pa.array(np.full(len(at), t, np.int32)), pa.array(k[:, t]), seen], names=["node", "label", "dim", "count", "v", "code", "factor", "t", "key", "seen"])

        return run

    cell = ["label", "dim", "t", "key"]
    found = sized.mapInArrow(spread(False), "label long, dim int, t int, key long").groupBy(*cell).count()
    large = found.where(F.col("count") > BLOCK).select(*cell, F.ceil(F.col("count") / (BLOCK // 2)).cast("int").alias("blocks"))
    large = materialize(large, "dense-buckets")
    rows = sized.mapInArrow(spread(True), "node long, label long, dim int, count long, v binary, code binary, factor double, t int, key long, seen binary")
    rows = rows.join(_small(large), cell, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(*cell, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "count", "v", "code", "factor", "seen")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        t, d, p, q = (table.column(c)[0].as_py() for c in ("t", "dim", "p", "q"))
        node, count, own = (np.asarray(table.column(c)) for c in ("node", "count", "own"))
        unit = _vectors(table.column("v").to_pylist(), d)
        code = np.unpackbits(np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(node), -1), axis=1, count=d).astype(np.int8) * 2 - 1
        factor, seen = np.asarray(table.column("factor")), table.column("seen").to_pylist()
        key = np.frombuffer(b"".join(seen), "<i4" if t and len(seen[0]) == 4 * t else "<i8").reshape(len(node), t)
        rows, cols = np.flatnonzero(own == p), np.flatnonzero(own == q)
        pairs = [(rows, cols)] if p == q else [(rows, cols), (cols, rows)]
        n, up = np.zeros(len(node), np.int64), np.arange(len(node))

        def root(i):
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        edges = []
        for r, c in pairs:
            for x, y in _links(unit, code, factor, key, t, r, c, threshold):
                np.add.at(n, x, count[y])
                np.add.at(n, y, count[x])
                for i, j in zip(x.tolist(), y.tolist()):
                    a, b = root(i), root(j)
                    if a != b:
                        up[b] = a
                        edges.append((i, j))
        hit = np.flatnonzero(n)
        e = np.array(edges, int).reshape(-1, 2)
        return pa.table({"node": np.concatenate([node[hit], node[e[:, 0]]]), "other": pa.array(np.concatenate([np.full(len(hit), -1), node[e[:, 1]]]), mask=np.arange(len(hit) + len(e)) < len(hit)), "n": np.concatenate([n[hit], np.zeros(len(e), np.int64)])})

    out = materialize(rows.groupBy(*cell, "p", "q").applyInArrow(compare, "node long, other long, n long"), "links")
    return out.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n")), out.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    good = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    good = good.groupBy("vec_id").agg(F.min_by(F.struct("label", "v"), F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v")

    kind = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"

    def pack(batches):
        for batch in batches:
            # Scaled by a power of two, which is exact, so that no square leaves the range of doubles.
            rows = [np.asarray(x, "<f8") for x in batch.column(2).to_pylist()]
            rows = [np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(x) for x in rows], pa.int32()), pa.array([x.astype(kind).tobytes() for x in rows], pa.binary())], names=["vec_id", "label", "dim", "v"])

    good = materialize(good.mapInArrow(pack, "vec_id long, label long, dim int, v binary"), "vectors")
    same = materialize(good.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("count")), "vector-sets")
    counts, edges = links(same, threshold=threshold)
    comps = connected_components(edges)
    node = good.join(same, ["label", "dim", "v"]).select("vec_id", "node", "count")
    found = node.join(counts, "node", "left").join(comps, "node", "left")
    found = found.select(F.col("vec_id").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("count") - 1).alias("_n"), F.coalesce("component", "node").alias("_c"))
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(found, F.col("vec_id") == F.col("_v"), "left")
    component = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r(vec_id, c) AS (
  SELECT a, a FROM l UNION SELECT b, a FROM l UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id
), m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(m.c, e.vec_id) AS component_id, e.vec_id = coalesce(m.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN m ON m.vec_id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
