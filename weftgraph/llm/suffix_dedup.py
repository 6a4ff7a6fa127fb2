"""Repeated byte strings across documents by a depth-limited radix sort of suffixes (operator 1).

A byte goes if a string of ``WIDTH`` bytes that covers it also starts in a document with a smaller doc_id.  Suffixes are ordered
through their first ``WIDTH`` bytes only, by passes over digits, most significant first, and a suffix that is alone after a
pass takes no part in the next.  So that not every suffix has to travel, the suffixes of one run whose windows share the smallest hashed
``DIGIT``-byte string travel as that anchor: equal windows have equal anchors at equal offsets, so no pair is missed.

Pass 1: the anchors' digits.  A chunk of documents sends each distinct digit once, as a few bytes of its hash, to its bucket; the
bucket answers with one bit per digit: met again, or not.
Pass 2: the rest.  For digits met again, a chunk sends each distinct surrounding (the bytes left and right of the anchor that
its windows cover) once, with its smallest doc_id.  Within equal digits the bucket groups windows by offset and all their bytes; equal groups are
exactly the repeated windows, and the answer is the smallest doc_id of each.
Last: a chunk marks the windows whose smallest doc_id is smaller than their own.

Scale: chunks are compressed files in the shared folder, named by content and renamed into place, so any task can run again; answers are
joined to chunks by name and texts are never shuffled.  A string that every document holds is one record per chunk.  Buckets follow
the total size, and so does the width of the hashes.  The distinct surroundings of one digit meet in one task, which needs some 400 bytes for
each of them, however many there are; equal ones are one record a chunk.  64-bit hashes stand for digits and two for windows.

Cases: null text has no bytes; texts shorter than ``WIDTH`` stay; a null doc_id counts as smaller than all others; rows of equal doc_id are no
copies of each other; very long texts are scanned in blocks; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, read_table
from .textbytes import mix

WIDTH, DIGIT, SENT, BUCKET_BYTES, HOT = 50, 24, 5, 8 << 20, 1 << 17
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
BLOCK = 1 << 17  # its arrays stay in the processor's cache
U = np.uint64
_K = U(0x9E3779B97F4A7C15)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _digits(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of ``b``, eight bytes at a time."""
    m = len(b) - k + 1
    pad = np.concatenate([b, np.zeros(8, np.uint8)])
    word = np.ndarray(len(b), "<u8", pad, strides=(1,)).astype(U)
    total = np.full(m, U(k))
    for at in range(0, k, 8):
        w = word[at : at + m]
        total += w if k - at >= 8 else w & U((1 << 8 * (k - at)) - 1)
        total *= _K
        total ^= total >> U(32)
    return mix(total)


class Chunk:
    """Some documents as one run of bytes, and the anchors of their windows."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes, width: int = WIDTH, digit: int = DIGIT):
        self.ids, self.sizes, self.width, self.digit = ids, sizes, width, digit
        self.buf = np.frombuffer(data, np.uint8)
        self.end = np.cumsum(sizes)
        self.hash = None
        self.known: dict[int, tuple] = {}

    def pack(self) -> bytes:
        import zstandard

        head = np.array([len(self.ids)], "<i8").tobytes() + self.ids.astype("<i8").tobytes() + self.sizes.astype("<i8").tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + self.buf.tobytes())

    @classmethod
    def unpack(cls, data: bytes, width: int, digit: int) -> Chunk:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        return cls(np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n), raw[8 + 16 * n :], width, digit)

    def anchors(self) -> None:
        """Sets ``hash``, ``at``, ``first``, ``last`` (window starts) and ``doc`` of each anchor, in order of place."""
        w, k = self.width, self.digit
        reach = w - k + 1
        start = self.end - self.sizes
        inside = np.zeros(len(self.buf), bool)  # whether a window starts here
        for a, e in zip(start.tolist(), self.end.tolist()):
            inside[a : max(a, e - w + 1)] = True
        begins = np.zeros(len(self.buf) + 1, bool)
        begins[start] = True
        found = []
        for s in range(0, max(0, len(self.buf) - w + 1), BLOCK):
            b = self.buf[s : s + BLOCK + w - 1]
            h = _digits(b, k)
            m = (h & ~U(0xFFFFF)) | np.arange(len(h), dtype=U)  # equal hashes: the leftmost
            n = 1
            while 2 * n <= reach:
                m = np.minimum(m[:-n], m[n:])
                n *= 2
            windows = len(b) - w + 1
            m = np.minimum(m[:windows], m[reach - n : reach - n + windows])
            at = (m & U(0xFFFFF)).astype(np.int64)
            ok = inside[s : s + windows]
            new = np.ones(windows, bool)
            new[1:] = (at[1:] != at[:-1]) | begins[s + 1 : s + windows] | ~ok[:-1]
            new &= ok
            i = np.flatnonzero(new)
            if not len(i):
                continue
            stop = np.ones(windows, bool)
            stop[:-1] = new[1:] | ~ok[1:]
            stop &= ok
            j = np.flatnonzero(stop)
            # Anchors are minima, so their hashes crowd at the low end: hashed again, they spread over all buckets.
            found.append((mix(h[at[i]] ^ _K), at[i] + s, i + s, j + s, np.searchsorted(self.end, i + s, side="right")))
        none = (np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(4)))
        self.hash, self.at, self.first, self.last, self.doc = (np.concatenate(c) for c in zip(none, *found))

    def digits_by_bucket(self, bits: int):
        """(bucket, sent hash values ascending, whether two documents of the chunk hold it, anchors' order and value index)."""
        if bits not in self.known:
            self.known[bits] = self._digits_by_bucket(bits)
        return self.known[bits]

    def _digits_by_bucket(self, bits: int):
        if self.hash is None:
            self.anchors()
        value = (self.hash >> U(64 - bits - 8 * SENT)) if bits + 8 * SENT < 64 else self.hash
        order = np.argsort(value)
        v, d = value[order], self.doc[order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        index = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        own = np.minimum.reduceat(self.ids[d], start) != np.maximum.reduceat(self.ids[d], start) if len(v) else np.zeros(0, bool)
        bucket = (v[start] >> U(8 * SENT)).astype(np.int64)
        sent = v[start] & U((1 << 8 * SENT) - 1)
        return bucket, sent, own, order, index

    def records(self, bits: int, again: np.ndarray):
        """Distinct surroundings of the anchors whose digit was met again.

        Returns (bucket, hash, left, right, n_left, n_right, smallest doc_id) of the records in order, and (anchor, record) pairs.
        """
        _, _, _, order, index = self.digits_by_bucket(bits)
        a = np.sort(order[again[index]])
        side = self.width - self.digit
        n_left, n_right = self.at[a] - self.first[a], self.last[a] + self.width - self.at[a] - self.digit
        pad = np.concatenate([np.zeros(side, np.uint8), self.buf, np.zeros(side + self.digit, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(pad, side)
        col = np.arange(side)
        left = np.ascontiguousarray(around[self.at[a]][:, ::-1])  # outwards from the anchor
        left[col >= n_left[:, None]] = 0
        right = around[self.at[a] + side + self.digit]
        right[col >= n_right[:, None]] = 0
        h, doc = self.hash[a], self.ids[self.doc[a]]
        (la, lb), (ra, rb), sizes = _twice(left), _twice(right), (n_left * 256 + n_right).astype(U)
        key = [h, mix(la * _K + ra) + sizes, mix(lb * U(0xD6E8FEB86659FD93) + rb) + sizes]
        o = np.lexsort((doc, *key[::-1]))
        new = np.ones(len(o), bool)
        new[1:] = np.any([k[o][1:] != k[o][:-1] for k in key], axis=0)
        first = o[new]
        bucket = (h[first] >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)
        record = np.empty(len(o), np.int64)
        record[o] = np.cumsum(new) - 1
        return (bucket, h[first], left[first], right[first], n_left[first], n_right[first], doc[first]), (a, record)


def _twice(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row of bytes."""
    a, b = np.full(len(x), U(1)), np.full(len(x), U(2))
    wide = np.zeros((len(x), -(-x.shape[1] // 8) * 8), np.uint8)
    wide[:, : x.shape[1]] = x
    for w in wide.view("<u8").T:
        a, b = mix(a * _K + w), mix(b + (w + U(77)) * U(0xD6E8FEB86659FD93))
    return a, b


def _squeeze(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _expand(data: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Arrays of (dtype, number) from :func:`_squeeze`."""
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def smallest(h, left, right, n_left, n_right, doc, side: int) -> np.ndarray:
    """(records, side + 1): the smallest doc_id of the windows equal to the record's window at each offset; HIGHEST where it has none."""
    out = np.full((len(h), side + 1), HIGHEST)
    order = np.argsort(h, kind="stable")
    s = h[order]
    alone = np.ones(len(s), bool)
    alone[1:] &= s[1:] != s[:-1]
    alone[:-1] &= s[1:] != s[:-1]
    offset = np.arange(side + 1)
    lone = order[alone]
    valid = (offset <= n_left[:, None]) & (offset >= side - n_right[:, None])
    out[lone] = np.where(valid[lone], doc[lone][:, None], HIGHEST)
    more = order[~alone]
    for at in _cuts(h[more], 1 << 15):
        i = more[at]
        if len(i) > HOT:  # one digit with many surroundings: no table of all prefixes, so that memory is that of the records alone
            for o in range(side + 1):
                r = np.flatnonzero(valid[i, o])
                (la, lb), (ra, rb) = _prefix(left[i[r]], o, 3), _prefix(right[i[r]], side - o, 5)
                _least(out, i[r], o, h[i[r]], la, lb, ra, rb, doc[i[r]])
            continue
        la, lb = _runs(left[i], 3)
        ra, rb = _runs(right[i], 5)
        own_h, own_doc, fits = h[i], doc[i], np.ascontiguousarray(valid[i].T)
        for o in range(side + 1):
            r = np.flatnonzero(fits[o])
            _least(out, i[r], o, own_h[r], la[o][r], lb[o][r], ra[side - o][r], rb[side - o][r], own_doc[r])
    return out


def _least(out, record, o: int, h, la, lb, ra, rb, doc) -> None:
    """Sets ``out[record, o]`` to the smallest doc of equal windows, each given by its digit and the bytes left and right of it."""
    x = mix(h + mix(la * _K + ra))
    y = mix(lb * U(0xD6E8FEB86659FD93) + rb + h)
    if not len(x):
        return
    sort = np.argsort(x)
    again, differs = x[sort][1:] == x[sort][:-1], y[sort][1:] != y[sort][:-1]
    if (again & differs).any():  # the first hash alone does not tell the windows apart
        sort = np.lexsort((y, x))
        again, differs = x[sort][1:] == x[sort][:-1], y[sort][1:] != y[sort][:-1]
    new = np.append(True, ~again | differs)
    out[record[sort], o] = np.minimum.reduceat(doc[sort], np.flatnonzero(new))[np.cumsum(new) - 1]


def _prefix(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the first ``k`` bytes of each row, as in :func:`_runs`."""
    a, b = np.full(len(x), U(seed)), np.full(len(x), U(seed + 100))
    for c in range(k):
        a = mix(a * _K + x[:, c])
        b = mix(b + (x[:, c].astype(U) + U(77)) * U(0xD6E8FEB86659FD93))
    return a, b


def _cuts(sorted_keys: np.ndarray, size: int):
    """Slices of about ``size`` rows that never part equal keys."""
    at = 0
    while at < len(sorted_keys):
        end = min(len(sorted_keys), at + size)
        end = int(np.searchsorted(sorted_keys, sorted_keys[end - 1], side="right"))
        yield slice(at, end)
        at = end


def _runs(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the first 0, 1, 2, ... bytes of each row: a line for each number of bytes."""
    a = np.empty((x.shape[1] + 1, len(x)), U)
    b = np.empty_like(a)
    a[0], b[0] = U(seed), U(seed + 100)
    for c, byte in enumerate(x.T.astype(U)):
        a[c + 1] = mix(a[c] * _K + byte)
        b[c + 1] = mix(b[c] + (byte + U(77)) * U(0xD6E8FEB86659FD93))
    return a, b


def _file(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _by_bucket(bucket: np.ndarray):
    """(bucket, slice) of an ascending array."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, len(bucket))):
        if b > a:
            yield int(bucket[a]), slice(int(a), int(b))


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, digit: int = DIGIT, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, chunk_bytes: int | None = None, keep_bytes: bool = True) -> DataFrame:
    """Per document what is left without repeated strings of ``width`` bytes: counts, digest, and the bytes themselves."""
    spark = docs.sparkSession
    side = width - digit
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("d"), F.col(id_col).isNull().alias("z"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(1, math.ceil(math.log2(max(1, total) / bucket_bytes)))
    chunk_bytes = chunk_bytes or min(64 << 20, max(4 << 20, total // 20_000))
    folder = new_path(spark, "chunks")

    def cut(batches):
        import xxhash

        system, path = _file(folder)
        system.create_dir(path, recursive=True)
        ids, texts, size = [], [], 0

        def flush():
            chunk = Chunk(np.array(ids, np.int64), np.array([len(t) for t in texts], np.int64), b"".join(texts), width, digit)
            data = chunk.pack()
            name = f"{xxhash.xxh64_hexdigest(data)}-{len(data)}-{ids[0]}"
            part = f"{path}/.{name}.{np.random.default_rng().integers(1 << 62)}"
            with system.open_output_stream(part) as out:
                out.write(data)
            system.move(part, f"{path}/{name}")
            bucket, sent, own, _, _ = chunk.digits_by_bucket(bits)
            low = sent.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]
            b, p = [None], [None]
            for k, at in _by_bucket(bucket):
                b.append(k)
                p.append(np.array([at.stop - at.start], "<i8").tobytes() + np.ascontiguousarray(low[at]).tobytes() + np.packbits(own[at]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([name] * len(b)), pa.array(b, pa.int64()), pa.array(p, pa.binary())], names=["chunk", "bucket", "data"])

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                ids.append(d)
                texts.append(t)
                size += len(t)
                if size >= chunk_bytes:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    def met_again(table: pa.Table) -> pa.Table:
        name, data = table.column("chunk").to_pylist(), table.column("data").to_pylist()
        n = [int(np.frombuffer(x, "<i8", 1)[0]) for x in data]
        value = np.zeros((sum(n), 8), np.uint8)
        value[:, :SENT] = np.concatenate([np.frombuffer(x, np.uint8, SENT * k, 8).reshape(-1, SENT) for x, k in zip(data, n)])
        value = value.view("<u8").ravel()
        own = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=8 + SENT * k), count=k) for x, k in zip(data, n)]).astype(bool)
        order = np.argsort(value)
        s = value[order]
        twice = own[order]
        twice[1:] |= s[1:] == s[:-1]
        twice[:-1] |= s[1:] == s[:-1]
        again = np.empty(len(s), bool)
        again[order] = twice
        parts = np.split(again, np.cumsum(n)[:-1])
        return pa.table({"chunk": name, "bucket": table.column("bucket"), "data": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})

    def load(name: str) -> Chunk:
        system, path = _file(f"{folder}/{name}")
        with system.open_input_stream(path) as f:
            return Chunk.unpack(f.read(), width, digit)

    def answered(chunk: Chunk, bucket_list, data_list) -> np.ndarray:
        bucket, _, _, _, _ = chunk.digits_by_bucket(bits)
        got = dict(zip(bucket_list, data_list))
        again = np.zeros(len(bucket), bool)
        for k, at in _by_bucket(bucket):
            if k in got:
                again[at] = np.unpackbits(np.frombuffer(got[k], np.uint8), count=at.stop - at.start).astype(bool)
        return again

    def surroundings(table: pa.Table) -> pa.Table:
        name = table.column("chunk")[0].as_py()
        chunk = load(name)
        (bucket, h, left, right, n_left, n_right, doc), _ = chunk.records(bits, answered(chunk, table.column("bucket").to_pylist(), table.column("data").to_pylist()))
        b, n, p = [], [], []
        for k, at in _by_bucket(bucket):
            b.append(k)
            n.append(at.stop - at.start)
            p.append(_squeeze(h[at].astype("<u8"), doc[at].astype("<i8"), n_left[at].astype(np.uint8), n_right[at].astype(np.uint8), left[at], right[at]))
        return pa.table({"chunk": pa.array([name] * len(b), pa.string()), "bucket": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64()), "data": pa.array(p, pa.binary())})

    def windows(table: pa.Table) -> pa.Table:
        name, n = table.column("chunk").to_pylist(), table.column("n").to_pylist()
        parts = [_expand(x, ("<u8", k), ("<i8", k), (np.uint8, k), (np.uint8, k), (np.uint8, k * side), (np.uint8, k * side)) for x, k in zip(table.column("data").to_pylist(), n)]
        h, doc, n_left, n_right, left, right = (np.concatenate(c) for c in zip(*parts))
        least = smallest(h, left.reshape(-1, side), right.reshape(-1, side), n_left.astype(np.int64), n_right.astype(np.int64), doc, side)
        return pa.table({"chunk": name, "bucket": table.column("bucket"), "data": pa.array([_squeeze(x.T.astype("<i8")) for x in np.split(least, np.cumsum(n)[:-1])], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        name = table.column("chunk")[0].as_py()
        chunk = load(name)
        kind, bucket, data = (table.column(c).to_pylist() for c in ("kind", "bucket", "data"))
        times = max(1, kind.count(0))
        one = [(b, x) for k, b, x in zip(kind, bucket, data) if k == 1]
        two = dict((b, x) for k, b, x in zip(kind, bucket, data) if k == 2)
        cover = np.zeros(len(chunk.buf) + 1, np.int32)
        if two:
            (own_bucket, *_), (anchor, record) = chunk.records(bits, answered(chunk, [b for b, _ in one], [x for _, x in one]))
            least = np.full((side + 1, len(own_bucket)), HIGHEST)
            for k, at in _by_bucket(own_bucket):
                m = at.stop - at.start
                least[:, at] = _expand(two[k], ("<i8", m * (side + 1)))[0].reshape(side + 1, m)
            doc = chunk.ids[chunk.doc[anchor]]
            some = least.min(axis=0)[record] < doc  # a window of the others is nowhere again
            anchor, record, doc = anchor[some], record[some], doc[some]
            for o in range(side + 1):
                p = chunk.at[anchor] - o
                p = p[(least[o][record] < doc) & (p >= chunk.first[anchor]) & (p <= chunk.last[anchor])]
                cover[p] += 1  # one offset: no place twice
                cover[p + width] -= 1
        removed = np.cumsum(cover[:-1]) > 0
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for d, a, b in zip(chunk.ids.tolist(), (chunk.end - chunk.sizes).tolist(), chunk.end.tolist()):
            r = removed[a:b]
            left = chunk.buf[a:b][~r].tobytes()
            spans = int(r[:1].sum() + (r[1:] & ~r[:-1]).sum())
            for c, v in zip(out, (None if d == LOWEST else d, b - a, int(r.sum()), spans, hashlib.sha256(left).hexdigest(), left if keep_bytes else None)):
                out[c] += [v]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        found = pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))
        return pa.concat_tables([found] * times)  # chunks of equal content are one file

    first = materialize(rows.mapInArrow(cut, "chunk string, bucket long, data binary"), "digits")
    again = first.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(met_again, "chunk string, bucket long, data binary")
    again = materialize(again, "digits-again")
    records = again.groupBy("chunk").applyInArrow(surroundings, "chunk string, bucket long, n long, data binary")
    least = records.groupBy("bucket").applyInArrow(windows, "chunk string, bucket long, data binary")
    all_ = first.where("bucket IS NULL").select("chunk", F.lit(0).alias("kind"), "bucket", "data")
    all_ = all_.unionByName(again.select("chunk", F.lit(1).alias("kind"), "bucket", "data")).unionByName(least.select("chunk", F.lit(2).alias("kind"), "bucket", "data"))
    return all_.groupBy("chunk").applyInArrow(finish, RESULT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


OP1_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), b AS (
  SELECT doc_id, h, n, unnest(range(n)) AS i FROM d WHERE n > 0
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN i + 50 <= n THEN substr(h, 2 * i + 1, 100) END AS s FROM b
), g AS (
  SELECT doc_id, i, x, coalesce(s IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY s), false) AS again FROM w
), r AS (
  SELECT doc_id, i, x, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g
), p AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM r
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans,
         string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM p GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
