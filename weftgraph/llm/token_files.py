"""Token ids as seekable zstandard files (operator 4).

A shard holds the ids of a range of documents, in ascending doc_id order, as independent zstandard frames of ``FRAME`` ids
each; one more frame holds the shard's index (doc_id, number of ids).  A trailing seek table in a skippable frame gives
every frame's compressed size, decompressed size and checksum, in the layout of the public seekable format, so a reader
decompresses only the frames that a document covers and notices any damage.  ``manifest`` gives each shard's place in the whole order.

Scale: documents are range partitioned by (doc_id, text hash), so equal ids spread too; a task streams its rows and keeps one
frame and the shard's index.  Files get their name from the partition and are renamed into place when complete: a task
that runs again after a lost executor writes the same bytes to the same name.

Cases: null text is encoded as empty and has the end id only; equal ids are ordered by text hash; a null doc_id comes first and
is kept as null; ids of a very long text run over many frames; an empty table gives no shard with documents.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import new_path, read_table, text_of

FRAME = 1 << 17
END = 2
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
MANIFEST = "shard int, path string, n_docs long, n_ids long"
DOCS = "shard int, ordinal long, doc_id long, start long, n_tokens long, ids_crc32 long"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Frames, index and seek table of one shard; ``add`` takes the ids of whole documents."""

    def __init__(self, out, width: int = 2, frame: int = FRAME, level: int = 3):
        import zstandard

        self.out, self.dtype, self.frame = out, np.dtype(f"<u{width}"), frame
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.press.compress(data)
        self.out.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_ids, lengths, ids: np.ndarray) -> None:
        self.ids += doc_ids
        self.lengths += [int(n) for n in lengths]
        self.n_ids += len(ids)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= self.frame:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.frame * self.frame
            for at in range(0, whole, self.frame):
                self._frame(flat[at : at + self.frame].tobytes())
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.n_held:
            self._frame(np.concatenate(self.held).tobytes())
        null = np.array([i is None for i in self.ids], np.uint8)
        index = struct.pack("<QIB", len(self.ids), self.frame, self.dtype.itemsize)
        index += null.tobytes() + np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes()
        self._frame(index)
        body = b"".join(struct.pack("<III", *row) for row in self.table) + struct.pack("<IBI", len(self.table), 1 << 7, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class ShardReader:
    """Random access to one shard through its seek table."""

    def __init__(self, uri: str):
        import zstandard

        system, path = _open(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        foot = self.file.read_at(9, size - 9)
        n, flags, magic = struct.unpack("<IBI", foot)
        if magic != SEEKABLE or not flags & 1 << 7:
            raise ValueError(f"{uri}: no seek table with checksums")
        rows = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.packed, self.plain, self.check = rows[:, 0].astype(np.int64), rows[:, 1], rows[:, 2]
        self.at = np.cumsum(self.packed) - self.packed
        self.press = zstandard.ZstdDecompressor()
        index = self.frame(n - 1)
        docs, self.per_frame, width = struct.unpack_from("<QIB", index)
        self.dtype, o = np.dtype(f"<u{width}"), 13
        null = np.frombuffer(index, np.uint8, docs, o)
        ids = np.frombuffer(index, "<i8", docs, o + docs)
        self.doc_ids = [None if z else int(i) for z, i in zip(null, ids)]
        self.lengths = np.frombuffer(index, "<i8", docs, o + 9 * docs)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        import xxhash

        data = self.press.decompress(self.file.read_at(int(self.packed[k]), int(self.at[k])), max_output_size=int(self.plain[k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != int(self.check[k]):
            raise ValueError(f"frame {k} is damaged")
        self.frames_read = getattr(self, "frames_read", 0) + 1
        return data

    def document(self, ordinal: int) -> np.ndarray:
        """The ids of the shard's document of this ordinal; only the frames it covers are decompressed."""
        first, n = int(self.starts[ordinal]), int(self.lengths[ordinal])
        a, b = first // self.per_frame, max(first, first + n - 1) // self.per_frame
        flat = np.frombuffer(b"".join(self.frame(k) for k in range(a, b + 1)), self.dtype)
        return flat[first - a * self.per_frame :][:n].astype(np.uint32)

    def checksums(self):
        """(ordinal, crc32 of the ids as 32-bit integers) of all documents, frame by frame."""
        k, held, o = -1, np.empty(0, np.uint32), 0
        for ordinal, n in enumerate(self.lengths):
            crc, n = 0, int(n)
            while n:
                if o == len(held):
                    k, o = k + 1, 0
                    held = np.frombuffer(self.frame(k), self.dtype).astype("<u4")
                take = min(n, len(held) - o)
                crc = zlib.crc32(held[o : o + take].tobytes(), crc)
                o, n = o + take, n - take
            yield ordinal, crc


def write_tokens(docs: DataFrame, out_dir: str, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, frame: int = FRAME) -> DataFrame:
    """Write ``docs`` as shards under ``out_dir``; returns the manifest, which is also kept there as a table."""
    rows = docs.select(F.col(id_col).cast("long").alias("d"), text_of(text_col).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("d", "h").sortWithinPartitions("d", "h").select("d", "t")

    def write(batches):
        shard = TaskContext.get().partitionId()
        enc = tokens.encoder(tokenizer)
        system, folder = _open(out_dir)
        system.create_dir(folder, recursive=True)
        name = f"part-{shard:07d}.tok"
        part = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(part) as out:
            shard_out = ShardWriter(out, 2 if enc.full.get_vocab_size() <= 1 << 16 else 4, frame)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in tokens.slices(texts):
                    flat, lengths = enc.encode(texts[a:b])
                    ends = np.cumsum(lengths)
                    shard_out.add(ids[a:b], lengths + 1, np.insert(flat, ends, end))
            shard_out.close()
        system.move(part, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{out_dir}/{name}"], "n_docs": [len(shard_out.ids)], "n_ids": [shard_out.n_ids]})

    found = rows.mapInArrow(write, MANIFEST)
    found.write.parquet(f"{out_dir}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(shard, ordinal, doc_id, start, n_tokens, ids_crc32) per document, read from the shards of a manifest."""
    n = max(1, manifest.count())
    # One row per shard: their running sum is one small sort.
    placed = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = placed.repartition(n, "shard")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["path"])
                crc = np.fromiter((c for _, c in shard.checksums()), np.int64, len(shard.lengths))
                step = 50_000
                for a in range(0, len(crc), step):
                    k = np.arange(a, min(a + step, len(crc)))
                    yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]] * len(k), pa.int32()), "ordinal": k, "doc_id": pa.array(shard.doc_ids[a : a + step], pa.int64()), "start": row["base"] + shard.starts[k], "n_tokens": shard.lengths[k], "ids_crc32": crc[k]})

    return placed.mapInArrow(read, DOCS)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, new_path(spark, "tokens"), tokenizer=tokens.default_path())
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "ordinal")
