"""Near-duplicate documents by an LSH forest over SimHash (operator 3).

Words are runs of anything but ASCII white space and punctuation, in lower case (a text of punctuation alone is split at white space).  Two
documents are near copies if the cosine of their sets of five-word shingles is ``THRESHOLD`` or more: the similarity whose angle SimHash
estimates.  Classes are the connected components of that relation.

1. Every text gets a 256-bit SimHash of its shingle set and a fingerprint of the set.  Texts with equal sets are one class at
   once; only the member with the smallest id goes on, so thousands of copies cost one row.
2. Forest: only representatives enough of whose smallest shingle hashes are among those of others take part (:func:`partnered`); a pair of any other would
   not pass the bound on similarity below.  Each try orders them by their bits in another random permutation.  A row looks back at the ``REACH`` rows
   before it, which are those with the longest common prefixes: the depth adapts to the density, and shorter prefixes are reached
   where the tree is thin.  The number of tries follows from the number of rows: enough that a pair at the threshold shares, with
   probability ``RECALL``, a prefix deep enough in one of them.
3. Each row offers its nearest row and the earlier one of lowest rank, among those within ``BITS`` bits.  The connected groups of offers are compared
   whole, on the shingle sets of all their rows: a crowd of variants of one text has far more pairs than a join of pairs with texts can carry, but few
   shingles that many rows hold, so that products of matrices count what its rows share.  Of groups of more than ``MOST_BLOCKS`` blocks only the offers are
   verified, on the texts, the best of each row first, then those that still join two components.
4. Climb: rows that met more than they offered in a try stand in a crowd that may hide more, outside of a group that was compared whole.  For them passes of further tries offer every row of another
   component within ``BITS`` bits, not only the nearest, and each pass looks back twice as far as the last: up to prefixes a bit
   shorter.  What was tested is left out, and all the rest is tested, nearest first, in batches of bounded size.  The climb ends with a pass in
   which all that was offered is tested and no link is found.

Rows whose numbers of shingles differ too much to reach ``THRESHOLD`` are no candidates.  ``BITS`` is three standard deviations beyond the
distance of a pair at the threshold.  Before texts are fetched, the ``SKETCH`` smallest shingle hashes of both sets bound their similarity: exact
for sets of that size or less, ``SIGMAS`` standard errors wide for larger ones; only pairs whose upper bound reaches ``THRESHOLD`` go on.

Scale: a try is rows of 40 bytes, spread by (try, leading bits), sorted in the JVM and streamed; no group is ever held, whatever its size.
Links, components and fingerprints stay distributed; only counts reach the driver.  A group travels as shingle hashes, in blocks of ``BLOCK`` hashes that meet
pair by pair, so memory does not depend on its size.  Verification of single pairs joins them with the texts they name alone.  Shuffle files and tables of rows go from the disk as soon as nothing reads them.

Cases: null texts and texts without words are alone in their class; texts of one to four words have one shingle, all their words; very long
texts are cut into words in slices and have one sketch like any other; ties between nearest rows go to the smaller rank, so reruns agree; a
repeated (doc_id, text) is an ordinary copy; rows with the same id and different texts count as one document (they share a class); rows with a null id
are never linked: each is in the result with a null class and kept; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import math
import string
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, drop_materialized, materialize, read_table, spent_shuffles_removed
from .textbytes import Words, mix, slices

SHINGLE, THRESHOLD, RECALL, REACH, BITS, SEED = 5, 0.8, 0.95, 128, 72, 11
SKETCH, SIGMAS, WIDE = 64, 5.0, 256
#: So many ids are sent to all tasks to pick their texts; of more, texts are joined by a shuffle.
SENT = 1 << 20
DENSE_REACH, BATCH, LEAST_BATCH = 256, 8, 1 << 16
#: Hashes in a block of a group that is compared whole, as how many a row counts at least, the most blocks of such a group, and from how many rows a hash is counted by matrices.
BLOCK, LEAST_HASHES, MOST_BLOCKS, COMMON = 1 << 21, 1 << 10, 32, 8
#: Hashes that one bucket compares, and rows of a chunk, which are named by 16 bits.
PROBES, CHUNK_ROWS = 1 << 21, 1 << 15
_MARKS = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
#: The bits of a byte as 0 or 1 in the bytes of a word, so that eight counters add up in one.
_LANES = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).view("<u8").ravel()
SIGNED = "doc_id long, n long, f1 long, f2 long, s1 long, s2 long, s3 long, s4 long, sketch binary, tails binary"
BITS_OF = ("s1", "s2", "s3", "s4")
U = np.uint64


def plain(text: str) -> bytes:
    """The text whose words are compared: lower case, without ASCII punctuation unless it has nothing else."""
    low = text.lower().encode("utf-8", "surrogatepass")
    bare = low.translate(_MARKS)
    return low if bare.isspace() else bare


def shingle_sets(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, number per text)."""
    w = Words([plain(t) for t in texts])
    h = w.hashes()
    n = len(h)
    short = w.per_doc < width
    first = np.cumsum(w.per_doc) - w.per_doc
    s = np.full(n, U(0x2545F4914F6CDD1D))
    for k in range(width):
        # A text shorter than the width has one shingle of all its words.
        at = np.arange(n) + k
        inside = at < n
        part = np.zeros(n, U)
        part[inside] = h[at[inside]]
        same = inside & (w.doc == w.doc[np.minimum(at, n - 1)])
        s = np.where(same, mix(s * U(0x9E3779B97F4A7C15) + part), s)
    rank = np.arange(n) - first[w.doc] if n else np.zeros(0, int)
    valid = np.where(short[w.doc], rank == 0, rank + width <= w.per_doc[w.doc]) if n else np.zeros(0, bool)
    doc, s = w.doc[valid], s[valid]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], np.bincount(doc[new], minlength=len(texts))


def votes(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(groups, 64): how many of a group's words have each bit, the highest first; groups begin at ``starts``."""
    n = np.diff(np.append(starts, len(words)))
    parts = -(-n // 255)  # counters of one byte
    first = np.cumsum(parts) - parts
    at = np.repeat(starts - 255 * first, parts) + 255 * np.arange(parts.sum())
    byte = words.astype(">u8").view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_LANES[byte[:, k]], at) for k in range(8)], 1)
    return np.add.reduceat(np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int32)


def signatures(texts: list[str]) -> list:
    """n, two words of the set's fingerprint and four of its SimHash (0 where it has no words), its smallest hashes and their next 16 bits, for each text."""
    s, n = shingle_sets(texts)
    out = [n.astype(np.int64), *(np.zeros(len(texts), U) for _ in range(6))]
    live = np.flatnonzero(n)
    if len(live):
        starts = (np.cumsum(n) - n)[live]
        a, b = mix(s ^ U(0xA5A5A5A55A5A5A5A)), mix(s + U(0x632BE59BD9B4E019))
        out[1][live], out[2][live] = np.add.reduceat(a, starts), np.add.reduceat(b, starts)
        for k, x in enumerate((mix(a), mix(b), mix(a + U(1)), mix(b + U(1))), 3):
            even = 2 * votes(x, starts) - n[live][:, None]  # a draw goes by the smallest shingle, which few edits change
            draw = np.unpackbits(x[starts].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            out[k][live] = np.packbits(even + draw > 0, axis=1).view(">u8").ravel().astype(U)
    low = (s >> U(32)).astype("<u4").tobytes()
    tail = (s >> U(16)).astype("<u2").tobytes()
    ends = np.cumsum(n)
    sketch = [low[4 * (e - k) : 4 * (e - k + min(k, SKETCH))] for e, k in zip(ends.tolist(), n.tolist())]
    tails = [tail[2 * (e - k) : 2 * (e - k + min(k, SKETCH))] for e, k in zip(ends.tolist(), n.tolist())]
    return [out[0], *(x.view(np.int64) for x in out[1:]), sketch, tails]


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([ids[a:b], *map(pa.array, signatures(texts[a:b]))], names=["doc_id", "n", "f1", "f2", *BITS_OF, "sketch", "tails"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SIGNED)


def least_common(n: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """How many of the smallest hashes of a set of ``n`` another set has to hold at least, whatever its size, for :func:`possible` to be true."""
    share = threshold**2  # the least for large sets, where one is so much smaller than the other that it lies in it
    large = SKETCH * (share - SIGMAS * math.sqrt(share * (1 - share) / SKETCH))
    return np.minimum(share * n, large) - 1e-6


def _first_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of these ascending values is the first of its kind, and whether it has an equal."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    equal = ~new
    equal[:-1] |= ~new[1:]
    return new, equal


def partnered(sets: DataFrame, rows: int, threshold: float = THRESHOLD, probes: int = PROBES) -> DataFrame:
    """(node) of the rows whose smallest hashes are, as many as :func:`least_common` asks for, also among those of other rows.

    No pair of any other row passes :func:`possible`.  ``sets``: (node, n, sketch, tails), ``rows`` of them.  A chunk of rows sends each distinct
    hash (48 bits) once to its bucket, with the row that holds it unless several do; the bucket answers with the rows whose hash came from another chunk too.
    """
    if least_common(np.array([1 << 40]), threshold)[0] <= 0:
        return sets.select("node").distinct()
    bits = max(0, math.ceil(math.log2(max(1, rows * SKETCH / probes))))

    def send(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                node, n, sketch, tails = batch.slice(at, CHUNK_ROWS).columns
                high, low = b"".join(sketch.to_pylist()), b"".join(tails.to_pylist())
                per_row = pa.compute.binary_length(sketch).to_numpy() // 4
                h = mix(np.frombuffer(high, "<u4").astype(U) << U(32) | np.frombuffer(low, "<u2").astype(U) << U(16)) & ~U(0xFFFF)
                h = np.sort(h | np.repeat(np.arange(len(per_row), dtype=U), per_row))
                new, equal = _first_of(h >> U(16))
                met = np.bincount((h[equal] & U(0xFFFF)).astype(np.int64), minlength=len(per_row))
                sent = np.where(equal, h | U(0xFFFF), h)[new]
                cut = np.searchsorted(sent >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U)) if bits else np.array([0, len(sent)])
                own = np.concatenate([np.asarray(node), np.asarray(n), met]).astype("<i8").tobytes()
                parts = [(b, sent[i:j].astype("<u8").tobytes()) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if j > i]
                name = uuid.uuid4().hex
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(parts) + 1)), pa.array([None, *(b for b, _ in parts)], pa.int64()), pa.array([own, *(x for _, x in parts)], pa.binary())], names=["chunk", "bucket", "data"])

    def answer(table: pa.Table) -> pa.Table:
        name, parts = table.column("chunk").to_pylist(), [np.frombuffer(x, "<u8") for x in table.column("data").to_pylist()]
        v = np.concatenate(parts)
        order = np.argsort(v, kind="stable")
        equal = np.empty(len(v), bool)
        equal[order] = _first_of(v[order] >> U(16))[1]
        row = (v & U(0xFFFF)).astype("<u2")
        equal &= row != 0xFFFF
        at = np.cumsum([0, *map(len, parts)]).tolist()
        return pa.table({"chunk": name, "data": pa.array([row[i:j][equal[i:j]].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())})

    def settle(table: pa.Table) -> pa.Table:
        own, data = table.column("own").to_pylist(), table.column("data").to_pylist()
        node, n, met = np.frombuffer(data[own.index(True)], "<i8").reshape(3, -1)
        for x, is_own in zip(data, own):
            if not is_own:
                met = met + np.bincount(np.frombuffer(x, "<u2"), minlength=len(n))
        return pa.table({"node": node[met >= least_common(n, threshold)]})

    sent = materialize(sets.select("node", "n", "sketch", "tails").mapInArrow(send, "chunk string, bucket long, data binary"), "near-probes")
    answers = sent.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(answer, "chunk string, data binary")
    both = sent.where("bucket IS NULL").select("chunk", "data", F.lit(True).alias("own")).unionByName(answers.withColumn("own", F.lit(False)))
    found = materialize(both.groupBy("chunk").applyInArrow(settle, "node long").distinct(), "near-partnered")
    drop_materialized(sets.sparkSession, sent)
    return found


def tries(rows: int, threshold: float = THRESHOLD, recall: float = RECALL, reach: int = REACH) -> int:
    """How many permutations a pair at the threshold needs to share a deep enough prefix with probability ``recall``."""
    depth = max(0.0, math.log2(max(1, rows) / reach) + 0.5)
    agree = 1 - math.acos(threshold) / math.pi
    hit = agree**depth
    return 8 if hit > 0.999 else max(8, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def _permutations(n: int) -> list[np.ndarray]:
    rnd = np.random.default_rng(SEED)
    return [rnd.permutation(WIDE) for _ in range(n)]


def forest(reps: DataFrame, n_tries: int, lead: int, *, first_try: int = 0, reach: int = REACH, every: bool = False, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, d): candidate pairs, ``b`` of higher rank, and their distance in bits.

    ``reps``: (node, s1 to s4, n, and maybe comp and whole).  In every try each row offers its nearest row on either side and the earlier one of lowest
    rank, among those within ``reach`` places and ``bits`` bits, of another component (comp), of another group that was compared whole, and of a size
    that allows ``threshold``; with ``every``, all of these.  Rows (a, a, -1) name those that met more than they offered.
    """

    names = [*BITS_OF, "node", "n", *(c for c in ("comp", "whole") if c in reps.columns)]  # without them each row is its own

    def plant(batches):
        perms = _permutations(first_try + n_tries)[first_try:]
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.stack([np.asarray(batch.column(i)).view(U) for i in range(4)], 1).astype(">u8")
            plane = np.unpackbits(np.ascontiguousarray(s).view(np.uint8).reshape(len(s), WIDE // 8), axis=1)
            for t, perm in enumerate(perms):
                key = np.ascontiguousarray(np.packbits(plane[:, perm[:64]], axis=1)).view(">u8").ravel().astype(U)
                cell = np.full(len(s), t << 32) + ((key >> U(64 - lead)).astype(np.int64) if lead else 0)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array((key ^ U(1 << 63)).view(np.int64)), *batch.columns], names=["cell", "key", *names])

    def offered(node, rank, i, j, d):
        up = rank[i] > rank[j]
        pair = np.unique(np.stack([np.where(up, node[j], node[i]), np.where(up, node[i], node[j]), d], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(pair.T)], names=["a", "b", "d"])

    def apart(s, i, j):
        return sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in s)

    def look(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(c) for c in (batch.column(0), *batch.columns[2:])]
            cell, *s, node, size, comp, whole = both = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            old, n = 0 if held is None else len(held[0]), len(node)
            rank, s = mix(node.view(U)), [x.view(U) for x in s]  # bits are counted unsigned
            near, near_at = np.full(n, 1 << 10, np.int64), np.full(n, -1)
            low, low_at, met = np.full(n, (1 << 64) - 1, U), np.full(n, -1), np.zeros(n, np.int64)
            full, waiting = [], 0
            for k in range(1, min(reach, n - 1) + 1):
                i = np.arange(max(old, k), n)
                d = np.bitwise_count(s[0][i] ^ s[0][i - k])
                i = i[d <= bits]  # most pairs are told apart by their first words
                d = np.bitwise_count(s[0][i] ^ s[0][i - k]) + np.bitwise_count(s[1][i] ^ s[1][i - k])
                i = i[d <= bits]
                j = i - k
                d = apart(s, i, j)
                ok = (d <= bits) & (cell[i] == cell[j]) & (comp[i] != comp[j]) & (whole[i] != whole[j])
                ok &= np.minimum(size[i], size[j]) >= threshold**2 * np.maximum(size[i], size[j]) - 1e-9
                if not ok.any():
                    continue
                i, j, d = i[ok], j[ok], d[ok]
                if every:
                    full.append((i, j, d))
                    waiting += len(i)
                    if waiting > 1 << 18:
                        yield offered(node, rank, *map(np.concatenate, zip(*full)))
                        full, waiting = [], 0
                    continue
                for x, y in ((i, j), (j, i)):
                    met[x] += 1
                    b = d < near[x]
                    near[x[b]], near_at[x[b]] = d[b], y[b]
                lower = rank[j] < low[i]
                low[i[lower]], low_at[i[lower]] = rank[j][lower], j[lower]
            if waiting:
                yield offered(node, rank, *map(np.concatenate, zip(*full)))
            at = np.concatenate([near_at, low_at])
            i = np.tile(np.arange(n), 2)[at >= 0]
            j = at[at >= 0]
            if len(i):
                yield offered(node, rank, i, j, apart(s, i, j))
            more = np.flatnonzero(met > 1)  # not all that these rows met is offered: d = -1
            if len(more):
                yield pa.RecordBatch.from_arrays([pa.array(node[more]), pa.array(node[more]), pa.array(np.full(len(more), -1))], names=["a", "b", "d"])
            held = [x[-reach:] for x in both]

    planted = reps.select(*names).mapInArrow(plant, "cell long, key long, " + ", ".join(f"{c} long" for c in names))
    spread = planted.repartition("cell").sortWithinPartitions("cell", "key", "node")
    spread = spread.select("cell", "key", *BITS_OF, "node", "n", *(c if c in names else F.col("node").alias(c) for c in ("comp", "whole")))
    return spread.mapInArrow(look, "a long, b long, d long").distinct()


def possible(one: list[bytes], two: list[bytes], n1: np.ndarray, n2: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Whether sets of ``n1`` and ``n2`` shingles with these smallest hashes may be ``threshold`` similar."""
    flat = np.full((len(one), 2 * SKETCH), (1 << 33) - 1, np.int64)
    size = np.array([(len(x) // 4, len(y) // 4) for x, y in zip(one, two)]).reshape(-1, 2)
    col = np.arange(SKETCH)
    flat[:, :SKETCH][col < size[:, :1]] = np.frombuffer(b"".join(one), "<u4")
    flat[:, SKETCH:][col < size[:, 1:]] = np.frombuffer(b"".join(two), "<u4")
    flat.sort(axis=1)
    real = flat < 1 << 32
    again = np.zeros_like(real)
    again[:, 1:] = real[:, 1:] & (flat[:, 1:] == flat[:, :-1])
    rank = np.cumsum(real & ~again, axis=1)  # among the distinct hashes of both
    small = np.maximum(n1, n2) <= SKETCH
    seen = np.where(small, 2 * SKETCH, SKETCH)
    common = (again & (rank <= seen[:, None])).sum(1)
    need = threshold * np.sqrt(n1.astype(float) * n2)
    share = need / np.maximum(n1 + n2 - need, 1e-9)
    least = share - SIGMAS * np.sqrt(np.maximum(0, share * (1 - share)) / SKETCH)
    return np.where(small, common >= need - 1e-9, common >= SKETCH * least - 1e-9)


def screened(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b, d) that their sketches don't rule out; ``sets``: (node, n, sketch)."""
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n1, n2 = (np.asarray(batch.column(i)) for i in (3, 5))
                ok = pa.array(possible(batch.column(4).to_pylist(), batch.column(6).to_pylist(), n1, n2, threshold))
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(ok) for i in range(3)], names=["a", "b", "d"])

    return pairs.select("a", "b", "d", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(run, "a long, b long, d long")


def asked(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that these pairs (a, b) name, picked without a shuffle if their ids can be sent to all tasks."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return texts.join(F.broadcast(ids) if ids.count() <= SENT else ids, "node", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets are at least ``threshold`` similar; ``texts``: (node, text).

    Only texts that a pair names are shuffled: later batches name few.  ``pairs`` are read twice.
    """
    texts = asked(texts, pairs)
    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches):
        for batch in batches:
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = np.zeros(len(one), bool)
            for first, last in slices([x if len(x) > len(y) else y for x, y in zip(one, two)], most=1 << 19):
                at: dict[str, int] = {}  # a text that several pairs share is cut into shingles once
                pair = [(at.setdefault(x, len(at)), at.setdefault(y, len(at))) for x, y in zip(one[first:last], two[first:last])]
                s, n = shingle_sets(list(at))
                sets = np.split(s, np.cumsum(n)[:-1])
                for k, (x, y) in enumerate(pair):
                    x, y = sets[x], sets[y]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok[first + k] = common > 0 and common >= threshold * math.sqrt(len(x) * len(y)) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def grouped(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, size, whole, block, blocks): the connected groups of these pairs (a, b), named by their smallest node, and the block of each of their rows."""
    size = F.greatest("n", F.lit(LEAST_HASHES))
    rows = connected_components(pairs).join(sets.select("node", size.alias("size")), "node")
    own = W.partitionBy("component")
    block = ((F.sum("size").over(own.orderBy("node")) - F.col("size")) / BLOCK).cast("long")
    rows = rows.select("node", "size", F.col("component").alias("whole"), block.alias("block"))
    return rows.withColumn("blocks", F.max("block").over(W.partitionBy("whole")) + 1)


def _linked(one: list[np.ndarray], two: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether the shingle sets of each of one and of each of two are at least ``threshold`` similar."""
    n1, n2 = (np.array([len(x) for x in sets], np.int64) for sets in (one, two))
    h = np.concatenate([*one, *two])
    row = np.repeat(np.arange(len(n1) + len(n2)), np.concatenate([n1, n2]))
    order = np.argsort(h, kind="stable")  # the rows of each hash in order, those of one before those of two
    h, row = h[order], row[order]
    new = np.flatnonzero(_first_of(h)[0])
    second = row >= len(n1)
    c2 = np.add.reduceat(second.astype(np.int64), new)
    held = np.diff(np.append(new, len(h)))
    c1 = held - c2
    common = np.zeros((len(n1), len(n2)), np.float32)
    much = (held >= COMMON) & (c1 > 0) & (c2 > 0)
    name = np.full(len(new), -1)
    name[much] = np.arange(much.sum())
    name = np.repeat(name, held)
    step = 1 << 11
    for at in range(0, int(much.sum()), step):
        here = (name >= at) & (name < at + step)
        m = np.zeros((len(n1) + len(n2), step), np.float32)
        m[row[here], name[here] - at] = 1
        common += m[: len(n1)] @ m[len(n1) :].T
    few = np.flatnonzero(~much & (c1 > 0) & (c2 > 0))  # at most COMMON rows each
    for x in range(COMMON):
        for y in range(COMMON - x):
            k = few[(c1[few] > x) & (c2[few] > y)]
            np.add.at(common, (row[new[k] + x], row[new[k] + c1[k] + y] - len(n1)), 1)
    return (common > 0) & (common >= threshold * np.sqrt(n1[:, None].astype(float) * n2) - 1e-9)


def _joined(link: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list, list]:
    """Edges (a, b) that join what these links between nodes of one and of two join, one a node."""
    a, b = [], []
    waiting, open_two = link.any(axis=1), np.ones(len(two), bool)
    for first in np.flatnonzero(waiting):
        if not waiting[first]:
            continue
        waiting[first] = False
        new = np.array([first])
        while len(new):
            a += one[new].tolist()
            b += [one[first]] * len(new)
            met = np.flatnonzero(open_two & link[new].any(axis=0))
            open_two[met] = False
            a += two[met].tolist()
            b += [one[first]] * len(met)
            new = np.flatnonzero(waiting & link[:, met].any(axis=1))
            waiting[new] = False
    return a, b


def compared(groups: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): edges that join all rows of each group whose shingle sets are linked by pairs that are at least ``threshold`` similar.

    ``groups``: as of :func:`grouped`, ``texts``: (node, text) of all their rows.  Groups of one block share tasks; the blocks of a larger one meet pair by pair.
    """
    lone = groups.where("blocks = 1").agg(F.sum("size")).first()[0] or 0
    tasks = 2 * lone // BLOCK + 1

    def hashes(batches):
        for batch in batches:
            text = batch.column(0).to_pylist()
            for i, j in slices(text):
                s, n = shingle_sets(text[i:j])
                sets = [x.tobytes() for x in np.split(s, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[1:]), pa.array(sets, pa.binary())], names=["node", "task", "block", "blocks", "data"])

    def meet(table: pa.Table) -> pa.Table:
        node, block = (np.asarray(table.column(c)) for c in ("node", "block"))
        sets = [np.frombuffer(x, U) for x in table.column("data").to_pylist()]
        first = np.flatnonzero(block == block.min())
        second = first if block.min() == block.max() else np.flatnonzero(block == block.max())
        a, b = [], []
        for i in range(0, len(first), 1 << 11):
            x = first[i : i + (1 << 11)]
            for j in range(0, len(second), 1 << 11):
                y = second[j : j + (1 << 11)]
                if first is second and j < i:
                    continue
                link = _linked([sets[k] for k in x], [sets[k] for k in y], threshold)
                if first is second and i == j:
                    np.fill_diagonal(link, False)
                for ends, more in zip((a, b), _joined(link, node[x], node[y])):
                    ends += more
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    task = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("whole"), F.lit(tasks))).otherwise(F.col("whole"))
    placed = groups.select("node", task.alias("task"), "block", "blocks")
    rows = texts.join(F.broadcast(placed) if placed.count() <= SENT else placed, "node").select("text", "node", "task", "block", "blocks")
    rows = rows.mapInArrow(hashes, "node long, task long, block long, blocks long, data binary")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("task", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "data")
    return rows.groupBy("task", "i", "j").applyInArrow(meet, "a long, b long").where("a <> b").distinct()


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    c = comps.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    d = comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(c, "a", "left").join(d, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "d")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, kept) for every row; ``class_id``: the smallest id of its near copies, null where the id is."""
    with spent_shuffles_removed(docs.sparkSession):
        return _near_duplicates(docs, id_col, text_col, threshold, recall)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float) -> DataFrame:
    spark = docs.sparkSession
    signed = materialize(sign(docs.where(F.col(id_col).isNotNull()), id_col, text_col), "signed")
    same = signed.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in BITS_OF], F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("sketch", "tails")])
    same = materialize(same, "near-sets")
    # What the result needs of these tables is kept apart, so that hashes and sketches can go.
    named, firsts = materialize(signed.select("doc_id", "n", "f1", "f2"), "near-named"), materialize(same.select("f1", "f2", "node"), "near-firsts")
    drop_materialized(spark, signed)
    live = materialize(same.drop("tails").join(partnered(same, same.count(), threshold), "node", "left_semi"), "near-live")
    drop_materialized(spark, same)
    rows = live.count()
    n = tries(rows, threshold, recall)
    lead = max(0, math.ceil(math.log2(max(1, rows) / (64 * REACH))))
    found = materialize(forest(live, n, lead, threshold=threshold), "near-found")
    sets = live.select("node", "n", "sketch")
    pool = materialize(screened(found.where("d >= 0"), sets, threshold), "near-pool")
    crowd = live.join(found.where("d < 0").select(F.col("a").alias("node")), "node", "left_semi").select("node", *BITS_OF, "n")
    crowd = materialize(crowd, "near-crowd")
    ids = pool.select(F.col("a").alias("node")).union(pool.select(F.col("b").alias("node"))).union(crowd.select("node")).distinct()
    ids = materialize(ids, "near-ids")
    own = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    texts = materialize(own.join(F.broadcast(ids) if ids.count() <= SENT else ids, "node"), "near-texts")

    groups = materialize(grouped(pool, sets), "near-groups")
    whole = groups.where(F.col("blocks") <= MOST_BLOCKS)
    links = materialize(compared(whole, texts, threshold), "near-links")
    whole = whole.select("node", "whole")
    best = F.row_number().over(W.partitionBy("b").orderBy("d", "a"))
    ranked = materialize(pool.join(whole.select(F.col("node").alias("a")), "a", "left_anti").withColumn("r", best), "near-ranked")
    if ranked.count():
        links = links.unionByName(materialize(verified(ranked.where("r = 1"), texts, threshold), "near-links"))
        comps = materialize(connected_components(links), "near-comps")
        left = materialize(_apart(ranked.where("r > 1"), comps), "near-left")
        links = links.unionByName(materialize(verified(left, texts, threshold), "near-links"))
    tested = found.where("d >= 0").select("a", "b")
    # Dense groups: further tries over rows that have neighbours, until a pass joins nothing.
    size, done = crowd.count(), n
    each = max(BATCH, LEAST_BATCH // max(1, size))
    n, reach = tries(size, threshold, recall, DENSE_REACH), DENSE_REACH
    comps = materialize(connected_components(links), "near-comps")
    while size:
        now = crowd.join(comps, "node", "left").join(whole, "node", "left").withColumn("comp", F.coalesce("component", "node")).withColumn("whole", F.coalesce("whole", "node"))
        lead = max(0, math.ceil(math.log2(max(1, size) / (64 * reach))))
        offers = forest(now, n, lead, first_try=done, reach=reach, every=True, threshold=threshold)
        offers = materialize(offers.join(tested, ["a", "b"], "left_anti"), "near-offers")
        tested, done, reach, joined = tested.unionByName(offers.select("a", "b")), done + n, 2 * reach, 0
        left = materialize(screened(offers, sets, threshold), "near-left")
        while waiting := left.count():
            batch = left
            if more := waiting > each * size:
                left = materialize(left.withColumn("r", best), "near-ranked")
                batch, left = left.where(F.col("r") <= each), left.where(F.col("r") > each).select("a", "b", "d")
            new = materialize(verified(batch, texts, threshold), "near-links")
            if found := new.count():
                joined, links = joined + found, links.unionByName(new)
                comps = materialize(connected_components(links), "near-comps")
                left = materialize(_apart(left, comps), "near-left") if more else left
            if not more:
                break
        if not joined:
            break
    drop_materialized(spark, texts)
    drop_materialized(spark, live)
    found = firsts.join(comps, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("node"))
    found = named.where("n > 0").join(found, ["f1", "f2"]).select("doc_id", F.col("node").alias("class_id"))
    alone = named.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"))
    found = found.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("class_id"))
    unnamed = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return found.unionByName(unnamed)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest id stays; of equal (doc_id, text), one row; all rows without an id."""
    found = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_s_id")).distinct()
    named = docs.where("doc_id IS NOT NULL").join(found, F.col("doc_id") == F.col("_s_id"), "left_semi")
    named = named.withColumns({"_s_a": F.xxhash64("text"), "_s_b": F.xxhash64(F.lit(3), "text")}).dropDuplicates(["doc_id", "_s_a", "_s_b"]).drop("_s_a", "_s_b")
    return named.unionByName(docs.where("doc_id IS NULL"))
