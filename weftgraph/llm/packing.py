"""Packing documents into sequences by a configuration linear program (operator 6).

The pieces' lengths form a histogram of at most ``capacity`` entries, whatever the number of documents.  A configuration is a
multiset of lengths that fits one sequence; the linear program covers every length as often as it occurs with as few
configurations as possible.

1. Multiplicative weights price the lengths.  A round weighs every configuration by the product of its lengths' weights, exp(price /
   temperature), in one knapsack dynamic program over the room that is left, and gets how often each length is used on average: the fractional
   solution of the round, held as the probabilities of each next length at each room.  Weights of lengths that are used too rarely
   grow by a power of what they lack; others shrink.  Every ``REFRESH`` rounds the exact knapsack finds the dearest configuration, and with it the prices become a
   feasible dual: ``bound`` sequences are needed at least.  Prices start as the best of some dual-feasible step functions.
2. Rounding: as many sequences as the bound asks for flow through the program's rooms.  At each room whole numbers of them take each next
   length, nearest to the probabilities and to what the length is behind.  Large histograms go in units of many equal sequences, what is left of
   a unit in smaller ones.
3. What rounding leaves fills the room that is left, tightest first.  Sequences with no more room than the bound leaves on average are kept; the
   program is solved again for the pieces of the others, at most ``REPEATS`` times, until within ``CLOSE`` of the bound.  The rest is filled
   largest first.  (If filling all pieces largest first takes fewer sequences, that plan is returned; ``Solution.by_program`` says so.)

Scale: the driver sees the histogram only.  Pieces get their rank among pieces of equal length from counts of (length, salt)
groups, so one length with a third of all pieces is spread; the rank alone decides configuration, copy and place, looked up in
a table bounded by the histogram and ``UNITS``.

Cases: a null or empty text is one piece of the end id alone; longer documents, however long, are cut every ``capacity`` ids; equal rows are
packed once each; pieces of equal length are told apart by (id, piece, checksum), ties beyond that are equal pieces; an empty table gives no
piece; other columns do not matter, since only id and text are read.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, read_table, text_of

CAPACITY, END = 2048, 0
ROUNDS, REFRESH, NEAR, UNITS, STEPS, REPEATS = 60, 6, 0.002, 20_000, 60, 3
HEAT, CLOSE = (0.01, 0.0005), 1e-4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"

Plan = list[tuple[int, list[tuple[int, int]]]]  # (copies, [(length, times), ...] longest first)


def pieces(docs: DataFrame, *, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document's ids (with the end id)."""

    def cut(batches):
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tokens.slices(texts):
                flat, lengths = enc.encode(texts[a:b])
                flat = np.insert(flat, np.cumsum(lengths), end).astype("<u4")
                ends = np.cumsum(lengths + 1)
                out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for d, first, last in zip(ids[a:b], ends - lengths - 1, ends):
                    for k, at in enumerate(range(first, last, capacity)):
                        part = flat[at : min(at + capacity, last)]
                        for c, v in zip(out, (d, k, at - first, len(part), tokens.crc32(part))):
                            out[c].append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return docs.select(F.col(id_col).cast("long").alias("d"), text_of(text_col).alias("t")).mapInArrow(cut, PIECES)


def greedy(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Fill sequences largest first, each pattern as often as the counts allow."""
    left = counts.astype(np.int64).copy()
    plan: Plan = []
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            return plan
        room, pattern, own = capacity, [], lengths[have]
        hi = len(have)
        while hi:
            hi = int(np.searchsorted(own[:hi], room, side="right"))
            if not hi:
                break
            i = have[hi - 1]
            times = int(min(left[i], room // lengths[i]))
            pattern.append((i, times))
            room -= times * int(lengths[i])
            hi -= 1
        copies = min(int(left[i]) // k for i, k in pattern)
        for i, k in pattern:
            left[i] -= copies * k
        plan.append((copies, [(int(lengths[i]), k) for i, k in pattern]))


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: most value in c; pick[c]: a length's index that it uses, -1 if c - 1 is as good."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, c, side="right"))
        if n:
            value = best[c - lengths[:n]] + prices[:n]
            i = int(value.argmax())
            if value[i] > best[c - 1]:
                best[c], pick[c] = value[i], i
                continue
        best[c] = best[c - 1]
    return best, pick


@dataclass
class Solution:
    plan: Plan
    bound: float  # sequences that any plan needs, by the dual
    rounds: int
    by_program: bool  # False: largest first took fewer sequences

    @property
    def sequences(self) -> int:
        return sum(c for c, _ in self.plan)


def step_prices(lengths: np.ndarray, capacity: int):
    """Dual-feasible prices: no configuration is worth more than 1."""
    yield lengths / capacity
    for k in range(1, STEPS):
        whole, part = np.divmod((k + 1) * lengths, capacity)
        yield np.where(part == 0, lengths / capacity, whole / k)


def flow(lengths: np.ndarray, prices: np.ndarray, best: np.ndarray, weights: np.ndarray, capacity: int, heat: float) -> list[tuple[np.ndarray, float]]:
    """At each room: the probabilities of each next length that fits, and of none, over all configurations by weight.

    A configuration weighs exp(its prices / heat) times its ``weights``; ``best`` is the knapsack of ``prices``, which keeps numbers in range.
    """
    total, out = np.empty(capacity + 1), []
    stop = np.exp(-best / heat)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(capacity + 1):
        n = int(fits[room])
        before = room - lengths[:n]
        part = weights[:n] * np.exp((prices[:n] + best[before] - best[room]) / heat) * total[before]
        total[room] = stop[room] + part.sum()
        out.append((part / total[room], stop[room] / total[room]))
    return out


def usage(lengths: np.ndarray, steps: list[tuple[np.ndarray, float]], capacity: int) -> np.ndarray:
    """How often a configuration holds each length on average."""
    here, used = np.zeros(capacity + 1), np.zeros(len(lengths))
    here[capacity] = 1.0
    for room in range(capacity, 0, -1):
        if here[room] > 1e-15:
            go = here[room] * steps[room][0]
            used[: len(go)] += go
            here[room - lengths[: len(go)]] += go
    return used


def program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS):
    """(steps of the fractional solution, dual bound, rounds made) by multiplicative weights."""
    n = counts.astype(float)
    prices = max(step_prices(lengths, capacity), key=lambda y: float((n * y).sum())).astype(float)
    bound, base = float((n * prices).sum()), n / n.sum()
    best, _ = knapsack(lengths, prices, capacity)
    power, weights = np.maximum(0.15, lengths / capacity), base
    spare = 1 - float((n * lengths).sum()) / (math.ceil(bound - 1e-6) * capacity)
    heat, coldest = HEAT[0], min(HEAT[0], max(HEAT[1], spare / 2))
    for made in range(1, rounds + 1):
        steps = flow(lengths, prices, best, weights, capacity, heat)
        lack = n / math.ceil(bound - 1e-6) / np.maximum(usage(lengths, steps, capacity), 1e-300)
        off = float(np.abs(np.log(lack)) @ (n * lengths)) / float((n * lengths).sum())
        if made == rounds or off < NEAR and heat <= coldest:
            break
        weights = weights * np.clip(lack, 0.05, 20) ** power
        if made % REFRESH == 0:
            # The prices take over what the weights have learned; scaled by the dearest configuration they are a feasible dual.
            prices = np.maximum(0, prices + heat * np.log(weights / base))
            best, _ = knapsack(lengths, prices, capacity)
            prices, best = prices / best[capacity], best / best[capacity]
            bound = max(bound, float((n * prices).sum()))
            weights, heat = base, max(coldest, heat / 2)
    return steps, bound, made


def rounded(lengths: np.ndarray, left: np.ndarray, steps: list, sequences: int, capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """(copies, room left, {length's index: times}) of ``sequences`` whole sequences; takes what they hold off ``left``."""
    at: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]
    at[capacity][()] = sequences
    behind, closed = np.zeros(len(lengths)), []
    for room in range(capacity, -1, -1):
        groups = at[room]
        if not groups:
            continue
        many, (p, stop) = sum(groups.values()), steps[room]
        p = np.where(left[: len(p)] > 0, p, 0)
        scale = p.sum() + stop
        expected = many * p / scale if scale > 0 else p
        give = np.minimum(np.floor(expected), left[: len(p)]).astype(np.int64)
        more = many - int(give.sum()) - int(many * stop / scale if scale > 0 else many)
        if more > 0 and len(p):
            wish = np.where((left[: len(p)] > give) & (p > 0), expected - give + behind[: len(p)], -np.inf)
            for i in np.argsort(-wish, kind="stable")[:more]:
                if wish[i] > 0:
                    give[i] += 1
        behind[: len(p)] += expected - give
        left[: len(p)] -= give
        waiting = sorted(groups.items(), reverse=True)
        for i in np.flatnonzero(give).tolist():
            need = int(give[i])
            while need:
                config, has = waiting[-1]
                n = min(need, has)
                bag = dict(config)
                bag[i] = bag.get(i, 0) + 1
                key, to = tuple(sorted(bag.items())), at[room - int(lengths[i])]
                to[key] = to.get(key, 0) + n
                need -= n
                if n == has:
                    waiting.pop()
                else:
                    waiting[-1] = (config, has - n)
        closed += [(n, room, dict(config)) for config, n in waiting if config]
    return closed


def fill(lengths: np.ndarray, left: np.ndarray, open_: list[tuple[int, int, dict[int, int]]], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """The sequences with pieces of ``left`` put into their room, longest piece first, each into the tightest place."""
    rooms: list[list] = [[] for _ in range(capacity + 1)]
    for copies, room, config in open_:
        rooms[room].append((copies, config))
    have = [r for r in range(capacity + 1) if rooms[r]]
    for i in range(len(lengths) - 1, -1, -1):
        size = int(lengths[i])
        while left[i]:
            k = bisect.bisect_left(have, size)
            if k == len(have):
                break
            room = have[k]
            copies, config = rooms[room].pop()
            n, times = min(copies, int(left[i])), 1
            if n == copies:
                times = min(room // size, int(left[i]) // n)
            else:
                rooms[room].append((copies - n, config))
            left[i] -= n * times
            rest = room - size * times
            if not rooms[rest]:
                bisect.insort(have, rest)
            rooms[rest].append((n, config | {i: config.get(i, 0) + times}))
            if not rooms[room] and room != rest:
                have.remove(room)
    return [g for r in rooms for g in r]


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> Solution:
    """Copies of configurations that hold every length exactly as often as it is counted."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(lengths):
        return Solution([], 0.0, 0, True)
    plain = greedy(lengths, counts, capacity)
    number = lambda plan: sum(c for c, _ in plan)
    left, kept, best, bound, made = counts.copy(), [], plain, 0.0, 0
    for again in range(REPEATS, -1, -1):
        live = np.flatnonzero(left)
        own, need = lengths[live], left[live]
        steps, least, k = program(own, need, capacity, rounds)
        bound, made = bound or least, made + k
        unit = max(1, math.ceil(least / UNITS))
        sequences = math.ceil(least - 1e-6)
        spare = (sequences * capacity - int((own * need).sum())) / sequences
        some = need // unit
        found = [(n * unit, sorted(((int(own[i]), t) for i, t in bag.items()), reverse=True)) for n, bag in fill(own, some, rounded(own, some, steps, sequences // unit, capacity), capacity)]
        good = [g for g in found if capacity - sum(n * t for n, t in g[1]) <= spare + 1]
        for part in (found, good):
            rest = left.copy()
            for n, bag in part:
                for size, t in bag:
                    rest[np.searchsorted(lengths, size)] -= n * t
            plan = kept + part + greedy(lengths, rest, capacity)
            if number(plan) < number(best) or best is plain and number(plan) == number(plain) and part:
                best = plan
        left, kept = rest, kept + good
        if not good or not left.any() or number(best) <= math.ceil(bound * (1 + CLOSE) - 1e-6):
            break
    return Solution(best, bound, made, best is not plain)


def slots(plan: Plan) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, first sequence, times per sequence, first offset)], ranks ascending."""
    table: dict[int, list] = {}
    upto: dict[int, int] = {}
    sequence = 0
    for copies, config in plan:
        offset = 0
        for n, k in config:
            table.setdefault(n, []).append((upto.get(n, 0), sequence, k, offset))
            upto[n] = upto.get(n, 0) + copies * k
            offset += n * k
        sequence += copies
    return table


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with their sequence and the offset in it."""
    cut = materialize(cut, "pieces")
    seen = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    total = sum(r["count"] for r in seen)
    plan = solve(np.array([r["length"] for r in seen], np.int64), np.array([r["count"] for r in seen], np.int64), capacity).plan
    table = {n: [np.array(c, np.int64) for c in zip(*rows)] for n, rows in slots(plan).items()}

    salts = 2 ** max(0, math.ceil(math.log2(max(1, total) / 2_000_000 + 1e-9))) * 8
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        for batch in batches:
            n = np.asarray(batch.column(3))
            rank = np.asarray(batch.column(5))
            sequence, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for length in np.unique(n):
                mine = np.flatnonzero(n == length)
                first, base, times, at = table[int(length)]
                i = np.searchsorted(first, rank[mine], side="right") - 1
                j = rank[mine] - first[i]
                sequence[mine] = base[i] + j // times[i]
                offset[mine] = at[i] + j % times[i] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(read_table(spark, sf_dir, "documents"), tokenizer=tokens.default_path()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents and their places."""
    return pack(pieces(docs, tokenizer=tokens.default_path()))
