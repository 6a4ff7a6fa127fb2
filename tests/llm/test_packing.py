import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftgraph.llm import packing as p
from weftgraph.llm import tokens


def used(plan):
    have = Counter()
    for copies, config in plan:
        for n, k in config:
            have[n] += copies * k
    return have


DRAWS = {"small": range(1, 200), "mixed": range(1, 2049), "large": range(900, 1500), "quarters": range(400, 620), "one": [700], "thirds": [683, 682, 1366, 5]}


@pytest.mark.parametrize("kind", DRAWS)
def test_plans_are_exact_and_close_to_the_dual_bound(kind, monkeypatch):
    rnd = random.Random(4)
    n = Counter(rnd.choice(DRAWS[kind]) for _ in range(3000))
    lengths, counts = np.array(list(n)), np.array(list(n.values()))
    calls, knapsack = [], p.knapsack
    monkeypatch.setattr(p, "knapsack", lambda *a: calls.append(1) or knapsack(*a))
    found = p.solve(lengths, counts)
    assert calls and found.rounds > 0
    assert used(found.plan) == n
    assert all(sum(a * k for a, k in c) <= 2048 for _, c in found.plan)
    least = max(-(-int((lengths * counts).sum()) // 2048), int(counts[lengths > 1024].sum()))
    assert least <= math.ceil(found.bound - 1e-6) <= found.sequences
    if kind != "one":
        assert found.sequences <= math.ceil(found.bound * 1.01)
    assert found.sequences <= sum(c for c, _ in p.greedy(np.sort(lengths), counts[np.argsort(lengths)], 2048))


def test_many_equal_pieces_make_a_small_plan():
    lengths = np.array([1, 3, 50, 333, 1000, 2048])
    found = p.solve(lengths, np.array([10**9, 7, 10**8, 10**8 + 1, 5 * 10**7, 3]))
    assert used(found.plan)[50] == 10**8 and len(found.plan) < 10**5
    assert found.sequences <= found.bound * 1.01 + 1
    assert p.solve(np.array([], int), np.array([], int)).plan == []


def test_the_dual_bound_never_exceeds_the_optimum():
    def fewest(sizes, capacity):  # exhaustive
        best = [len(sizes)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= capacity:
                    go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
            go(i + 1, [*bins, sizes[i]])

        go(0, [])
        return best[0]

    rnd = random.Random(9)
    gap = 0
    for _ in range(25):
        capacity = rnd.choice([10, 17, 30])
        sizes = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 10))), reverse=True)
        n = Counter(sizes)
        found, best = p.solve(np.array(list(n)), np.array(list(n.values())), capacity), fewest(sizes, capacity)
        assert used(found.plan) == n and math.ceil(found.bound - 1e-6) <= best <= found.sequences <= best + 1
        gap += found.sequences - best
    assert gap <= 2


def test_every_piece_is_placed_once(spark, make_docs, write_table):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([0, 3, 40, 900, 5000])))) for i in range(150)]
    rows += [(200, None), (201, ""), (3, rows[3][1]), (None, "a b")]
    got = p.op6_packing(spark, write_table(make_docs(rows))).collect()
    full = tokens.WordEncoder(tokens.default_path()).full
    want = []
    for d, t in rows:
        ids = np.array(full.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert Counter(want) == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= 1.2 * sum(r.length for r in got) / 2048 + 1


def test_empty_table(spark, make_docs, write_table):
    assert p.op6_packing(spark, write_table(make_docs([]))).count() == 0


def test_a_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "b " * 500_000, 3, "x"), (2, "a", 4, "y")], "doc_id long, text string, length int, sequence_id string")
    got = sorted((r.doc_id, r.piece, r.length) for r in p.pack(p.pieces(docs, tokenizer=tokens.default_path())).collect())
    first = [n for d, _, n in got if d == 1]
    assert first[:-1] == [2048] * (len(first) - 1) and sum(first) > 500_000 and [k for d, k, _ in got if d == 1] == list(range(len(first)))
