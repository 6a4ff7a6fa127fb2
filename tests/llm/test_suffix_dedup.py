import hashlib
import random

import numpy as np

from weftgraph.llm import suffix_dedup as s


def brute(rows, width):
    least = {}
    data = [(-(1 << 63) if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            least[w] = min(least.get(w, d), d)
    out = []
    for (d, b), (own, _) in zip(data, rows):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < d:
                gone[i : i + width] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((own, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    parts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.choice([20, 49, 50, 51, 80, 200]))) for _ in range(25)]
    rows = [(i, "".join(rnd.choice(parts) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh") for _ in range(30)) for _ in range(rnd.randint(0, 12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a" * 700), (103, "a" * 60), (104, "ab" * 300), (105, "b" + "ab" * 40), (None, parts[3] + parts[4]), (7, parts[5] * 2), (7, parts[5]), (106, rows[0][1]), (107, rows[0][1])]
    rnd.shuffle(rows)
    return rows


def test_equals_brute_force(spark, make_docs):
    for seed, width, digit, chunk in ((1, 50, 24, 2000), (2, 50, 24, None), (3, 20, 8, 700)):
        rows = corpus(seed)
        got = s.remove_repeats(make_docs(rows).repartition(3), width=width, digit=digit, chunk_bytes=chunk, bucket_bytes=4000).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, width)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_blocks_and_repeated_rows(spark, make_docs, write_table, monkeypatch):
    rows = corpus(5) * 2
    got = s.op1_suffix_dedup(spark, write_table(make_docs(rows))).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 50)
    assert s.op1_suffix_dedup(spark, write_table(make_docs([]))).count() == 0


def test_blocks(monkeypatch):
    rnd = random.Random(1)
    data = "".join(rnd.choice("ab") for _ in range(5000)).encode()
    sizes = np.array([1000, 30, 3970])
    whole = s.Chunk(np.arange(3), sizes, data)
    whole.anchors()
    monkeypatch.setattr(s, "BLOCK", 137)
    cut = s.Chunk(np.arange(3), sizes, data)
    cut.anchors()
    cover = lambda c: sorted((p, int(a), int(h)) for h, a, f, z in zip(c.hash, c.at, c.first, c.last) for p in range(f, z + 1))
    assert cover(whole) == cover(cut)
    assert [p for p, _, _ in cover(whole)] == [*range(0, 951), *range(1030, 4951)]


def test_buckets_are_even():
    rnd = random.Random(2)
    data = "".join(rnd.choice("abcdefgh ") for _ in range(200_000)).encode()
    chunk = s.Chunk(np.array([1]), np.array([len(data)]), data)
    bucket = chunk.digits_by_bucket(4)[0]
    n = np.bincount(bucket, minlength=16)
    assert n.max() < 1.3 * n.mean()


def test_a_digit_under_ids_a_b_a_is_not_alone():
    import numpy as np

    from weftgraph.llm.suffix_dedup import Chunk

    text = bytes(np.random.default_rng(3).integers(97, 123, 400, dtype=np.uint8))
    own = lambda *ids: Chunk(np.array(ids, np.int64), np.full(len(ids), len(text)), text * len(ids)).digits_by_bucket(4)[2]
    assert own(1, 2, 1).all() and own(1, 2).all() and len(own(1, 2, 1))
    assert not own(1, 1, 1).any()


def test_a_long_text_and_its_copy(spark, make_docs):
    rnd = random.Random(4)
    long = "".join(rnd.choices("abcdefgh \n", k=1_200_000))
    got = {r.doc_id: r for r in s.remove_repeats(make_docs([(1, long), (2, "own start " + long + " own end"), (3, "clean")])).collect()}
    assert (got[1].n_removed, got[3].n_removed) == (0, 0)
    assert got[2].n_spans == 1 and got[2].n_removed >= 1_200_000 and len(got[2].kept) <= 18


def test_hot_digits_equal_brute_force(spark, make_docs, monkeypatch):
    monkeypatch.setattr(s, "HOT", 0)
    rows = corpus(8)
    got = s.remove_repeats(make_docs(rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, 50)
    rnd = np.random.default_rng(1)
    n, side = 500, 26
    left, right = (rnd.integers(97, 99, (n, side), dtype=np.uint8) for _ in range(2))
    left[rnd.random(n) < 0.5, 3:] = 97
    args = (np.full(n, 7, np.uint64), left, right, rnd.integers(0, 27, n), rnd.integers(0, 27, n), rnd.integers(0, 50, n), side)
    hot = s.smallest(*args)
    monkeypatch.setattr(s, "HOT", 1 << 17)
    assert (hot == s.smallest(*args)).all() and (hot < s.HIGHEST).any()


def test_one_string_in_many_surroundings(spark, make_docs):
    rnd = random.Random(6)
    rule = "-" * 24
    rows = [(i, "".join(rnd.choices("abcdefgh", k=40)) + rule + "".join(rnd.choices("abcdefgh", k=40))) for i in range(40_000)] + [(50_000, "x" + rule + "y")]
    rows.append((60_000, rows[17][1]))
    got = {r.doc_id: r.n_removed for r in s.remove_repeats(make_docs(rows), keep_bytes=False).collect()}
    assert got[60_000] == 104 and sum(got.values()) == 104


def test_anchors_are_found_once_for_all_uses_of_a_chunk(monkeypatch):
    data = bytes(np.random.default_rng(3).integers(97, 99, 3000, dtype=np.uint8))
    chunk, calls, digits = s.Chunk(np.arange(3), np.full(3, 1000), data), [], s._digits
    monkeypatch.setattr(s, "_digits", lambda *a: calls.append(1) or digits(*a))
    bucket, *_ = chunk.digits_by_bucket(4)
    chunk.records(4, np.ones(len(bucket), bool))
    assert len(calls) == 1


def test_digits_are_equal_if_their_bytes_are():
    data = np.random.default_rng(4).integers(97, 99, 2000, dtype=np.uint8)
    for k in (3, 8, 13, 24):
        strings = [data[i : i + k].tobytes() for i in range(len(data) - k + 1)]
        found = s._digits(data, k).tolist()
        assert len(set(found)) == len(set(strings)) == len(set(zip(strings, found)))


def test_windows_are_told_apart_by_the_second_hash(monkeypatch):
    rnd, n = np.random.default_rng(5), 300
    x, doc = rnd.integers(0, 3, n).astype(np.uint64), rnd.integers(0, 50, n)
    y = rnd.integers(0, 3, n).astype(np.uint64)
    monkeypatch.setattr(s, "mix", lambda v: v)
    out, zero = np.full((n, 2), s.HIGHEST), np.zeros(n, np.uint64)
    s._least(out, np.arange(n), 1, zero, zero, y, x, zero, doc)
    assert out[:, 1].tolist() == [doc[(x == a) & (y == b)].min() for a, b in zip(x, y)] and (out[:, 0] == s.HIGHEST).all()
