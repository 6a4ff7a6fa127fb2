import math

import numpy as np

from weftgraph.llm import embedding_dedup as d


def brute(rows, threshold=0.93):
    ok = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, np.float32).astype(float), lab)
    ids = sorted(ok)
    near = {i: set() for i in ids}
    for i in ids:
        for j in ids:
            (a, la), (b, lb) = ok[i], ok[j]
            if i < j and la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                near[i].add(j)
                near[j].add(i)
    comp = {}
    for i in ids:
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += near[k]
    return {i: (len(near[i]), comp[i]) if i in ok else (0, i) for i, _, _ in rows}


def vectors(n, dim, seed):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and rnd.random() < 0.4:
            base = np.array(rows[rnd.integers(len(rows))][1])
            v = base + rnd.normal(size=dim) * rnd.choice([0, 0.1, 0.3, 0.4]) * np.linalg.norm(base) / math.sqrt(dim)
        else:
            v = rnd.normal(size=dim)
        rows.append((int(i), [float(np.float32(x)) for x in v], int(rnd.integers(3))))
    return rows


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 24, 1), (9004, [None] + [1.0] * 23, 1), (9005, [float("nan")] * 24, 1), (9006, [float("inf")] * 24, 1), (9007, [1.0] * 24, None), (9008, [1.0] * 24, 1), (9009, [2.0] * 24, 1), (9010, [1.0] * 5, 1), (9011, [1e-30] * 24, 1)]


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = vectors(700, 24, 1) + ODD
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(rows)
    for bucket, block in ((512, 4096), (16, 4096), (64, 32)):
        monkeypatch.setattr(d, "BUCKET", bucket)
        monkeypatch.setattr(d, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id) for r in d.op9_embedding_dedup(spark, str(tmp_path)).collect()}
        assert got == want, (bucket, block)


def test_repeats_and_empty(spark):
    s = "vec_id long, embedding array<float>, label int, extra string"
    a, b = [1.0] * 8, [1.0, -1.0] * 4
    got = d.near_duplicates(spark.createDataFrame([(1, a, 0, "x"), (1, a, 0, "y"), (2, a, 0, "z"), (3, b, 0, ""), (None, a, 0, "")], s)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in got) == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 0, True), ("None", 0, True)]
    assert d.near_duplicates(spark.createDataFrame([], s)).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rnd.normal(size=x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * other
    code, factor = d.encode(x)
    rotated = y @ d.rotation(64, 0)
    estimate = (code / 8 * rotated).sum(1) / factor
    assert abs(estimate.mean() - 0.93) < 0.005
    assert d.screen(code, factor, rotated.astype(np.float32)).diagonal().all()
