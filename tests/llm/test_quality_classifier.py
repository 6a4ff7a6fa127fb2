import random

import numpy as np

from weftgraph.llm import quality_classifier as c


def text(rnd, good, n):
    w = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n)]
    if not good:
        k = len(w) // 2
        w[:k] = [x.upper() + "!!" for x in w[:k]]
    return " ".join(w)


def test_held_out_accuracy(spark, make_docs, write_table):
    rnd = random.Random(1)
    y = [int(rnd.random() < 0.7) for _ in range(500)]
    rows = [(i, text(rnd, y[i], rnd.choice([20, 100, 700]))) for i in range(500)] + [(900, None), (901, ""), (902, " \n"), (None, "x")]
    path = write_table(make_docs(rows))
    write_table(spark.createDataFrame([(i, y[i], 0) for i in range(0, 500)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int"), "labels")
    got = {r.doc_id: r for r in c.op7_quality_classifier(spark, path).collect()}
    assert len(got) == len(rows)
    out = [i for i in range(500) if got[i].held_out]
    assert len(out) > 60 and np.mean([got[i].predicted == y[i] for i in out]) > 0.93
    assert got[900].score == got[901].score and 0 <= got[900].score <= 1
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_features_do_not_depend_on_the_neighbours():
    rnd = random.Random(2)
    t = ["", "one", "  two\nthree  ", text(rnd, 0, 300), "é" * 50, text(rnd, 1, 64), text(rnd, 1, 65), "\n\n"]
    x, n = c.passages(t)
    assert n.tolist() == [1, 1, 1, 5, 1, 1, 2, 1]
    each = [c.passages([s])[0] for s in t]
    assert np.allclose(x, np.concatenate(each), atol=1e-6)
    assert np.allclose(x[:, : c.CLASSES].sum(1), 1)


def test_without_labels(spark, make_docs, write_table):
    path = write_table(make_docs([(1, "a b"), (2, None)]))
    write_table(spark.createDataFrame([], "doc_id long, quality int, toxic int"), "labels")
    assert [r.score for r in c.op7_quality_classifier(spark, path).collect()] == [0.5, 0.5]
    assert c.op7_quality_classifier(spark, write_table(make_docs([]))).count() == 0


def test_gradients_equal_differences():
    rnd = np.random.default_rng(3)
    k = np.array([1, 4, 2])
    x, y = rnd.normal(size=(7, 5)), np.array([1.0, 0.0, 1.0])
    shape = {"w": (5, 4), "b": (4,), "v": (4, 3), "u": (4, 3), "a": (3,), "c": (4,), "d": (1,)}
    p = {n: rnd.normal(size=s) for n, s in shape.items()}

    def loss(q):
        out = c._forward(q, x, np.cumsum(k) - k, k)[-1]
        return -np.mean(y * np.log(out) + (1 - y) * np.log(1 - out))

    grad = c.gradients(p, x, k, y)
    for n, s in shape.items():
        for at in np.ndindex(*s):
            q = {m: v.copy() for m, v in p.items()}
            q[n][at] += 1e-6
            up = loss(q)
            q[n][at] -= 2e-6
            assert abs((up - loss(q)) / 2e-6 - grad[n][at]) < 1e-6, (n, at)


def test_scores_equal_plain_python():
    import math

    t = ["one two three " * 60, "", "What? " * 200]
    x, n = c.passages(t)
    m = c.train(x, n, np.array([1.0, 0.0, 1.0]))
    got = c.predict(t, m)
    at = 0
    for score, k in zip(got, n):
        hidden, weight = [], []
        for row in x[at : at + k]:
            f = [min(8, max(-8, (v - a) / b)) for v, a, b in zip(row.tolist(), m.mean.tolist(), m.scale.tolist())]
            h = [math.tanh(sum(a * b for a, b in zip(f, col)) + b0) for col, b0 in zip(m.weights["w"].T, m.weights["b"])]
            gate = [math.tanh(sum(a * b for a, b in zip(h, v))) / (1 + math.exp(-sum(a * b for a, b in zip(h, u)))) for v, u in zip(m.weights["v"].T, m.weights["u"].T)]
            hidden.append(h)
            weight.append(math.exp(sum(a * b for a, b in zip(gate, m.weights["a"]))))
        z = [sum(w * h[i] for w, h in zip(weight, hidden)) / sum(weight) for i in range(len(hidden[0]))]
        want = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, m.weights["c"])) + m.weights["d"][0])))
        assert abs(score - want) < 1e-4
        at += k


def test_long_bags_are_whole_and_their_number_bounded(spark, monkeypatch):
    rnd = random.Random(7)
    y = [i % 2 for i in range(60)]
    rows = [(i, text(rnd, y[i], 6000 if i < 4 else 80), 9.0) for i in range(60)] + [(3, "again another text", 1.0)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y[i]) for i in range(60)], "doc_id long, quality int")
    seen = []
    keep = c.train
    monkeypatch.setattr(c, "train", lambda x, n, y: seen.append(n) or keep(x, n, y))
    model = c.fit(docs, labels)
    assert sorted(seen[0].tolist())[-4:] == [94] * 4 and len(seen[0]) == 61
    c.fit(docs, labels, passages_in_all=100)
    assert 1 <= len(seen[1]) < 61 and (seen[1].sum() <= 100 or len(seen[1]) == 1)
    out = c.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"] and out.where("score > 1").count() == 0
