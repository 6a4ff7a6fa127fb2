import random

import numpy as np

from weftgraph.llm import language_id as g

PARTS = {"en": "the of th er in on and ing ly".split(), "fr": "eau oi é que la ou ment èr".split(), "xx": "zk wv qj xk vz kk jj".split()}


def say(rnd, lang, n):
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_rejection(spark, make_docs, write_table):
    rnd = random.Random(1)
    rows = [(i, say(rnd, lang, rnd.choice([4, 30, 400])), "s", lang) for i in range(400) for lang in [rnd.choice(["en", "fr"])]]
    rows = [(i, t, s, None if i % 10 == 3 else lang) for i, t, s, lang in rows]
    odd = [(1000, None), (1001, ""), (1002, "123 --- 456"), (1003, "привет как дела это русский текст " * 20), (1003, "the and ing"), (None, "the of and")]
    path = write_table(make_docs(rows + odd))
    got = g.op2_language_id(spark, path).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got if r.doc_id != 1003}
    out = [r for r in rows if by[r[0]].held_out and r[3]]
    assert len(out) > 50 and np.mean([by[r[0]].lang_pred == r[3] for r in out]) > 0.97
    assert np.mean([by[r[0]].rejected for r in rows]) < 0.01
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in got)
    assert all(by[i].lang_pred == "und" and by[i].rejected for i in (1000, 1001, 1002))
    assert sorted(r.rejected for r in got if r.doc_id == 1003) == [False, True]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)


def test_counts_do_not_depend_on_the_neighbours():
    t = ["the end", "", "é", "a  b", "x" * 5000]
    assert (g.gram_counts(t) == np.concatenate([g.gram_counts([x]) for x in t])).all()


def test_empty_and_unlabelled(spark, make_docs, write_table):
    assert g.op2_language_id(spark, write_table(make_docs([]))).count() == 0
    got = g.op2_language_id(spark, write_table(make_docs([(1, "the of", "s", None)]))).collect()
    assert got[0].lang_pred == "und"


def test_stage_keeps_columns(spark, make_docs):
    rnd = random.Random(2)
    docs = make_docs([(i, say(rnd, "en", 50), "s", "en") for i in range(60)] + [(99, "!!!", "s", "en")])
    out = g.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 60


def test_letters_are_those_of_unicode():
    assert all(map(g.has_letter, ["a", "é", "中", "ª", "1 я"]))
    assert not any(map(g.has_letter, ["", "²½①Ⅷ", "123 _-", "!?", "٣"]))


def test_equals_centroids_in_plain_python():
    import math

    def grams(t):
        b = [x if 97 <= x <= 122 or x > 127 else 32 for x in (" " + t.lower() + " ").encode()]
        out = {}
        for n in (2, 3):
            for i in range(len(b) - n + 1):
                w = b[i : i + n]
                if not w[0] == w[1] == 32:
                    k = (int.from_bytes(bytes(w), "big") * 2654435761 & 0xFFFFFFFF) >> 20
                    out[k] = out.get(k, 0) + 1
        return out

    texts = ["the end of it", "a  b", "éàü oui", "Die 3 Bären", "x"]
    for t in texts:
        row = g.gram_counts([t])[0]
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == grams(t)
    rnd = np.random.default_rng(1)
    c = rnd.random((6, g.DIMS))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    model = g.Model(["aa", "bb", "cc"], rnd.random(g.DIMS).astype(np.float32), c, np.array([0, 0, 1, 1, 2, 2]), np.zeros(64))
    lang, score, _ = g.predict(texts, model)
    for t, name, value in zip(texts, lang, score):
        x = {k: math.log1p(n) * float(model.idf[k]) for k, n in grams(t).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        cosine = [sum(v * float(row[k]) for k, v in x.items()) / size for row in c]
        assert name == model.languages[model.owner[int(np.argmax(cosine))]] and abs(value - max(cosine)) < 1e-5


def test_many_languages_long_texts_and_clashing_columns(spark):
    rnd = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    langs = [f"l{i:03}" for i in range(330)]
    parts = {lang: ["".join(rnd.choices(alphabet, k=4)) for _ in range(6)] for lang in langs}
    rows = [(k, " ".join(rnd.choices(parts[lang], k=40)), lang, 0.5) for k, lang in enumerate(langs * 3)]
    docs = spark.createDataFrame([*rows, (None, " ".join(parts["l007"] * 40_000), "l007", 1.0)], "doc_id long, text string, lang string, score double")
    model = g.fit(docs)
    assert model.languages == langs
    out = g.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    got = out.select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99


def test_equal_hashes_do_not_grow_the_sample(spark, make_docs):
    docs = make_docs([(None, "the same words", "s", "en")] * 5000 + [(i, "la ou eau " * 3, "s", "fr") for i in range(30)])
    model = g.fit(docs)
    assert model.languages == ["en", "fr"]
