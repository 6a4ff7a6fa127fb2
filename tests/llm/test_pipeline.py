import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def docs_of(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(2000)]
    text = lambda: "\n".join(" ".join(rnd.choices(words, k=12)) for _ in range(rnd.randint(3, 10)))
    return [(i, text(), f"s{i % 4}", "en") for i in range(n)]


def test_stages_one_by_one(spark, make_docs, tmp_path):
    rows = docs_of(60)
    near = rows[0][1].split("\n")
    near = "\n".join(x + (" extra" if i == 0 else "") for i, x in enumerate(near))
    rows += [(100, rows[1][1], "s0", "en"), (101, near.replace("\n", " "), None, "en"), (102, "12345", "s1", "en"), (103, None, "s1", None), (None, "a text without any id but with words enough", "s2", "en")]
    docs, seen = make_docs(rows), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert not {102, 103} & set(seen["language_id"]) and len(seen["language_id"]) == 63
    assert set(seen["language_id"]) - set(seen["line_dedup"]) == {100}
    assert set(range(1, 60)) <= set(seen["simhash"]) and 101 not in seen["simhash"]
    assert max(seen["mixing"].values()) <= 2
    assert set(seen["packing"]) == set(seen["mixing"])


def test_run_and_empty(spark, make_docs, write_table):
    assert corpus_pipeline.run(spark, write_table(make_docs(docs_of(20)))).count() > 0
    assert corpus_pipeline.run(spark, write_table(make_docs([]))).count() == 0
