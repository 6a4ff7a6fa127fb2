from collections import defaultdict

from weftgraph.llm import mixing as m


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, got, free = share * sum(sizes.values()), {}, set(names)
    while free:
        full = {s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s] + 1e-9}
        if not full:
            return got | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        for s in full:
            got[s] = most * sizes[s]
        left -= sum(got[s] for s in full)
        free -= full
    return got


def test_targets_and_taken(spark, make_docs, write_table):
    rows = [(i, "w " * (1 + i * 7 % 13), None if i % 5 == 0 else f"s{min(i % 11, 4)}") for i in range(600)]
    rows += [(700, None, "s1"), (701, "", "s9"), (702, "  ", "s1"), (5, "w w", "s2"), (None, "w w w", "s2")]
    path = write_table(make_docs(rows))
    got = m.op8_mixing(spark, path).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = targets(size)
    source = {r[0]: r[2] for r in rows if r[0] not in (5,)}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id in source:
            s = source[r.doc_id]
            assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
            taken[s] += r.taken
    for s in ("s0", "s1", "s3", "s4", None):
        assert abs(taken[s] - want[s]) <= 20
    again = m.op8_mixing(spark, path).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark, make_docs, write_table):
    assert m.op8_mixing(spark, write_table(make_docs([]))).count() == 0


def test_stage_repeats_rows(spark, make_docs):
    docs = make_docs([(i, "w " * 10, "ab"[i % 2]) for i in range(200)] + [(999, None, "a")])
    out = m.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert abs(out.count() - 300) <= 4 and out.where("text IS NULL").count() == 0


def test_a_long_text_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * (600_000 if i == 7 else 30), "ab"[i % 2], 1, "t") for i in range(100)], "doc_id long, text string, source string, size int, target string")
    got = m.mix(docs, m.count_words(F.col("text")), F.lit(1.0)).select("doc_id", "size", "target", "_m_size", "_m_copies").collect()
    assert {r.doc_id: r._m_size for r in got}[7] == 600_000 and {(r["size"], r.target) for r in got} == {(1, "t")}
    assert all(r._m_copies <= 2 for r in got)
