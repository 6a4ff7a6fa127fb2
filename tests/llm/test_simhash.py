import math
import random
import string
import time
from pathlib import Path

import numpy as np

from weftgraph.llm import simhash as s


def shingles(t):
    t = (t or "").lower()
    w = "".join(" " if c in string.punctuation else c for c in t).split() or t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * math.sqrt(len(a) * len(b)) - 1e-9:
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return {d: low[root(i)] for i, (d, _) in enumerate(rows)}


def corpus(seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    rows, i = [], 0
    for size in [1] * 150 + [2] * 40 + [3] * 10 + [300]:
        base = rnd.choices(words, k=rnd.choice([60, 150, 500]))
        for k in range(size):
            w = list(base)
            for _ in range(0 if k % 5 == 0 else rnd.randint(1, max(1, len(w) // 60))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((i, " ".join(w)))
            i += 1
    rnd.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark, make_docs, write_table):
    rows = corpus() + [(5001, None), (5002, ""), (5003, "  "), (5004, "one two"), (5005, "one two"), (5006, "one two three"), (5007, "x " * 3000)]
    got = {r.doc_id: r.class_id for r in s.op3_simhash(spark, write_table(make_docs(rows))).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    wrong = [d for d in want if got[d] != want[d]]
    assert len(wrong) <= 0.01 * len(want), wrong
    assert not [d for d in want if want[d] == d and got[d] != d]  # nothing clean is taken away


def test_repeats_nulls_and_empty(spark, make_docs, write_table):
    t = "a b c d e f g h"
    rows = [(3, t), (3, t), (1, t), (None, t), (4, "other words than those here")]
    got = s.op3_simhash(spark, write_table(make_docs(rows))).collect()
    assert sorted((str(r.doc_id), r.class_id, r.kept) for r in got) == [("1", 1, True), ("3", 1, False), ("3", 1, False), ("4", 4, True), ("None", None, True)]
    docs = make_docs(rows)
    out = s.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "None"]
    assert s.op3_simhash(spark, write_table(make_docs([]))).count() == 0


def test_tries_grow_with_the_rows():
    assert s.tries(100) <= s.tries(10**5) < s.tries(10**7)


def test_sets_do_not_depend_on_the_neighbours():
    t = ["a b c d e f", "", "a b", "a b c d e a b c d e", "  é  ü "]
    h, n = s.shingle_sets(t)
    assert n.tolist() == [2, 0, 1, 5, 1]
    assert [x for u in t for x in s.shingle_sets([u])[0].tolist()] == h.tolist()


def test_a_crowd_just_below_the_threshold_hides_nothing(spark, make_docs, write_table):
    # All rows share a long passage, at 0.77; partners share some words more, at 0.81, and are no nearer in bits than many others.
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    common, rows, partners = [word() for _ in range(250)], [], 20
    for i in range(400):
        own = [word() for _ in range(73)]
        rows.append((i, " ".join(common + own)))
        if i < partners:
            rows.append((1000 + i, " ".join(common + own[:14] + [word() for _ in range(59)])))
    want = brute(rows)
    assert len(set(want.values())) == 400 and all(want[1000 + i] == i for i in range(partners))
    got = {r.doc_id: r.class_id for r in s.op3_simhash(spark, write_table(make_docs(rows))).collect()}
    assert got == want


def test_case_punctuation_and_long_texts(spark, make_docs, write_table):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(130_000)]  # 1 MB
    long = " ".join(words)
    near = " ".join(w.upper() + "," if i % 900 == 0 else "other" if i % 100 == 7 else w for i, w in enumerate(words))
    rows = [(7, long), (8, near), (9, "!!! ??"), (10, "!!! ??"), (11, "?? !!!"), (12, long[:400_000])]
    got = {r.doc_id: r.class_id for r in s.op3_simhash(spark, write_table(make_docs(rows))).collect()}
    assert got == {7: 7, 8: 7, 9: 9, 10: 9, 11: 11, 12: 12}


def test_one_of_two_rows_of_an_id_stays_only_if_texts_are_equal(spark, make_docs):
    a, b = "a b c d e f g h", "quite other words are found in here"
    out = s.stage(spark, make_docs([(1, a), (1, a), (1, b), (2, b)]), "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (1, b)]


def test_components_by_rounds_equal_those_of_one_task(spark):
    from weftgraph.llm.common import connected_components

    rnd = random.Random(2)
    edges = spark.createDataFrame([(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(5, 5)], "a long, b long")
    one = sorted(map(tuple, connected_components(edges).collect()))
    assert one == sorted(map(tuple, connected_components(edges, one_task=0).collect()))
    assert all(c <= n for n, c in one)


def test_rows_without_a_partner_stay_out_of_the_forest(spark, make_docs, write_table, monkeypatch):
    rows, seen = corpus(9), []
    want = brute(rows)
    forest = s.forest
    monkeypatch.setattr(s, "forest", lambda reps, *a, **k: seen.append({r.node for r in reps.collect()}) or forest(reps, *a, **k))
    got = {r.doc_id: r.class_id for r in s.op3_simhash(spark, write_table(make_docs(rows))).collect()}
    size = {c: list(want.values()).count(c) for c in want.values()}
    alone = {d for d, c in want.items() if size[c] == 1}
    assert len(alone) >= 100 and not alone & seen[0]
    assert sum(got[d] != want[d] for d in want) <= 0.01 * len(want)


def test_rows_that_a_possible_pair_needs_are_partnered(spark, make_docs, monkeypatch):
    monkeypatch.setattr(s, "CHUNK_ROWS", 37)
    docs = make_docs([*corpus(4), *((900 + i, " ".join(str((7 * i + k) % 50) for k in range(20))) for i in range(30))])
    sets = s.sign(docs).where("n > 0").selectExpr("doc_id AS node", "n", "sketch", "tails").repartition(3).cache()
    all_ = sets.collect()
    one, two = zip(*[(a, b) for a in all_ for b in all_ if a.node < b.node and min(a.n, b.n) >= 0.64 * max(a.n, b.n)])
    ok = s.possible([bytes(r.sketch) for r in one], [bytes(r.sketch) for r in two], *(np.array([r.n for r in x]) for x in (one, two)))
    linked = {r.node for a, b, k in zip(one, two, ok) if k for r in (a, b)}
    for probes in (1 << 21, 500):
        found = {r.node for r in s.partnered(sets, len(all_), probes=probes).collect()}
        assert linked <= found and len(found) < len(all_)
    assert s.partnered(sets, len(all_), 0.4).count() == len(all_)  # so low a threshold rules nothing out


def test_what_is_spent_leaves_the_disk(spark, make_docs, write_table):
    local = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "weft")
    shuffles = lambda: {f for d in local for f in Path(d).rglob("shuffle_*.data")}
    tables = lambda: {f.name for f in shared.glob("*")}
    docs, had, old = write_table(make_docs(corpus(6))), shuffles(), tables()
    found = s.op3_simhash(spark, docs)
    for _ in range(40):  # executors remove them on their own time
        if not shuffles() - had:
            break
        time.sleep(0.25)
    assert not shuffles() - had
    large = ("signed", "near-sets", "near-probes", "near-texts", "near-live")
    assert not [t for t in tables() - old if t.rpartition("-")[0] in large]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"
    assert found.count() == len(corpus(6))  # the result needs none of it


def test_only_texts_that_a_pair_names_are_shuffled(spark, tmp_path, monkeypatch):
    def moved():
        stages = spark.sparkContext._jsc.sc().statusStore()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        kept = stages.store().view(spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.status.StageDataWrapper")).iterator()
        total = 0
        while kept.hasNext():
            total += kept.next().info().shuffleWriteBytes()
        return total

    rnd = random.Random(8)
    rows = [(i, " ".join(str(rnd.random()) for _ in range(200))) for i in range(300)]
    spark.createDataFrame([*rows, (300, rows[5][1] + " more")], "node long, text string").write.parquet(f"{tmp_path}/texts")
    texts, pairs = spark.read.parquet(f"{tmp_path}/texts"), spark.createDataFrame([(5, 300), (6, 7)], "a long, b long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        assert [tuple(r) for r in s.verified(pairs, texts).collect()] == [(5, 300)]
        assert 0 < moved() - before < 100_000  # all texts are a megabyte
        monkeypatch.setattr(s, "SENT", 0)  # too many ids to send
        assert [tuple(r) for r in s.verified(pairs, texts).collect()] == [(5, 300)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def crowd_of_variants(rows, seed=4):
    """Variants of one text, most of which are no near copies of each other."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    return [(i, " ".join(word() if rnd.random() < 0.06 * (i % 7) / 6 else w for w in base)) for i in range(rows)]


def test_a_crowd_is_compared_whole_not_pair_by_pair(spark, make_docs, write_table, monkeypatch):
    rows, pairs = crowd_of_variants(500), []
    verified = s.verified
    monkeypatch.setattr(s, "verified", lambda p, *a, **k: pairs.append(p.count()) or verified(p, *a, **k))
    got = {r.doc_id: r.class_id for r in s.op3_simhash(spark, write_table(make_docs(rows))).collect()}
    assert got == brute(rows)
    assert sum(pairs) < len(rows)  # 18,850 pairs before


def test_blocks_of_a_group_meet(spark, make_docs, monkeypatch):
    rows = [(3 * i, t) for i, t in crowd_of_variants(180)]
    monkeypatch.setattr(s, "LEAST_HASHES", 1)
    docs = make_docs(rows)
    sets, texts = s.sign(docs).selectExpr("doc_id AS node", "n"), docs.selectExpr("doc_id AS node", "text")
    path = spark.createDataFrame([(3 * i, 3 * i + 3) for i in range(89)] + [(3 * i, 3 * i + 3) for i in range(90, 179)], "a long, b long")  # two groups
    half, want = [brute(rows[:90]), brute(rows[90:])], brute(rows)
    for block in (1 << 21, 5000, 1500):
        monkeypatch.setattr(s, "BLOCK", block)
        groups = s.grouped(path, sets)
        assert groups.where("blocks > 1").isEmpty() == (block > 1 << 20)
        edges = s.compared(groups, texts)
        if block < 1 << 20:  # groups of one block may share a task, which finds links between them too
            found = {r.node: r.component for r in s.connected_components(edges).collect()}
            assert {i: found.get(i, i) for i, _ in rows} == half[0] | half[1]
        assert all(want[r.a] == want[r.b] for r in edges.collect())


def test_groups_too_large_to_compare_whole_are_verified_by_pairs(spark, make_docs, write_table, monkeypatch):
    monkeypatch.setattr(s, "MOST_BLOCKS", 0)
    rows = crowd_of_variants(120)
    got = {r.doc_id: r.class_id for r in s.op3_simhash(spark, write_table(make_docs(rows))).collect()}
    assert got == brute(rows)
