import hashlib
import random
import re

from pyspark.sql import functions as F

from weftgraph.llm import line_dedup as d


def brute(docs, min_lines=2, min_words=10):
    """doc index -> kept text; docs: (id, text) in order of id."""
    seqs = []
    for _, t in docs:
        ls = [] if t is None else t.split("\n")
        seqs.append([(i, x) for i, x in enumerate(ls) if re.search(r"[^\x20\x09-\x0D]", x)])
    seen, gone = set(), [set() for _ in docs]
    for k, s in enumerate(seqs):
        for p in range(len(s)):
            for n in {1, min_lines}:
                run = tuple(x for _, x in s[p : p + n])
                if len(run) < n:
                    continue
                if (n, run) in seen and (n >= min_lines or len(re.findall(r"[^\x20\x09-\x0D]+", run[0])) >= min_words):
                    gone[k] |= {i for i, _ in s[p : p + n]}
                seen.add((n, run))
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for (_, t), g in zip(docs, gone)]


def cases(seed):
    rnd = random.Random(seed)
    lines = ["", " \t", "short", "All rights kept.", *[" ".join(rnd.choices("abcdefg", k=rnd.choice([3, 12]))) for _ in range(12)]]
    return [(i, "\n".join(rnd.choices(lines, k=rnd.randint(0, 9)))) for i in range(60)] + [(60, None), (61, ""), (62, "x\n" * 300)]


def test_equals_brute_force(make_docs):
    for seed, n in ((1, 2), (2, 3), (3, 5), (4, 1)):
        docs = cases(seed)
        got = {r.doc_id: r._l_kept for r in d.dedup_lines(make_docs(docs), min_lines=n).collect()}
        want = brute(docs, min_lines=n)
        assert [got[i] for i, _ in docs] == want, n


def test_edge_cases(spark, make_docs, write_table):
    assert d.op10_line_dedup(spark, write_table(make_docs([]))).count() == 0
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(5, long), (5, long), (None, long), (7, long + "\nown words"), (8, None), (9, "")]
    got = d.op10_line_dedup(spark, write_table(make_docs(rows))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[None].n_removed == 0  # the null id comes first
    assert [r.n_removed for r in got if r.doc_id == 5] == [1, 1]
    assert by[7].n_removed == 1 and by[7].kept_sha256 == hashlib.sha256(b"own words").hexdigest()
    assert by[8].n_lines == 0 and by[9].n_lines == 1


def test_stage_keeps_columns_and_clean_rows(spark, make_docs):
    long = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([(1, long, "s"), (2, long, "s"), (3, long + "\nmine", "s"), (4, "only me", None)])
    out = d.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.select(F.col("doc_id"), "text", "n_chars").collect()}
    assert got == {1: (long, len(long)), 3: ("mine", 4), 4: ("only me", 7)}


def test_equals_the_sql_on_small_documents(spark, make_docs, write_table, tmp_path):
    import duckdb

    con = duckdb.connect()
    for seed in (1, 2):
        docs = [(i, t) for i, t in cases(seed) if i < 62]
        path = write_table(make_docs(docs))
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        df = d.op10_line_dedup(spark, path)
        cols = sorted(df.columns)
        assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, con.execute(f"SELECT {', '.join(cols)} FROM ({d.OP10_SQL})").fetchall()))


def test_long_texts_and_clashing_columns(spark):
    body = "\n".join(f"line {i} of a long text that has quite a number of words" for i in range(15_000))  # 0.8 MB
    docs = spark.createDataFrame([(1, body, 5, "a"), (2, "own\n" + body, 6, "b")], "doc_id long, text string, n_lines int, kept string")
    got = {r.doc_id: r for r in d.dedup_lines(docs).collect()}
    assert got[1]._l_removed == 0 and got[2]._l_removed == 15_000 and got[2]._l_kept == "own" and got[2]._l_runs == 1
    assert (got[1].n_lines, got[2].kept) == (5, "b")
