import random
import re
from collections import Counter

from weftgraph.llm import quality_rules as q

WORDS = "the of and to in that was he it with as his on be at by".split()


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def texts():
    rnd = random.Random(3)
    out = [None, "", "   \n\t", "a", "a b", "a b c", "a b c a b c", "a b c d a b c", " x   y\x0bz\x1cq", "é *** <b> 😀😀"]
    for k in range(60):
        out.append(" ".join(rnd.choice(WORDS) + rnd.choice(["", "", ".", "***", "\n"]) for _ in range(rnd.choice([5, 60, 300, 3000]))))
    out.append("same line\n" * 500)
    return out


def test_counts_equal_brute_force(spark, make_docs, write_table):
    t = texts()
    rows = [(i, x) for i, x in enumerate(t)] + [(3, "a"), (None, "null id")]
    got = q.op5_quality_rules(spark, write_table(make_docs(rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t[r.doc_id]), t[r.doc_id][:80]
            assert not (r.base_failed and r.kept)


def test_empty_table(spark, make_docs, write_table):
    assert q.op5_quality_rules(spark, write_table(make_docs([]))).count() == 0


def test_em_finds_the_rules_rates():
    rnd = random.Random(1)
    seen = Counter()
    true = [(0.98, 0.9), (0.97, 0.7), (0.95, 0.6), (0.9, 0.5)]
    for _ in range(20000):
        good = rnd.random() < 0.75
        seen[tuple((1 if (rnd.random() < g if good else rnd.random() > b) else -1) if rnd.random() < 0.9 else 0 for g, b in true)] += 1
    prior, rates = q.fit(sorted(seen.items()))
    assert abs(prior - 0.75) < 0.04
    assert all(abs(x - y) < 0.06 for a, b in zip(rates, true) for x, y in zip(a, b))
    assert q.fit([]) == (q.PRIOR, [])


def test_clean_prose_stays_and_junk_goes(spark, make_docs):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    clean = [(i, "\n".join(" ".join(rnd.choices(words, k=20)) for _ in range(8))) for i in range(80)]
    junk = [(100 + i, " ".join(w.upper() + "***" for w in rnd.choices(words, k=150))) for i in range(12)]
    got = {r.doc_id: r.kept for r in q.judge(make_docs(clean + junk)).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(120_000))  # 1 MB
    docs = spark.createDataFrame([(1, long, "x", 7, 0.1, "v"), (2, None, "y", 8, 0.2, "v")], "doc_id long, text string, n_words string, kept int, posterior double, vote_length string")
    got = {r.doc_id: r for r in q.judge(docs).collect()}
    assert got[1].n_words == 120_000 and got[1].n_repeat_words == 0 and got[1].kept and not got[1].base_failed
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept
