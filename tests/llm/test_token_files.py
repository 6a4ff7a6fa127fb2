import random
import zlib

import numpy as np
import pytest

from weftgraph.llm import token_files as f
from weftgraph.llm import tokens


def whole(texts):
    full = tokens.WordEncoder(tokens.default_path()).full
    return [full.encode(t or "", add_special_tokens=False).ids for t in texts]


def texts():
    rnd = random.Random(2)
    odd = ["it's DON'T 'S 12a_b", "x<|endoftext|>y <|startoftext|>", "İstanbul ŉ ſ ñandú é 日本語 x² \U0001f600", "a\x1cb\x0bc\x85d\xa0e f", "é ́x", "", "  \n", None]
    return odd + [" ".join("".join(rnd.choice("abcdeéñß'.,!") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.choice([3, 40, 4000]))) for _ in range(40)]


def test_ids_equal_the_library():
    t = [x or "" for x in texts()]
    ids, lengths = tokens.WordEncoder(tokens.default_path()).encode(t)
    want = whole(t)
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_round_trip(spark, make_docs, tmp_path):
    t = texts()
    rows = [(100 - i, x) for i, x in enumerate(t)] + [(100, t[0]), (None, "null id")]
    manifest = f.write_tokens(make_docs(rows), f"file://{tmp_path}/tok", tokenizer=tokens.default_path(), frame=512)
    got = sorted(f.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and got[0].doc_id is None
    assert [r.doc_id for r in got[1:]] == sorted(r[0] for r in rows if r[0] is not None)
    by = {r[0]: w + [2] for r, w in zip(rows, whole([r[1] for r in rows]))}
    start = 0
    for r in got:
        ids = np.array(by[r.doc_id], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = max(manifest.collect(), key=lambda m: m.n_ids)
    reader = f.ShardReader(shard.path)
    k = len(reader.doc_ids) // 2
    assert reader.document(k).tolist() == by[reader.doc_ids[k]] or reader.doc_ids[k] == 100
    assert reader.frames_read <= 2 + reader.lengths[k] // 512 + 1  # index, and what the document covers

    path = shard.path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[20] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception):
        list(f.ShardReader(shard.path).checksums())


def test_empty_table(spark, make_docs, write_table):
    assert f.op4_token_files(spark, write_table(make_docs([]))).count() == 0


def test_a_long_text_and_clashing_columns(spark, tmp_path):
    rnd = random.Random(8)
    long = " ".join("".join(rnd.choice("abcdeéñ'") for _ in range(6)) for _ in range(150_000))  # 1 MB
    docs = spark.createDataFrame([(1, "a b", 3, "x"), (2, long, 4, "y")], "doc_id long, text string, start int, path string")
    got = sorted(map(tuple, f.read_tokens(f.write_tokens(docs, f"file://{tmp_path}/tok", tokenizer=tokens.default_path())).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    ids = [np.array(w + [2], "<u4") for w in whole(["a b", long])]
    assert got == [(1, 0, len(ids[0]), zlib.crc32(ids[0].tobytes())), (2, len(ids[0]), len(ids[1]), zlib.crc32(ids[1].tobytes()))]


def test_a_known_word_is_looked_up_once():
    from weftgraph.llm import tokens

    class Counted(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.n += 1
            return super().__getitem__(k)

        def __contains__(self, k):
            self.n += 1
            return super().__contains__(k)

    enc, texts = tokens.WordEncoder(tokens.default_path()), ["one two three one", "", "naïve 中文 one", "two　中文 two"]
    for _ in range(2):
        ids, n = enc.encode(texts)
        want = [enc.full.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    enc.index = Counted(enc.index)
    enc.encode(["one two three one"])
    assert enc.index.n == 4
