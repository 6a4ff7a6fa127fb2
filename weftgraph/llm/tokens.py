"""Token ids by a public tokenizer file, fast enough for a whole corpus.

The ids are exactly those the ``tokenizers`` library gives for the whole text.  A word-level BPE gives equal words equal ids,
so each distinct word is encoded once per worker and looked up afterwards.  Texts whose characters all belong to a plain
set (ASCII and composed Latin letters) are split into the tokenizer's own words here; any other text, or one with a special token's
string, is cut at ASCII white space only and each piece goes through the full tokenizer with its own normalizer.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib

import numpy as np

LATIN = "".join(chr(c) for c in range(0xC0, 0x180) if chr(c) not in "×÷İıŉſĸ")
PLAIN = re.compile(rf"[\n\r\t -~{LATIN}]*")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+")
CUT = re.compile(r"[ \t\n\r]+")
#: The cache starts anew beyond so many distinct words: a worker's memory stays bounded.
MOST = 600_000


class WordEncoder:
    """``encode(texts) -> (ids as one uint32 array, number of ids of each text)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"] if spec["pre_tokenizer"]["type"] == "Sequence" else []
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        ends = spec["model"].get("end_of_word_suffix")
        #: Only a word-end BPE with this normalizer and split may be taken apart; others run whole texts.
        self.known = bool(ends) and normal == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        if self.known:
            spec["normalizer"] = None
            spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}
            spec["added_tokens"] = []
            self.bare = Tokenizer.from_str(json.dumps(spec))
            vocab = self.bare.get_vocab()
            self.is_end = np.zeros(max(vocab.values()) + 1, bool)
            self.is_end[[i for t, i in vocab.items() if t.endswith(ends)]] = True
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _add(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        n, k = len(self.index), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        while n + k > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[n : n + k] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + k] = lengths
        self.used += len(ids)
        self.index.update(zip(words, range(n, n + k)))

    def _learn(self, words: set[str], plain: bool) -> None:
        todo = sorted(words)
        for at in range(0, len(todo), 512):
            part = todo[at : at + 512]
            if plain:
                names = part
                ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)  # without offsets
                ends = np.flatnonzero(self.is_end[ids]) + 1
                if len(ends) != len(part):
                    raise ValueError("the tokenizer split a plain word")
                lengths = np.diff(ends, prepend=0)
            else:
                names = ["\n" + w for w in part]  # apart from plain words
                found = [e.ids for e in self.full.encode_batch(part, add_special_tokens=False)]
                lengths = np.array([len(x) for x in found], np.int64)
                ids = np.array(list(itertools.chain.from_iterable(found)), np.uint32)
            self._add(names, lengths, ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.known:
            found = [self.full.encode(t, add_special_tokens=False).ids for t in texts]
            return np.array(list(itertools.chain.from_iterable(found)), np.uint32), np.array([len(x) for x in found], np.int64)
        if len(self.index) > MOST:
            self._reset()
        found: list[int] = []  # each word's place; -1: not known yet
        new: dict[int, str] = {}
        counts = np.empty(len(texts), np.int64)
        for k, t in enumerate(texts):
            if PLAIN.fullmatch(t) and not any(s in t for s in self.specials):
                own = WORDS.findall(t.lower())
            else:
                own = ["\n" + w for w in CUT.split(t) if w]
            counts[k] = len(own)
            places = [self.index.get(w, -1) for w in own]
            if -1 in places:
                new.update((len(found) + i, own[i]) for i, p in enumerate(places) if p < 0)
            found += places
        words = set(new.values())
        self._learn({w for w in words if w[0] != "\n"}, True)
        self._learn({w[1:] for w in words if w[0] == "\n"}, False)
        at = np.array(found, np.int64)
        at[np.fromiter(new, np.int64, len(new))] = np.fromiter(map(self.index.__getitem__, new.values()), np.int64, len(new))
        lengths = self.length[at]
        before = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        ids = self.ids[np.repeat(self.start[at] - before, lengths) + np.arange(total)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[ends[1:]] - upto[ends[:-1]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of this file; it lives as long as the worker, so its cache serves all tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(texts, most: int = 1 << 20):
    """(first, last) ranges of ``texts`` of about ``most`` characters, so that long texts don't pile up."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
