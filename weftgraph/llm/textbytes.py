"""Words and their hashes over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_R = pow(0x9E3779B97F4A7C15 | 1, 1, 1 << 64)
_RI = pow(_R, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, _RI)):
            p = np.full(n, U(base), U)
            p[0] = U(1)
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def slices(texts: list[str], most: int = 1 << 20, rows: int = 1 << 30):
    """(first, last) ranges of about ``most`` characters and at most ``rows`` texts."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i + 1 - first >= rows:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Words:
    """Words of a list of texts: ``start``, ``end`` (bytes), ``doc`` (index of the text), ``per_doc`` (count)."""

    def __init__(self, texts: list[str] | list[bytes]):
        data = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
        self.buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
        sizes = np.array([len(d) + 1 for d in data], np.int64)
        self.doc_end = np.cumsum(sizes)
        space = IS_SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.doc_end, self.start, side="right")
        self.per_doc = np.bincount(self.doc, minlength=len(texts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        p, q = _power(len(self.buf) + 1)
        run = np.concatenate([np.zeros(1, U), np.cumsum((self.buf.astype(U) + U(1)) * p[:-1])])
        value = (run[self.end] - run[self.start]) * q[self.start]
        return mix(value + (self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93))
