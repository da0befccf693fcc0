"""Words of many texts at once, in numpy over Arrow's UTF-8 buffers. A word is a maximal run of bytes other than ASCII white space."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _M1, _M2 = U(0x9E3779B97F4A7C15 | 1), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = _powers(max(1 << 21, 1 << int(n - 1).bit_length()))
    return a[:n], b[:n]


@dataclass
class Words:
    """data: the bytes of all texts; row, start and end (in data), hash: of each word; first: where each text's words begin, and their number at last."""

    data: np.ndarray
    text_at: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    prefix: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words that stay within a text, and the index of the first word of each."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        h = self.hash[at]
        for j in range(1, n):
            h = h * _M2 + self.hash[at + j]
        return mix(h + U(n)), at

    def starts_with(self, n: int, lower: bool = True) -> np.ndarray:
        """Hashes of the first n bytes of each word, 0 where it is not longer than that."""
        ok = self.end - self.start > n
        h = np.zeros(len(self.start), np.uint64)
        s = self.start[ok]
        h[ok] = mix((self.prefix[s + n] - self.prefix[s]) * powers(len(self.data) + 1)[1][s] + U(n))
        return h


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (and the last ends)."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    buffer = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if buffer is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(texts: pa.Array, alter: np.ndarray | None = None, space: np.ndarray = SPACE) -> Words:
    """alter: what each byte counts as, for example its lower case. space: the bytes that part words."""
    data, at = raw(texts)
    if alter is not None:
        data = alter[data]
    n = len(data)
    word = np.zeros(n + 2, bool)
    np.logical_not(space[data], out=word[1:-1])
    begins = word[1:-1] & ~word[:-2]
    ends = word[1:-1] & ~word[2:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = word[1:-1][cut]
    ends[cut - 1] = word[1:-1][cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    p, inverse = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[:n], out=prefix[1:])
    h = mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(data, at, row, start, end, h, first, prefix)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Every ASCII byte but letters and digits parts words here; bytes of other characters are letters.
NOT_ALNUM = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])


def counted(texts: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    data, at = raw(texts)
    word = np.zeros(len(data) + 1, bool)
    np.logical_not(SPACE[data], out=word[1:])
    begins = word[1:] & ~word[:-1]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = word[1:][cut]
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[at])
