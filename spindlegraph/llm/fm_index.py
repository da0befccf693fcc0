"""A compressed FM-index in numpy: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix of packed bits, and matching statistics by backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with rank; 1.5 bits of memory a bit."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Wavelet:
    """rank(c, i): how often c is among the first i symbols; one level for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.depth = max(1, int(kinds - 1).bit_length())
        self.levels, self.zeros = [], []
        s = symbols
        for b in range(self.depth - 1, -1, -1):
            bit = (s >> b) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.bottom = self._down(np.arange(kinds), np.zeros(kinds, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, zeros, b in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1)):
            ones = level.rank(i)
            i = np.where((c >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.bottom[c]


def suffixes(ids: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and the longest common prefix of each suffix with the one before it (0 at the ends); ids differ within longest symbols of any two places."""
    n = len(ids)
    pad = lambda x: np.concatenate([x.astype(np.int32), np.zeros(longest * 2 + 8, np.int32)])
    first, top = ids + 1, int(ids.max(initial=0)) + 1
    levels, h = [(1, pad(first))], 1
    while True:
        r = levels[-1][1]
        key = r[:n].astype(np.int64) * (n + top + 2) + r[h : n + h]
        order = np.argsort(key)
        k = key[order]
        new = np.concatenate([[1], (k[1:] != k[:-1])]).astype(np.int64).cumsum()
        rank = np.empty(n, np.int32)
        rank[order] = new
        h *= 2
        levels.append((h, pad(rank)))
        if new[-1] == n or h > longest:
            break
    lcp = np.zeros(n + 1, np.int32)
    i, j = order[:-1], order[1:]
    got = np.zeros(n - 1, np.int32)
    for width, r in reversed(levels[:-1]):
        same = r[i + got] == r[j + got]
        got[same] += width
    # a width may fit twice at the top level only where suffixes are longer than longest; ids forbid that
    lcp[1:n] = got
    return order, lcp


class Index:
    """Of distinct segments (symbol arrays, 1 and up), with the smallest document that has each and whether others have it too."""

    def __init__(self, segments: list[np.ndarray], document: np.ndarray, many: np.ndarray, window: int):
        length = np.array([len(s) for s in segments])
        m, longest = len(segments), int(length.max())
        text = np.concatenate([x for s in segments for x in (s, np.zeros(1, s.dtype))]).astype(np.int64)
        ends = np.cumsum(length + 1) - 1
        unique = text + m - 1
        unique[ends] = np.arange(m)
        order, self.lcp = suffixes(unique, longest)
        n = self.n = len(text)
        kinds = int(text.max()) + 1
        self.wavelet = Wavelet(text[order - 1], kinds)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=kinds))[:-1]])
        owner = np.repeat(document, length + 1)[order]
        # up to where the suffixes from each on belong to one document
        change = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        shared = np.flatnonzero(np.repeat(many, length + 1)[order])
        self.next_owner = np.minimum(np.append(change, n + 1)[np.searchsorted(change, np.arange(n), side="right")], np.append(shared, n + 1)[np.searchsorted(shared, np.arange(n))]).astype(np.int32)
        # the suffixes that share their first `window` symbols, and the smallest document among them
        new = np.concatenate([[True], self.lcp[1:n] < window])
        self.of, at = np.cumsum(new, dtype=np.int32) - 1, np.flatnonzero(new)
        self.low, self.high, self.least = at, np.append(at[1:], n), np.minimum.reduceat(owner, at)
        self.window, self.segments, self.document, self.length = window, segments, document, length
        self.tables = [np.minimum(self.lcp[:n], 32_000).astype(np.uint8 if longest < 255 else np.int16)]
        while 1 << len(self.tables) <= n:
            t, step = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(t[:-step], t[step:]))

    def wider(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest interval around [lo, hi) of suffixes that share `least` symbols."""
        lo, hi = lo.copy(), hi.copy()
        for level in range(len(self.tables) - 1, -1, -1):
            step, t = 1 << level, self.tables[level]
            ok = lo - step >= 0
            ok[ok] = t[lo[ok] - step + 1] >= least[ok]
            lo[ok] -= step
            ok = hi + step <= self.n
            ok[ok] = t[hi[ok]] >= least[ok]
            hi[ok] += step
        return lo, hi

    def repeats(self, must: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each segment, all places whose next `window` symbols occur in another document as well: segment, place, and the smallest document that has them.

        Each segment is streamed from its end against the index. A state is the longest match that starts at the present
        place and occurs in another document; where a symbol can't be put before it, it gives up its tail, to the next
        shorter match with more occurrences (the parent interval). Matches that leave out symbols must[0] to must[1] of
        their segment once these are passed are of no use, nor are those that can't reach the window any more."""
        flat = np.concatenate(self.segments)
        base = np.cumsum(self.length) - self.length
        live = np.arange(len(self.segments))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        size, begin = np.zeros(len(live), np.int64), self.length.copy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            # each state takes one step, to the left or to a shorter match
            c = flat[base[live] + begin - 1]
            r = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.tile(self.before[c], 2)
            a, b = r[: len(live)], r[len(live) :]
            ok = b > a
            ok[ok] = self.next_owner[a[ok]] < b[ok]
            short = np.flatnonzero(~ok & (size > 0))
            begin = begin - (ok | (size == 0))
            lo, hi, size = np.where(ok, a, lo), np.where(ok, b, hi), size + ok
            up = np.maximum(self.lcp[lo[short]], self.lcp[hi[short]])
            # a match that can't reach the window with what is left to its left, or not past its must, needn't be widened
            worth = (up + begin[short] >= self.window) & ((begin[short] > must[0][live[short]]) | (begin[short] + up >= must[1][live[short]]))
            size[short] = np.where(worth, up, -1)
            short, up = short[worth], up[worth]
            lo[short], hi[short] = self.wider(lo[short], hi[short], up)
            long = np.flatnonzero(ok & (size >= self.window))
            if len(long):
                k = self.of[lo[long]]
                lo[long], hi[long], size[long] = self.low[k], self.high[k], self.window
                out.append((live[long], begin[long], self.least[k]))
            # the tail of a match never moves right
            keep = (size >= 0) & (begin > 0) & (size + begin >= self.window) & ((begin > must[0][live]) | (begin + size >= must[1][live]))
            live, begin, lo, hi, size = live[keep], begin[keep], lo[keep], hi[keep], size[keep]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, p, e = (np.concatenate(x) for x in zip(*out))
        by = np.lexsort((p, s))
        return s[by], p[by], e[by]
