"""Vectorised word and shingle hashing over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_SPAN = 1 << 16
_POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(_SPAN - 1, _BASE, U)]))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [starts, ends), ascending and without overlap."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    inside = data[place + np.repeat(starts, lens)].astype(U)
    inside += U(1)
    inside *= _POWERS[place & (_SPAN - 1)]
    if lens.max() > _SPAN:  # powers repeat: each further stretch has a factor of its own
        far = np.multiply.accumulate(np.full(int(lens.max()) // _SPAN + 1, U(0xC2B2AE3D27D4EB4F)))
        inside *= far[place // _SPAN]
    return mix(np.add.reduceat(inside, first) ^ (lens.astype(U) << U(48)))


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each text the index of its first word (one more entry than texts).

    lower: A-Z are folded, nothing else.
    """
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, off)


def shingles(w: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, with the index of each text's first one.

    A text of 1 to k-1 words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    out = np.zeros(int(begin[-1]), U)
    if not len(out):
        return out, begin
    m = len(w) - k + 1
    if m > 0:
        total = np.full(m, U(k), U)
        for j in range(k):
            total = mix(total * U(0x9FB21C651E98DF25) + w[j : j + m])
        text = np.repeat(np.arange(len(counts)), n)
        at = np.arange(len(out)) - begin[text] + first[text]
        long = (counts >= k)[text]
        out[long] = total[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        x = np.full(1, U(int(counts[i])), U)
        for h in w[first[i] : first[i + 1]]:
            x = mix(x * U(0x9FB21C651E98DF25) + h)
        out[begin[i]] = x[0]
    return out, begin


class Known:
    """Values of span hashes seen before, as sorted arrays; it starts anew at `most` entries.

    missing(indexes) gives the value of each hash that is not known yet, as an array of numbers.
    """

    def __init__(self, most: int):
        self.most, self.keys, self.values = most, np.zeros(0, U), np.zeros(0, np.int64)

    def look_up(self, keys: np.ndarray, missing) -> np.ndarray:
        """keys: ascending, distinct."""
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        out = np.zeros(len(keys), np.int64)
        out[hit] = self.values[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            out[new] = missing(new)
            self.keys, self.values = np.insert(self.keys, at[new], keys[new]), np.insert(self.values, at[new], out[new])
            if len(self.keys) > self.most:
                self.clear()
        return out

    def clear(self) -> None:
        self.keys, self.values = np.zeros(0, U), np.zeros(0, np.int64)
