"""Byte-level BPE ids of many texts at once: splits found over code point arrays, distinct splits encoded once.

All texts take the same way. They are cut around special strings, then at window ends: a window is cut where a
split begins that nothing behind the window can change, and grows while it is within one split. A split is
encoded as one piece, without the pattern, so that its length does not matter.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import tiktoken

from evalweave.llm.words import Known, span_hashes

#: Fixed value: the split pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points with the property White_Space.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What follows the apostrophe of a contraction.
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
SPECIAL = "<|endoftext|>"
STORE = 400_000
#: Code points looked at together; a longer split is a window of its own.
WINDOW = 1 << 20
#: What a window's end may change: contractions look so far ahead, the last split aside.
AHEAD = 4
#: Splits of more code points are encoded each time instead of being kept.
LONG = 1 << 10
_BLANK, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    out[list(WHITE)] = _BLANK
    return out


def splits(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the splits of texts begin. cp: code points of all texts; off: where each text begins, and the end."""
    n = len(cp)
    kind = _classes()[cp]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    change = edge[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    begin = change.copy()
    blank = kind == _BLANK
    # The last blank of a run that something follows stands alone or, a space, joins what follows.
    last = blank.copy()
    last[:-1] &= ~blank[1:] & ~edge[1:n]
    last[-1] = False
    begin |= last
    joined = np.flatnonzero(last & (cp == 32)) + 1
    begin[joined] = False
    quotes = np.flatnonzero((cp == 39) & begin)
    if len(quotes):
        ends = off[np.searchsorted(off, quotes, "right")]
        padded = np.append(cp, [0, 0, 0])
        for ending in ENDINGS:
            chars, size = [ord(c) for c in ending], len(ending)
            hit = quotes + size < ends
            for j, c in enumerate(chars):
                hit &= padded[quotes + 1 + j] == c
            begin[quotes[hit] + 1] = False
            after = quotes[hit] + 1 + size
            after = after[after < ends[hit]]
            begin[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(begin)


class ByteBPE:
    """Ids as the tokenizer file gives them, special strings inside texts included."""

    def __init__(self, path: str):
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t != SPECIAL}
        self.special = vocab.get(SPECIAL, len(ranks))
        self.own = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: self.special})
        # Where the ids of a known split stand in `flat`, times 2**32, plus how many they are.
        self.known, self.flat, self.used = Known(STORE), np.zeros(1 << 20, np.uint32), 0

    def _keep(self, splits: list[str]) -> np.ndarray:
        found = [self._piece(s) for s in splits]
        sizes = np.array([len(x) for x in found], np.int64)
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.concatenate([np.array(x, np.uint32) for x in found])
        places = (self.used + np.cumsum(sizes) - sizes) << 32 | sizes
        self.used += total
        return places

    def _piece(self, split: str) -> list[int]:
        return self.own._encode_single_piece(split)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, off): the ids of all texts and where each text's begin."""
        out, sizes = [], np.zeros(len(texts), np.int64)
        for parts, of in self._windows(texts):
            ids, at = self._ids(parts)
            out.append(ids)
            np.add.at(sizes, of, np.diff(at))
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _windows(self, texts: list[str]):
        """(parts, text of each part) in order; special strings are parts of their own."""
        parts, of, held = [], [], 0
        for i, text in enumerate(texts):
            between = text.split(SPECIAL)
            for j, t in enumerate(between):
                at, size = 0, WINDOW
                while len(t) - at > size:
                    starts = splits(_points(t[at : at + size]), np.array([0, size]))
                    starts = starts[(starts > 0) & (starts <= size - AHEAD)]
                    # The last split that begins before the end may go on behind it.
                    if len(starts) < 2:
                        size *= 2
                        continue
                    yield [*parts, t[at : at + int(starts[-2])]], np.array([*of, i])
                    parts, of, held = [], [], 0
                    at, size = at + int(starts[-2]), WINDOW
                parts.append(t[at:])
                of.append(i)
                if j + 1 < len(between):
                    parts.append(SPECIAL)
                    of.append(i)
                held += len(parts[-1])
                if held > WINDOW:
                    yield parts, np.array(of)
                    parts, of, held = [], [], 0
        if parts:
            yield parts, np.array(of)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        cp = _points(whole)
        starts = splits(cp, off)
        special = np.array([i for i, t in enumerate(texts) if t == SPECIAL], np.int64)
        if len(special):
            inside = np.searchsorted(off[special], starts, "right") - 1
            starts = starts[(inside < 0) | (starts == off[special][inside]) | (starts >= off[special + 1][inside])]
        ends = np.append(starts[1:], len(cp))
        keys = span_hashes(cp, starts, ends)
        distinct, example, place = np.unique(keys, return_index=True, return_inverse=True)
        if not len(self.known.keys):  # at the start, or when the store has started anew
            self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        a, b = starts[example], ends[example]
        kept = b - a <= LONG
        where = np.zeros(len(distinct), np.int64)
        where[kept] = self.known.look_up(distinct[kept], lambda new: self._keep([whole[i:j] for i, j in zip(a[kept][new].tolist(), b[kept][new].tolist(), strict=True)]))
        alone = [np.array(self._piece(whole[i:j]), np.uint32) for i, j in zip(a[~kept].tolist(), b[~kept].tolist(), strict=True)]
        flat = np.concatenate([self.flat[: self.used], *alone]) if alone else self.flat
        lengths = np.array([len(x) for x in alone], np.int64)
        where[~kept] = (self.used + np.cumsum(lengths) - lengths) << 32 | lengths
        if len(special):
            at = np.searchsorted(starts, off[special])
            flat, where, place = np.append(flat, np.uint32(self.special)), np.append(where, len(flat) << 32 | 1), place.copy()
            place[at] = len(where) - 1
        size = (where & ((1 << 32) - 1))[place]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat((where >> 32)[place] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, off)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _byte_of() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBPE:
    return ByteBPE(path)
