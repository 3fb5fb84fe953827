"""Words, lines and shingles of many texts at once, as flat numpy arrays over their UTF-8 bytes.

Space is [\\x20\\x09-\\x0D], all of it ASCII, so bytes can be scanned without decoding. Hashes are 64-bit:
a polynomial over the bytes with a random value for each byte, read off prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C55)
BASE_INVERSE = _U(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that begin a code point.
HEAD = np.ones(256, bool)
HEAD[0x80:0xC0] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, BASE if which == "up" else BASE_INVERSE, np.uint64)
        have[0] = 1
        have = _powers[which] = np.multiply.accumulate(have)
    return have[:n]


class Scan:
    """Texts given as their bytes, one after the other, and the offsets where each begins."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.flat = LOWER[flat] if lower else flat
        self.offsets = offsets
        self.n = len(offsets) - 1
        self.solid = ~SPACE[self.flat]
        self._prefix: np.ndarray | None = None
        size = len(self.flat)
        begins, ends = self.solid.copy(), self.solid.copy()
        if size:
            begins[1:] &= ~self.solid[:-1]
            ends[:-1] &= ~self.solid[1:]
            inner = offsets[(offsets > 0) & (offsets < size)]
            begins[inner] = self.solid[inner]
            ends[inner - 1] = self.solid[inner - 1]
        self.word_start, self.word_end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: Of each text, where its words begin in the arrays of words.
        self.word_offsets = np.searchsorted(self.word_start, offsets)

    def count(self, marked: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        total = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of each range of bytes."""
        if self._prefix is None:
            self._prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[self.flat] * _power("up", len(self.flat)), dtype=np.uint64)))
        at = _power("down", len(self.flat) + 1)[start]
        return mix((self._prefix[end] - self._prefix[start]) * at + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def words(self) -> np.ndarray:
        return self.hashes(self.word_start, self.word_end)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each line; a text without \\n is one line."""
        cut = np.flatnonzero(self.flat == 10)
        of_cut = np.searchsorted(self.offsets, cut, "right") - 1
        of = np.sort(np.concatenate((np.arange(self.n), of_cut)))
        # Within a text its own begin comes before those behind its cuts, and its end after its cuts.
        first = np.searchsorted(of, np.arange(self.n))
        last = np.searchsorted(of, np.arange(self.n), "right") - 1
        start, end = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
        rest = np.ones(len(of), bool)
        rest[first] = False
        start[first], start[rest] = self.offsets[:-1], cut + 1
        rest[:] = True
        rest[last] = False
        end[last], end[rest] = self.offsets[1:], cut
        return start, end, of


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words; run i begins at word i. Runs that cross a text's end are the caller's to leave out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _U(0xE7037ED1A0B428DB)
        out += words[k : k + n]
    return mix(out)


def run_starts(word_offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of size words may begin without leaving their text, and each run's text."""
    runs = np.maximum(0, np.diff(word_offsets) - size + 1)
    of = np.repeat(np.arange(len(runs)), runs)
    first = np.concatenate(([0], np.cumsum(runs)))[:-1]
    return np.arange(len(of)) - np.repeat(first, runs) + np.repeat(word_offsets[:-1], runs), of


def salted(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return mix(hashes + mix(of.astype(np.uint64) + _U(0x8CB92BA72F3D8DD7)))


def repeated(hashes: np.ndarray, keep: str | bool) -> np.ndarray:
    return pd.Series(hashes).duplicated(keep=keep).to_numpy()


def shingles(scan: Scan, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after the other, and the offsets of each text's.

    A text with fewer than size words, but one at least, has its whole sequence as its one shingle.
    """
    words = scan.words()
    starts, of = run_starts(scan.word_offsets, size)
    runs = windows(words, size)[starts] if len(starts) else np.zeros(0, np.uint64)
    counts = np.diff(scan.word_offsets)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        value = counts[short].astype(np.uint64) * _U(0x2545F4914F6CDD1D)
        for k in range(size - 1):
            has = counts[short] > k
            value[has] = value[has] * _U(0xE7037ED1A0B428DB) + words[scan.word_offsets[short[has]] + k]
        runs, of = np.concatenate((runs, mix(value))), np.concatenate((of, short))
    order = np.lexsort((runs, of))
    runs, of = runs[order], of[order]
    new = np.ones(len(runs), bool)
    if len(runs):
        new[1:] = (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])
    runs, of = runs[new], of[new]
    return runs, np.searchsorted(of, np.arange(scan.n + 1))
