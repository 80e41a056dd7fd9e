"""Hashes of words and shingles of a text, computed on its bytes as arrays.

Words are runs of letters, digits and marks in lower case. Hashes depend on the
text alone, so any worker computes the same ones.
"""

from __future__ import annotations

import re

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(BASE, -1, 1 << 64)
_PIECE = 1 << 20  # bytes hashed at once: bounds memory, whatever the length of a text
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
# Beyond ASCII, what is no letter, digit or mark divides words as a space does.
_DIVIDER = re.compile(r"[^\x00-\x7f\ẁ-ͯ]")


class Powers:
    """Powers of an odd base and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 1 << 14)
            self.up = np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)].cumprod(dtype=np.uint64)
            self.down = np.r_[np.uint64(1), np.full(size - 1, _BACK, np.uint64)].cumprod(dtype=np.uint64)


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit hash over all of them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(x: np.ndarray) -> np.ndarray:
    inside = np.r_[False, _IS_WORD[x], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    POWERS.reach(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(x)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * POWERS.down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word, in order; empty for a null or empty text."""
    if not text:
        return np.zeros(0, np.uint64)
    text = text.lower()
    if not text.isascii() and _DIVIDER.search(text):
        text = _DIVIDER.sub(" ", text)
    raw = text.encode("utf-8", "surrogatepass")
    x = np.frombuffer(raw, np.uint8)
    if len(x) <= _PIECE:
        return _hashes(x)
    parts, at = [], 0
    while at < len(x):
        stop = min(at + _PIECE, len(x))
        while stop < len(x) and _IS_WORD[x[stop]]:  # not inside a word
            stop += 1
        parts.append(_hashes(x[at:stop]))
        at = stop
    return np.concatenate(parts)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash per run of ``size`` words; of all words if there are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    factor = 1
    for i in range(size):
        out += words[i : n - size + 1 + i] * np.uint64(factor)
        factor = factor * BASE & (1 << 64) - 1
    return mix(out)
