"""Word shingles of whole texts as sorted arrays of distinct 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_BLANK[joined]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    at = np.arange(len(joined), dtype=np.int64) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    at[: starts[0]] = 0
    power = np.ones(int(at.max()) + 1, _U)
    power[1:] = _BASE
    power = np.cumprod(power)
    size = np.add.reduceat(inside, starts, dtype=np.int64)
    value = (joined.astype(_U) + _U(1)) * power[at]
    value[~inside] = 0
    words = mix(np.add.reduceat(value, starts) + size.astype(_U) * _U(0xD6E8FEB86659FD93))
    upto = np.searchsorted(starts, ends_of_texts)
    return words, np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles; a text with fewer words has one, of all its words,
    and one without words has none."""
    words, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - n + 1), _U)
    factor = [_U((2 * i + 1) * 0xA0761D6478BD642F & (2**64 - 1)) for i in range(n)]
    for i in range(n):
        rolled += words[i : len(rolled) + i] * factor[i]
    rolled = mix(rolled + _U(n))
    out, start = [], 0
    for c in counts.tolist():
        if c >= n:
            out.append(np.unique(rolled[start : start + c - n + 1]))
        elif c:
            short = (words[start : start + c] * np.array(factor[:c], _U)).sum(dtype=_U)
            out.append(mix(np.array([short], _U) + _U(c)))
        else:
            out.append(np.zeros(0, _U))
        start += c
    return out
