"""Vectorised hashing of words and shingles with numpy.

A text's bytes become prefix sums of (byte + 1) * BASE**position modulo 2**64;
the hash of any run of bytes is a difference of two of these, shifted back by
the inverse power, so all words of a text are hashed without a Python loop.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        make = lambda b: np.cumprod(np.concatenate((np.ones(1, _U), np.full(size - 1, b, _U))))
        _powers, _inverses = make(BASE), make(_INVERSE)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words of a text."""
    inside = np.empty(len(buf) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_WHITE[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, lower: bool = True, longest: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word, or of its first ``longest`` bytes; A-Z count as a-z if ``lower``."""
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        return np.empty(0, _U)
    if lower:
        buf = _LOWER[buf]
    starts, ends = spans(buf)
    if longest is not None:
        ends = np.minimum(ends, starts + longest)
    powers, inverses = _tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, _U)
    np.cumsum((buf.astype(_U) + _U(1)) * powers[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts])


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` hashes, in order; of all of them if there are fewer; of none if there are none."""
    n = len(h)
    if not n:
        return h
    k = min(width, n)
    out = np.full(n - k + 1, _U(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1), _U)
    for i in range(k):
        out = mix(out + h[i : n - k + 1 + i])
    return out


def shingle_set(data: bytes, width: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words."""
    return np.unique(windows(word_hashes(data, lower), width))
